"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. The operator never looks inside it: it
renders the first turns of a conversation, then one turn more, and so on, and compares consecutive outputs. Where
output k leaves output k - 1 the span of turn k begins; where output k + 1 leaves output k it ends. Inside the span
the turn's own text is found by rendering the same turns with a probe, a character that the conversation does
not hold, in its place: what stands before and behind the probe is the template's. So a loss mask covers the texts of the
learned roles alone, without headers and end marks.

A template rewrites history if a longer prefix changes the output up to the end of an earlier text (e.g. one that moves
system turns or drops thoughts of past turns). Such a conversation keeps its whole rendering, gets the number
of the turn that changed it in `rewritten_at`, and no spans and no mask, as no prefix of it is what a model would have
seen. A closing mark that moves along behind the last turn is no rewriting.

Blocks of turns bound the work: a conversation of n turns would take n renderings of up to n turns. Beyond `block_turns`
turns (or the root of n, if that is more), full prefixes are rendered at the ends of blocks only; within one, the block's turns are rendered behind the last
turn before it, and the block counts only if what its turns add makes exactly the next full prefix of the whole;
otherwise it is rendered again by full prefixes. For a template that keeps history the work is n ** 1.5.

`marked` is a template whose control strings are escaped in roles and texts, so that `read_back` gives exactly what went in.

Cases: rows go by turn, then role, then text, nulls first; null texts and roles are empty; repeated rows are turns of
their own; rows without conv_id make one conversation whose id is null; empty texts have empty spans; very long texts are
rendered whole, and a conversation is one row, as the template sees it; columns but conv_id, turn, role, text
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

Turns = Sequence[tuple[str, str]]
SPANS = "array<struct<begin: bigint, end: bigint, text_begin: bigint, text_end: bigint, learned: boolean>>"
FORMATTED = f"conv_id bigint, formatted string, rewritten_at int, spans {SPANS}"
READ = "conv_id bigint, chars bigint, roles array<string>, texts array<string>, learned array<string>"

#: control strings of `marked`
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
_KNOWN = {"system": "System", "user": "User", "assistant": "Assistant"}
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """The text with backslashes doubled, and one inside each `### ` and `</`, so that no control string is left."""
    return text.replace("\\", "\\\\").replace("### ", "##\\# ").replace("</", "<\\/")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def marked(turns: Turns) -> str:
    """`### Role: text</turn>` a turn, ready for `read_marked`. Known roles are capitalised; others stand after a dot."""
    out = []
    for role, text in turns:
        name = _KNOWN.get(role) or "." + escape(role).replace(MIDDLE, ":\\ ")
        out += [HEAD, name, MIDDLE, escape(text), TAIL]
    return "".join(out)


def read_marked(formatted: str) -> list[tuple[str, str]]:
    """The turns that `marked` rendered."""
    out = []
    for piece in formatted.split(TAIL)[:-1]:
        name, _, text = piece[len(HEAD) :].partition(MIDDLE)
        out.append((unescape(name[1:]) if name.startswith(".") else name.lower(), unescape(text)))
    return out


def common_prefix(a: str, b: str) -> int:
    """The length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:  # a[:low] == b[:low], a[:high] != b[:high]
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def common_suffix(a: str, b: str) -> int:
    return common_prefix(a[::-1], b[::-1])


def probe_for(turns: Turns) -> str:
    """The first private-use character that no turn holds."""
    held = {c for role, text in turns for c in role + text if "\ue000" <= c <= "\uf8ff"}
    return next(c for c in map(chr, range(0xE000, 0xF900)) if c not in held)


class Rewritten(Exception):
    """args: the number of the turn that changed earlier output."""


def _walk(turns: Turns, first: int, template: Callable, probe: str, before: str) -> tuple[list[tuple[int, int, int]], str]:
    """For the turns from `first` on: (begin of the span, begin and end of the text) in the output, and the last output.

    before: the rendering of the turns before; their texts end at `floor` at the latest.
    """
    found, floor = [], 0
    for k in range(first, len(turns)):
        now = template(turns[: k + 1])
        probed = template([*turns[:k], (turns[k][0], probe)])
        begin = common_prefix(before, now)
        text_begin = common_prefix(now, probed)
        text_end = max(text_begin, len(now) - common_suffix(now, probed))
        if now == probed:  # the template leaves the text out
            text_begin = text_end = begin
        if begin < floor or text_begin < begin:
            raise Rewritten(k)
        found.append((begin, text_begin, text_end))
        before, floor = now, text_end
    return found, before


def locate(turns: Turns, template: Callable[[Turns], str], block_turns: int = 64) -> tuple[str, int | None, list[tuple[int, int, int, int]]]:
    """(output, None, (begin, end, text_begin, text_end) of each turn), or (output, turn that rewrites history, [])."""
    whole = template(turns)
    probe, n = probe_for(turns), len(turns)
    block_turns = max(block_turns, math.isqrt(n))
    places: list[tuple[int, int, int]] = []
    before, start = "", 0
    try:
        while start < n:
            stop = min(start + block_turns, n)
            part = None
            if start:
                after = whole if stop == n else template(turns[:stop])
                part = _block(turns[start - 1 : stop], template, probe, before, after, places[-1][2])
            if part is None:  # from the start of the conversation
                part, after = _walk(turns[:stop], start, template, probe, before)
                if places and part[0][0] < places[-1][2]:
                    raise Rewritten(start)
            places += part
            before, start = after, stop
    except Rewritten as e:
        return whole, e.args[0], []
    ends = [p[0] for p in places[1:]] + [len(whole)]
    return whole, None, [(a, z, x, y) for (a, x, y), z in zip(places, ends)]


def _block(turns: Turns, template: Callable, probe: str, before: str, after: str, floor: int) -> list[tuple[int, int, int]] | None:
    """The places of turns[1:], rendered behind turns[0] alone; None unless they make the full output `after` out of `before`."""
    head = template(turns[:1])
    try:
        found, last = _walk(turns, 1, template, probe, head)
    except Rewritten:
        return None
    shift = len(after) - len(last)
    begin = found[0][0]
    if begin + shift < floor or after[: begin + shift] != before[: begin + shift] or after[begin + shift :] != last[begin:]:
        return None
    return [(a + shift, x + shift, y + shift) for a, x, y in found]


def _mapped(df: DataFrame, ddl: str, one: Callable, most_bytes: int = 32 << 20) -> DataFrame:
    """A row of `ddl` for each row of df, by a function of its values; batches of bounded size."""
    kind = _parse_datatype_string(ddl)

    def run(batches):
        schema = to_arrow_type(kind)
        fields = [schema.field(i) for i in range(schema.num_fields)]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], names=[f.name for f in fields])

        for batch in batches:
            rows, held = [], 0
            for i in range(len(batch)):
                rows.append(one(*[c[i].as_py() for c in batch.columns]))
                held += sum(len(x) for x in rows[-1] if isinstance(x, str))
                if held > most_bytes or len(rows) == 1024:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return df.mapInArrow(run, kind)


def format_conversations(rows: DataFrame, template: Callable[[Turns], str] = marked, learn: Sequence[str] = ("assistant",), block_turns: int = 64) -> DataFrame:
    """A row (FORMATTED) per conversation; `learned` spans have the texts that the loss is taken over. Offsets are code points."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    learned = frozenset(learn)

    def one(conv_id, found):
        held = [(t["role"] or "", t["text"] or "") for t in found]
        text, rewritten, spans = locate(held, template, block_turns)
        return conv_id, text, rewritten, [(a, z, x, y, role in learned) for (a, z, x, y), (role, _) in zip(spans, held)]

    return _mapped(turns, FORMATTED, one)


def read_back(formatted: DataFrame, parse: Callable[[str], list[tuple[str, str]]] = read_marked, plain: Callable[[str], str] = unescape) -> DataFrame:
    """The turns that the formatted texts hold, and what stands under their loss masks, unescaped: rows of READ."""

    def one(conv_id, text, spans):
        turns = parse(text)
        under = [plain(text[s["text_begin"] : s["text_end"]]) for s in spans if s["learned"]]
        return conv_id, len(text), [r for r, _ in turns], [t for _, t in turns], under

    return _mapped(formatted.select("conv_id", "formatted", "spans"), READ, one)
