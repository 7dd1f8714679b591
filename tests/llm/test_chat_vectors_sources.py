"""Chat formatting, hard negatives and the source audit against plain loops, with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quittance.llm import chat_format, divergence, hard_negatives

RANDOM = random.Random(3)

# --- 11 --------------------------------------------------------------------------------------

CHATS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", r"\### Assistant: </turn> ok"), (1, 2, "user", ""), (1, 3, "assistant", None), (2, None, "tool: x", "late"), (2, 0, "assistant", "a\n</turn>\n### User: b"),
    (3, 5, "assistant", "one\\"), (3, 5, "assistant", "one\\"), (3, 5, None, "#### ##\\# </</turn>"), (None, 0, "user", "who"), (None, 0, "assistant", " taken "), (4, 0, "USER", "<"), (5, 0, "system", "s"), (5, 1, "user:", "😀 é"),
]


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("x")).withColumn("spans", F.lit(1))


def test_formatting_comes_back(spark):
    rows = chat_format.format_conversations(chats(spark, CHATS)).collect()
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(chats(spark, CHATS))).collect()}
    assert len(rows) == len(back) == 6
    for r in rows:
        # nulls first; of equal turns the smaller role, then text
        own = sorted((t for t in CHATS if t[0] == r["conv_id"]), key=lambda t: ((t[1] is not None, t[1] or 0), (t[2] is not None, t[2] or ""), (t[3] is not None, t[3] or "")))
        want = [(role or "", text or "") for _, _, role, text in own]
        got = back[r["conv_id"]]
        assert list(zip(got["roles"], got["texts"])) == want and got["chars"] == len(r["formatted"])
        assert got["learned"] == [text for role, text in want if role == "assistant"]
        assert r["rewritten_at"] is None and [s["begin"] for s in r["spans"][1:]] == [s["end"] for s in r["spans"][:-1]]
        assert r["spans"][0]["begin"] == 0 and r["spans"][-1]["end"] == len(r["formatted"])
        for s, (role, text) in zip(r["spans"], want):
            assert s["learned"] == (role == "assistant") and chat_format.unescape(r["formatted"][s["text_begin"] : s["text_end"]]) == text
    assert chat_format.format_conversations(chats(spark, [])).collect() == []


def test_escapes_are_reversible():
    parts = ["\\", "#", "### ", "</turn>\n", "<", "/", ": ", "a", " ", "\n", "turn>"]
    for _ in range(3000):
        turns = [("".join(RANDOM.choices(parts, k=RANDOM.randrange(4))), "".join(RANDOM.choices(parts, k=RANDOM.randrange(9)))) for _ in range(3)]
        assert chat_format.read_marked(chat_format.marked(turns)) == turns
        assert not any(c in chat_format.escape(t) for _, t in turns for c in ("### ", "</turn>"))


def templates():
    plain = lambda turns: "<s>" + "".join(f"[{r}]{t}|" for r, t in turns)
    closing = lambda turns: plain(turns) + "<end>"  # noqa: E731  moves along
    trimming = lambda turns: plain([(r, t.strip()) for r, t in turns])
    leaving_out = lambda turns: plain([(r, "" if r == "tool" else t) for r, t in turns])
    forgetting = lambda turns: plain([(r, t if i >= len(turns) - 2 or r != "assistant" else "...") for i, (r, t) in enumerate(turns)])
    gathering = lambda turns: plain(sorted(turns, key=lambda t: t[0] != "system"))
    return plain, closing, trimming, leaving_out, forgetting, gathering


def test_black_boxes():
    plain, closing, trimming, leaving_out, forgetting, gathering = templates()
    turns = [("user", " a "), ("assistant", "b"), ("tool", "t"), ("user", "c"), ("assistant", "d"), ("user", "")]
    for template, shown in ((plain, str), (closing, str), (trimming, str.strip)):
        text, rewritten, spans = chat_format.locate(turns, template)
        assert text == template(turns) and rewritten is None
        assert [text[x:y] for *_, x, y in spans] == [shown(t) for _, t in turns]
        assert "".join(text[a:z] for a, z, *_ in spans) == text
    text, rewritten, spans = chat_format.locate(turns, leaving_out)
    assert rewritten is None and spans[2][2] == spans[2][3] and text[spans[4][2] : spans[4][3]] == "d"
    assert chat_format.locate(turns, forgetting)[1:] == (3, [])  # the first answer goes when the fourth turn comes
    assert chat_format.locate([*turns, ("system", "s")], gathering)[1:] == (6, [])


def test_blocks_change_nothing():
    plain, closing, trimming, _, forgetting, _ = templates()
    numbered = lambda turns: "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns))  # noqa: E731  shows how many turns there were
    turns = [(RANDOM.choice(["user", "assistant"]), " ".join(RANDOM.choices(["x", "yy", "<end>"], k=RANDOM.randrange(5)))) for _ in range(70)]
    for template in (plain, closing, trimming, numbered, forgetting):
        assert chat_format.locate(turns, template, 10) == chat_format.locate(turns, template, 1000)
    long = [("assistant", "w" * 50_000)] * 3 + [("user", "x")] * 3000
    text, rewritten, spans = chat_format.locate(long, chat_format.marked)
    assert rewritten is None and len(spans) == 3003 and text[spans[-1][2] : spans[-1][3]] == "x"


# --- 12 --------------------------------------------------------------------------------------


def brute_negatives(rows, anchor, low=50, high=95, positives=5, negatives=3):
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, q) in enumerate(kept):
        if not anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), j, other) for b, (j, other, v) in enumerate(kept) if b != a)
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            inside = [(t, n) for t, n, other in scored if other != lab and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(inside)]
    return sorted(out)


VECTORS = "vec_id bigint, embedding array<float>, label int, id int, vector string, list int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", 2) for i, v, lab in rows], VECTORS)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 8))
    rows = [(int(i), (centres[i % 6] + r.normal(size=8) * 0.3 * seed).astype(np.float32).tolist(), int(r.integers(3))) for i in range(240)]
    rows += [(1000 + k, rows[4][1], k % 3) for k in range(12)] + [(4, rows[4][1], 2), (4, rows[9][1], 0), (4, rows[4][1], 2)]
    rows += [(None, rows[1][1], 1), (2000, None, 1), (2004, [1.0] * 7 + [None], 1), (2008, [float("nan")] * 8, 1), (2012, [float("inf")] * 8, 1), (2016, [0.5] * 8, None), (2020, [], 1), (2024, [3.0, 1.0], 2), (-4, [1.0] * 8, 0)]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 4 == 0, lists=9, part_rows=7, block_anchors=16)
    want = brute_negatives(rows, lambda i: i % 4 == 0)
    assert len(want) > 100 and sorted(tuple(x) for x in got.collect()) == want
    few = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") == 8, positives=2, negatives=1, low_percent=10, high_percent=70)
    assert sorted(tuple(x) for x in few.collect()) == brute_negatives(rows, lambda i: i == 8, 10, 70, 2, 1)


def test_no_vectors(spark):
    assert hard_negatives.mine(vectors(spark, []), F.lit(True)).collect() == []
    assert hard_negatives.mine(vectors(spark, [(0, [1.0], 1)]), F.lit(True)).collect() == []
    assert hard_negatives.mine(vectors(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]), F.col("vec_id") == 0).collect()[0]["negative_id"] == 2
    with pytest.raises(OverflowError):
        hard_negatives.mine(vectors(spark, [(0, [3e38], 1)]), F.lit(True))


def test_large_components_stay_exact(spark):
    rows = [(k, [float(np.float32(1e6 + 1000 * k)), float(np.float32(RANDOM.uniform(5e5, 4e6)))], k % 2) for k in range(40)]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") < 9)
    assert sorted(tuple(x) for x in got.collect()) == brute_negatives(rows, lambda i: i < 9)


class Held:
    """Lists in memory, counting what is read."""

    def __init__(self, parts):
        self.parts, self.asked = parts, []

    def read(self, number):
        self.asked.append(number)
        yield self.parts[number]


def test_lists_are_skipped_but_ties_are_not():
    near, tie, far = ([[10, 0]] * 3, [5, 6, 7]), ([[10, 0], [10, 1]], [1, 8]), ([[-9, 0]], [2])
    parts = [(np.array(i), np.zeros(len(i), np.int64), np.arange(len(i)), np.array(v, np.float64)) for v, i in (near, tie, far)]
    index = hard_negatives.Index("", np.arange(3), np.array([[10.0, 0], [10, 0.5], [-9, 0]]), np.array([0, 0.5, 0]), np.dtype(np.float64))
    lists, best = Held(parts), [hard_negatives.Best(1, 2)]
    wide = np.iinfo(np.int64)
    hard_negatives.search(index, lists, np.array([[1.0, 0]]), lambda some, of, at: np.ones((len(some), len(of)), bool), best, np.full((1, 1), wide.min), np.full((1, 1), wide.max))
    assert best[0].ids.tolist() == [[1, 5]] and sorted(lists.asked) == [0, 1]  # a tie's smaller id counts; the far list is never read
    lists, best = Held(parts), [hard_negatives.Best(1, 2)]
    hard_negatives.search(index, lists, np.array([[1.0, 0]]), lambda some, of, at: np.ones((len(some), len(of)), bool), best, np.full((1, 1), -20), np.full((1, 1), -1))
    assert best[0].ids[0, 0] == 2 and lists.asked == [2]  # lists above the window are passed over


# --- 13 --------------------------------------------------------------------------------------


def brute_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    seen, uses, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        seen[lang].update(set(words))
        uses[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        terms = [t for t, n in seen[lang].items() if n >= least]
        v = len(terms)

        def shares(found):
            total = sum(found[t] for t in terms)
            return {t: 1 + 1000000000 * (found[t] + 1) // (total + v) for t in terms}

        everyone = Counter()
        for s in sources:
            everyone.update(uses[lang, s])
        q, p = shares(everyone), {s: shares(uses[lang, s]) for s in sources}
        gap = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            parts = {"pair": [(sum(gap(p[s][t], p[o][t]) for t in terms), o) for o in sources if o != s], "term": [(gap(p[s][t], q[t]), t) for t in terms if uses[lang, s][t] and p[s][t] > q[t]]}
            for part, values in parts.items():
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))[: None if part == "pair" else top]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def doc_frame(spark, rows):
    return spark.createDataFrame([(t, lang, s, "x", 1) for t, lang, s in rows], "text string, lang string, source string, term string, n int")


def test_source_audit(spark):
    words = ["Ab", "the", "é", "中文", "x1y", "Zz", "a-b", "İx", "rare"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(RANDOM.choices(words, weights=[1 + (hash_ * 7 + k) % 9 for k in range(len(words))], k=RANDOM.randrange(1, 40))), RANDOM.choice(["en", "de", None]), f"s{hash_}" if hash_ else None) for hash_ in [RANDOM.randrange(6) for _ in range(120)]]
    rows += [(None, "en", "s1"), ("", "fr", "s1"), ("12 34 -- \t\x01", "fr", "s2"), ("only once", "it", "s9"), ("same same", "es", "a"), ("same same", "es", "a"), ("same", "es", "b"), (None, "es", "c"), ("Big " * 50_000, "en", "s2"), (None, None, None)]
    got = sorted(tuple(r) for r in divergence.audit(doc_frame(spark, rows)).collect())
    assert got == brute_audit(rows)
    assert sorted(tuple(r) for r in divergence.audit(doc_frame(spark, rows), top=3, least_docs=1).collect()) == brute_audit(rows, 1, 3)
    assert divergence.audit(doc_frame(spark, [])).collect() == []


def test_term_counts_in_small_pieces(spark):
    rows = [("alpha beta " * 30 + "x" * 100 + " gamma", "en", "a"), ("beta", "en", "b")]
    whole = divergence.term_counts(doc_frame(spark, rows))
    cut = divergence.term_counts(doc_frame(spark, rows), most_entries=1, piece_bytes=7)
    added = lambda df: sorted((r.asDict().items() for r in df.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()), key=str)
    assert [list(x) for x in added(whole)] == [list(x) for x in added(cut)]
    assert list(divergence.pieces(b"", 5)) == [b""] and b"".join(divergence.pieces(b"abcdefghij kl", 4)) == b"abcdefghij kl"
