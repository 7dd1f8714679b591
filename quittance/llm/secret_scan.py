"""Secret scans in DataFrame functions only.

Fixed (base) patterns find assignments to secret names, access key ids and hex runs.
A test battery adds spans: runs of encoding characters that hold a digit or change case
inside get an inferred encoding (hex, base32, base64, base64url, alphanumeric), and three
tests of uniform randomness over its alphabet: chi-squared of the symbol counts,
runs above and below the alphabet's middle, and lag-1 serial correlation. Their z values
give one p-value (Fisher's rule over two-sided or upper tails by normal approximation).

Random strings have uniform p-values; ordinary text piles up near 0. So within each
(encoding, length band), over the whole corpus, the random strings are estimated from
the p-values over one half, and a cutoff t is the smallest of a grid for which the
estimated share of ordinary text among the runs with p >= t is at most `fdr`.
The bands make the control length-aware: where short runs of ordinary text look random, the
cutoff rises, or nothing is flagged. A cell with too few random runs for an estimate has the
fixed cutoff of its band in `STRICT`, without control of the share. The cutoffs (at most
encodings x bands numbers) come to the driver.

Spans are code points, ends exclusive: a pattern's whole match (for assignments with
the name and quotes), not only its secret part. Base spans always stay; a battery
span is added only where it overlaps no base span.

Cases: null and empty texts have no spans; very long runs are tested whole, and the work for a text of n matches is n log n;
of patterns that match at the same place the earlier listed stands first; repeated documents and ids are scanned row by row;
other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise
from .quality import let

#: kind, pattern, least length, group whose length counts (fixed values of the base rules)
BASE_RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]+", 16, 0),
)
KINDS = ("assign", "access", "hex", "random")
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: encoding: condition (pattern of the whole run), alphabet in order; the first that fits
ENCODINGS = (
    ("hex", r"^(?:[0-9A-F]+|[0-9a-f]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", r"^[A-Za-z0-9]+=*$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: first lengths of the bands
BANDS = (20, 24, 32, 48, 64, 128, 512)
#: cutoffs of the bands where no share can be estimated: joined words of up to 31 characters may pass 0.05
STRICT = (0.5, 0.5, 0.05, 0.05, 0.05, 0.05, 0.05)
STEPS = 100
MARK, OTHER = "\x01", "\x02"


def accumulated(values: Column, combine) -> Column:
    """What combine(value, all before) makes of each place of an array, by doubling: n log n steps, no growing copies.

    combine gets null where nothing is before.
    """

    def over(v):
        steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(v))
        return F.aggregate(steps, v, lambda held, d: F.transform(held, lambda x, i: combine(x, F.get(held, i - d))))

    return let(values, over)


def spans_of(text: Column, pattern: str, keep, kind: int) -> Column:
    """array<struct<start, rank, end, run>> of leftmost matches that pass keep(match).

    Matches are set between marks, which the text cannot hold after `MARK` is
    replaced by another character outside all patterns: every second piece is a match, and the running sums of the pieces'
    lengths give the places.
    """

    def placed(x):
        def span(part, i):
            end = F.get(x["ends"], i)
            made = F.struct((end - F.length(part)).alias("start"), F.lit(kind).alias("rank"), end.alias("end"), part.alias("run"))
            return F.struct(((i % 2 == 1) & keep(part)).alias("kept"), made.alias("span"))

        return F.transform(F.filter(F.transform(x["parts"], span), lambda s: s["kept"]), lambda s: s["span"])

    def walk(parts):
        ends = accumulated(F.transform(parts, F.length), lambda n, before: n + F.coalesce(before, F.lit(0)))
        return let(F.struct(parts.alias("parts"), ends.alias("ends")), placed)

    marked = F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}")
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,run:string>>)")
    return F.when(text.rlike(pattern), let(F.split(marked, MARK), walk)).otherwise(none)


def outside(runs: Column, base: Column) -> Column:
    """The runs (in order, apart from each other) that overlap no base span, by one sorted walk over the ends of runs and the starts of spans.

    A run overlaps if a span that starts before the run's end ends behind its start.
    """
    of_base = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("turn"), b["end"].alias("reach"), F.lit(None).cast("int").alias("run")))
    of_runs = F.transform(runs, lambda r, i: F.struct(r["end"].alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("reach"), i.alias("run")))

    def walk(events):
        reach = accumulated(F.transform(events, lambda e: e["reach"]), F.greatest)
        told = let(reach, lambda r: F.transform(events, lambda e, i: F.struct(e["run"].alias("run"), F.get(r, i).alias("reach"))))
        return F.filter(F.transform(F.filter(told, lambda e: e["run"].isNotNull()), lambda e: F.struct(F.get(runs, e["run"]).alias("run"), e["reach"].alias("reach"))), lambda e: e["reach"] <= e["run"]["start"])

    kept = let(F.array_sort(F.concat(of_base, of_runs)), walk)
    return F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(F.transform(kept, lambda e: e["run"]))


#: patterns that find only the matches long enough, where these are whole runs: shorter ones make no pieces
LONG_RUNS = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}


def base_spans(text: Column) -> list[Column]:
    """One array of spans for each of BASE_RULES."""
    out = []
    for k, (kind, pattern, least, group) in enumerate(BASE_RULES):
        keep = (lambda p, n=least, r=pattern: F.length(F.regexp_extract(p, r, 2)) >= n) if group else (lambda p, n=least: F.length(p) >= n)
        out.append(spans_of(text, LONG_RUNS.get(kind, pattern), keep, k))
    return out


def battery(runs: Column) -> Column:
    """Runs with `run` replaced by encoding, length and p (its chance under uniform randomness).

    Each step is a transform of its own, so that what a later step uses twice is computed once.
    """
    place = ("start", "rank", "end")

    def step(rows, made, keep=()):
        """made(r): columns added; keep: earlier ones that go on."""
        return F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in (*place, *keep)], *[x.alias(n) for n, x in made(r).items()]))

    def inferred(r):
        encoding = F.lit(None).cast("string")
        for name, fits, _ in reversed(ENCODINGS):
            encoding = F.when(r["run"].rlike(fits), F.lit(name)).otherwise(encoding)
        return {"encoding": encoding, "body": F.regexp_replace(r["run"], "=+$", "")}

    def spelled(r):
        alphabet = F.lit(None).cast("string")
        for name, _, symbols in ENCODINGS:
            alphabet = F.when(r["encoding"] == name, F.lit(symbols)).otherwise(alphabet)
        return {"alphabet": alphabet, "body": F.when(r["encoding"] == "hex", F.lower(r["body"])).otherwise(r["body"])}

    def numbered(r):
        symbols = F.split(r["body"], "")
        squares = F.transform(F.array_distinct(symbols), lambda c: F.pow(F.length(r["body"]) - F.length(F.replace(r["body"], c)), F.lit(2.0)))
        return {
            "size": F.length(r["alphabet"]).cast("double"),
            "length": F.length(r["body"]),
            "squares": F.aggregate(squares, F.lit(0.0), lambda s, x: s + x),
            "values": F.transform(symbols, lambda c: F.instr(r["alphabet"], c).cast("double") - (F.length(r["alphabet"]) + 1) / 2),
        }

    def counted(r):
        before, after = F.slice(r["values"], F.lit(1), r["length"] - 1), F.slice(r["values"], F.lit(2), r["length"] - 1)
        pairs = F.zip_with(before, after, lambda a, b: F.struct((a * b).alias("product"), ((a > 0) != (b > 0)).cast("double").alias("turn")))
        sums = F.aggregate(
            pairs,
            F.struct(F.lit(0.0).alias("product"), F.lit(1.0).alias("turn")),
            lambda s, p: F.struct((s["product"] + p["product"]).alias("product"), (s["turn"] + p["turn"]).alias("turn")),
        )
        n = r["length"].cast("double")
        free = r["size"] - 1
        return {
            "n": n,
            "free": free,
            "chi": F.greatest(r["squares"] * r["size"] / n - n, F.lit(0.0)) / free,
            "high": F.size(F.filter(r["values"], lambda v: v > 0)).cast("double"),
            "sums": sums,
        }

    def deviates(r):
        n, mean = r["n"], 2 * r["high"] * (r["n"] - r["high"]) / r["n"] + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        variance = (r["size"] * r["size"] - 1) / 12
        part = 2 / (9 * r["free"])
        return {
            # Wilson and Hilferty's cube root turns chi-squared into a normal deviate
            "chi": (F.pow(r["chi"], F.lit(1 / 3)) - (1 - part)) / F.sqrt(part),
            "runs": (r["sums"]["turn"] - mean) / spread,
            "serial": r["sums"]["product"] / (variance * F.sqrt(n - 1)),
        }

    def tails(r):
        a = F.transform(F.array(r["chi"], r["runs"], r["serial"]), lambda z: F.struct(z.alias("z"), (1 / (1 + 0.2316419 * F.abs(z))).alias("t")))

        def upper(x):
            # P(Z > |z|), Abramowitz and Stegun 26.2.17
            t = x["t"]
            poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
            return F.struct(x["z"].alias("z"), (F.exp(-x["z"] * x["z"] / 2) * 0.3989422804014327 * poly).alias("tail"))

        return {"tails": F.transform(a, upper)}

    def combined(r):
        chi = F.element_at(r["tails"], 1)
        ps = [
            F.when(chi["z"] >= 0, chi["tail"]).otherwise(1 - chi["tail"]),
            2 * F.element_at(r["tails"], 2)["tail"],
            2 * F.element_at(r["tails"], 3)["tail"],
        ]
        return {"half": -sum((F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))) for p in ps), F.lit(0.0))}

    def fisher(r):
        # upper tail of chi-squared with six degrees of freedom
        return {"p": F.exp(-r["half"]) * (1 + r["half"] + r["half"] * r["half"] / 2)}

    rows = step(step(runs, inferred), spelled, ("encoding",))
    rows = step(rows, numbered, ("encoding",))
    rows = step(rows, counted, ("encoding", "length", "size"))
    rows = step(rows, deviates, ("encoding", "length"))
    rows = step(step(rows, tails, ("encoding", "length")), combined, ("encoding", "length"))
    return step(rows, fisher, ("encoding", "length"))


def band(length: Column) -> Column:
    return sum(((length >= first).cast("int") for first in BANDS), F.lit(0))


def _mixed(run: Column) -> Column:
    """A digit, or a capital after a small letter: not an ordinary word."""
    return run.rlike("[0-9]") | run.rlike("[a-z][A-Z]")


def cutoffs(tested: DataFrame, fdr: float, least: int) -> dict[tuple[str, int], float]:
    """The p-value from which runs of an (encoding, band) are flagged. tested: encoding, length, p."""
    cells = tested.groupBy("encoding", band(F.col("length")).alias("band"), F.floor(F.least(F.col("p"), F.lit(0.999999)) * STEPS).cast("int").alias("step")).count().collect()
    counts: dict[tuple[str, int], list[int]] = {}
    for c in cells:
        counts.setdefault((c["encoding"], c["band"]), [0] * STEPS)[c["step"]] += c["count"]
    out = {}
    for key, bins in counts.items():
        if key[0] is None:
            continue  # of no encoding
        random = min(sum(bins), 2 * sum(bins[STEPS // 2 :]))
        if random < least:
            out[key] = STRICT[key[1] - 1]
            continue
        for t in range(1, STEPS):
            flagged = sum(bins[t:])
            if flagged and 1 - min(1.0, random * (1 - t / STEPS) / flagged) <= fdr:
                out[key] = t / STEPS
                break
    return out


def _found(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """row, base (spans), runs (tested runs that overlap no base span)."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK, OTHER)
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), text.alias("t"))
    found = found.select("row", *[s.alias(f"b{k}") for k, s in enumerate(base_spans(F.col("t")))], spans_of(F.col("t"), RUN, _mixed, 3).alias("runs"))
    base = F.transform(F.concat("b0", "b1", "b2"), lambda s: s.dropFields("run"))
    free = outside(F.col("runs"), F.col("base"))
    return found.select("row", base.alias("base"), "runs").select("row", "base", battery(free).alias("runs"))


def _learn(found: DataFrame, fdr: float, least: int) -> dict[tuple[str, int], float]:
    return cutoffs(found.select(F.explode("runs").alias("r")).select("r.*").where("p is not null"), fdr, least)


def _flagged(found: DataFrame, chosen: dict[tuple[str, int], float]) -> DataFrame:
    def flagged(r):
        case = F.lit(False)
        for (encoding, b), t in sorted(chosen.items()):
            case = case | ((r["encoding"] == encoding) & (band(r["length"]) == b) & (r["p"] >= t))
        return F.coalesce(case, F.lit(False))

    added = F.transform(F.filter("runs", flagged), lambda r: r.dropFields("encoding", "length", "p"))
    return found.select("row", F.array_sort(F.concat("base", added)).alias("spans")).withColumn(
        "spans", F.transform("spans", lambda s: s.withField("kind", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)))
    )


def learn_cutoffs(docs: DataFrame, fdr: float = 0.1, least: int = 4) -> dict[tuple[str, int], float]:
    return _learn(_found(docs, ()), fdr, least)


def find_spans(docs: DataFrame, chosen: dict[tuple[str, int], float], carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """row (struct of `carry`), spans array<struct<start,rank,end,kind>> in order; no shuffle."""
    return _flagged(_found(docs, carry), chosen)


def scan(docs: DataFrame, carry: Sequence[str] = ("doc_id",), fdr: float = 0.1, least: int = 4) -> DataFrame:
    """learn_cutoffs and find_spans in one reading of the texts, whose spans and runs (with the
    columns `carry`, so leave out the texts) go through the shared folder."""
    found = materialise(_found(docs, carry))
    return _flagged(found, _learn(found, fdr, least))


#: code points of the pieces that texts are cut into: a place is looked for in one of them
CUT = 256


def redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch of overlapping spans (in order) replaced by its first span's kind in brackets."""

    def between(cuts, start, end):
        first, last = F.floor(start / CUT).cast("int"), F.floor(end / CUT).cast("int")
        head = F.coalesce(F.get(cuts, first), F.lit(""))
        apart = F.concat(
            F.substring(head, start - first * CUT + 1, F.lit(CUT)),
            F.array_join(F.slice(cuts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
            F.substring(F.coalesce(F.get(cuts, last), F.lit("")), F.lit(1), end - last * CUT),
        )
        return F.when(first == last, F.substring(head, start - first * CUT + 1, end - start)).otherwise(apart)

    def joined(x):
        before = lambda i: F.coalesce(F.get(x["reach"], i - 1), F.lit(0))
        told = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), before(i).alias("before")))
        pieces = F.transform(F.filter(told, lambda s: s["start"] >= s["before"]), lambda s: F.concat(between(x["cuts"], s["before"], s["start"]), F.lit("["), s["kind"], F.lit("]")))
        return F.array_join(F.concat(pieces, F.array(between(x["cuts"], F.element_at(x["reach"], -1), F.length(text)))), "")

    cuts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    reach = accumulated(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(F.size(spans) > 0, let(F.struct(cuts.alias("cuts"), reach.alias("reach")), joined)).otherwise(text)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
