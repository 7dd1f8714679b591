"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Fixed (base) rules reject texts of fewer than ten words and texts of which over 20 %
of the words stand in repeated 5-word windows. Further rules compare a score
(shares of symbols, capitals, shouts, list bars, repeated lines) with a cutoff. Cutoffs are
learned per stratum (language) from labelled documents: for each cutoff of
a fixed grid, lenient to strict, the false rejections k among the n good labelled
documents give the exact binomial p-value P(Bin(n, risk) <= k) of "this
cutoff rejects more than `risk` of the good documents". Cutoffs are tested in that fixed
order up to the first that fails (fixed-sequence testing).

Two families are tested in each stratum, each with half of its share of delta. In the first every rule has
its own sequence, at level delta / (2 x strata x rules) and risk total_risk / rules, so that all of them
together keep to total_risk. The second ("joint") tightens all rules in step, each down to its entry in `FLOORS`, as one
sequence, at level delta / (2 x strata) and the whole total_risk; it certifies on a fifth of the labels. Of the certified cutoffs of a
sequence the one that best separates the labels is used, and of the families the one with the greater gain. With
probability 1 - delta no family that is certified anywhere rejects more than total_risk of the good documents.

Strata: all languages that have labels, and one of all labelled documents together ("pooled"), which counts as a stratum
in the levels. Documents of a language for which nothing is certified meet the pooled cutoffs, whose guarantee
holds over all labelled languages together.

Cases: null and empty texts have no words and are rejected by the base rules; null
languages count as the stratum of the empty name; repeated documents are judged row by row, repeated labels of an
id count once (quality 0 wins), and of documents of one labelled id each counts; without labels no cutoff is
certified and base rules act alone; very long texts are read whole; ties of gain go to the more lenient cutoff;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, spread_join

SPACES = r"[ \t\n\x0B\f\r]+"
#: lenient to strict; a text is rejected where its score exceeds the cutoff
GRID = (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.16, 0.13, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)
RULES = ("symbols", "capitals", "shouts", "bars", "dup_lines")
#: least cutoffs of the joint sequence, well over what ordinary texts show
FLOORS = {"symbols": 0.1, "capitals": 0.4, "shouts": 0.1, "bars": 0.1, "dup_lines": 0.4}
JOINT = "joint"
#: strata whose cutoffs are broadcast at most
FEW = 10_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5


def let(value: Column, body) -> Column:
    """body(value) with value computed once: lambda variables are not inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, n: Column, hashes: Column) -> Column:
    """Words in windows found twice or more. hashes: those of all windows, which rule out most texts."""

    def spread(keyed):
        # neighbours of equal windows in sorted order are the repeated ones
        m = F.size(keyed)
        pairs = F.zip_with(
            F.slice(keyed, F.lit(1), m - 1),
            F.slice(keyed, F.lit(2), m - 1),
            lambda a, b: F.when(a["key"] == b["key"], F.array(a["at"], b["at"])).otherwise(F.slice(F.array(a["at"]), 1, 0)),
        )
        return F.array_sort(F.array_distinct(F.flatten(pairs)))

    def covered(places):
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda s, at: F.struct((s["n"] + F.least(F.lit(WINDOW), at - s["last"])).alias("n"), at.alias("last"))
        return F.aggregate(places, start, step, lambda s: s["n"])

    keyed = F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)),
        lambda at: F.struct(F.array_join(F.slice(words, at, F.lit(WINDOW)), " ").alias("key"), at.alias("at")),
    )
    exact = let(F.array_sort(keyed), lambda k: let(spread(k), covered))
    return F.when((n <= WINDOW) | (F.size(F.array_distinct(hashes)) == F.size(hashes)), F.lit(0)).otherwise(exact)


def features(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """row (struct of `carry`), the columns BASE (long), n_lines and a score column for each of RULES."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]"))
    cut = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), text.alias("t"))
    cut = cut.select("row", "t", F.array_remove(F.split("t", SPACES), "").alias("w"), lines.alias("lines"))
    n = F.size("w")
    hashed = F.transform("w", lambda w: F.xxhash64(w))
    cut = cut.withColumn("h", hashed).withColumn(
        "windows",
        F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))),
                lambda i: F.xxhash64(*[F.try_element_at("h", i + k) for k in range(WINDOW)]),
            )
        ),
    )
    chars = F.length(F.array_join("w", ""))
    counted = cut.select(
        "row",
        n.cast("bigint").alias("n_words"),
        chars.cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("w"), n, F.col("windows")).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
        F.regexp_count("t", F.lit(r"[!?]{2,}")).cast("bigint").alias("n_shouts"),
        F.regexp_count("t", F.lit(r"(?:^|[ \n])[|](?=[ \n]|$)")).cast("bigint").alias("n_bars"),
    )

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return counted.select(
        "row",
        *BASE,
        share("n_symbols", "word_chars").alias("symbols"),
        share("n_capitals", "word_chars").alias("capitals"),
        share("n_shouts", "n_words").alias("shouts"),
        share("n_bars", "n_words").alias("bars"),
        share("n_dup_lines", "n_lines").alias("dup_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """ln(Gamma(x)) for x >= 1, by Stirling's series eight places up."""
    shift = sum((F.log(x + k) for k in range(1, 8)), F.log(x))
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), from the term at k downwards; 1 where k is at or over the mean."""
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    terms = F.least(k, F.ceil(60 + 12 * F.sqrt(n * p))).cast("bigint")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s, i):
        at = k - i + 1  # the ratio of the terms at - 1 and at
        term = s["term"] * at * (1 - p) / ((n - at + 1) * p)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    tail = F.when(terms > 0, F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(terms, F.lit(1).cast("bigint"))), start, step, lambda s: s["sum"]))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * F.coalesce(tail, F.lit(1.0)))


def joint_grid(rule: str) -> list[float]:
    return [max(c, FLOORS[rule]) for c in GRID]


def certify(scored: DataFrame, labels: DataFrame, total_risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The cutoffs of each stratum that has any: stratum (null: pooled), family, a column for each of RULES (null: no cutoff).

    scored: doc_id, stratum and a column for each of RULES.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # cutoffs exceeded; grids fall, so these are their last ones. The joint sequence rejects where any rule does
    passed = lambda rule, grid: sum((F.col(rule) > c).cast("int") for c in grid)
    exceeded = [F.struct(F.lit(r).alias("rule"), passed(r, GRID).alias("exceeded")) for r in RULES]
    exceeded.append(F.struct(F.lit(JOINT).alias("rule"), F.greatest(*[passed(r, joint_grid(r)) for r in RULES]).alias("exceeded")))
    stacked = scored.join(marked, "doc_id").select("stratum", "quality", F.explode(F.array(*exceeded)).alias("x"))
    # aggregated once: what follows reads it twice
    own = materialise(stacked.groupBy("stratum", "x.rule", "x.exceeded").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad")))
    pooled = own.groupBy("rule", "exceeded").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).withColumn("stratum", F.lit(None).cast("string"))
    tested = own.unionByName(pooled).groupBy("stratum", "rule").agg(
        F.sum("good").alias("n"), F.sum("bad").alias("n_bad"), F.collect_list(F.struct("exceeded", "good", "bad")).alias("bins")
    )
    tested = materialise(tested)  # a few numbers per stratum
    over = lambda part, g: F.aggregate(
        F.filter("bins", lambda b: b["exceeded"] >= len(GRID) - g), F.lit(0).cast("bigint"), lambda s, b: s + b[part]
    )
    joint = F.col("rule") == JOINT
    strata = tested.where(joint).count()
    tested = tested.withColumn("level", F.lit(delta / 2) / (F.lit(float(strata)) * F.when(joint, 1).otherwise(len(RULES))))
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("g")
    tested = tested.select("stratum", "rule", "n", "n_bad", "bins", "level", steps).withColumns({"k": over("good", F.col("g")), "caught": over("bad", F.col("g"))})
    p = F.when(joint, binomial_cdf(F.col("k"), F.col("n"), total_risk)).otherwise(binomial_cdf(F.col("k"), F.col("n"), total_risk / len(RULES)))
    gain = F.when(F.col("n") > 0, F.col("caught") / F.greatest(F.col("n_bad"), F.lit(1)) - 10 * F.col("k") / F.col("n")).otherwise(0.0)
    step = F.struct("g", (p <= F.col("level")).alias("ok"), gain.alias("gain"))
    walked = tested.groupBy("stratum", "rule").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    stop = F.coalesce(F.array_min(F.transform(F.filter("steps", lambda x: ~x["ok"]), lambda x: x["g"])), F.lit(len(GRID)))
    good = F.filter("steps", lambda x: (x["g"] < F.col("stop")) & (x["gain"] > 0))
    best = F.array_max(F.transform(good, lambda x: F.struct(x["gain"].alias("gain"), (-x["g"]).alias("back"))))
    chosen = walked.withColumn("stop", stop).select("stratum", "rule", best.alias("best")).where("best is not null")
    per = chosen.groupBy("stratum").agg(
        F.sum(F.when(~joint, F.col("best.gain"))).alias("apart"), F.max(F.when(joint, F.col("best.gain"))).alias("together"),
        *[F.max(F.when(F.col("rule") == r, -F.col("best.back"))).alias(r) for r in (*RULES, JOINT)],
    )
    # rounded: the order of the sum is open
    use = F.round(F.coalesce("together", F.lit(0.0)), 9) > F.round(F.coalesce("apart", F.lit(0.0)), 9)
    at = lambda grid, g: F.element_at(F.array(*map(F.lit, grid)), F.col(g) + 1)
    return per.select(
        "stratum", F.when(use, JOINT).otherwise("apart").alias("family"),
        *[F.when(use, at(joint_grid(r), JOINT)).otherwise(at(GRID, r)).alias(r) for r in RULES],
    )


def _scored(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    inner = list(dict.fromkeys([*carry, "doc_id", "lang"]))
    return features(docs, inner).withColumn("stratum", F.coalesce(F.col("row.lang").cast("string"), F.lit("")))


def _learn(scored: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return materialise(certify(scored.select(F.col("row.doc_id").alias("doc_id"), "stratum", *RULES), labels, **options))


def _with_cutoffs(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """scored with `cut`: the cutoffs of its stratum, else null."""
    own = cutoffs.where("stratum is not null").select("stratum", F.struct(*RULES).alias("cut"))
    if cutoffs.count() <= FEW:
        return scored.join(F.broadcast(own), "stratum", "left")
    sizes = scored.groupBy("stratum").agg(F.count(F.lit(1)).alias("rows"))
    # more languages than can be broadcast: only the largest are, at most 2048
    least = max(1, scored.count() // 2048)
    known = sizes.join(own, "stratum", "left").select("stratum", "rows", "cut")
    return spread_join(scored, "stratum", known, ["cut"], F.col("rows") > least, F.xxhash64("row").cast("string"))


def _apply(scored: DataFrame, cutoffs: DataFrame, carry: Sequence[str]) -> DataFrame:
    row = F.struct(*[F.col("row")[c].alias(c) for c in carry]).alias("row")
    pooled = cutoffs.where("stratum is null").first()
    failing = F.lit(False)
    for rule in RULES:
        rest = F.lit(pooled[rule] if pooled else None).cast("double")
        cutoff = F.when(F.col("cut").isNotNull(), F.col("cut")[rule]).otherwise(rest)
        failing = failing | F.coalesce(F.col(rule) > cutoff, F.lit(False))
    joined = _with_cutoffs(scored, cutoffs).withColumns({"base_failed": base_failed(), "passes": ~failing})
    return joined.select(row, *BASE, *RULES, "stratum", "base_failed", (~F.col("base_failed") & F.col("passes")).alias("kept"))


def learn_cutoffs(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Certified cutoffs, see certify()."""
    return _learn(_scored(docs, ()), labels, **options)


def apply_rules(docs: DataFrame, cutoffs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """row (struct of `carry`), BASE, the scores, stratum, base_failed, kept; no shuffle up to FEW strata."""
    return _apply(_scored(docs, carry), cutoffs, carry)


def judge(docs: DataFrame, labels: DataFrame, carry: Sequence[str] = ("doc_id",), **options) -> DataFrame:
    """learn_cutoffs and apply_rules in one reading of the texts, whose scores (with the
    columns `carry`, so leave out the texts) go through the shared folder."""
    scored = materialise(_scored(docs, carry))
    return _apply(scored, _learn(scored, labels, **options), carry)
