"""Running and closing balances, and sides repaired from them.

Input rows: rec_id, row_no, id, date, amount, direction, balance (may be null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import prefix
from .matching import flow, signed


def ordered(rows: DataFrame) -> DataFrame:
    """Adds `seq`, the oldest-first place: rows run backwards where the first dated row is later than the last."""
    dated = rows.where("date is not null").groupBy("rec_id").agg(
        (F.min_by("date", "row_no") > F.max_by("date", "row_no")).alias("backwards")
    )
    joined = rows.join(dated, "rec_id", "left")
    return joined.withColumn("seq", F.when(F.coalesce("backwards", F.lit(False)), -F.col("row_no")).otherwise(F.col("row_no"))).drop("backwards")


def running(rows: DataFrame, opening: DataFrame) -> DataFrame:
    """Adds `effect` and `expected`: the balance after each row, counted from the last stated one or the opening.

    opening: rec_id, opening (null to derive it from the first row's balance). A reconciliation's rows are worked on in
    ranges with carried sums, so none is a task of its own.
    """
    effect = signed(F.col("amount"), flow(F.col("direction")))
    key, order = ["rec_id"], ["seq"]
    moved = prefix.sums(prefix.spread(ordered(rows).withColumn("effect", effect), key, order), key, order, {"total": F.col("effect")})
    # the stated balance less all effects up to it: what it says of the start
    stated = F.when(F.col("balance").isNotNull(), F.col("balance") - F.col("total"))
    moved = prefix.done(prefix.before(moved, key, order, {"anchor": stated}, known=True))
    first = moved.groupBy("rec_id").agg(F.min_by(F.struct((F.col("balance") - F.col("effect")).alias("derived")), "seq").alias("first"))
    joined = moved.join(first, "rec_id", "left").join(opening, "rec_id", "left")
    start = F.coalesce("opening", "first.derived")
    expected = F.coalesce("anchor", start) + F.col("total")
    return joined.withColumn("start", start).withColumn("expected", expected.cast("decimal(38,3)")).drop("anchor", "first", "opening")


def breaks(run: DataFrame) -> DataFrame:
    """Rows whose stated balance is not the expected one."""
    return run.where("balance is not null and expected is not null and balance != expected").select(
        "rec_id", "row_no", "id", "date", "expected", "balance", (F.col("balance") - F.col("expected")).cast("decimal(38,3)").alias("difference")
    )


def _status(difference: Column) -> Column:
    return F.when(difference.isNull(), "unverifiable").when(difference == 0, "passed").otherwise("failed")


def summary(run: DataFrame, closing: DataFrame) -> DataFrame:
    """Per reconciliation: opening, closing, calculated closing, status, and the running check. closing: rec_id, closing."""
    grouped = run.groupBy("rec_id").agg(
        F.max("start").alias("opening"),
        F.sum("effect").alias("net"),
        F.max_by("balance", "seq").alias("last_balance"),
        F.count_if(F.col("balance").isNotNull() & F.col("expected").isNotNull()).alias("checked"),
        F.count_if(F.col("balance") != F.col("expected")).alias("breaks"),
    ).join(closing, "rec_id", "left")
    close = F.coalesce("closing", "last_balance")
    calculated = F.col("opening") + F.col("net")
    difference = (close - calculated).cast("decimal(38,3)")
    running_status = F.when(F.col("checked") == 0, "unverifiable").when(F.col("breaks") == 0, "passed").otherwise("failed")
    return grouped.select(
        "rec_id", F.col("opening").cast("decimal(38,3)").alias("opening"), close.cast("decimal(38,3)").alias("closing"), calculated.cast("decimal(38,3)").alias("calculated"),
        difference.alias("difference"), _status(difference).alias("status"), "checked", "breaks", running_status.alias("running_status"),
    )


def repaired(rows: DataFrame, opening: DataFrame) -> DataFrame:
    """Rows with `corrected`: the side the balance's move shows, where nearly all others follow one rule.

    A vote needs the balance to move by exactly the amount from the row before (from the opening for the first).
    """
    told = F.struct("balance")
    moved = prefix.previous(ordered(rows), ["rec_id"], ["seq"], {"before": told}).join(opening, "rec_id", "left")
    before = F.when(F.col("before").isNull(), F.col("opening")).otherwise(F.col("before.balance"))
    delta = F.col("balance") - before
    vote = F.when((delta != 0) & (F.abs(delta) == F.col("amount")), (delta > 0) == (F.col("direction") == "credit"))
    voted = moved.withColumn("vote", vote)
    counts = voted.groupBy("rec_id").agg(F.count_if("vote").alias("yes"), F.count_if(~F.col("vote")).alias("no"))
    major, minor = F.greatest("yes", "no"), F.least("yes", "no")
    rule = counts.select("rec_id", F.when((major >= 5) & (minor > 0) & (minor * 9 <= major), F.col("no") > F.col("yes")).alias("wrong"))
    flipped = F.when(F.col("direction") == "credit", "debit").otherwise("credit")
    return voted.join(rule, "rec_id", "left").select(
        *rows.columns, F.when(F.col("vote") == F.col("wrong"), flipped).otherwise(F.col("direction")).alias("corrected")
    )


def book_to_bank(bank: DataFrame, ledger: DataFrame, unmatched_bank: DataFrame, unmatched_ledger: DataFrame, differences: DataFrame) -> DataFrame:
    """Whether the difference of the closing balances is explained by what is not reconciled.

    bank, ledger: summary() rows; unmatched: rec_id, effect; differences: rec_id, difference of mismatched pairs.
    """
    def total(df, column, name):
        return df.groupBy("rec_id").agg(F.sum(column).alias(name))

    b = bank.select("rec_id", F.col("opening").alias("b_open"), F.col("closing").alias("b_close"))
    l = ledger.select("rec_id", F.col("opening").alias("l_open"), F.col("closing").alias("l_close"))
    joined = b.join(l, "rec_id", "left")
    for df, column, name in ((unmatched_bank, "effect", "ub"), (unmatched_ledger, "effect", "ul"), (differences, "difference", "md")):
        joined = joined.join(total(df, column, name), "rec_id", "left")
    explained = F.coalesce("ub", F.lit(0)) - F.coalesce("ul", F.lit(0)) + F.coalesce("md", F.lit(0))
    unexplained = (F.col("b_close") - F.col("l_close") - (F.col("b_open") - F.col("l_open")) - explained).cast("decimal(38,3)")
    return joined.select("rec_id", explained.cast("decimal(38,3)").alias("explained"), unexplained.alias("unexplained"), _status(unexplained).alias("status"))
