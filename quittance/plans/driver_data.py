"""Domain tables derived from the TPC-H-like driver tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text

#: descriptions given to derived bank rows, by order key (invented)
PHRASES = (
    "Netflix monthly plan", "Salary for the month", "Zomato dinner order", "Uber trip to airport", "Amazon order of books",
    "Walmart supermarket basket", "Electricity bill payment", "NEFT transfer to savings", "Zerodha mutual fund sip",
    "Spotify family plan", "Consulting invoice paid", "Gym membership fee", "Rent for office",
)
_LIST = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
#: CTEs bank and ledger in SQL
BANK_SQL = f"""bank AS (
  SELECT o_custkey % 50 AS rec_id, o_orderkey + 1 AS row_no, 'B' || (o_orderkey + 1) AS id, CAST(o_orderdate AS DATE) AS date,
         CAST(o_totalprice AS DECIMAL(28,3)) AS amount, CASE WHEN o_orderstatus = 'F' THEN 'debit' ELSE 'credit' END AS direction,
         'ORD' || o_orderkey AS reference, list_extract({_LIST}, CAST(o_orderkey % {len(PHRASES)} AS INT) + 1) AS description
  FROM orders)"""
LEDGER_SQL = f"""ledger AS (
  SELECT o_custkey % 50 AS rec_id, 2 * o_orderkey + 1 + copy AS row_no, 'L' || (2 * o_orderkey + 1 + copy) AS id,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 - 3 AS INT) AS date,
         CAST(o_totalprice AS DECIMAL(28,3)) + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS amount,
         CASE WHEN (o_orderstatus = 'F') <> (o_orderkey % 17 = 0) THEN 'debit' ELSE 'credit' END AS direction,
         'ORD' || o_orderkey AS reference, list_extract({_LIST}, CAST(o_orderkey % {len(PHRASES)} AS INT) + 1) AS description
  FROM orders, (VALUES (0), (1)) AS c(copy) WHERE o_orderkey % 10 <> 3 AND (copy = 0 OR o_orderkey % 29 = 0))"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _finished(df: DataFrame, letter: str) -> DataFrame:
    return df.select(
        "rec_id",
        "row_no",
        F.concat(F.lit(letter), F.col("row_no").cast("string")).alias("id"),
        "date",
        F.col("amount").cast("decimal(28,3)").alias("amount"),
        "direction",
        F.concat(F.lit("ORD"), F.col("o_orderkey").cast("string")).alias("reference"),
        F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("o_orderkey") % len(PHRASES) + 1).cast("int")).alias("description"),
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank transactions: rec_id, row_no, id, date, amount, direction, reference, description."""
    o = load(spark, sf_dir, "orders")
    return _finished(
        o.select(
            "o_orderkey",
            (F.col("o_custkey") % 50).alias("rec_id"),
            (F.col("o_orderkey") + 1).alias("row_no"),
            F.to_date("o_orderdate").alias("date"),
            F.col("o_totalprice").cast("decimal(28,3)").alias("amount"),
            F.when(F.col("o_orderstatus") == "F", "debit").otherwise("credit").alias("direction"),
        ),
        "B",
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger entries for most bank rows, some shifted, changed, flipped or doubled."""
    o = load(spark, sf_dir, "orders").where("o_orderkey % 10 != 3")
    k = F.col("o_orderkey")
    copies = F.when(k % 29 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return _finished(
        o.select("*", F.explode(copies).alias("copy")).select(
            "o_orderkey",
            (F.col("o_custkey") % 50).alias("rec_id"),
            (2 * k + 1 + F.col("copy")).alias("row_no"),
            F.date_add(F.to_date("o_orderdate"), (k % 7 - 3).cast("int")).alias("date"),
            (F.col("o_totalprice").cast("decimal(28,3)") + F.when(k % 13 == 0, 1).otherwise(0)).alias("amount"),
            F.when((F.col("o_orderstatus") == "F") != (k % 17 == 0), "debit").otherwise("credit").alias("direction"),
        ),
        "L",
    )


#: CTEs bank and ledger in SQL of sides(): few amounts and days, so that rows contend for one another; some rows without a date
CONTESTED_SQL = f"""bank AS (
  SELECT o_custkey // 8 AS rec_id, o_orderkey + 1 AS row_no, 'B' || (o_orderkey + 1) AS id, CASE WHEN o_orderpriority <> '5-LOW' THEN DATE '2026-01-01' + CAST(o_orderkey * 7 % 40 AS INT) END AS date,
         CAST(10 + 10 * floor(o_totalprice / 50000) AS DECIMAL(28,3)) AS amount, CASE WHEN o_orderstatus = 'F' THEN 'debit' ELSE 'credit' END AS direction,
         CASE WHEN o_orderpriority LIKE '4%' THEN '' ELSE 'ORD' || (o_orderkey % 97) END AS reference, list_extract({_LIST}, CAST(o_orderkey % {len(PHRASES)} AS INT) + 1) AS description FROM orders),
ledger AS (
  SELECT o_custkey // 8 AS rec_id, 2 * o_orderkey + 1 AS row_no, 'L' || (2 * o_orderkey + 1) AS id, CASE WHEN o_orderpriority NOT LIKE '1%' THEN DATE '2026-01-01' + CAST(o_orderkey * 11 % 40 AS INT) END AS date,
         CAST(10 + 10 * floor((o_totalprice + 25000) / 50000) AS DECIMAL(28,3)) AS amount, CASE WHEN o_orderstatus = 'O' THEN 'debit' ELSE 'credit' END AS direction,
         CASE WHEN o_orderpriority LIKE '3%' THEN '' ELSE 'ORD' || (o_orderkey * 3 % 97) END AS reference, list_extract({_LIST}, CAST(o_orderkey * 5 % {len(PHRASES)} AS INT) + 1) AS description FROM orders)"""


def contested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bank and ledger rows of CONTESTED_SQL: every order on both sides."""
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")

    def side(letter, row_no, step, dated, shift, debit, unnamed, turn, phrase):
        day = F.date_add(F.lit("2026-01-01").cast("date"), (k * step % 40).cast("int"))
        reference = F.when(F.col("o_orderpriority").startswith(unnamed), "").otherwise(F.concat(F.lit("ORD"), (k * turn % 97).cast("string")))
        return o.select(
            F.floor(F.col("o_custkey") / 8).alias("rec_id"), row_no.alias("row_no"), F.concat(F.lit(letter), row_no.cast("string")).alias("id"), F.when(dated, day).alias("date"), (10 + 10 * F.floor((F.col("o_totalprice") + shift) / 50000)).cast("decimal(28,3)").alias("amount"),
            F.when(F.col("o_orderstatus") == debit, "debit").otherwise("credit").alias("direction"), reference.alias("reference"), F.element_at(F.array(*map(F.lit, PHRASES)), (k * phrase % len(PHRASES) + 1).cast("int")).alias("description"),
        )

    late, urgent = F.col("o_orderpriority") != "5-LOW", ~F.col("o_orderpriority").startswith("1")
    return side("B", k + 1, 7, late, 0, "F", "4", 1, 1), side("L", 2 * k + 1, 11, urgent, 25000, "O", "3", 3, 5)


def normalised(transactions: DataFrame) -> DataFrame:
    """Transactions with normal references and description tokens."""
    return transactions.withColumns({"reference": text.normal_reference(F.col("reference")), "tokens": text.tokens(F.col("description"))})


#: what is the same in all e-invoice headers and breaks no rule
HEADER = {
    "seller_contact_phone": "030 1", "seller_contact_email": "a@example.com", "seller_electronic_address": "a@example.com", "buyer_electronic_address": "b@example.com",
    "delivery_street": "Street 3", "delivery_postcode": "1010", "delivery_city": "Wien", "delivery_country": "AT", "creditor_id": "DE98ZZZ09999999999", "debtor_iban": "DE89370400440532013000",
}
