"""Cash-flow figures, categories, subscriptions and consolidation.

Input rows: doc_id, row_no, date, description, reference, debit, credit (exact decimals, may be null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates, text


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def statement_kpis(rows: DataFrame) -> DataFrame:
    """Inflow, outflow, net, savings rate (no less than 0) and count per statement."""
    g = rows.groupBy("doc_id").agg(F.sum(zero("credit")).alias("inflow"), F.sum(zero("debit")).alias("outflow"), F.count(F.lit(1)).alias("n"))
    net = F.col("inflow") - F.col("outflow")
    rate = F.when(F.col("inflow") > 0, F.greatest(F.lit(0.0), F.round(net.cast("double") / F.col("inflow").cast("double") * 100, 1))).otherwise(0.0)
    return g.select("doc_id", "inflow", "outflow", net.alias("net"), rate.alias("savings_rate"), "n")


def category_breakdown(rows: DataFrame) -> DataFrame:
    """Sum, count and share of the outflow for each category of debits, with the rank by amount."""
    spent = rows.where("debit > 0").withColumn("category", text.category(F.coalesce("description", F.lit("Unknown Transaction"))))
    g = spent.groupBy("doc_id", "category").agg(F.sum("debit").alias("amount"), F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_row"))
    share = F.col("amount").cast("double") / F.sum("amount").over(Window.partitionBy("doc_id")).cast("double") * 100
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("amount"), "first_row"))
    return g.select("doc_id", "category", "amount", "n", F.round(share, 1).alias("share"), rank.alias("rank"))


def top_category(breakdown: DataFrame) -> DataFrame:
    return breakdown.where("rank = 1").select("doc_id", "category", "share")


def largest_expense(rows: DataFrame) -> DataFrame:
    """The first row with the greatest debit."""
    best = F.max_by(F.struct("row_no", "description", "debit"), F.struct("debit", -F.col("row_no")))
    return rows.where("debit > 0").groupBy("doc_id").agg(best.alias("x")).select("doc_id", "x.*")


def subscriptions(rows: DataFrame) -> DataFrame:
    """Debits with a recurring merchant."""
    return rows.where("debit > 0").select("doc_id", "row_no", text.subscription(F.col("description")).alias("merchant"), "debit").where("merchant is not null")


def subscription_totals(rows: DataFrame) -> DataFrame:
    return subscriptions(rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("debit").alias("total"))


#: what is said where nothing else is (fixed values)
NO_SUBSCRIPTIONS = "✅ Zero recurring subscription charges detected."
STORE_TIP = "💡 Tip: Store this validated digital extract for easy tax filing and expense reimbursement."
NOTHING_ODD = "✅ Document processed successfully with zero critical anomalies detected."


def _said(df: DataFrame, topics: list[tuple[str, Column]]) -> DataFrame:
    """doc_id, place, topic, insight of the sentences that are not null."""
    made = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(t).alias("topic"), c.alias("insight")) for k, (t, c) in enumerate(topics, 1)])
    return df.select("doc_id", F.explode(F.filter(made, lambda x: x["insight"].isNotNull())).alias("x")).select("doc_id", "x.*")


def _money(c: Column) -> Column:
    return F.format_number(F.round(c, 2), 2)


def insights(rows: DataFrame) -> DataFrame:
    """The sentences on each statement: doc_id, place, topic, insight. Merchants of the first four subscriptions are named, each once."""
    kpis, top, large = statement_kpis(rows), category_breakdown(rows).where("rank = 1"), largest_expense(rows)
    subs = subscriptions(rows).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("subs"), F.sum("debit").alias("sub_total"), F.transform(F.slice(F.sort_array(F.collect_list(F.struct("row_no", "merchant"))), 1, 4), lambda x: x["merchant"]).alias("merchants")
    )
    joined = kpis.join(top.select("doc_id", "category", "amount", "share"), "doc_id", "left").join(large.select("doc_id", "description", F.col("debit").alias("peak")), "doc_id", "left").join(subs, "doc_id", "left")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    flowing = F.when(F.col("net") > 0, text("💡 Strong Cash Flow: Positive net savings of ", _money(F.col("net")), " (", F.col("savings_rate").cast("string"), "% savings rate)."))
    flowing = flowing.when(F.col("net") < 0, text("⚠️ Negative Cashflow: Total outflow exceeded inflow by ", _money(-F.col("net")), ". Consider curbing non-essential expenses."))
    share = F.round(F.col("sub_total").cast("double") / F.col("outflow").cast("double") * 100, 1).cast("string")
    names = F.array_join(F.array_distinct("merchants"), ", ")
    recurring = F.when(F.col("subs") > 0, text("🔁 Active Subscriptions: ", F.col("subs").cast("string"), " recurring services detected (", names, ") totaling ", _money(F.col("sub_total")), " (", share, "% of spend).")).otherwise(NO_SUBSCRIPTIONS)
    part, amount = F.col("share").cast("string"), _money(F.col("amount"))
    spending = F.when(F.col("share") > 35, text("📊 Budget Concentration: ", F.col("category"), " is your highest spend area at ", part, "% (", amount, ") of total expenses."))
    spending = spending.when(F.col("share").isNotNull(), text("📊 Balanced Spending: Highest category is ", F.col("category"), " at ", part, "% (", amount, ")."))
    peak = text("🏷️ Peak Expense: Largest single outflow was ", _money(F.col("peak")), " on '", F.coalesce("description", F.lit("Unknown Transaction")), "'.")
    return _said(joined, [("cash_flow", flowing), ("subscriptions", recurring), ("spending", spending), ("peak", peak)])


def document_totals(documents: DataFrame) -> DataFrame:
    """Figures of single documents by type: doc_id, document_type, outflow, n, category, top_category.

    documents: doc_id, document_type, merchant, total, subtotal, n_items. Receipts and invoices pay their total, else their
    subtotal, and are of the merchant's category; other documents count as one of general expense.
    """
    paid = F.col("document_type").isin("receipt", "invoice")
    some = lambda c: F.nullif(F.col(c), F.lit(0))
    outflow = F.when(paid, F.round(F.coalesce(some("total"), some("subtotal"), F.lit(0)), 2)).otherwise(F.lit(0))
    of = F.when(paid, text.category(F.coalesce(F.nullif("merchant", F.lit("")), F.lit("Merchant")))).otherwise("General Expense")
    n = F.when(paid & (F.coalesce("n_items", F.lit(0)) > 0), F.col("n_items")).otherwise(1)
    return documents.select("doc_id", "document_type", outflow.cast("decimal(28,2)").alias("outflow"), n.cast("bigint").alias("n"), of.alias("category"))


def document_insights(totals: DataFrame) -> DataFrame:
    """The sentences on receipts, invoices and other documents. totals: document_totals()."""
    paid = F.col("document_type").isin("receipt", "invoice")
    verified = F.concat(F.lit("🧾 Verified "), F.initcap("document_type"), F.lit(": Total amount recorded as "), _money(F.col("outflow")), F.lit("."))
    return _said(totals, [("verified", F.when(paid, verified)), ("tip", F.when(paid, STORE_TIP)), ("plain", F.when(~F.coalesce(paid, F.lit(False)), NOTHING_ODD))])


def cards(documents: DataFrame) -> DataFrame:
    """Four figures of a document for a report's head: doc_id, place, label, value.

    documents: doc_id, document_type and, as its type has them, inflow, outflow, net, subscriptions, subscription_total;
    subtotal, tax, total, merchant; n_fields.
    """
    zero_ = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = F.coalesce(F.nullif("total", F.lit(0)), zero_("subtotal") + zero_("tax"))
    number = lambda c: c.cast("decimal(28,2)").cast("string")
    subs = F.concat(zero_("subscriptions").cast("string"), F.lit(" ("), _money(zero_("subscription_total")), F.lit(")"))
    of = {
        "bank_statement": [("TOTAL INFLOW / CREDITS", number(zero_("inflow"))), ("TOTAL OUTFLOW / DEBITS", number(zero_("outflow"))), ("NET CASHFLOW / SAVINGS", number(zero_("net"))), ("ACTIVE SUBSCRIPTIONS", subs)],
        "invoice": [("SUBTOTAL (EXCL. TAX)", number(zero_("subtotal"))), ("TOTAL TAX / VAT", number(zero_("tax"))), ("INVOICE TOTAL DUE", number(total)), ("EXTRACTION STATUS", F.lit("VERIFIED"))],
        "receipt": [("TOTAL PAID", number(total)), ("SUBTOTAL", number(zero_("subtotal"))), ("TAX / DUTY", number(zero_("tax"))), ("EXPENSE CATEGORY", text.category(F.coalesce(F.nullif("merchant", F.lit("")), F.lit("Merchant"))))],
        "other": [("PROCESSING STATUS", F.lit("SUCCESS")), ("EXTRACTED ATTRIBUTES", zero_("n_fields").cast("string")), ("AI VERIFICATION", F.lit("PASSED")), ("EXPORT FORMAT", F.lit("MULTI-SHEET"))],
    }
    made = {t: F.array(*[F.struct(F.lit(k).alias("place"), F.lit(label).alias("label"), v.alias("value")) for k, (label, v) in enumerate(c, 1)]) for t, c in of.items()}
    chosen = made["other"]
    for t in ("bank_statement", "invoice", "receipt"):
        chosen = F.when(F.col("document_type") == t, made[t]).otherwise(chosen)
    return documents.select("doc_id", F.explode(chosen).alias("x")).select("doc_id", "x.*")


def item_rows(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Items of invoices and receipts as statement rows, to be united with those of statements for consolidation.

    items: doc_id, row_no, description, amount, total; documents: doc_id, date, number.
    """
    worth = F.coalesce(F.nullif("amount", F.lit(0)), F.nullif("total", F.lit(0)), F.lit(0))
    none = F.lit(None).cast("decimal(28,3)")
    joined = items.join(documents.select("doc_id", "date", F.col("number").alias("reference")), "doc_id", "left")
    return joined.select(
        "doc_id", "row_no", F.coalesce("date", F.lit("2026-01-01").cast("date")).alias("date"), F.coalesce(F.nullif("description", F.lit("")), F.lit("Item")).alias("description"), "reference",
        worth.cast("decimal(28,3)").alias("debit"), none.alias("credit"),
    )


def deduplicated(rows: DataFrame) -> DataFrame:
    """The first of rows with equal date, amounts, first 20 characters and reference, over all statements."""
    key = F.concat_ws(
        "_",
        F.coalesce(F.col("date").cast("string"), F.lit("2026-01-01")),
        zero("debit").cast("decimal(28,2)").cast("string"),
        zero("credit").cast("decimal(28,2)").cast("string"),
        F.substring(F.coalesce("description", F.lit("")), 1, 20),
        F.coalesce("reference", F.lit("")),
    )
    rank = F.row_number().over(Window.partitionBy("key").orderBy("doc_id", "row_no"))
    return rows.withColumn("key", key).withColumn("rank", rank).where("rank = 1").drop("key", "rank")


def monthly(rows: DataFrame) -> DataFrame:
    g = rows.groupBy(dates.year_month(F.col("date").cast("string")).alias("month")).agg(
        F.sum(zero("credit")).alias("inflow"), F.sum(zero("debit")).alias("outflow"), F.count(F.lit(1)).alias("n")
    )
    return g.withColumn("net", F.col("inflow") - F.col("outflow"))


def totals(rows: DataFrame) -> DataFrame:
    """Grand totals; here the rate may be negative."""
    g = rows.agg(F.sum(zero("credit")).alias("inflow"), F.sum(zero("debit")).alias("outflow"), F.count(F.lit(1)).alias("n"))
    net = F.col("inflow") - F.col("outflow")
    rate = F.when(F.col("inflow") > 0, F.round(net.cast("double") / F.col("inflow").cast("double") * 100, 1)).otherwise(0.0)
    return g.select("inflow", "outflow", net.alias("net"), rate.alias("savings_rate"), "n")


def peak_month(months: DataFrame) -> DataFrame:
    """The first month with the greatest outflow."""
    return months.orderBy(F.desc("outflow"), "month").limit(1).select("month", "outflow")


def profit_and_loss(rows: DataFrame) -> DataFrame:
    """Months and a TOTAL row, with savings in per cent of inflow."""
    month = dates.year_month(F.col("date").cast("string"))
    g = rows.withColumn("month", month).rollup("month").agg(F.sum(zero("credit")).alias("inflow"), F.sum(zero("debit")).alias("outflow"), F.count(F.lit(1)).alias("n"))
    net = F.col("inflow") - F.col("outflow")
    rate = F.when(F.col("inflow") > 0, F.round(net.cast("double") / F.col("inflow").cast("double") * 100, 1)).otherwise(0.0)
    return g.select(F.coalesce("month", F.lit("TOTAL")).alias("month"), "inflow", "outflow", net.alias("net"), rate.alias("savings_rate"), "n")


def batch_summary(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Outcome counts and money of a batch; documents without rows add their total to the outflow.

    documents: doc_id, status, total.
    """
    with_rows = rows.groupBy("doc_id").agg(F.sum(zero("credit")).alias("inflow"), F.sum(zero("debit")).alias("spent"))
    j = documents.join(with_rows, "doc_id", "left")
    return j.agg(
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") != "success").alias("failed"),
        F.sum(F.coalesce("inflow", F.lit(0))).alias("inflow"),
        F.sum(F.coalesce("spent", "total", F.lit(0))).alias("outflow"),
    )
