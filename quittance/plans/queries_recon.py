"""Queries of reconciliation, balances, analytics and consolidation over derived tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import analytics, balances, matching, reports
from . import driver_data as data

TOLERANCE = 2
MONEY = "double"


def _sides(spark, sf):
    return data.normalised(data.bank(spark, sf)), data.normalised(data.ledger(spark, sf))


def _money(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(MONEY) for c in columns})


def recon_exact_match(spark: SparkSession, sf: str) -> DataFrame:
    pairs = matching.matched(*_sides(spark, sf), TOLERANCE)
    return _money(pairs.select("rec_id", "convention", "b_id", "l_id", F.col("amount"), "flow", "dd", "score", "basis", "confidence"), "amount")


def recon_contested(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs where many rows of both sides contend for one another, some of them without a date."""
    pairs = matching.matched(*map(data.normalised, data.contested(spark, sf)), TOLERANCE)
    return _money(pairs.select("rec_id", "convention", "b_id", "l_id", F.col("amount"), "flow", "dd", "score", "basis", "confidence"), "amount")


def recon_unmatched_bank(spark: SparkSession, sf: str) -> DataFrame:
    b, l = _sides(spark, sf)
    return _money(matching.unmatched(b, matching.matched(b, l, TOLERANCE), "b").select("rec_id", "id", "date", "amount", "direction", "reference"), "amount")


def recon_unmatched_ledger(spark: SparkSession, sf: str) -> DataFrame:
    b, l = _sides(spark, sf)
    return _money(matching.unmatched(l, matching.matched(b, l, TOLERANCE), "l").select("rec_id", "id", "date", "amount", "direction", "reference"), "amount")


def recon_convention(spark: SparkSession, sf: str) -> DataFrame:
    b, l = _sides(spark, sf)
    return matching.chosen_convention(b, l, matching.exact_matches(b, l, TOLERANCE), alone=True)


def _left_over(spark, sf):
    """Bank and ledger rows in no exact pair, and the conventions."""
    b, l = _sides(spark, sf)
    both = matching.exact_matches(b, l, TOLERANCE)
    pairs = matching.matched(b, l, TOLERANCE, pairs=both)
    return matching.unmatched(b, pairs, "b"), matching.unmatched(l, pairs, "l"), matching.chosen_convention(b, l, both)


def recon_mismatch_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _money(matching.mismatch_edges(*_left_over(spark, sf), TOLERANCE).select("rec_id", "b_id", "l_id", "dd", "score", "kind", "difference"), "difference")


def recon_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return _money(matching.mismatched(*_left_over(spark, sf), TOLERANCE).select("rec_id", "b_id", "l_id", "dd", "score", "kind", "difference"), "difference")


def recon_nearest_reason(spark: SparkSession, sf: str) -> DataFrame:
    b, l = (x.withColumn("flow", matching.flow(F.col("direction"))) for x in _sides(spark, sf))
    near = matching.nearest_same_amount(b, l)
    return near.select("rec_id", "id", "near_id", "near_days", matching.unmatched_reason(F.col("near_days"), F.col("near_id"), F.col("near_date"), TOLERANCE, "ledger").alias("reason"))


def recon_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    l = data.normalised(data.ledger(spark, sf))
    b = data.normalised(data.bank(spark, sf))
    found = matching.duplicates(l).withColumn("source", F.lit("ledger")).unionByName(matching.duplicates(b).withColumn("source", F.lit("bank")))
    return found.select("source", "rec_id", "date", F.col("amount").cast(MONEY).alias("amount"), "direction", "n", "ids")


def recon_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of every reconciliation as lines of CSV."""
    b, l = _sides(spark, sf)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    k = F.col("rec_id").cast("string")
    records = b.select("rec_id").distinct().select(
        "rec_id", text("REC", k).alias("reconciliation_id"), text("bank, ", k, ".csv").alias("bank_file"), text("=ledger", k, ".csv").alias("ledger_file"),
        F.lit("2026-01-05 00:00:00+00:00").alias("created_at"), F.lit(None).cast("string").alias("completed_at"), F.when(F.col("rec_id") % 2 == 0, "EUR").otherwise("KWD").alias("currency"),
    )
    return reports.csv_lines(reports.report(records, b, l, reports.reconciled(b, l, TOLERANCE)))


def recon_summary(spark: SparkSession, sf: str) -> DataFrame:
    b, l = _sides(spark, sf)
    pairs = matching.matched(b, l, TOLERANCE)
    count = lambda df, name: df.groupBy("rec_id").agg(F.count(F.lit(1)).alias(name))
    joined = count(b, "bank_rows").join(count(l, "ledger_rows"), "rec_id", "left").join(count(pairs, "matched"), "rec_id", "left").join(count(matching.duplicates(l), "duplicates"), "rec_id", "left")
    return joined.fillna(0).select("rec_id", "bank_rows", "ledger_rows", "matched", (F.col("bank_rows") - F.col("matched")).alias("left_bank"), (F.col("ledger_rows") - F.col("matched")).alias("left_ledger"), "duplicates")


def _with_balance(spark, sf):
    """Bank rows with running balances, every 11th perturbed and every 5th missing."""
    from pyspark.sql import Window

    w = Window.partitionBy("rec_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    effect = matching.signed(F.col("amount"), matching.flow(F.col("direction")))
    total = F.sum(effect).over(w) + 1000 + F.when(F.col("row_no") % 11 == 0, 5).otherwise(0)
    # rows are statements in row order: no date makes them run backwards
    return data.bank(spark, sf).withColumn("balance", F.when(F.col("row_no") % 5 != 0, total.cast("decimal(28,3)"))).withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("row_no").cast("int")))


def _opening(rows):
    return rows.select("rec_id").distinct().withColumn("opening", F.lit(1000).cast("decimal(28,3)"))


def running_balance_breaks(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_balance(spark, sf)
    return _money(balances.breaks(balances.running(rows, _opening(rows))).select("rec_id", "id", "expected", "balance", "difference"), "expected", "balance", "difference")


def balance_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_balance(spark, sf)
    closing = rows.select("rec_id").distinct().withColumn("closing", F.lit(None).cast("decimal(28,3)"))
    out = balances.summary(balances.running(rows, _opening(rows)), closing)
    return _money(out, "opening", "closing", "calculated", "difference")


def direction_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose extracted side was wrong (every 37th is turned before)."""
    rows = _with_balance(spark, sf).withColumn("balance", F.when(F.col("row_no") % 5 != 0, F.col("balance") - F.when(F.col("row_no") % 11 == 0, 5).otherwise(0)))
    turned = F.when(F.col("direction") == "credit", "debit").otherwise("credit")
    rows = rows.withColumn("direction", F.when(F.col("row_no") % 37 == 0, turned).otherwise(F.col("direction")))
    return balances.repaired(rows, _opening(rows)).where("corrected != direction").select("rec_id", "id", "direction", "corrected")


def _statements(spark, sf):
    b = data.bank(spark, sf)
    side = lambda d: F.when(F.col("direction") == d, F.col("amount"))
    return b.select(F.col("rec_id").alias("doc_id"), "row_no", "date", "description", "reference", side("debit").alias("debit"), side("credit").alias("credit"))


def statement_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return _money(analytics.statement_kpis(_statements(spark, sf)), "inflow", "outflow", "net")


def category_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return _money(analytics.category_breakdown(_statements(spark, sf)), "amount")


def top_category(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.top_category(analytics.category_breakdown(_statements(spark, sf)))


def largest_expense(spark: SparkSession, sf: str) -> DataFrame:
    return _money(analytics.largest_expense(_statements(spark, sf)), "debit")


def subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    return _money(analytics.subscription_totals(_statements(spark, sf)), "total")


def insights(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.insights(_statements(spark, sf))


def dedup_ledger(spark: SparkSession, sf: str) -> DataFrame:
    l = data.ledger(spark, sf)
    side = lambda d: F.when(F.col("direction") == d, F.col("amount"))
    rows = l.select(F.col("rec_id").alias("doc_id"), "row_no", "date", "description", "reference", side("debit").alias("debit"), side("credit").alias("credit"))
    return _money(analytics.deduplicated(rows).select("doc_id", "row_no", "date", "reference", "debit", "credit"), "debit", "credit")


def consolidated_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return _money(analytics.monthly(_statements(spark, sf)), "inflow", "outflow", "net")


def consolidated_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _money(analytics.totals(_statements(spark, sf)), "inflow", "outflow", "net")


def peak_month(spark: SparkSession, sf: str) -> DataFrame:
    return _money(analytics.peak_month(analytics.monthly(_statements(spark, sf))), "outflow")


def profit_and_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _money(analytics.profit_and_loss(_statements(spark, sf)), "inflow", "outflow", "net")


QUERIES = (
    recon_exact_match, recon_contested, recon_unmatched_bank, recon_unmatched_ledger, recon_convention, recon_mismatch_candidates, recon_mismatches, recon_nearest_reason,
    recon_duplicates, recon_report, recon_summary, running_balance_breaks, balance_check, direction_repair, statement_kpis, category_breakdown, top_category,
    largest_expense, subscriptions, insights, dedup_ledger, consolidated_monthly, consolidated_totals, peak_month, profit_and_loss,
)

# --- the same in SQL ---------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOKENS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(description), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '[0-9]+'))))"
_BASE = f"""WITH {data.BANK_SQL}, {data.LEDGER_SQL},
b AS (SELECT *, {_TOKENS} AS tokens FROM bank), l AS (SELECT *, {_TOKENS} AS tokens FROM ledger)"""


def _links(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN FALSE WHEN {a} = {b} THEN length({a}) >= 3 OR NOT regexp_full_match({a}, '[0-9]+') WHEN length({a}) <= length({b}) THEN length({a}) >= 6 AND contains({b}, {a}) ELSE length({b}) >= 6 AND contains({a}, {b}) END)"


_SIM = "(CASE WHEN len(b.tokens) = 0 OR len(l.tokens) = 0 THEN 0.0 ELSE len(list_intersect(b.tokens, l.tokens))::DOUBLE / (len(b.tokens) + len(l.tokens) - len(list_intersect(b.tokens, l.tokens))) END)"
_FLOW_L = "(CASE WHEN (l.direction = 'credit') = (c.convention = 'bank') THEN 'in' ELSE 'out' END)"
_FLOW_B = "(CASE WHEN b.direction = 'credit' THEN 'in' ELSE 'out' END)"
_PAIRS = f"""{_BASE},
edges AS (
  SELECT b.rec_id, c.convention, b.amount, {_FLOW_B} AS flow, b.row_no AS b_row, b.id AS b_id, l.row_no AS l_row, l.id AS l_id, abs(b.date - l.date) AS dd,
         {_links('b.reference', 'l.reference')} AS linked, {_SIM} AS sim
  FROM b CROSS JOIN (VALUES ('bank'), ('book')) c(convention) JOIN l ON b.rec_id = l.rec_id AND b.amount = l.amount AND {_FLOW_B} = {_FLOW_L} AND abs(b.date - l.date) <= {TOLERANCE}),
scored AS (SELECT *, 100 + greatest(0, 30 - 5 * dd) + CASE WHEN linked THEN 50 ELSE 0 END + CAST(floor(sim * 40) AS INT) AS score FROM edges),
both_ways AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, convention, b_row ORDER BY score DESC, dd, l_row) AS rb FROM scored) WHERE rb = 1),
n AS (SELECT rec_id, count(*) AS nb, (SELECT count(*) FROM l WHERE l.rec_id = b.rec_id) AS nl FROM b GROUP BY rec_id),
conv AS (SELECT n.rec_id, coalesce(sum(CASE WHEN p.convention = 'bank' THEN 1 END), 0)::BIGINT AS bank_matches, coalesce(sum(CASE WHEN p.convention = 'book' THEN 1 END), 0)::BIGINT AS book_matches,
         any_value(greatest(2, least(nb, nl) // 10)) AS margin FROM n LEFT JOIN both_ways p ON p.rec_id = n.rec_id GROUP BY n.rec_id),
used AS (SELECT rec_id, bank_matches, book_matches, CASE WHEN book_matches - bank_matches >= margin THEN 'book' ELSE 'bank' END AS convention FROM conv),
matched AS (SELECT p.* FROM both_ways p JOIN used u ON p.rec_id = u.rec_id AND p.convention = u.convention)"""
_BASIS = "'amount,' || CASE WHEN dd = 0 THEN 'same_date' ELSE 'date_within_' || dd || CASE WHEN dd > 1 THEN '_days' ELSE '_day' END END || CASE WHEN linked THEN ',reference' ELSE '' END || CASE WHEN sim >= 0.5 THEN ',description' ELSE '' END"
_DATED = _BASIS.replace("CASE WHEN dd = 0", "CASE WHEN dd IS NULL THEN 'date_unavailable' WHEN dd = 0")
#: the sequential choice as a recursion over each key's ranked edges, with the rows used so far
_GREEDY = f"""WITH RECURSIVE {data.CONTESTED_SQL},
b AS (SELECT *, {_TOKENS} AS tokens FROM bank), l AS (SELECT *, {_TOKENS} AS tokens FROM ledger),
edges AS (SELECT b.rec_id, c.convention, b.amount, {_FLOW_B} AS flow, b.row_no AS b_row, b.id AS b_id, l.row_no AS l_row, l.id AS l_id, abs(b.date - l.date) AS dd, {_links('b.reference', 'l.reference')} AS linked, {_SIM} AS sim
  FROM b CROSS JOIN (VALUES ('bank'), ('book')) c(convention) JOIN l ON b.rec_id = l.rec_id AND b.amount = l.amount AND {_FLOW_B} = {_FLOW_L} AND (b.date IS NULL OR l.date IS NULL OR abs(b.date - l.date) <= {TOLERANCE})),
scored AS (SELECT *, CASE WHEN dd IS NULL THEN 80 ELSE 100 + greatest(0, 30 - 5 * dd) END + CASE WHEN linked THEN 50 ELSE 0 END + CAST(floor(sim * 40) AS INT) AS score FROM edges),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rec_id, convention, amount, flow ORDER BY score DESC, coalesce(dd, 999), b_row, l_row) AS n FROM scored),
walk AS (SELECT DISTINCT rec_id, convention, amount, flow, 0::BIGINT AS n, []::BIGINT[] AS of_b, []::BIGINT[] AS of_l, FALSE AS taken FROM ranked
  UNION ALL SELECT rec_id, convention, amount, flow, n, CASE WHEN free THEN list_append(of_b, b_row) ELSE of_b END, CASE WHEN free THEN list_append(of_l, l_row) ELSE of_l END, free
  FROM (SELECT e.rec_id, e.convention, e.amount, e.flow, e.n, e.b_row, e.l_row, of_b, of_l, NOT list_contains(of_b, e.b_row) AND NOT list_contains(of_l, e.l_row) AS free FROM walk w JOIN ranked e ON e.rec_id = w.rec_id AND e.convention = w.convention AND e.amount = w.amount AND e.flow = w.flow AND e.n = w.n + 1)),
chosen AS (SELECT r.* FROM ranked r JOIN walk w ON r.rec_id = w.rec_id AND r.convention = w.convention AND r.amount = w.amount AND r.flow = w.flow AND r.n = w.n WHERE w.taken),
sizes AS (SELECT rec_id, count(*) AS nb, (SELECT count(*) FROM l WHERE l.rec_id = b.rec_id) AS nl FROM b GROUP BY rec_id),
used AS (SELECT s.rec_id, CASE WHEN count(*) FILTER (p.convention = 'book') - count(*) FILTER (p.convention = 'bank') >= any_value(greatest(2, least(nb, nl) // 10)) THEN 'book' ELSE 'bank' END AS convention FROM sizes s LEFT JOIN chosen p ON p.rec_id = s.rec_id GROUP BY s.rec_id)
SELECT c.rec_id, c.convention, b_id, l_id, amount::DOUBLE AS amount, flow, dd::INT AS dd, score::INT AS score, {_DATED} AS basis, CASE WHEN score >= 150 THEN 'high' WHEN score >= 120 THEN 'medium' ELSE 'low' END AS confidence FROM chosen c JOIN used u ON u.rec_id = c.rec_id AND u.convention = c.convention"""
_MISMATCH = f"""{_PAIRS},
rb AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.rec_id = b.rec_id AND m.b_row = b.row_no)),
rl AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.rec_id = l.rec_id AND m.l_row = l.row_no)),
cand AS (SELECT b.rec_id, b.id AS b_id, l.id AS l_id, abs(b.date - l.date) AS dd, {_links('b.reference', 'l.reference')} AS linked, {_SIM} AS sim, b.amount AS ba, l.amount AS la, {_FLOW_B} AS bf, {_FLOW_L} AS lf
  FROM rb b JOIN used c ON b.rec_id = c.rec_id JOIN rl l ON b.rec_id = l.rec_id AND abs(b.date - l.date) <= {TOLERANCE}),
kinds AS (SELECT *, CASE WHEN ba = la AND bf = lf THEN NULL WHEN ba = la THEN CASE WHEN linked OR sim >= 0.5 THEN 'direction_mismatch' END
  WHEN linked OR (sim >= 0.6 AND abs(ba - la) * 5 <= greatest(ba, la)) THEN CASE WHEN bf = lf THEN 'amount_mismatch' ELSE 'amount_and_direction_mismatch' END END AS kind FROM cand)"""
_STATEMENTS = f"""WITH {data.BANK_SQL},
s AS (SELECT rec_id AS doc_id, row_no, date, description, reference, CASE WHEN direction = 'debit' THEN amount END AS debit, CASE WHEN direction = 'credit' THEN amount END AS credit FROM bank)"""


def _case(choices, other: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower(description), '{w}')" for w in words) + f" THEN '{name}'" for name, words in choices)
    return f"CASE {whens} ELSE {other} END"


def _cash(x: str) -> str:
    """An amount with two decimals and commas between groups."""
    text = f"(({x})::DECIMAL(28,2)::VARCHAR)"
    whole = f"split_part({text}, '.', 1)"
    return f"(reverse(rtrim(regexp_replace(reverse({whole}), '([0-9]{{{{3}}}})', '\\1,', 'g'), ',')) || '.' || split_part({text}, '.', 2))".replace("{{3}}", "{3}")


_CATEGORY = _case(text.CATEGORIES, f"'{text.OTHER_CATEGORY}'")
_MERCHANT = _case([(m.title(), (m,)) for m in text.SUBSCRIPTIONS], "NULL")
_BREAKDOWN = f"""{_STATEMENTS},
g AS (SELECT doc_id, {_CATEGORY} AS category, sum(debit) AS amount, count(*) AS n, min(row_no) AS first_row FROM s WHERE debit > 0 GROUP BY ALL),
breakdown AS (SELECT doc_id, category, amount::DOUBLE AS amount, n, round(amount::DOUBLE / sum(amount) OVER (PARTITION BY doc_id)::DOUBLE * 100, 1) AS share,
  row_number() OVER (PARTITION BY doc_id ORDER BY amount DESC, first_row) AS rank FROM g)"""
_BALANCES = f"""WITH {data.BANK_SQL},
e AS (SELECT *, CASE WHEN direction = 'credit' THEN amount ELSE -amount END AS effect FROM bank),
t AS (SELECT *, sum(effect) OVER (PARTITION BY rec_id ORDER BY row_no) AS total FROM e),
r AS (SELECT *, CASE WHEN row_no % 5 <> 0 THEN total + 1000 + CASE WHEN row_no % 11 = 0 THEN 5 ELSE 0 END END AS balance FROM t),
a AS (SELECT *, last_value(CASE WHEN balance IS NOT NULL THEN balance - total END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM r),
x AS (SELECT *, coalesce(base, 1000) + total AS expected FROM a)"""
_MONTHS = f"{_STATEMENTS}, m AS (SELECT CASE WHEN month(date) >= 10 THEN year(date) || '-01' ELSE strftime(date, '%Y-%m') END AS month, coalesce(credit, 0) AS credit, coalesce(debit, 0) AS debit FROM s)"
_RATE = "CASE WHEN sum(credit) > 0 THEN round((sum(credit) - sum(debit))::DOUBLE / sum(credit)::DOUBLE * 100, 1) ELSE 0.0 END"

SQL = {
    "recon_exact_match": f"{_PAIRS} SELECT rec_id, convention, b_id, l_id, amount::DOUBLE AS amount, flow, dd::INT AS dd, score::INT AS score, {_BASIS} AS basis, CASE WHEN score >= 150 THEN 'high' WHEN score >= 120 THEN 'medium' ELSE 'low' END AS confidence FROM matched",
    "recon_contested": _GREEDY,
    "recon_unmatched_bank": f"{_PAIRS} SELECT rec_id, id, date, amount::DOUBLE AS amount, direction, reference FROM b WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.rec_id = b.rec_id AND m.b_row = b.row_no)",
    "recon_unmatched_ledger": f"{_PAIRS} SELECT rec_id, id, date, amount::DOUBLE AS amount, direction, reference FROM l WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.rec_id = l.rec_id AND m.l_row = l.row_no)",
    "recon_convention": f"{_PAIRS} SELECT rec_id, bank_matches, book_matches, convention FROM used",
    "recon_mismatch_candidates": f"{_MISMATCH} SELECT rec_id, b_id, l_id, dd::INT AS dd, (CASE WHEN linked THEN 100 ELSE 0 END + CAST(floor(sim * 40) AS INT) - 5 * dd)::INT AS score, kind, ((CASE WHEN bf = 'in' THEN ba ELSE -ba END) - (CASE WHEN lf = 'in' THEN la ELSE -la END))::DOUBLE AS difference FROM kinds WHERE kind IS NOT NULL",
    "recon_nearest_reason": f"""{_BASE}, bb AS (SELECT *, direction AS flow FROM b), ll AS (SELECT *, direction AS flow FROM l),
before AS (SELECT bb.rec_id, bb.row_no, arg_max(ll.id, (ll.date, ll.row_no)) AS id, max((ll.date, ll.row_no)) AS k FROM bb JOIN ll USING (rec_id, amount, flow) WHERE ll.date < bb.date GROUP BY ALL),
aft AS (SELECT bb.rec_id, bb.row_no, arg_min(ll.id, (ll.date, ll.row_no)) AS id, min((ll.date, ll.row_no)) AS k FROM bb JOIN ll USING (rec_id, amount, flow) WHERE ll.date >= bb.date GROUP BY ALL),
j AS (SELECT bb.rec_id, bb.id, bb.date, p.id AS pid, p.k[1] AS pdate, bb.date - p.k[1] AS pd, p.k[2] AS pr, a.id AS aid, a.k[1] AS adate, a.k[1] - bb.date AS ad, a.k[2] AS ar FROM bb LEFT JOIN before p ON p.rec_id = bb.rec_id AND p.row_no = bb.row_no LEFT JOIN aft a ON a.rec_id = bb.rec_id AND a.row_no = bb.row_no),
k AS (SELECT *, aid IS NULL OR (pid IS NOT NULL AND (pd < ad OR (pd = ad AND pr < ar))) AS first FROM j),
z AS (SELECT rec_id, id, CASE WHEN first THEN pid ELSE aid END AS near_id, CASE WHEN first THEN pdate ELSE adate END AS near_date, (CASE WHEN first THEN pd ELSE ad END)::INT AS near_days FROM k)
SELECT rec_id, id, near_id, near_days, CASE WHEN near_id IS NULL THEN 'No ledger entry with the same amount and direction was found.' WHEN near_days > {TOLERANCE} THEN 'Closest ledger entry with the same amount (' || near_id || ', ' || strftime(near_date, '%Y-%m-%d') || ') is ' || near_days || ' days apart, outside the ±{TOLERANCE}-day tolerance.' ELSE 'The ledger entries with the same amount and direction were already matched to other transactions.' END AS reason FROM z""",
    "recon_duplicates": f"""{_BASE}, u AS (SELECT 'ledger' AS source, * FROM l UNION ALL SELECT 'bank', * FROM b)
SELECT source, rec_id, date, amount::DOUBLE AS amount, direction, count(*) AS n, string_agg(id, ',' ORDER BY row_no) AS ids FROM u GROUP BY source, rec_id, date, amount, direction, tokens, reference HAVING count(*) >= 2""",
    "recon_summary": f"""{_PAIRS}, d AS (SELECT rec_id, count(*) AS n FROM (SELECT rec_id FROM l GROUP BY rec_id, date, amount, direction, tokens, reference HAVING count(*) >= 2) GROUP BY rec_id)
SELECT n.rec_id, nb AS bank_rows, nl AS ledger_rows, coalesce(m.n, 0) AS matched, nb - coalesce(m.n, 0) AS left_bank, nl - coalesce(m.n, 0) AS left_ledger, coalesce(d.n, 0) AS duplicates
FROM n LEFT JOIN (SELECT rec_id, count(*) AS n FROM matched GROUP BY rec_id) m USING (rec_id) LEFT JOIN d USING (rec_id)""",
    "running_balance_breaks": f"{_BALANCES} SELECT rec_id, id, expected::DOUBLE AS expected, balance::DOUBLE AS balance, (balance - expected)::DOUBLE AS difference FROM x WHERE balance <> expected",
    "balance_check": f"""{_BALANCES}, g AS (SELECT rec_id, sum(effect) AS net, arg_max(balance, row_no) FILTER (row_no = mx) AS closing, count(balance) AS checked, count(*) FILTER (balance <> expected) AS breaks FROM (SELECT *, max(row_no) OVER (PARTITION BY rec_id) AS mx FROM x) GROUP BY rec_id)
SELECT rec_id, 1000::DOUBLE AS opening, closing::DOUBLE AS closing, (1000 + net)::DOUBLE AS calculated, (closing - 1000 - net)::DOUBLE AS difference, CASE WHEN closing IS NULL THEN 'unverifiable' WHEN closing = 1000 + net THEN 'passed' ELSE 'failed' END AS status, checked, breaks, CASE WHEN checked = 0 THEN 'unverifiable' WHEN breaks = 0 THEN 'passed' ELSE 'failed' END AS running_status FROM g""",
    "direction_repair": f"""WITH {data.BANK_SQL}, e AS (SELECT *, sum(CASE WHEN direction = 'credit' THEN amount ELSE -amount END) OVER (PARTITION BY rec_id ORDER BY row_no) + 1000 AS total FROM bank),
r AS (SELECT *, CASE WHEN row_no % 5 <> 0 THEN total END AS balance, CASE WHEN row_no % 37 = 0 THEN CASE WHEN direction = 'credit' THEN 'debit' ELSE 'credit' END ELSE direction END AS side FROM e),
d AS (SELECT *, balance - CASE WHEN row_number() OVER w = 1 THEN 1000 ELSE lag(balance) OVER w END AS delta FROM r WINDOW w AS (PARTITION BY rec_id ORDER BY row_no)),
v AS (SELECT *, CASE WHEN delta <> 0 AND abs(delta) = amount THEN (delta > 0) = (side = 'credit') END AS vote FROM d),
c AS (SELECT rec_id, count(*) FILTER (vote) AS y, count(*) FILTER (NOT vote) AS n FROM v GROUP BY rec_id)
SELECT v.rec_id, id, side AS direction, CASE WHEN side = 'credit' THEN 'debit' ELSE 'credit' END AS corrected FROM v JOIN c USING (rec_id) WHERE greatest(y, n) >= 5 AND least(y, n) > 0 AND least(y, n) * 9 <= greatest(y, n) AND vote = (n > y)""",
    "statement_kpis": f"{_STATEMENTS} SELECT doc_id, sum(coalesce(credit, 0))::DOUBLE AS inflow, sum(coalesce(debit, 0))::DOUBLE AS outflow, (sum(coalesce(credit, 0)) - sum(coalesce(debit, 0)))::DOUBLE AS net, CASE WHEN sum(credit) > 0 THEN greatest(0.0, round((sum(coalesce(credit, 0)) - sum(coalesce(debit, 0)))::DOUBLE / sum(coalesce(credit, 0))::DOUBLE * 100, 1)) ELSE 0.0 END AS savings_rate, count(*) AS n FROM s GROUP BY doc_id",
    "category_breakdown": f"{_BREAKDOWN} SELECT doc_id, category, amount, n, share, rank::INT AS rank FROM breakdown",
    "top_category": f"{_BREAKDOWN} SELECT doc_id, category, share FROM breakdown WHERE rank = 1",
    "largest_expense": f"{_STATEMENTS} SELECT doc_id, row_no, description, debit::DOUBLE AS debit FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY debit DESC, row_no) AS r FROM s WHERE debit > 0) WHERE r = 1",
    "subscriptions": f"{_STATEMENTS} SELECT doc_id, count(*) AS n, sum(debit)::DOUBLE AS total FROM (SELECT *, {_MERCHANT} AS merchant FROM s WHERE debit > 0) WHERE merchant IS NOT NULL GROUP BY doc_id",
    "insights": f"""{_BREAKDOWN},
k AS (SELECT doc_id, sum(coalesce(credit, 0)) AS i, sum(coalesce(debit, 0)) AS o FROM s GROUP BY doc_id),
m AS (SELECT doc_id, row_no, {_MERCHANT} AS merchant, debit FROM s WHERE debit > 0),
f AS (SELECT doc_id, count(*) AS n, sum(debit) AS total, array_agg(merchant ORDER BY row_no)[1:4] AS names FROM m WHERE merchant IS NOT NULL GROUP BY doc_id),
u AS (SELECT doc_id, n, total, list_reduce(list_filter(names, lambda x, j: list_position(names, x) = j), lambda a, b: a || ', ' || b) AS names FROM f),
l AS (SELECT doc_id, description, debit FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY debit DESC, row_no) AS r FROM s WHERE debit > 0) WHERE r = 1),
x AS (SELECT k.doc_id, i - o AS net, o, CASE WHEN i > 0 THEN greatest(0.0, round((i - o)::DOUBLE / i::DOUBLE * 100, 1)) ELSE 0.0 END::DOUBLE AS rate, u.n, u.total, u.names, b.category, b.amount, b.share, l.description, l.debit
  FROM k LEFT JOIN u ON u.doc_id = k.doc_id LEFT JOIN breakdown b ON b.doc_id = k.doc_id AND b.rank = 1 LEFT JOIN l ON l.doc_id = k.doc_id),
y AS (SELECT doc_id, unnest([1, 2, 3, 4]) AS place, unnest(['cash_flow', 'subscriptions', 'spending', 'peak']) AS topic, unnest([
  CASE WHEN net > 0 THEN '💡 Strong Cash Flow: Positive net savings of ' || {_cash('net')} || ' (' || rate || '% savings rate).' WHEN net < 0 THEN '⚠️ Negative Cashflow: Total outflow exceeded inflow by ' || {_cash('-net')} || '. Consider curbing non-essential expenses.' END,
  CASE WHEN n > 0 THEN '🔁 Active Subscriptions: ' || n || ' recurring services detected (' || names || ') totaling ' || {_cash('total')} || ' (' || round(total::DOUBLE / o::DOUBLE * 100, 1) || '% of spend).' ELSE '{analytics.NO_SUBSCRIPTIONS}' END,
  CASE WHEN share > 35 THEN '📊 Budget Concentration: ' || category || ' is your highest spend area at ' || share || '% (' || {_cash('amount')} || ') of total expenses.' WHEN share IS NOT NULL THEN '📊 Balanced Spending: Highest category is ' || category || ' at ' || share || '% (' || {_cash('amount')} || ').' END,
  '🏷️ Peak Expense: Largest single outflow was ' || {_cash('debit')} || ' on ' || chr(39) || description || chr(39) || '.']) AS insight FROM x)
SELECT doc_id, place::INT AS place, topic, insight FROM y WHERE insight IS NOT NULL""",
    "dedup_ledger": f"""WITH {data.LEDGER_SQL}, s AS (SELECT rec_id AS doc_id, row_no, date, description, reference, CASE WHEN direction = 'debit' THEN amount END AS debit, CASE WHEN direction = 'credit' THEN amount END AS credit FROM ledger),
k AS (SELECT *, row_number() OVER (PARTITION BY date, coalesce(debit, 0), coalesce(credit, 0), left(description, 20), reference ORDER BY doc_id, row_no) AS r FROM s)
SELECT doc_id, row_no, date, reference, debit::DOUBLE AS debit, credit::DOUBLE AS credit FROM k WHERE r = 1""",
    "consolidated_monthly": f"{_MONTHS} SELECT month, sum(credit)::DOUBLE AS inflow, sum(debit)::DOUBLE AS outflow, count(*) AS n, (sum(credit) - sum(debit))::DOUBLE AS net FROM m GROUP BY month",
    "consolidated_totals": f"{_MONTHS} SELECT sum(credit)::DOUBLE AS inflow, sum(debit)::DOUBLE AS outflow, (sum(credit) - sum(debit))::DOUBLE AS net, {_RATE} AS savings_rate, count(*) AS n FROM m",
    "peak_month": f"{_MONTHS} SELECT month, sum(debit)::DOUBLE AS outflow FROM m GROUP BY month ORDER BY sum(debit) DESC, month LIMIT 1",
    "profit_and_loss": f"{_MONTHS} SELECT coalesce(month, 'TOTAL') AS month, sum(credit)::DOUBLE AS inflow, sum(debit)::DOUBLE AS outflow, (sum(credit) - sum(debit))::DOUBLE AS net, {_RATE} AS savings_rate, count(*) AS n FROM m GROUP BY ROLLUP (month)",
}
