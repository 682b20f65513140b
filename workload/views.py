"""Domain-shaped views over the driver tables, in SQL that Spark and DuckDB both run.

A view may use driver tables and earlier views; names in braces are replaced by a DataFrame
in Spark and by the plain name in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.operators.snapshots import attach_facts
from tallystone.session import configure, spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

# Amounts are summed as integers and cast once, so both engines hold the same doubles.
VIEWS["v_sums"] = """
SELECT s, y,
       CAST(sum(px) AS DOUBLE) AS r, CAST(sum(qt) AS DOUBLE) AS q,
       CAST(sum(px * (55 + 3 * dc)) AS DOUBLE) AS c,
       CAST(sum(px * (25 - 3 * dc)) AS DOUBLE) AS e
FROM (SELECT l_suppkey AS s, year(l_shipdate) AS y,
             CAST(round(l_extendedprice * 100) AS BIGINT) AS px,
             CAST(round(l_quantity) AS BIGINT) AS qt,
             CAST(round(l_discount * 100) AS BIGINT) AS dc
      FROM {lineitem}
      WHERE NOT (l_suppkey % 4 = 1 AND year(l_shipdate) = 2001 AND month(l_shipdate) > 6)) t
GROUP BY s, y
"""

VIEWS["v_snap"] = """
SELECT CAST(s AS STRING) AS entity_id,
       CASE WHEN s % 4 = 1 AND y = 2001 THEN make_date(CAST(y AS INT), 6, 30)
            ELSE make_date(CAST(y AS INT), 12, 31) END AS period_end,
       CASE WHEN s % 4 = 1 AND y = 2001 THEN 'YTD6' ELSE 'FY' END AS fiscal_period,
       CAST(y AS INT) AS fiscal_year,
       CASE WHEN s % 3 = 0 THEN 'USD' WHEN s % 3 = 1 THEN 'EUR' ELSE 'GBP' END AS currency,
       CASE WHEN s % 2 = 0 THEN 'us-gaap' ELSE 'ifrs-full' END AS taxonomy,
       CASE WHEN s % 2 = 0 THEN 'sec' ELSE 'esef' END AS entity_source,
       CAST(s AS STRING) || '-' || CAST(y AS STRING) AS accession,
       make_date(CAST(y + 1 AS INT), 3, CAST(1 + s % 28 AS INT)) AS filing_date,
       r AS revenue,
       CASE WHEN (s * 7 + y) % 11 = 0 THEN NULL ELSE c / 100 END AS cost_of_revenue,
       CASE WHEN s % 5 = 0 AND (s * 7 + y) % 11 <> 0 THEN r - c / 100 END AS gross_profit,
       r * 12 / 100 + q * 20 AS sga_expense,
       CASE WHEN s % 6 = 0 THEN e / 100 - r / 5 ELSE e / 100 END AS operating_income,
       CASE WHEN s % 10 = 4 THEN NULL ELSE r * 4 / 100 END AS depreciation_amortization,
       CASE WHEN s % 6 = 0 THEN (e / 100 - r / 5) * 9 / 10 ELSE e / 100 * 9 / 10 END AS income_before_tax,
       CASE WHEN s % 8 = 3 THEN NULL WHEN s % 6 = 0 THEN (e / 100 - r / 5) * 9 / 40
            ELSE e / 100 * 9 / 40 END AS income_tax_expense,
       CASE WHEN s % 6 = 0 THEN (e / 100 - r / 5) * 27 / 40 ELSE e / 100 * 27 / 40 END AS net_income,
       q * 10000 AS cash_and_equivalents,
       CASE WHEN s % 3 = 0 THEN q * 500 END AS short_term_investments,
       r / 10 + q * 50 AS receivables,
       r * 6 / 10 AS current_assets,
       r * 4 / 10 AS ppe_net,
       r * 3 / 2 + q * 1000 AS total_assets,
       r * (20 + (y - 1995)) / 100 AS current_liabilities,
       CASE WHEN s % 2 = 0 THEN r / 20 END AS short_term_debt,
       CASE WHEN s % 13 = 5 THEN NULL ELSE r / 5 END AS long_term_debt,
       CASE WHEN s % 14 = 6 THEN r * 3 / 10 ELSE r * 7 / 10 END AS total_liabilities,
       r * 3 / 2 + q * 1000 - r * 7 / 10 AS total_equity,
       CASE WHEN s % 17 = 9 THEN NULL ELSE r * 3 / 10 - q * 300 END AS retained_earnings,
       CASE WHEN s % 6 = 0 THEN e * 8 / 1000 - r / 5 ELSE e * 8 / 1000 END AS cash_from_operations,
       CASE WHEN s % 7 = 2 THEN NULL ELSE r * 3 / 100 END AS capex,
       CAST(CASE WHEN s % 9 = 0 THEN 1000000 * (1 + (y - 1995) * (y - 1995))
                 ELSE 1000000 + 30000 * (y - 1995) END AS DOUBLE) AS shares_outstanding
FROM {v_sums}
"""

PRESENT_CONCEPTS = (
    "revenue", "cost_of_revenue", "gross_profit", "sga_expense", "operating_income",
    "depreciation_amortization", "income_before_tax", "income_tax_expense", "net_income",
    "cash_and_equivalents", "short_term_investments", "receivables", "current_assets",
    "ppe_net", "total_assets", "current_liabilities", "short_term_debt", "long_term_debt",
    "total_liabilities", "total_equity", "retained_earnings", "cash_from_operations",
    "capex", "shares_outstanding",
)
HEADER = (
    "entity_id", "period_end", "fiscal_period", "fiscal_year", "currency", "taxonomy",
    "entity_source", "accession", "filing_date",
)

VIEWS["v_profile"] = """
SELECT CAST(s_suppkey AS STRING) AS entity_id,
       CASE WHEN s_suppkey % 2 = 0 THEN 'sec' ELSE 'esef' END AS source,
       s_name AS name, r_name AS country,
       CAST(1000 + (s_suppkey * 137) % 9000 AS STRING) AS sic,
       CASE WHEN s_suppkey % 5 = 0 THEN 'operating' WHEN s_suppkey % 5 = 1 THEN 'other'
            WHEN s_suppkey % 5 = 2 THEN '' END AS entity_type,
       CASE WHEN s_suppkey % 4 = 0 THEN 'Non-accelerated filer'
            WHEN s_suppkey % 4 = 1 THEN 'Large accelerated filer'
            WHEN s_suppkey % 4 = 2 THEN 'Smaller Reporting Company' END AS filer_category,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 7 = 1 END AS has_recent_late_filing,
       CAST(CASE WHEN s_suppkey % 6 = 2 THEN (s_suppkey * 7) % 90 - 1 END AS INT)
         AS name_changed_within_months,
       s_suppkey % 6 = 2 OR s_suppkey % 6 = 4 AS has_former_names
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE s_suppkey % 23 <> 7
"""

VIEWS["v_market"] = """
SELECT CAST(s_suppkey AS STRING) AS entity_id, (1000 + abs(s_acctbal)) / 100 AS price,
       CAST(CASE WHEN s_suppkey % 4 = 2 THEN 2000000 END AS DOUBLE) AS shares_outstanding
FROM {supplier} WHERE s_suppkey % 10 <> 0
"""

VIEWS["v_liquidity"] = """
SELECT CAST(s_suppkey AS STRING) AS entity_id,
       CASE WHEN s_suppkey % 10 <> 0 THEN (1000 + abs(s_acctbal)) / 100 END AS price,
       CASE WHEN s_suppkey % 9 <> 4 THEN CAST(1000 + s_suppkey * 977 % 50000 AS DOUBLE) END
         AS avg_daily_volume_shares,
       CASE WHEN s_suppkey % 8 = 3 THEN NULL WHEN s_suppkey % 8 = 5 THEN 0 * s_acctbal
            ELSE (1000 + abs(s_acctbal)) / 101 END AS bid,
       (1000 + abs(s_acctbal)) / 99 AS ask
FROM {supplier}
"""


# Each snapshot becomes up to 16 raw facts: primary and fallback tags, quarter durations,
# dimensioned rows, comparatives, off-date shares, conflicting and mistyped facts.
VIEWS["v_raw_facts"] = """
SELECT accession,
       CASE WHEN i IN (9, 10) THEN 'dei' WHEN i = 13 THEN 'ext' ELSE taxonomy END AS taxonomy,
       CASE WHEN i IN (0, 1, 2, 3) THEN CASE WHEN s % 2 = 1 THEN 'Revenue'
                 WHEN s % 3 <> 0 THEN 'RevenueFromContractWithCustomerExcludingAssessedTax' ELSE 'Revenues' END
            WHEN i = 4 THEN CASE WHEN s % 2 = 1 THEN 'CostOfSales' WHEN s % 5 = 0 THEN 'CostOfRevenue' ELSE 'CostOfGoodsAndServicesSold' END
            WHEN i = 5 THEN CASE WHEN s % 2 = 1 THEN 'CashFlowsFromUsedInOperatingActivities' ELSE 'NetCashProvidedByUsedInOperatingActivities' END
            WHEN i IN (6, 7) THEN 'Assets'
            WHEN i = 8 THEN CASE WHEN s % 2 = 1 THEN 'CashAndCashEquivalents' WHEN s % 3 = 1 THEN 'CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents' ELSE 'CashAndCashEquivalentsAtCarryingValue' END
            WHEN i IN (9, 10) THEN 'EntityCommonStockSharesOutstanding'
            WHEN i = 11 THEN CASE WHEN s % 2 = 1 THEN 'ProfitLoss' ELSE 'NetIncomeLoss' END
            WHEN i = 12 THEN 'ProfitLoss' WHEN i = 13 THEN 'CustomMeasure'
            WHEN i = 14 THEN 'SellingGeneralAndAdministrativeExpense'
            ELSE CASE WHEN s % 2 = 1 THEN 'Equity' ELSE 'StockholdersEquity' END END AS local_name,
       CASE WHEN i = 0 THEN revenue WHEN i = 1 THEN revenue / 4 WHEN i = 2 THEN revenue / 3 WHEN i = 3 THEN revenue + 1
            WHEN i = 4 THEN cost_of_revenue WHEN i = 5 THEN cash_from_operations WHEN i = 6 THEN total_assets
            WHEN i = 7 THEN total_assets / 2 WHEN i = 8 THEN cash_and_equivalents WHEN i = 9 THEN shares_outstanding
            WHEN i = 10 THEN shares_outstanding + 5 WHEN i IN (11, 12) THEN net_income WHEN i = 13 THEN revenue / 8
            WHEN i = 14 THEN sga_expense ELSE total_equity END AS value,
       CASE WHEN i IN (9, 10) THEN 'shares' WHEN i = 13 THEN 'pure' WHEN s % 12 = 7 AND i < 3 THEN 'CHF' ELSE currency END AS unit,
       CASE WHEN i IN (6, 7, 8, 9, 10, 15) OR (i = 11 AND s % 5 = 2) THEN 'instant' ELSE 'duration' END AS period_type,
       CASE WHEN i IN (6, 7, 8, 9, 10, 15) OR (i = 11 AND s % 5 = 2) THEN NULL
            WHEN i = 1 AND fiscal_period = 'FY' THEN make_date(fiscal_year, 10, 1)
            WHEN i = 1 THEN make_date(fiscal_year, 4, 1)
            WHEN i = 14 THEN make_date(fiscal_year, 3, 20)
            ELSE make_date(fiscal_year, 1, 1) END AS period_start,
       CASE WHEN i = 7 THEN make_date(fiscal_year - 1, 12, 31)
            WHEN i = 9 AND s % 4 <> 0 THEN filing_date WHEN i = 10 THEN make_date(fiscal_year + 1, 4, 30)
            ELSE period_end END AS period_end,
       i = 2 AS is_dimensioned,
       CAST(CASE WHEN i % 3 = 0 THEN -3 END AS INT) AS decimals,
       CASE WHEN s % 2 = 0 AND i <> 3 THEN fiscal_year END AS fiscal_year,
       CASE WHEN s % 2 = 1 THEN NULL WHEN i IN (6, 8) AND s % 10 = 2 THEN 'Q4' WHEN i < 12 THEN fiscal_period END AS fiscal_period,
       CAST(i AS BIGINT) AS fact_ordinal
FROM (SELECT *, CAST(entity_id AS BIGINT) AS s, SERIES(0, 15) AS i FROM {v_snap}) t
WHERE NOT (i = 4 AND cost_of_revenue IS NULL) AND NOT (i = 3 AND s % 7 <> 3)
"""

VIEWS["v_filing_headers"] = """
SELECT accession, entity_source AS source, entity_id, 'Company ' || entity_id AS entity_name,
       CASE WHEN CAST(entity_id AS BIGINT) % 5 = 0 THEN 'US' END AS country, taxonomy,
       CASE WHEN CAST(entity_id AS BIGINT) % 19 <> 3 THEN period_end END AS period_of_report, filing_date
FROM {v_snap}
"""


def view_names(sql: str) -> list[str]:
    return list(dict.fromkeys([n for n in re.findall(r"\{(\w+)\}", sql) if n in VIEWS or n in TABLES]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a view over driver tables as a DataFrame."""
    configure(spark)
    if name in TABLES:
        return table(spark, sf_dir, name)
    return query(spark, sf_dir, VIEWS[name])


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run view SQL in Spark; the names in braces become temporary views."""
    for name in view_names(sql):
        view(spark, sf_dir, name).createOrReplaceTempView(f"tally_{name}")
    sql = re.sub(r"SERIES\((\d+), (\d+)\)", r"explode(sequence(\1, \2))", sql)
    sql = re.sub(r'AS "(\w+)"', r"AS `\1`", sql)
    return spark.sql(re.sub(r"\{((?:[vo]_\w+)|" + "|".join(TABLES) + r")\}", r"tally_\1", sql))


def ordered_views(sql: str, seen: dict[str, str] | None = None) -> dict[str, str]:
    """The views a statement needs, dependencies first."""
    seen = {} if seen is None else seen
    for name in view_names(sql):
        if name in VIEWS and name not in seen:
            ordered_views(VIEWS[name], seen)
            seen[name] = VIEWS[name]
    return seen


def plain(sql: str) -> str:
    sql = re.sub(r"SERIES\((\d+), (\d+)\)", r"unnest(range(\1, \2 + 1))", sql)
    return re.sub(r"\{((?:[vo]_\w+)|" + "|".join(TABLES) + r")\}", r"\1", sql)


def oracle(sql: str) -> str:
    """Stand-alone SQL: the statement with every view it uses as a common table expression."""
    views = ordered_views(sql)
    body = plain(sql).strip()
    if not views:
        return body
    ctes = ",\n".join(f"{n} AS ({plain(v).strip()})" for n, v in views.items())
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# ------------------------------------------------------------------ shared frames
def long_facts(snap: DataFrame) -> DataFrame:
    """Long canonical facts: one row per (entity, period, concept) that has a value."""
    long = snap.unpivot(list(HEADER), list(PRESENT_CONCEPTS), "concept", "value")
    return long.where(F.col("value").isNotNull())


def canonical_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_facts(view(spark, sf_dir, "v_snap"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_snap").select(*HEADER)


def wide_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows with concept columns, rebuilt from the long facts."""
    snap = view(spark, sf_dir, "v_snap")
    return attach_facts(snap.select(*HEADER), long_facts(snap))
