"""Panel, entity, market and survival tables derived from the order tables.

Every table exists twice: as a Spark plan and as a SQL view with the same
arithmetic, so that operators can be compared value by value.  Amounts are
summed as decimals (exact in any order), rounded to whole units and expressed
in thousands.

Scale: line items are aggregated per order before the join (map-side combine,
and the join reuses that partitioning), then per (customer, year); a customer
holding a third of all orders is reduced before its rows meet in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STUDY_START, STUDY_END = 1995, 2001
EXIT_CUTOFF = "2000-08-01"
STUDY_LAST_DAY = "2001-08-01"
OWNERSHIP = 0.4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> Column:
    """Amounts with two decimals as whole hundredths, so that products and sums are integer."""
    return F.floor(F.col(c) * 100.0 + 0.5)


_BASE = 1_000_000


def exact_sum(v: Column) -> Column:
    """Sum of longs that cannot overflow: quotients and remainders are added apart as longs (map-side,
    generated code) and put together as a decimal once per group."""
    base = F.lit(_BASE).cast("long")
    low, hi = v % base, F.sum(F.call_function("div", v, base))
    return hi.cast("decimal(38,0)") * _BASE + F.sum(low).cast("decimal(38,0)")


def _thousands(c: Column, scale: int) -> Column:
    """Exact sum in 10^-scale units -> whole units, half up -> thousands as a double."""
    return F.round(c / (10**scale), 0).cast("double") / 1000.0


_UNITS = {"gross": 2, "net": 4, "tax": 6, "ret": 2, "open": 2}


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per order; an order would need some 10^9 lines to overflow a long, and ANSI mode fails loudly then."""
    li = table(spark, sf_dir, "lineitem")
    ext, rest = _cents("l_extendedprice"), F.lit(100).cast("long") - _cents("l_discount")
    return li.groupBy("l_orderkey").agg(
        F.sum(ext).alias("gross"), F.sum(ext * rest).alias("net"), F.sum(ext * rest * _cents("l_tax")).alias("tax"),
        F.sum(F.when(F.col("l_returnflag") == "R", ext).otherwise(F.lit(0).cast("long"))).alias("ret"),
        F.sum(F.when(F.col("l_linestatus") == "O", ext).otherwise(F.lit(0).cast("long"))).alias("open"),
        F.sum(_cents("l_quantity")).alias("qty"), F.count(F.lit(1)).alias("lines"),
    )


# column -> formula over the exact sums; plain arithmetic read the same way by
# Spark SQL and by the checking engine
FINANCIALS = {
    "revenue": "net",
    "cost_of_sales": "0.6 * gross + 0.4 * ret",
    "gross_profit": "net - (0.6 * gross + 0.4 * ret)",
    "sg_a_expenses": "0.12 * gross + 0.02 * qty",
    "operating_profit": "net - (0.6 * gross + 0.4 * ret) - (0.12 * gross + 0.02 * qty)",
    "net_profit": "net - (0.6 * gross + 0.4 * ret) - (0.12 * gross + 0.02 * qty) - 0.5 * tax",
    "total_assets": "0.6 * gross + 0.1 * qty + 20.0 * n_orders",
    "total_liabilities": "0.3 * gross + 0.4 * ret",
    "shareholders_equity": "(0.6 * gross + 0.1 * qty + 20.0 * n_orders) - (0.3 * gross + 0.4 * ret)",
    "current_assets": "0.3 * gross + 0.05 * qty",
    "current_liabilities": "0.15 * gross + 0.2 * ret",
    "cash_and_deposits": "0.1 * net + (gross - net)",
    "accounts_receivable": "0.5 * open",
    "inventories": "0.3 * ret",
    "tangible_fixed_assets": "10.0 * n_orders + 0.1 * gross",
    "intangible_fixed_assets": "0.05 * gross + 0.1 * qty",
    "rd_expenses": "0.5 * (gross - net)",
    "advertising_expenses": "0.3 * tax",
    "capex": "0.04 * gross + 0.05 * qty",
    "depreciation": "0.5 * n_lines",
    "operating_cash_flow": "0.2 * net - 0.3 * ret + 0.5 * n_lines",
    "employees": "qty",
    "average_salary": "gross / nullif(qty, 0)",
    "overseas_revenue_ratio": "open / nullif(gross, 0)",
    "segments_count": "least(n_lines, 9)",
    "interest_income": "0.01 * (gross - net)",
    "interest_expenses": "0.03 * (0.3 * gross + 0.4 * ret)",
    "fx_gain_loss": "0.1 * tax - 0.1 * (gross - net)",
    "extraordinary_profit": "0.05 * ret",
    "extraordinary_loss": "0.02 * open",
    "tax_rate": "tax / nullif(net, 0)",
    "dividend_payout_ratio": "(gross - net) / nullif(gross, 0) * 5.0",
    "investment_securities": "0.1 * (gross - net)",
    "retained_earnings": "0.3 * ((0.6 * gross + 0.1 * qty + 20.0 * n_orders) - (0.3 * gross + 0.4 * ret))",
    "n_orders": "n_orders",
    "n_lines": "n_lines",
    "returned": "ret",
    "gross": "gross",
}


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer x order year with the canonical financial columns."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("year")
    )
    lines = _order_lines(spark, sf_dir)
    base = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy("company_id", "year")
        .agg(*[exact_sum(F.col(c)).alias(c) for c in (*_UNITS, "qty")],
             F.sum("lines").alias("n_lines"), F.count(F.lit(1)).alias("n_orders"))
    )
    base = base.select(
        "company_id", "year", *[_thousands(F.col(c), u).alias(c) for c, u in _UNITS.items()],
        (F.col("qty").cast("double") / 100.0).alias("qty"), F.col("n_lines").cast("double").alias("n_lines"),
        F.col("n_orders").cast("double").alias("n_orders"),
    )
    return base.select("company_id", "year", *[
        F.expr(re.sub(r"(\d+\.\d+)", r"\1D", e)).cast("double").alias(c) for c, e in FINANCIALS.items()
    ])


_BASE_SQL = """
panel_base AS (
  SELECT o_custkey AS company_id, cast(year(o_orderdate) AS int) AS year,
    cast(round(sum(ext),0) AS double)/1000.0 AS gross, cast(round(sum(ext*(1-disc)),0) AS double)/1000.0 AS net,
    cast(round(sum(ext*(1-disc)*tx),0) AS double)/1000.0 AS tax,
    cast(round(sum(CASE WHEN l_returnflag='R' THEN ext ELSE 0 END),0) AS double)/1000.0 AS ret,
    cast(round(sum(CASE WHEN l_linestatus='O' THEN ext ELSE 0 END),0) AS double)/1000.0 AS open,
    cast(sum(cast(l_quantity AS decimal(18,2))) AS double) AS qty, cast(count(*) AS double) AS n_lines,
    cast(count(DISTINCT l_orderkey) AS double) AS n_orders
  FROM (SELECT *, cast(l_extendedprice AS decimal(18,2)) AS ext, cast(l_discount AS decimal(4,2)) AS disc,
          cast(l_tax AS decimal(4,2)) AS tx FROM lineitem) l
  JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
"""
_PANEL_SQL = (
    "panel AS (SELECT company_id, year, "
    + ", ".join(
        f"cast({re.sub(r'([0-9]+[.][0-9]+)', lambda m: m.group(1) + 'e0', e)} AS double) AS {c}"
        for c, e in FINANCIALS.items()
    )
    + " FROM panel_base),\n"
)


def entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with orders: market, dates, status and parent."""
    span = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company_id")).agg(
        F.to_date(F.min("o_orderdate")).alias("established"),
        F.to_date(F.max("o_orderdate")).alias("last_seen"),
    )
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("company_id"), F.col("c_mktsegment").alias("market"),
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"),
    )
    gone = F.col("last_seen") < F.lit(EXIT_CUTOFF).cast("date")
    return span.join(cust, "company_id").select(
        "*", F.when(gone, "extinct").otherwise("active").alias("status"),
        F.when(gone, F.col("last_seen")).alias("extinction"),
        F.when(F.col("balance") < 0, F.col("company_id") - 1).alias("parent_id"),
        F.year("established").alias("start_year"), F.year("last_seen").alias("end_year"),
    )


_ENTITY_SQL = f"""
entity AS (
  SELECT *, CASE WHEN last_seen < DATE '{EXIT_CUTOFF}' THEN 'extinct' ELSE 'active' END AS status,
    CASE WHEN last_seen < DATE '{EXIT_CUTOFF}' THEN last_seen END AS extinction,
    CASE WHEN balance < 0 THEN company_id - 1 END AS parent_id,
    cast(year(established) AS int) AS start_year, cast(year(last_seen) AS int) AS end_year
  FROM (SELECT c_custkey AS company_id, c_mktsegment AS market, c_nationkey AS nation, c_acctbal AS balance,
          cast(min(o_orderdate) AS date) AS established, cast(max(o_orderdate) AS date) AS last_seen
        FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1,2,3,4)),
"""


def mpanel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with the entity's market and dates (1:1 key join, no hot key)."""
    e = entity(spark, sf_dir).select("company_id", "market", "nation", "status", "start_year", "end_year",
                                     "established", "extinction", "parent_id", "balance")
    return panel(spark, sf_dir).join(e, "company_id")


_MPANEL_SQL = """
mpanel AS (SELECT p.*, e.market, e.nation, e.status, e.start_year, e.end_year, e.established, e.extinction,
  e.parent_id, e.balance FROM panel p JOIN entity e USING (company_id)),
"""


def market_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier x ship year sales with the share of its nation's total."""
    li = table(spark, sf_dir, "lineitem")
    net = _cents("l_extendedprice") * (F.lit(100).cast("long") - _cents("l_discount"))
    sup = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("company_id"), F.col("s_nationkey").alias("market"))
    fact = (
        li.groupBy(F.col("l_suppkey").alias("company_id"), F.year("l_shipdate").alias("year"))
        .agg(exact_sum(net).alias("s"))
        .select("company_id", "year", _thousands(F.col("s"), 4).alias("sales"))
        .join(sup, "company_id")
    )
    tot = fact.groupBy("market", "year").agg(F.sum("sales").alias("market_size"))
    return fact.join(tot, ["market", "year"]).withColumn("share", F.col("sales") / F.col("market_size"))


_SHARE_SQL = """
share_base AS (
  SELECT s_nationkey AS market, cast(year(l_shipdate) AS int) AS year, l_suppkey AS company_id,
    cast(round(sum(cast(l_extendedprice AS decimal(18,2))*(1-cast(l_discount AS decimal(4,2)))),0) AS double)/1000.0 AS sales
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1,2,3),
market_share AS (SELECT *, sales/market_size AS share FROM (
  SELECT *, sum(sales) OVER (PARTITION BY market, year) AS market_size FROM share_base)),
"""


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration in days from first to last order; event = gone before the cutoff."""
    end = F.coalesce(F.col("extinction"), F.lit(STUDY_LAST_DAY).cast("date"))
    return entity(spark, sf_dir).select(
        "company_id", "market", "nation", "balance", "established",
        F.datediff(end, F.col("established")).alias("duration"),
        (F.col("status") == "extinct").cast("int").alias("event"),
    )


_SURV_SQL = f"""
surv AS (SELECT company_id, market, nation, balance, established,
  cast(date_diff('day', established, coalesce(extinction, DATE '{STUDY_LAST_DAY}')) AS int) AS duration,
  CASE WHEN status = 'extinct' THEN 1 ELSE 0 END AS event FROM entity),
"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth-class stage per customer-year from the change of revenue."""
    from ..functions.windows import growth

    g = F.col("g")
    return mpanel(spark, sf_dir).withColumn("g", growth("revenue")).withColumn(
        "stage",
        F.when(g.isNull(), "startup").when(g > 0.3, "growth").when(g > -0.3, "maturity").otherwise("decline"),
    )


_STAGES_SQL = """
stages AS (SELECT *, CASE WHEN g IS NULL THEN 'startup' WHEN g > 0.3 THEN 'growth' WHEN g > -0.3 THEN 'maturity'
    ELSE 'decline' END AS stage
  FROM (SELECT *, revenue/nullif(lag(revenue) OVER (PARTITION BY company_id ORDER BY year),0)-1 AS g FROM mpanel)),
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ledger: establishment, extinction and spin-off dates of customers."""
    e = entity(spark, sf_dir)
    cols = ["company_id", "market"]
    est = e.select(*cols, F.lit("establishment").alias("event_type"), F.col("established").alias("event_date"))
    ext = e.where("extinction is not null").select(
        *cols, F.when(F.col("balance") < 0, "bankruptcy").otherwise("dissolution").alias("event_type"),
        F.col("extinction").alias("event_date"))
    spin = e.where("parent_id is not null").select(
        *cols, F.lit("spinoff").alias("event_type"), F.col("established").alias("event_date"))
    return est.unionByName(ext).unionByName(spin)


_LEDGER_SQL = """
ledger AS (
  SELECT company_id, market, 'establishment' AS event_type, established AS event_date FROM entity
  UNION ALL SELECT company_id, market, CASE WHEN balance < 0 THEN 'bankruptcy' ELSE 'dissolution' END, extinction
    FROM entity WHERE extinction IS NOT NULL
  UNION ALL SELECT company_id, market, 'spinoff', established FROM entity WHERE parent_id IS NOT NULL),
"""


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel on the full year grid: years without orders are null (true gaps)."""
    from ..operators.align import align

    e = entity(spark, sf_dir)
    p = panel(spark, sf_dir).select("company_id", "year", "revenue", "employees", "total_assets", "net_profit")
    return align(p, e, STUDY_START, STUDY_END, carry=["market", "start_year", "end_year", "status"])


_HOLED_SQL = f"""
holed AS (SELECT e.company_id, y.year, e.market, e.start_year, e.end_year, e.status,
    y.year BETWEEN e.start_year AND e.end_year AS exists_flag,
    p.revenue, p.employees, p.total_assets, p.net_profit
  FROM entity e CROSS JOIN (SELECT cast(unnest(range({STUDY_START}, {STUDY_END + 1})) AS int) AS year) y
  LEFT JOIN panel p ON p.company_id = e.company_id AND p.year = y.year),
"""

def competition(spark: SparkSession, sf_dir: str, share: bool = True) -> DataFrame:
    """Panel in percent terms with the share of the (market, year) total.

    The totals take a second pass over the line items; without ``share`` the same rows come from one.
    """
    from ..functions.cols import sd
    from ..functions.windows import growth

    p = mpanel(spark, sf_dir)
    p = p.where("market is not null and year is not null")  # as the join with the totals keeps them
    ratios = {"margin": ("operating_profit", "revenue"), "roe": ("net_profit", "shareholders_equity"),
              "cost_ratio": ("cost_of_sales", "revenue"), "rd_ratio": ("rd_expenses", "revenue"),
              "ad_ratio": ("advertising_expenses", "revenue"), "capex_ratio": ("capex", "revenue")}
    d = p
    if share:
        d, ratios["share"] = p.join(p.groupBy("market", "year").agg(F.sum("revenue").alias("_t")), ["market", "year"]), ("revenue", "_t")
    return d.select(
        *p.columns, *[(sd(a, b) * 100.0).alias(k) for k, (a, b) in ratios.items()],
        (growth("revenue") * 100.0).alias("growth"))


_COMP_SQL = """
comp AS (SELECT *, operating_profit/revenue*100 AS margin, net_profit/nullif(shareholders_equity,0)*100 AS roe, cost_of_sales/revenue*100 AS cost_ratio,
  rd_expenses/revenue*100 AS rd_ratio, advertising_expenses/revenue*100 AS ad_ratio, capex/revenue*100 AS capex_ratio,
  revenue/sum(revenue) OVER (PARTITION BY market, year)*100 AS share,
  (revenue/nullif(lag(revenue) OVER (PARTITION BY company_id ORDER BY year),0)-1)*100 AS growth FROM mpanel),
"""

def staged(spark: SparkSession, sf_dir: str, share: bool = True) -> DataFrame:
    """Competition panel (see there for ``share``) with the growth-class stage and the debt ratio in percent."""
    from ..functions.cols import ladder, sd

    g = F.col("growth")
    stage = ladder([(g.isNull(), "startup"), (g > 30, "growth"), (g > -30, "maturity")], "decline")
    return competition(spark, sf_dir, share).select("*", stage.alias("stage"),
                                             (sd("total_liabilities", "total_assets") * 100).alias("debt"))


_LC_SQL = """
lc AS (SELECT *, CASE WHEN growth IS NULL THEN 'startup' WHEN growth > 30 THEN 'growth' WHEN growth > -30 THEN 'maturity' ELSE 'decline' END AS stage,
  total_liabilities/total_assets*100 AS debt FROM comp),
"""

# view -> (definition, views it needs), in dependency order
_VIEWS = {
    "panel": (_BASE_SQL + _PANEL_SQL, []),
    "entity": (_ENTITY_SQL, []),
    "mpanel": (_MPANEL_SQL, ["panel", "entity"]),
    "market_share": (_SHARE_SQL, []),
    "surv": (_SURV_SQL, ["entity"]),
    "stages": (_STAGES_SQL, ["mpanel", "panel", "entity"]),
    "comp": (_COMP_SQL, ["mpanel", "panel", "entity"]),
    "lc": (_LC_SQL, ["comp", "mpanel", "panel", "entity"]),
    "ledger": (_LEDGER_SQL, ["entity"]),
    "holed": (_HOLED_SQL, ["panel", "entity"]),
}


def oracle_views(sql: str) -> str:
    """The WITH entries that a checking SQL text refers to."""
    need: set[str] = set()
    for v, (_, deps) in _VIEWS.items():
        if re.search(rf"\b{v}\b", sql):
            need |= {v, *deps}
    return "".join(d for v, (d, _) in _VIEWS.items() if v in need)
