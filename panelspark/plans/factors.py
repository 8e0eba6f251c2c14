"""Factor pack queries (inventory M26, M27, appendix A), one per family."""

from pyspark.sql import functions as F

from ..operators import factors as f
from ..sources import derive as d
from .registry import query

c = F.col
RANGE1 = "(PARTITION BY company_id ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
# layered views with the same named measures for the checking engine
VIEW = f"""f0 AS (SELECT *, start_year AS founding_year, CASE WHEN parent_id IS NOT NULL THEN start_year END AS succession_year, min(year) OVER (PARTITION BY company_id) AS entry_year FROM mpanel),
 f1 AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in f.ROW.items())} FROM f0),
 f2 AS (SELECT *, {', '.join(f'max({x}) OVER {RANGE1} AS p_{x}' for x in f.PREVIOUS)} FROM f1),
 f3 AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in f.GROWTH.items())} FROM f2),
 f4 AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in f.COMPOSITE.items())} FROM f3)"""
# measures from year windows are compared by the brute-force test instead
WINDOWED = {"innovation_cycle", "expansion_rate", "capital_trend", "cf_stability", "revenue_stability", "profit_stability", "adaptation", "innovation_frequency", "scaling", "diffusion", "synergy", "-", *f.FINAL}


def panel(spark, sf):
    return d.mpanel(spark, sf).withColumn("founding_year", c("start_year")).withColumn("succession_year", F.when(c("parent_id").isNotNull(), c("start_year")))


def _register(fam: str) -> None:
    ids = [(f"{fam}_{i:02d}", x) for i, x in enumerate(f.FAMILIES[fam], 1) if x not in WINDOWED]
    ok = {"growth": "p_revenue IS NOT NULL", "roe": "shareholders_equity <> 0", "survival": "true", "emergence": "true", "succession": "true"}.get(fam, "revenue <> 0")
    sql = f"WITH {VIEW} SELECT company_id, year, {', '.join(f'CASE WHEN {ok} THEN {x} END AS {k}' for k, x in ids)} FROM f4"

    @query(f"factors_{fam}", "M26 M27 appendix-A", "company_id year", " ".join(k for k, _ in ids), sql)
    def _(spark, sf):
        return f.factors(panel(spark, sf), [fam])


for _fam in f.FAMILIES:
    _register(_fam)


@query("factor_facts", "M26 IO9", "factor n", "mean")
def _(spark, sf):
    """All 207 factors in long form, summarized."""
    return f.factor_facts(f.factors(panel(spark, sf))).groupBy("factor").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
