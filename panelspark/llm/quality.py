"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Each rule rejects a document whose score exceeds the rule's cutoff in the document's stratum.  Labelled good
documents decide which cutoffs are allowed: a cutoff is certified when the exact binomial tail
P(Bin(n, risk) <= k), for k of n good documents rejected, is at most the error level.  Cutoffs of a rule are
tested from the most lenient on and testing stops at the first failure (fixed sequence), and the error level is
divided by the number of rules and strata (Bonferroni), so with probability ``1 - error`` all chosen cutoffs
hold at once.  The risk of a stratum is divided by the number of rules, so that a stratum loses at most ``risk``
of its good documents to all rules together.  Among certified cutoffs the one that catches most bad documents
for the good ones it costs is used; with none certified the rule is silent there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable
from .common import fresh, words

#: Cutoffs of each rule, most lenient first.
CUTOFFS = {
    "symbols_per_word": (5.0, 3.0, 2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.45, 0.3, 0.2, 0.1),
    "shouts_per_word": (3.0, 2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1),
    "capital_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeat_share": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
}
#: One good document lost weighs as much as so many bad ones caught (as shares).
LOSS_WEIGHT = 10.0
#: Strata whose cutoffs are sent to every task; more of them are joined.
FEW_STRATA = 10_000


def measured(df: DataFrame, text: str = "text", into: str = "m") -> DataFrame:
    """Add struct ``into`` with the base measures and the rule scores of each whole text (null text: empty).

    All work is per row, so nothing is shuffled.  Windows are compared by 64-bit hash and then by their words.
    """
    w, h, s = fresh(df, "_words", "_windows", "_sorted")
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.size(w)
    out = df.withColumn(w, words(F.col(text)))
    out = out.withColumn(h, F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )).otherwise(F.array().cast("array<bigint>")))
    # most texts repeat no window: only the others are sorted
    out = out.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(
        F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    at = lambda a, b, k: F.get(w, a["i"] + k) == F.get(w, b["i"] + k)
    pairs = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(
        (a["h"] == b["h"]) & at(a, b, 0) & at(a, b, 1) & at(a, b, 2), F.array(a["i"], b["i"])))
    starts = F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda keep: F.length(F.regexp_replace(t, keep, "")).cast("long")
    (b,) = fresh(df, "_base")
    # the row number (always 0 or more) keeps the optimizer from repeating these expressions inside later filters
    out = out.withColumn(b, F.struct(
        F.when(F.monotonically_increasing_id() >= 0, n).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        count(r"[^!]+").alias("n_shouts"),
        count(r"[^\p{Lu}]+").alias("n_capitals"),
    ))
    per = lambda x, y: F.col(f"{b}.{x}") / F.greatest(F.col(f"{b}.{y}"), F.lit(1))
    return out.withColumn(into, F.struct(
        f"{b}.n_words", f"{b}.word_chars", f"{b}.n_symbols", f"{b}.n_dup_lines", f"{b}.n_repeat_words",
        per("n_symbols", "n_words").alias("symbols_per_word"),
        per("n_shouts", "n_words").alias("shouts_per_word"),
        per("n_capitals", "word_chars").alias("capital_share"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"),
        per("n_repeat_words", "n_words").alias("repeat_share"),
    )).drop(w, h, s, b)


def base_failed(m: str = "m") -> Column:
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def log_gamma(x: Column) -> Column:
    """Stirling's series, shifted to arguments over 8: right to about 1e-13."""
    y = x + 8
    shift = sum((F.log(x + k) for k in range(8)), F.lit(0.0))
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact to double precision for k below the mean; 1 otherwise, as no test can pass there.

    Below the mean terms fall off on both ends of the range by a normal law at least, so 40 standard deviations
    (and 1,000 terms) under k hold all that a double can see.
    """
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    terms = F.least(k, 1000 + 40 * F.sqrt(n * p * (1 - p))).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] * (k - i + 1) * (1 - p) / ((n - k + i) * p)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, add, lambda a: a["total"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def calibrate(scored: DataFrame, stratum: str, good: str, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """Cutoffs per stratum and rule from labelled rows with a struct ``m``.

    ``good`` is 1 for good, 0 for bad; rows with a null label are left out.  A null stratum is a stratum.  Counts
    are summed on the map side to rules x cutoffs per stratum, so a hot stratum costs nothing extra.
    No labelled good row: empty result.
    """
    rows = scored.where(F.col(good).isNotNull()).select(F.col(stratum).alias("stratum"), F.col(good).cast("int").alias("good"), *[
        F.col(f"m.{r}").alias(r) for r in CUTOFFS])
    steps = [F.struct(F.lit(r).alias("rule"), sum((F.when(F.col(r) > c, 1).otherwise(0) for c in cs), F.lit(0)).alias("rejected_by"))
             for r, cs in CUTOFFS.items()]
    counts = rows.select("stratum", "good", F.explode(F.array(*steps)).alias("x")).groupBy("stratum", "x.rule", "x.rejected_by").agg(
        F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(len(cs) - i).alias("least"), F.lit(c).alias("cutoff"))
                     for r, cs in CUTOFFS.items() for i, c in enumerate(cs)])
    # a row that k of a rule's cutoffs reject is rejected by the k strictest, which come last
    cells = counts.select("*", F.explode(F.filter(grid, lambda g: g["rule"] == F.col("rule"))).alias("g")).groupBy(
        "stratum", "rule", F.col("g.step").alias("step"), F.col("g.cutoff").alias("cutoff")).agg(
        F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"),
        F.sum(F.when(F.col("rejected_by") >= F.col("g.least"), F.col("good")).otherwise(0)).alias("good_lost"),
        F.sum(F.when(F.col("rejected_by") >= F.col("g.least"), F.col("bad")).otherwise(0)).alias("bad_caught"))
    cells = cells.where("n_good > 0")
    strata = rows.where("good = 1").select("stratum").distinct().count()
    level = error / max(1, strata * len(CUTOFFS))
    w = Window.partitionBy("stratum", "rule").orderBy("step")
    tested = cells.withColumn("p_value", binomial_tail(F.col("good_lost"), F.col("n_good"), risk / len(CUTOFFS))).withColumn(
        "certified", F.min((F.col("p_value") <= level).cast("int")).over(w) == 1)
    gain = F.col("bad_caught") / F.greatest(F.col("n_bad"), F.lit(1)) - LOSS_WEIGHT * F.col("good_lost") / F.col("n_good")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), "step")
    return tested.where("certified").withColumn("gain", gain).where("gain > 0").withColumn("_k", F.row_number().over(best)).where(
        "_k = 1").drop("_k")


def judged(df: DataFrame, cutoffs: DataFrame, stratum: str, m: str = "m", into: str = "kept") -> DataFrame:
    """Add ``into``: true where no base rule and no certified cutoff rejects the row.

    The cutoffs of a stratum are one row (null is a stratum like any other).  They are broadcast where counted as few.
    """
    names = fresh(df, "_stratum", *[f"_cut_{r}" for r in CUTOFFS])
    wide = reliable(cutoffs.groupBy(F.col("stratum").alias(names[0])).agg(*[
        F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(c) for r, c in zip(CUTOFFS, names[1:])]))
    if wide.limit(FEW_STRATA + 1).count() <= FEW_STRATA:
        wide = F.broadcast(wide)
    bad = base_failed(m)
    for rule, c in zip(CUTOFFS, names[1:]):
        bad = bad | F.coalesce(F.col(f"{m}.{rule}") > F.col(c), F.lit(False))
    return df.join(wide, F.col(stratum).eqNullSafe(F.col(names[0])), "left").withColumn(into, ~bad).drop(*names)


def label_table(labels: DataFrame) -> DataFrame:
    """One good/bad label per document id; ids labelled both ways count as bad, null ids or labels go."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_good"))


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """Rows of ``docs`` that pass, with their columns as they came.

    A first pass measures the texts for the cutoffs and a second one filters, so no text is shuffled.  Null and
    empty texts have no words and go; repeated rows are judged alike; an empty table stays empty; no labels leave
    the base rules alone.
    """
    m, kept = fresh(docs, "_m", "_kept")
    cutoffs = calibrate(labelled(measured(docs.select("doc_id", "text", F.col(stratum).alias("stratum"))), labels),
                        "stratum", "_good", risk, error)
    scored = measured(docs, into=m)
    return judged(scored, cutoffs, stratum, m, kept).where(F.col(kept)).select(*[f"`{c}`" for c in docs.columns])


def labelled(scored: DataFrame, labels: DataFrame) -> DataFrame:
    return scored.select("doc_id", "stratum", "m").join(label_table(labels), "doc_id")
