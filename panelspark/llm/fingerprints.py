"""Document fingerprints: SimHash of weighted terms, and searches through permuted block tables (DataFrame functions only)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable
from .common import partitions, settled, words

#: Terms per chunk: at weight 3, their votes on one bit stay below 128, so that the lanes of a signed long hold them.
CHUNK = 42
RADIUS = 3
#: Six blocks of the 64 bits; RADIUS differing bits leave three of them alike.
WIDTHS = (11, 11, 11, 11, 10, 10)
TABLES = list(combinations(range(6), 3))


def with_fingerprint(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add ``into``, the 64-bit SimHash (long) of a text's distinct words.

    A word votes on each bit by the sign of its hash's bit, with weight 1 to 3 by its length (longer words tell
    more).  Votes of eight bits are added at once in the bytes of a long.  No words: 0.
    """
    t, c = "_terms", "_votes"
    weight = lambda w: F.least(F.lit(3), F.floor((F.length(w) + 3) / 4)).cast("long")
    out = df.withColumn(t, settled(F.transform(F.array_distinct(words(F.col(text))), lambda w: F.struct(F.xxhash64(w).alias("h"), weight(w).alias("w")))))
    out = out.withColumn(c, settled(F.expr(
        f"transform(sequence(0, greatest(size({t}) - 1, 0), {CHUNK}), s -> transform(sequence(0, 7), j -> aggregate("
        f"slice({t}, s + 1, {CHUNK}), 0L, (a, x) -> a + x.w * (shiftrightunsigned(x.h, j) & 72340172838076673L))))")))
    out = out.withColumn("_all", settled(F.expr(f"aggregate({t}, 0L, (a, x) -> a + x.w)")))
    bit = f"aggregate({c}, 0L, (n, v) -> n + (shiftrightunsigned(v[b % 8], cast(8 * (b div 8) as int)) & 255L))"
    return out.withColumn(into, settled(F.expr(
        f"aggregate(sequence(0, 63), 0L, (a, b) -> if(2 * {bit} > _all, a | shiftleft(1L, b), a))"))).drop(t, c, "_all")


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64.0


def hexed(c: str) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def next_rows(keys: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ``keys`` (distinct) with struct ``next``: the row that follows by ``order``, nulls first; the first after the last.

    Rows are placed by range, each partition looks ahead by itself, and the first rows of partitions (one each) close the gaps.
    """
    place = F.struct(*[x for c in order for x in (F.col(c).isNotNull().alias(f"k_{c}"), F.col(c))])
    all_ = F.struct(*[F.col(c) for c in keys.columns])
    placed = reliable(keys.withColumn("_place", place).withColumn("_self", all_).repartitionByRange(
        partitions(keys.sparkSession), "_place").withColumn("_part", F.spark_partition_id()))
    heads = placed.groupBy("_part").agg(F.min_by("_self", "_place").alias("head"))
    after = Window.orderBy("_part").rowsBetween(1, 1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("_part", F.coalesce(F.first("head").over(after), F.first("head").over(every)).alias("after"))
    w = Window.partitionBy("_part").orderBy("_place")
    return placed.withColumn("_lead", F.lead("_self").over(w)).join(F.broadcast(heads), "_part").select(
        *keys.columns, F.coalesce("_lead", "after").alias("next"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fp, edited_sha256, edited_fp and next_fp of every row.

    A text's last quarter gives way to as many first characters of the next document's.  Null texts are empty; rows
    equal in doc_id and text count as one document in the order; the order is by doc_id, nulls first, then by the
    text's hash.  Texts are shuffled once by key; what the joins move besides is a quarter of them.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = own.select("doc_id", "h", F.length("text").cast("long").alias("n")).distinct()
    chain = next_rows(keys, ["doc_id", "h"]).select(
        F.col("doc_id").alias("a_id"), F.col("h").alias("a_h"), F.floor(F.col("n") / 4).cast("int").alias("need"),
        F.col("next.doc_id").alias("b_id"), F.col("next.h").alias("b_h"))
    # both joins use the same columns of ``own`` and so read one exchange; fingerprints come after it
    ends = own.join(chain, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("h") == F.col("b_h"))).select(
        "a_id", "a_h", "b_id", "b_h", F.expr("left(text, need)").alias("end")).dropDuplicates(["a_id", "a_h"])
    both = own.join(ends, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("h") == F.col("a_h"))).select(
        "doc_id", "h", "b_id", "b_h", F.length("text").cast("long").alias("n_chars"), "text",
        F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 4) as int))"), "end").alias("edit"))
    rows = with_fingerprint(with_fingerprint(both, "text", "fp"), "edit", "edited_fp").withColumn("edited_sha256", F.sha2("edit", 256))
    rows = reliable(rows.drop("edit", "text"))
    after = rows.select(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h"), F.col("fp").alias("next_fp")).distinct()
    return rows.join(after, F.col("b_id").eqNullSafe(F.col("c_id")) & (F.col("b_h") == F.col("c_h"))).drop("h", "b_id", "b_h", "c_id", "c_h")


def block_keys(df: DataFrame, fp: str = "fp") -> DataFrame:
    """A row per table: the fingerprint's bits in that table's three blocks."""
    starts = [sum(WIDTHS[:i]) for i in range(6)]
    mask = [((1 << w) - 1) << s for w, s in zip(WIDTHS, starts)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    rows = F.array(*[F.struct(F.lit(i).alias("table"), F.col(fp).bitwiseAND(F.lit(signed(sum(mask[b] for b in t))).cast("long")).alias("key"))
                     for i, t in enumerate(TABLES)])
    return df.select("*", F.explode(rows).alias("_t")).select(*df.columns, "_t.table", "_t.key")


def within_radius(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(q, fp) of each distinct query fingerprint ``q`` and index fingerprint ``fp`` at RADIUS or fewer differing bits, each pair once.

    Exact: some three blocks of such a pair agree.  A pair that agrees in more is taken from its first table only.
    A block key that many fingerprints share is a skewed join key, which adaptive execution splits.
    """
    starts = [sum(WIDTHS[:i]) for i in range(6)]
    differ = lambda g: f"(shiftrightunsigned(q ^ fp, {starts[g]}) & {(1 << WIDTHS[g]) - 1}L) <> 0"
    first = "case " + " ".join(f"when q_table = {i} then " + (" and ".join(differ(g) for g in range(t[2]) if g not in t) or "true")
                               for i, t in enumerate(TABLES)) + " end"
    q = block_keys(queries.select("q").distinct(), "q").select("q", F.col("table").alias("q_table"), F.col("key").alias("q_key"))
    return q.join(block_keys(index.select("fp").distinct()), F.expr(f"q_table = table and q_key = key and bit_count(q ^ fp) <= {RADIUS} and {first}")).select("q", "fp")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and edited texts, their likeness (1 - differing bits / 64), and ``n_within``: for rows whose
    doc_id is divisible by 50, the rows with fingerprints within RADIUS bits (itself included); null for others."""
    rows = reliable(edited(docs))
    index = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    near = within_radius(rows.where("doc_id % 50 = 0").select(F.col("fp").alias("q")), index)
    counts = near.join(index, "fp").groupBy("q").agg(F.sum("n").alias("within"))
    out = rows.join(counts, rows.fp == counts.q, "left")
    return out.select("doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"),
                      likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
                      F.when(F.col("doc_id") % 50 == 0, F.col("within")).alias("n_within"))
