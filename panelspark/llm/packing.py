"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

A bin holds at most one piece of each source and of each duplicate cluster.  Bins are ordered by residual; for a piece
the search starts at the least residual that holds it and goes to successors until a bin's bitmaps have neither the
piece's source nor its cluster.  Documents longer than a bin are cut: whole bins first, then the rest.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable
from .common import n_words

CAPACITY = 2048
GROUP = 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each item, in the given order; sources and clusters are bit numbers, -1 for none."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by residual, in order of entry
    open_ = 0  # bit r: a bin of residual r exists
    marks: list[tuple[int, int]] = []
    out = []
    for size, s, c in zip(sizes, sources, clusters):
        sb, cb = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        rest, chosen, place = open_ >> size, -1, 0
        r = size - 1
        while rest and chosen < 0:
            step = (rest & -rest).bit_length()
            r += step
            rest >>= step
            for place, b in enumerate(free[r]):
                if not (marks[b][0] & sb or marks[b][1] & cb):
                    chosen = b
                    break
        if chosen < 0:
            chosen, r = len(marks), capacity
            marks.append((0, 0))
        else:
            del free[r][place]
            if not free[r]:
                open_ &= ~(1 << r)
        out.append((chosen, capacity - r))
        marks[chosen] = (marks[chosen][0] | sb, marks[chosen][1] | cb)
        if r > size:
            free[r - size].append(chosen)
            open_ |= 1 << (r - size)
    return out


def _bits(values: pd.Series) -> list[int]:
    """A bit number for each value met more than once; others can never conflict."""
    code, _ = pd.factorize(values, use_na_sentinel=False)
    often = pd.Series(code).map(pd.Series(code).value_counts()) > 1
    dense, _ = pd.factorize(pd.Series(code).where(often))
    return dense.tolist()


def packed(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, group, bin, bin_offset.

    ``cluster`` marks copies (default: equal texts, by 64-bit hash); no bin gets two of a cluster, nor two of a source.
    Pieces are dealt at random into groups of about ``group`` pieces, each packed in one task, so a hot source or a
    group of copies spreads over all groups and memory does not grow with the input.  A null source is a source; null or
    empty texts have one piece of no words; repeated rows are pieces of their own.
    """
    text = F.col("text")
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(text).alias("size"),
                       (F.xxhash64(F.coalesce(text, F.lit(""))) if cluster is None else cluster).alias("cluster"))
    pieces = base.select("doc_id", "source", "size", "cluster", F.posexplode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("size") - 1), F.lit(capacity).cast("long"))).alias("piece", "first_word"))
    pieces = pieces.withColumn("n_words", F.least(F.col("size") - F.col("first_word"), F.lit(capacity).cast("long"))).drop("size")
    pieces = reliable(pieces.withColumn("_r", F.monotonically_increasing_id()))
    groups = max(1, -(-pieces.count() // group))

    def pack(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["n_words", "doc_id", "piece", "_r"], ascending=[False, True, True, True])
        got = best_fit(b["n_words"].tolist(), _bits(b["source"]), _bits(b["cluster"]), capacity)
        return b.assign(bin=[x for x, _ in got], bin_offset=[x for _, x in got])[["doc_id", "piece", "first_word", "n_words", "group", "bin", "bin_offset"]]

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return pieces.withColumn("group", F.pmod(F.xxhash64("_r", "doc_id"), F.lit(groups))).groupBy("group").applyInPandas(
        pack, f"doc_id {kind}, piece int, first_word long, n_words long, group long, bin long, bin_offset long")
