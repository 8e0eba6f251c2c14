"""Periodic runs of words by seeds and diagonals.

A run is a maximal stretch with smallest period q and at least ``max(LEAST, TIMES * q)`` words.  On the diagonal of
lag q (word i against word i + q) it shows as a stretch of ``length - q`` equal words, so it holds a repeated k-gram
wherever k is at most that overlap.  Lags fall into classes by that guaranteed overlap: lags up to 16 hold 16-grams,
lags of 17 to 32 hold 32-grams, lags of 33 to 64 hold 64-grams, and so on; k is never below the lag.

* Index: k-grams get names by doubling (the name of a 2k-gram is that of its two halves), so equal names mean equal
  words.  A gram that occurs once is dropped, and so is every longer gram that contains it.
* Seeds: an occurrence is paired with the next one of the same gram only.  With k >= q no other pair is needed: two
  occurrences closer than q inside the run would give it a smaller period.  So a text has one pair a position and class.
* Extension: seeds are taken by lag and place, extended both ways to the first unequal word, and a table of the
  furthest covered place of each lag passes over the seeds inside what is already extended.

A document is a row and its words stay in one task; nothing is shuffled, and time is n log n in the words of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, words

LEAST, TIMES = 24, 3
#: The least overlap of any run on its diagonal: max(24 - q, 2 * q) is smallest at q = 8.
SEED = 16
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def named_words(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a text (between spaces and ASCII control white space) and a number for each distinct one."""
    found = text.split()
    names: dict[bytes, int] = {}
    return found, np.fromiter((names.setdefault(w, len(names)) for w in found), np.int64, len(found))


def repeated(key: np.ndarray) -> np.ndarray:
    """A name for each key that occurs twice or more, -1 for others; negative keys are no keys."""
    out = np.full(len(key), -1, np.int64)
    at = np.flatnonzero(key >= 0)
    if len(at):
        _, name, count = np.unique(key[at], return_inverse=True, return_counts=True)
        out[at] = np.where(count[name] > 1, name, -1)
    return out


def doubled(names: np.ndarray, k: int) -> np.ndarray:
    """Names of the 2k-grams from the names of the k-grams."""
    a, b = names[:-k], names[k:]
    return repeated(np.where((a >= 0) & (b >= 0), a * (len(names) + 1) + b, -1))


def seeds(names: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Lags and places, in that order, of the pairs of neighbouring occurrences with low < lag <= high."""
    at = np.flatnonzero(names >= 0)
    at = at[np.argsort(names[at], kind="stable")]
    lag = np.diff(at)
    fit = (names[at[1:]] == names[at[:-1]]) & (lag > low) & (lag <= high)
    place, lag = at[:-1][fit], lag[fit]
    order = np.lexsort((place, lag))
    return lag[order], place[order]


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items of two equally long arrays are equal."""
    at, step = 0, 64
    while at < len(a):
        unlike = np.flatnonzero(a[at:at + step] != b[at:at + step])
        if len(unlike):
            return at + int(unlike[0])
        at, step = at + step, step * 2
    return len(a)


def runs(word: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text given as word numbers, by start, then period."""
    n, found = len(word), []
    names, k = repeated(word), 1
    while k < SEED and len(names) > k and (names >= 0).any():
        names, k = doubled(names, k), 2 * k
    covered: dict[int, int] = {}
    while k >= SEED and (names >= 0).any():
        lags, places = seeds(names, k // 2 if k > SEED else 0, min(k, n // TIMES))
        # seeds that follow each other on one diagonal extend alike: only the first of them is tried
        first = np.ones(len(lags), bool)
        first[1:] = (np.diff(lags) != 0) | (np.diff(places) != 1)
        for q, i in zip(lags[first].tolist(), places[first].tolist()):
            if i < covered.get(q, 0):
                continue
            left = i - agreement(word[:i][::-1], word[q:q + i][::-1])
            end = i + agreement(word[i:n - q], word[i + q:])
            covered[q] = end
            if end - left + q >= max(LEAST, TIMES * q):
                found.append((left, end - left + q, q))
        if len(names) <= k:
            break
        names, k = doubled(names, k), 2 * k
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(found: list[bytes], spans: list[tuple[int, int, int]]) -> bytes:
    """The words without what a run repeats after its first period, joined by one space."""
    if not spans:
        return b" ".join(found)
    keep = np.ones(len(found), bool)
    for start, length, period in spans:
        keep[start + period:start + length] = False
    return b" ".join([found[i] for i in np.flatnonzero(keep)])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with ``runs`` (by start, then period) and the ``collapsed`` text.

    Clashing names get an underscore.  Null and empty texts have no run and collapse to an empty text; repeated rows
    stay; a text of one word repeated is one run; texts of any length are read whole.  Arrow batches hold whole texts:
    where they are very long, lower ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    at = docs.columns.index(text)
    kept = [c for c in docs.columns if c != text]
    names = fresh(docs.drop(text), "runs", "collapsed")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, texts = [], []
            for t in b.column(at).cast(pa.binary()):
                found, word = named_words(t.as_py() or b"")
                own = runs(word)
                spans.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                texts.append(collapsed(found, own))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(b.num_columns) if i != at], pa.array(spans, kind), pa.array(texts, pa.binary()).cast(pa.string())],
                [*kept, *names])

    return docs.mapInArrow(scan, ", ".join([*fields, f"`{names[0]}` array<{RUN}>", f"`{names[1]}` string"]))


def strongest(spans: Column) -> Column:
    """The run of greatest exact length / period; ties by smallest start, then period; null where there is none."""

    def order(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        less = (x > y) | ((x == y) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
        return F.when(less, -1).otherwise(F.when((x == y) & (a["start"] == b["start"]) & (a["period"] == b["period"]), 0).otherwise(1))

    return F.get(F.array_sort(spans, order), F.lit(0))


def digest_of_runs(spans: Column) -> Column:
    lines = F.transform(spans, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)


def with_planted_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where the texts of keys with crc32(key) % 10 = 0 repeat a stretch from a word on to their end.

    With h = crc32(key), g = h div 10 and n words, the words from a = g % n on repeat the p = 1 + (n - a) div (3 + g % 8)
    words that start there.  Texts without a word and rows without a key stay as they are.
    """
    h = F.crc32(F.col(key).cast("string"))
    g, w = F.floor(h / 10).cast("long"), words(F.col(text))
    n = F.size(w).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    tail = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    edited = F.concat_ws(" ", F.slice(w, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return docs.withColumn(text, F.when((h % 10 == 0) & (n > 0), edited).otherwise(F.col(text)))
