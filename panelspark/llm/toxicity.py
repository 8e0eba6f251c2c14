"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the sum of its own vector (words met often in training) and the mean vector of its character
3- to 5-grams, all of the word with its ends marked.  Two GRUs read a window of WINDOW words in both directions, attention pools their states,
and a logistic unit scores the window.  Windows overlap by half and cover every whole text; a document's score is its
highest window's, mapped to a probability on training documents held back for that.  Labels are given per document,
so training picks the windows: the most suspicious of each document, first by log-odds, then by the model itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

WINDOW, STRIDE = 32, 16
DIM, HIDDEN, BUCKETS = 12, 8, 1 << 15
#: Lengths of the character grams of a word.
GRAMS = (3, 4, 5)
#: Bounded training sample: so many documents of each label, by hash, of at most so many characters.
TOXIC_DOCS, CLEAN_DOCS, TRAIN_CHARS = 1500, 3000, 20_000
#: Words whose inputs a worker keeps.
CACHE = 200_000
WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def gram_table(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all character grams of the words (ends marked), word after word, and their number per word."""
    raw = [f"^{w}$" for w in vocabulary]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer("".join(raw).encode("utf-32-le"), np.uint32)
    end = np.repeat(np.cumsum(size), size)
    count = sum(np.maximum(size - n + 1, 0) for n in GRAMS)
    out = np.zeros(count.sum(), np.int64)
    place = np.cumsum(count) - count
    for n in GRAMS:
        own = np.maximum(size - n + 1, 0)
        at = np.flatnonzero(np.arange(len(data)) + n <= end)
        h = np.full(len(at), n, np.uint32)
        for j in range(n):
            h = (h ^ data[at + j]) * np.uint32(16777619)
        out[np.repeat(place - np.cumsum(own) + own, own) + np.arange(len(at))] = (h ^ (h >> 15)) % BUCKETS
        place = place + own
    return out, count


def gram_sums(table: np.ndarray, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``table`` over the grams of each word; so many grams at a time that long words fit memory."""
    out = np.zeros((len(count), *table.shape[1:]), table.dtype)
    owner = np.repeat(np.arange(len(count)), count)
    for s in range(0, len(gram), 1 << 18):
        own = owner[s:s + (1 << 18)]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first]] += np.add.reduceat(table[gram[s:s + (1 << 18)]], first)
    return out


def grams_of(gram: np.ndarray, count: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """gram and count of the chosen words."""
    size = count[chosen]
    return gram[np.repeat((np.cumsum(count) - count)[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())], size


def window_starts(n: int) -> list[int]:
    """Starts of windows over n words: every STRIDE words until the last word is covered."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    def __init__(self, vocabulary: dict[str, int], seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s, k=0.2: (r.standard_normal(s) * k).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": f(len(vocabulary) + 1, DIM, k=0.05), "gram": f(BUCKETS, DIM, k=0.05), "w": f(2, DIM, 3 * HIDDEN), "b": np.zeros((2, 3 * HIDDEN), np.float32),
                  "u": f(2, HIDDEN, 3 * HIDDEN), "q": f(2 * HIDDEN), "v": f(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        self.p["word"][0] = 0

    def vectors(self, ids: np.ndarray, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.p["word"][ids] + gram_sums(self.p["gram"], gram, count) / count[:, None].astype(np.float32)

    def run(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        """Logits of windows; x: (2, T, B, 3 HIDDEN) gate inputs per direction, live: (T, B) 1 where there is a word."""
        p, (_, steps, size, _) = self.p, x.shape
        states, tape = np.zeros((steps, size, 2 * HIDDEN), np.float32), [[], []]
        for d in (0, 1):
            h, u = np.zeros((size, HIDDEN), np.float32), p["u"][d]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g = h @ u
                zr = sigmoid(x[d, t, :, :2 * HIDDEN] + g[:, :2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = np.tanh(x[d, t, :, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
                m = live[t][:, None]
                new = h + m * (1 - z) * (n - h)
                if keep:
                    tape[d].append((t, h, z, r, n, g[:, 2 * HIDDEN:], m))
                h = new
                states[t, :, d * HIDDEN:(d + 1) * HIDDEN] = h
        s = states @ p["q"] + np.where(live > 0, 0, -1e9).astype(np.float32)
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * states).sum(axis=0)
        logit = pooled @ p["v"] + p["c"][0]
        return (logit, states, a, pooled, tape) if keep else logit

    def step(self, ids, gram, count, place, live, y, rate: float, memory: dict) -> float:
        """One Adagrad step on windows: ``place`` (T, B) points into the unique words ids / gram / count."""
        p = self.p
        vec = self.vectors(ids, gram, count)
        xs = vec[place]
        x = np.stack([xs @ p["w"][d] + p["b"][d] for d in (0, 1)])
        logit, states, a, pooled, tape = self.run(x, live, keep=True)
        prob = sigmoid(logit)
        dl = ((prob - y) / len(y)).astype(np.float32)
        grad = {"v": pooled.T @ dl, "c": dl.sum(keepdims=True), "u": np.zeros_like(p["u"]), "w": np.zeros_like(p["w"]), "b": np.zeros_like(p["b"])}
        dpool = dl[:, None] * p["v"]
        da = (states * dpool[None]).sum(axis=2)
        ds = a * (da - (a * da).sum(axis=0))
        grad["q"] = (ds[:, :, None] * states).sum(axis=(0, 1))
        dstates = a[:, :, None] * dpool[None] + ds[:, :, None] * p["q"]
        dx_all = np.zeros_like(xs)
        for d in (0, 1):
            dh, u = np.zeros((len(y), HIDDEN), np.float32), p["u"][d]
            for t, h, z, r, n, gn, m in reversed(tape[d]):
                dh = dh + dstates[t, :, d * HIDDEN:(d + 1) * HIDDEN]
                dn = dh * m * (1 - z) * (1 - n * n)
                dz = dh * m * (h - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dx = np.concatenate((dz, dr, dn), axis=1)
                dg = np.concatenate((dz, dr, dn * r), axis=1)
                grad["u"][d] += h.T @ dg
                grad["w"][d] += xs[t].T @ dx
                grad["b"][d] += dx.sum(axis=0)
                dx_all[t] += dx @ p["w"][d].T
                dh = dh * (1 - m * (1 - z)) + dg @ u.T
        dvec = np.zeros_like(vec)
        np.add.at(dvec, place.ravel(), dx_all.reshape(-1, DIM))
        grad["word"] = np.zeros_like(p["word"])
        np.add.at(grad["word"], ids, dvec)
        grad["word"][0] = 0
        grad["gram"] = np.zeros_like(p["gram"])
        np.add.at(grad["gram"], gram, np.repeat(dvec / count[:, None], count, axis=0))
        for k, g in grad.items():
            memory[k] = memory.get(k, 1e-6) + g * g
            p[k] -= (rate * g / np.sqrt(memory[k])).astype(np.float32)
        return float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))


def _coded(net: Network, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.fromiter((net.vocabulary.get(w, 0) for w in vocabulary), np.int64, len(vocabulary)), *gram_table(vocabulary)


class Scorer:
    """A trained network and the map from a document's highest logit to a probability."""

    def __init__(self, net: Network, slope: float = 1.0, shift: float = 0.0) -> None:
        self.net, self.slope, self.shift = net, slope, shift
        self.number: dict[str, int] = {}
        self.inputs = np.zeros((2, 0, 3 * HIDDEN), np.float32)

    def __getstate__(self):
        return {"net": self.net, "slope": self.slope, "shift": self.shift, "number": {}, "inputs": np.zeros((2, 0, 3 * HIDDEN), np.float32)}

    def _numbers(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Word numbers (1 on; 0 is no word) of the documents; inputs of words not met before are added."""
        if len(self.number) > CACHE:
            self.number, self.inputs = {}, self.inputs[:, :0]
        number, new, out = self.number, [], []
        for d in docs:
            for w in d:
                if w not in number:
                    number[w] = len(number) + 1
                    new.append(w)
            out.append(np.fromiter(map(number.__getitem__, d), np.int64, len(d)))
        if not self.inputs.shape[1]:
            self.inputs = np.zeros((2, 1, 3 * HIDDEN), np.float32)
        if new:
            vec = self.net.vectors(*_coded(self.net, new))
            self.inputs = np.concatenate((self.inputs, np.stack([vec @ self.net.p["w"][d] + self.net.p["b"][d] for d in (0, 1)])), axis=1)
        return out

    def window_logits(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Logits of all windows of each document (documents without words have none)."""
        coded = self._numbers(docs)
        counts = [len(window_starts(len(c))) if len(c) else 0 for c in coded]
        rows = np.zeros((sum(counts), WINDOW), np.int64)
        k = 0
        for c, m in zip(coded, counts):
            if m:
                padded = np.zeros((m - 1) * STRIDE + WINDOW, np.int64)
                padded[: len(c)] = c
                rows[k:k + m] = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]
                k += m
        out = np.zeros(len(rows), np.float32)
        for s in range(0, len(rows), 1024):
            place = rows[s:s + 1024].T
            out[s:s + 1024] = self.net.run(self.inputs[:, place], (place > 0).astype(np.float32))
        return np.split(out, np.cumsum(counts)[:-1]) if counts else []

    def scores(self, texts: list[str]) -> list[float]:
        """0 for a text without words."""
        out: list[float] = []
        docs, size = [], 0

        def flush() -> None:
            for x in self.window_logits(docs):
                out.append(float(sigmoid(np.float64(self.slope * x.max() + self.shift))) if len(x) else 0.0)
            docs.clear()

        for t in texts:
            docs.append(words(t))
            size += len(docs[-1])
            if size > 60_000:
                flush()
                size = 0
        flush()
        return out


def trained(texts: list[str], labels: list[int], rounds: int = 3, epochs: int = 2, seed: int = 0) -> Scorer:
    """Fit on whole documents with 0/1 labels; every fourth is held back for the map to probabilities."""
    docs = [words(t) for t in texts]
    y = np.array(labels, np.float32)
    fit = np.arange(len(docs)) % 4 != 3
    often = Counter(w for d, f in zip(docs, fit) if f for w in set(d))
    net = Network({w: i + 1 for i, w in enumerate(sorted(w for w, n in often.items() if n >= 5))}, seed)
    scorer = Scorer(net)
    if not len(docs) or y[fit].min(initial=1) == y[fit].max(initial=0):
        scorer.slope, scorer.shift = 0.0, -4.0
        return scorer
    # log-odds of words and grams over documents start the first component of their vectors
    known = sorted({w for d in docs for w in d})
    index = {w: j for j, w in enumerate(known)}
    ids, gram, count = _coded(net, known)
    coded = [np.fromiter(map(index.__getitem__, d), np.int64, len(d)) for d in docs]
    one = np.ones(len(known), np.int64)
    total = [1 + float((y[fit] == k).sum()) for k in (0, 1)]
    for name, of, per, size in (("word", ids, one, len(net.vocabulary) + 1), ("gram", gram, count, BUCKETS)):
        seen = np.zeros((2, size))
        for c, t, f in zip(coded, y, fit):
            if f:
                seen[int(t), np.unique(grams_of(of, per, np.unique(c))[0])] += 1
        odds = np.log((seen[1] + 0.5) / total[1]) - np.log((seen[0] + 0.5) / total[0])
        net.p[name][:, 0] = 0.5 * odds * np.minimum(1.0, seen.sum(axis=0) / 10)
    net.p["word"][0] = 0
    hint = net.p["word"][ids, 0] + gram_sums(net.p["gram"][:, :1], gram, count)[:, 0] / count
    rng, memory = np.random.default_rng(seed), {}
    positive, negative = np.flatnonzero(fit & (y == 1)), np.flatnonzero(fit & (y == 0))
    for k in range(rounds):
        picked: list[tuple[int, int, float]] = []
        logits = scorer.window_logits(docs) if k else [np.array([hint[c[s:s + WINDOW]].max() for s in window_starts(len(c)) if len(c)]) for c in coded]
        for i in positive:
            if len(logits[i]):
                picked.append((i, int(logits[i].argmax()) * STRIDE, 1.0))
        for i in negative:
            if len(logits[i]):
                picked.append((i, int(logits[i].argmax()) * STRIDE, 0.0))
                picked.append((i, int(rng.integers(len(logits[i]))) * STRIDE, 0.0))
        for _ in range(epochs):
            rng.shuffle(picked)
            for s in range(0, len(picked), 64):
                batch = picked[s:s + 64]
                place, live = np.full((WINDOW, len(batch)), -1), np.zeros((WINDOW, len(batch)), np.float32)
                for b, (i, at, _) in enumerate(batch):
                    own = coded[i][at:at + WINDOW]
                    place[: len(own), b], live[: len(own), b] = own, 1
                here, place = np.unique(place, return_inverse=True)
                net.step(ids[here], *grams_of(gram, count, here), place.reshape(WINDOW, len(batch)), live, np.array([t for *_, t in batch], np.float32), 0.05, memory)
        scorer.number, scorer.inputs = {}, scorer.inputs[:, :0]
    held = [i for i in np.flatnonzero(~fit) if docs[i]]
    top = np.array([x.max() for x in scorer.window_logits([docs[i] for i in held])], np.float64)
    scorer.slope, scorer.shift = logistic(top, y[held].astype(np.float64))
    return scorer


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """(slope, shift) of a logistic fit by Newton's steps, the slope held at 0.05 or more."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    w, m = np.zeros(2), np.stack((x, np.ones_like(x)), axis=1)
    for _ in range(50):
        p = sigmoid(np.clip(m @ w, -30, 30))
        h = (m * (p * (1 - p))[:, None]).T @ m + ridge * np.eye(2)
        w += np.linalg.solve(h, m.T @ (y - p) - ridge * w)
    return max(float(w[0]), 0.05), float(w[1])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the bounded sample: distinct ids are drawn first, one text (the least by hash) follows for each."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    short = docs.where(F.length("text") <= TRAIN_CHARS)
    ids = short.select("doc_id").join(known, "doc_id").dropDuplicates(["doc_id"])
    draw = lambda k, n: ids.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(n)
    chosen = draw(1, TOXIC_DOCS).unionByName(draw(0, CLEAN_DOCS))
    texts = short.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least"))
    return texts.select("least.text", "toxic", F.xxhash64("doc_id", F.lit(9)).alias("o"))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` but the text, with held_out, score and predicted (clashing names get an underscore).

    The network is fitted on the driver from a bounded sample of labelled rows outside the held-out quarter and sent to
    the tasks (about two megabytes, whatever the input); nothing is shuffled.  Null and empty texts score 0; repeated
    rows score alike; without labels of both kinds every text gets one small score.
    """
    sample = sorted((r["o"], r["text"], r["toxic"]) for r in training_rows(docs, labels).collect())
    scorer = trained([t for _, t, _ in sample], [int(y) for *_, y in sample])
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    hold, score, predicted = fresh(docs.drop("text"), "held_out", "score", "predicted")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            got = model.scores([t or "" for t in b.column(at).to_pylist()])
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(got, pa.float64())], [*names, score])

    out = docs.mapInArrow(run, ", ".join([*fields, f"`{score}` double"]))
    return out.withColumn(hold, held_out(F.col("doc_id"))).withColumn(predicted, (F.col(score) >= threshold).cast("int"))
