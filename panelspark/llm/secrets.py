"""Secret scans through a trigram inverted index.

Every rule's regular expression is turned into a Boolean trigram query (an AND of trigrams for each literal it
must contain, an OR over its alternatives).  Each batch of documents gets an inverted index of the trigrams that the
queries use: postings are the numbers of the batch's documents.  Postings are intersected and united, and the
expression itself verifies the candidates.  A rule without mandatory trigrams verifies every document.  The index is
partitioned by document, so nothing is shuffled and a task holds one batch.
"""

from __future__ import annotations

import hashlib
import re
import re._parser as sre
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh


@dataclass(frozen=True)
class Rule:
    """``least`` characters are needed in ``group`` of a match; a shorter match is dropped but still consumes its text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs of 24 or more: shorter ones would be dropped, and a run is never split, so the bound may stand in the expression
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"://[A-Za-z0-9._-]+:[^\s@/:]{6,}@"),
)
RULES = BASE + ADDED

#: A query is a set of alternatives, each a set of trigrams that must all occur; one empty alternative matches everything.
Query = frozenset


def _trigrams(literal: str) -> frozenset:
    low = "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in literal).encode()
    return frozenset(low[i:i + 3] for i in range(len(low) - 2))


def _both(a: Query, b: Query) -> Query:
    return frozenset(x | y for x in a for y in b)


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams that any match of ``pattern`` contains, in lower case.

    Exact literal alternatives are carried through sequences, groups, branches and optional characters, so that
    trigrams across those are found; anything else ends a literal.
    """
    everything = frozenset([frozenset()])

    def closed(texts: set[str]) -> Query:
        return frozenset(_trigrams(t) for t in texts)

    def walk(items, texts: set[str], query: Query) -> tuple[set[str], Query]:
        """``texts``: what may stand directly before this point; ``query``: what must have occurred before that."""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                texts = {t + chr(arg) for t in texts}
            elif name == "SUBPATTERN":
                texts, query = walk(arg[3], texts, query)
            elif name == "BRANCH":
                ways = [walk(branch, texts, everything) for branch in arg[1]]
                if all(q == everything for _, q in ways) and sum(len(t) for t, _ in ways) <= 64:
                    texts = set().union(*(t for t, _ in ways))
                else:
                    query = _both(query, frozenset().union(*(_both(closed(t), q) for t, q in ways)))
                    texts = {""}
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] == 0 and arg[1] == 1 and len(texts) <= 32:
                more, q = walk(arg[2], texts, everything)
                if q == everything and more != {""}:
                    texts = texts | more
                else:  # something other than a literal may stand here: the literal before it ends
                    query, texts = _both(query, closed(texts)), {""}
            else:
                query, texts = _both(query, closed(texts)), {""}
        return texts, query

    texts, query = walk(sre.parse(pattern), {""}, everything)
    return _both(query, closed(texts))


def batch_candidates(texts: list[bytes], queries: list[Query]) -> list[list[int]]:
    """For each query the numbers of the texts that satisfy it, by intersecting postings of this batch."""
    wanted = sorted({t for q in queries for way in q for t in way})
    data = np.frombuffer(b"\n\n".join(texts), np.uint8) if texts else np.zeros(0, np.uint8)
    data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint32)
    ends = np.cumsum([len(t) + 2 for t in texts]) if texts else np.zeros(0, np.int64)
    postings: dict[bytes, set[int]] = {t: set() for t in wanted}
    if len(data) >= 3 and wanted:
        code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        number = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(wanted):
            number[int.from_bytes(t, "big")] = i + 1
        hit = number[code]
        at = np.flatnonzero(hit)
        pairs = np.unique(hit[at].astype(np.int64) << 40 | np.searchsorted(ends, at, side="right"))
        for p in pairs.tolist():
            postings[wanted[(p >> 40) - 1]].add(p & ((1 << 40) - 1))
    out = []
    for q in queries:
        if frozenset() in q:
            out.append(list(range(len(texts))))
        else:
            out.append(sorted(set().union(*(set.intersection(*(postings[t] for t in way)) for way in q))))
    return out


def spans_of(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of each text, in code points, by start and then by the order of the rules."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, docs) in enumerate(zip(rules, batch_candidates(encoded, [trigram_query(r.pattern) for r in rules]))):
        find = rule.compiled().finditer
        for d in docs:
            found[d] += [(m.start(), k, m.end()) for m in find(texts[d]) if len(m.group(rule.group)) >= rule.least]
    return [[(s, e, rules[k].kind) for s, k, e in sorted(x)] for x in found]


def listing(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, overlapping ones as one, replaced by the kind of its first."""
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", redact: bool = False, drop_text: bool = False) -> DataFrame:
    """All columns of ``docs`` and a struct ``found``: counts of the base kinds, digest of the base spans, all spans.

    A null text has no spans (and stays null when redacted).  With ``redact`` the text is replaced.  Repeated rows
    are scanned alike; an empty table gives an empty one.
    """
    (found,) = fresh(docs, "found")
    names, base = docs.columns, {r.kind for r in BASE}
    kinds = [r.kind for r in BASE]
    at = names.index(text)
    fields = [f for f in docs.schema.fields if not (drop_text and f.name == text)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [
        f"`{found}` struct<{', '.join(f'n_{k}: bigint' for k in kinds)}, base_sha256: string, spans: string>"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is not None else "" for t in b.column(at).to_pylist()]
            spans = spans_of(texts, rules)
            own = [[x for x in s if x[2] in base] for s in spans]
            cols, labels = list(b.columns), list(b.schema.names)
            if redact:
                ok = b.column(at).is_valid().to_pylist()
                cols[at] = pa.array([redacted(t, s) if o else None for t, s, o in zip(texts, spans, ok)], cols[at].type)
            if drop_text:
                del cols[at], labels[at]
            value = pa.StructArray.from_arrays(
                [pa.array([sum(x[2] == k for x in s) for s in own], pa.int64()) for k in kinds]
                + [pa.array([hashlib.sha256(listing(s).encode()).hexdigest() for s in own]), pa.array([listing(s) for s in spans], pa.string())],
                [*[f"n_{k}" for k in kinds], "base_sha256", "spans"])
            yield pa.RecordBatch.from_arrays([*cols, value], [*labels, found])

    return docs.mapInArrow(scan, schema)


def redacted_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced by a mark, and ``n_chars``, where there is one, counted anew."""
    out = scanned(docs, redact=True)
    out = out.select(*[f"`{c}`" for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
