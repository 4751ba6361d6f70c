"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from whole texts, vectorised over batches of documents. Trees are
grown on the driver from a bounded labelled sample (SAMPLE rows at most, the least
by hash of id), on quantile bins; they are then flattened into arrays that numpy
walks for a whole batch at once. Scoring is one pass without a shuffle.

A null or empty text has all-zero statistics and gets a score like any other; without any
labelled row every score is 0.5; with labels of one class only, every score is that class's
prior. A repeated label counts once, the least of its values. A null id counts as empty text for the fold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import arrow_map, text_bytes
from .hashing import SPACE, word_hashes, words

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000
BINS = 64
FEATURES = (
    "log_chars", "log_words", "word_length", "short_words", "long_words", "upper", "lower", "digit", "space", "other_ascii", "non_ascii",
    "marks", "bare_marks", "end_marks", "adjacent_repeat", "distinct_words", "lines", "line_length", "repeated_lines", "top_letter", "stops",
)
_MARK = np.zeros(256, bool)
_MARK[list(b"!*$%&#|@^~_=+<>{}[]\\/")] = True


def _class(lo: int, hi: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[lo : hi + 1] = True
    return out


_UPPER, _LOWER, _DIGIT, _HIGH = _class(65, 90), _class(97, 122), _class(48, 57), _class(128, 255)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each of the texts on end."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[offsets]).astype(float)

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(n), where=b > 0)

    s, e, first = words(data, offsets)
    hashes, _ = word_hashes(data, offsets, lower=True)
    n_words = np.diff(first).astype(float)
    of = np.repeat(np.arange(n), np.diff(first))
    length = e - s

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=mask, minlength=n)[:n]

    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_MARK[data], out=marks[1:])
    in_word = marks[e] - marks[s]
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    newline = data == 10
    breaks = per_doc(newline)
    # Lines as spans of words: the hash of a line is the sum of its words' hashes by place.
    line_of = np.searchsorted(np.flatnonzero(newline), s) if len(s) else np.zeros(0, np.int64)
    line_key = of.astype(np.int64) * (len(data) + 1) + line_of
    starts = np.flatnonzero(np.concatenate([[True], line_key[1:] != line_key[:-1]])) if len(s) else np.zeros(0, np.int64)
    place = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s)))) if len(s) else np.zeros(0, np.int64)
    line_hash = np.add.reduceat(hashes * (2 * place.astype(np.uint64) + np.uint64(1)), starts) if len(s) else np.zeros(0, np.uint64)
    line_doc = of[starts] if len(s) else np.zeros(0, np.int64)
    lo = np.lexsort((line_hash, line_doc))
    again = np.zeros(len(lo), bool)
    again[1:] = (line_hash[lo][1:] == line_hash[lo][:-1]) & (line_doc[lo][1:] == line_doc[lo][:-1])
    n_lines = np.bincount(line_doc, minlength=n)[:n].astype(float)
    cols = [
        np.log1p(size), np.log1p(n_words), ratio(per_word(length), n_words), ratio(per_word(length <= 2), n_words), ratio(per_word(length >= 12), n_words),
        ratio(per_doc(_UPPER[data]), size), ratio(per_doc(_LOWER[data]), size), ratio(per_doc(_DIGIT[data]), size), ratio(per_doc(SPACE[data]), size),
        ratio(per_doc(~(_UPPER | _LOWER | _DIGIT | SPACE | _HIGH)[data]), size), ratio(per_doc(_HIGH[data]), size), ratio(per_doc(_MARK[data]), size),
        ratio(per_word(in_word == length), n_words), ratio(per_word(_MARK[data[e - 1]] if len(e) else np.zeros(0)), n_words), ratio(per_word(same), n_words),
        ratio(np.bincount(of[order], weights=new, minlength=n)[:n], n_words), np.log1p(breaks), ratio(size, breaks + 1),
        ratio(np.bincount(line_doc[lo], weights=again, minlength=n)[:n], n_lines), ratio(per_doc(data == 101), size), ratio(per_doc(data == 46), n_words),
    ]
    return np.stack(cols, axis=1)


@dataclass
class Forest:
    """Every tree as rows of one table: feature -1 marks a leaf, whose value is in threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of x."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                below = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f < 0, at, np.where(below, self.left[at], self.right[at]))
            total += self.threshold[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, least: int = 10) -> Forest:
    """Boosted trees for the logistic loss, each grown level by level from histograms of gradients over quantile bins."""
    n = len(y)
    share = float(np.clip((y.sum() + 0.5) / (n + 1), 1e-3, 1 - 1e-3)) if n else 0.5
    nodes: list[list[float]] = []
    roots: list[int] = []
    base = float(np.log(share / (1 - share)))
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(edge, x[:, j], side="left") for j, edge in enumerate(edges)], axis=1)
        total = np.full(n, base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            g, h = p - y, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([-1, 0, 0, 0])
            at = np.full(n, roots[-1])
            level = [roots[-1]]
            for d in range(depth + 1):
                slot = {v: i for i, v in enumerate(level)}
                live = np.isin(at, level)
                where = np.array([slot.get(v, 0) for v in range(len(nodes))])[at[live]]
                gl, hl = g[live], h[live]
                sums = np.bincount(where, gl, len(level)), np.bincount(where, hl, len(level))
                best = [(0.0, -1, -1)] * len(level)
                for j, edge in enumerate(edges) if d < depth else ():
                    cell = where * (BINS + 1) + binned[live, j]
                    hist = [np.bincount(cell, w, len(level) * (BINS + 1)).reshape(len(level), -1).cumsum(axis=1)[:, : len(edge)] for w in (gl, hl, None)]
                    if not len(edge):
                        continue
                    count = np.bincount(where, minlength=len(level))
                    a, b = hist[0] ** 2 / (hist[1] + ridge), (sums[0][:, None] - hist[0]) ** 2 / (sums[1][:, None] - hist[1] + ridge)
                    gain = a + b - (sums[0] ** 2 / (sums[1] + ridge))[:, None]
                    gain[(hist[2] < least) | (count[:, None] - hist[2] < least)] = -1
                    k = gain.argmax(axis=1)
                    best = [max(o, (float(gain[i, k[i]]), j, int(k[i])), key=lambda t: t[0]) for i, o in enumerate(best)]
                below = []
                for i, v in enumerate(level):
                    gain, j, k = best[i]
                    if j < 0 or gain <= 1e-6:
                        nodes[v] = [-1, -rate * float(sums[0][i] / (sums[1][i] + ridge)), 0, 0]
                        continue
                    nodes[v] = [j, float(edges[j][k]), len(nodes), len(nodes) + 1]
                    nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
                    mine = at == v
                    at[mine] = np.where(binned[mine, j] <= k, nodes[v][2], nodes[v][3])
                    below += [int(nodes[v][2]), int(nodes[v][3])]
                level = below
                if not level:
                    break
            total += np.array([v[1] if v[0] < 0 else 0.0 for v in nodes])[at]
    table = np.array(nodes or [[-1, 0, 0, 0]])
    return Forest(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), np.array(roots, int), base, depth)


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are kept from the model: crc32 of its id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def features(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and x, its statistics as an array of doubles."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(*text_bytes(rows.column(1)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([rows.column(0), lists], names=["doc_id", "x"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), run, "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Forest:
    """A model from at most sample labelled rows that are not held out. Broadcast: that sample's ids."""
    known = (
        labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known.select("doc_id", "y")), "doc_id")
    y = {r.doc_id: r.y for r in known.collect()}
    rows = features(src).collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([y[r.doc_id] for r in rows], float))


def score(docs: DataFrame, model: Forest, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with score (the chance of label 1) behind its columns, in one pass without a shuffle; a column score of docs is replaced."""
    docs = docs.drop("score")
    names = docs.columns
    at = names.index(text)

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        p = model.score(statistics(*text_bytes(rows.column(at))))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(p)], names=[*names, "score"])

    schema = StructType([*docs.schema.fields]).add("score", "double")
    return arrow_map(docs, run, schema)
