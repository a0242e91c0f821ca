"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from the UTF-8 bytes and words of whole texts, vectorised over a batch. Trees
grow level by level on binned features; each is a complete binary tree in heap order, so a model is
three arrays (feature, threshold, leaf value) and scoring walks all rows down a tree at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barspark.llm import arrays as A

#: Most labelled rows that the fit reads; chosen by a hash of their id.
MAX_TRAINING_ROWS = 20_000

_LOWER, _UPPER, _DIGIT, _BLANK, _LINE, _STOP, _MARK, _SYMBOL, _WIDE = range(9)


def _byte_classes() -> np.ndarray:
    c = np.full(256, _SYMBOL, np.int64)
    c[ord("a"):ord("z") + 1] = _LOWER
    c[ord("A"):ord("Z") + 1] = _UPPER
    c[ord("0"):ord("9") + 1] = _DIGIT
    c[[0x20, 0x09]] = _BLANK
    c[[0x0A, 0x0B, 0x0C, 0x0D]] = _LINE
    c[[ord(x) for x in ".,;:?"]] = _STOP
    c[[ord(x) for x in "'\"()-!/"]] = _MARK
    c[128:] = _WIDE
    return c


CLASSES = _byte_classes()
FEATURES = ["log_bytes", "log_words", "lower", "upper", "digit", "blank", "line", "stop", "mark", "symbol", "wide",
            "word_length", "word_spread", "longest_word", "distinct", "repeated_next", "commonest", "distinct_pairs",
            "words_a_line", "distinct_lines", "symbol_words", "one_letter_words"]


def statistics(text: A.Text) -> np.ndarray:
    """A row of FEATURES for each document; shares are of bytes, words or lines. Empty texts are all 0."""
    data, off = text
    n = len(off) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * 9 + CLASSES[data], minlength=9 * n).reshape(n, 9)
    w = A.words(text)
    words = np.diff(w.offsets)
    some_bytes, some_words = np.maximum(size, 1), np.maximum(words, 1)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    out[:, 2:11] = kinds / some_bytes[:, None]
    word_doc = np.repeat(np.arange(n), words)
    length = (w.ends - w.starts).astype(float)
    mean = np.bincount(word_doc, length, n) / some_words
    out[:, 11] = mean
    out[:, 12] = np.sqrt(np.maximum(np.bincount(word_doc, length ** 2, n) / some_words - mean ** 2, 0))
    has = np.flatnonzero(words)
    if len(has):
        out[has, 13] = np.log1p(np.maximum.reduceat(length, w.offsets[has]))
    inner = word_doc[1:] == word_doc[:-1]
    out[:, 15] = np.bincount(word_doc[1:][inner & (w.names[1:] == w.names[:-1])], minlength=n) / some_words
    pairs = A.rolling(w.names, 2)
    out[:, 14], out[:, 16] = _distinct(w.names, word_doc, n, some_words)
    out[:, 17], _ = _distinct(pairs[inner], word_doc[1:][inner], n, np.maximum(words - 1, 1))
    is_symbol = CLASSES[data[w.ends - 1]] if len(w.ends) else np.zeros(0, np.int64)
    out[:, 20] = np.bincount(word_doc[is_symbol == _SYMBOL], minlength=n) / some_words
    out[:, 21] = np.bincount(word_doc[length == 1], minlength=n) / some_words
    # lines: named by the words that they hold
    if len(w.names):
        breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
        line = breaks[w.starts]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | ~inner
        head = np.flatnonzero(new)
        name = A.mix(np.add.reduceat(A.mix(w.names + (np.arange(len(line)) - np.repeat(head, np.diff(np.append(head, len(line))))).astype(np.uint64)), head))
        lines = np.maximum(np.bincount(word_doc[head], minlength=n), 1)
        out[:, 18] = np.log1p(words / lines)
        out[:, 19] = _distinct(name, word_doc[head], n, lines)[0]
    return out


def _distinct(names: np.ndarray, doc: np.ndarray, n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document, the share of distinct names and the share of the commonest one."""
    order = np.lexsort((names, doc))
    k, d = names[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    head = np.flatnonzero(new)
    common = np.zeros(n)
    np.maximum.at(common, d[head], np.diff(np.append(head, len(k))) / total[d[head]])
    return np.bincount(d[head], minlength=n) / total, common


class Model(NamedTuple):
    """Complete trees in heap order. Inner node i of a tree sends a row to 2i + 1, or to 2i + 2
    where its feature is above the threshold; leaves follow the inner nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 8) -> Model:
    """Boosted trees for the logistic loss. Without rows the score is 0.5; with one class, its share."""
    inner = 2 ** depth - 1
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    features, thresholds, leaves = [], [], []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
        m = x.shape[1]
        total = np.full(len(y), bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), np.int64)
            f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(depth):
                first, count = 2 ** level - 1, 2 ** level
                at = (node - first)[:, None] * (m * bins) + np.arange(m) * bins + binned
                hist = [np.bincount(at.ravel(), np.repeat(v, m), count * m * bins).reshape(count, m, bins).cumsum(2) for v in (g, h, np.ones(len(y)))]
                gl, hl, nl = hist
                gt, ht, nt = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
                gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
                gain[(nl < least) | (nt - nl < least)] = 0
                best = gain.reshape(count, -1).argmax(1)
                for k, b in enumerate(best.tolist()):
                    j, c = divmod(b, bins)
                    if gain[k, j, c] > 1e-6 and c < len(cuts[j]):
                        f[first + k], t[first + k] = j, cuts[j][c]
                node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
            where = node - inner
            leaf = rate * np.bincount(where, g, inner + 1) / (np.bincount(where, h, inner + 1) + l2)
            total += leaf[where]
            features.append(f); thresholds.append(t); leaves.append(leaf)  # noqa: E702
    return Model(np.array(features, np.int64).reshape(-1, inner), np.array(thresholds).reshape(-1, inner), np.array(leaves).reshape(-1, inner + 1), bias)


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, t in A.slices(A.text_of(b.column(1))):
            x = statistics(t)
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), values], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, label_col: str = "quality",
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``max_rows`` labelled documents, those whose hashed id comes first.

    Labels other than 0 and 1 are left out; a document labelled twice counts twice. The chosen ids (16
    bytes each, so at most 16 * max_rows bytes) are broadcast, and only the statistics of their
    documents come to the driver. Where documents repeat ids, the least repeated ids go first, as long as
    all their rows stay within ``max_rows``.
    """
    chosen = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__op_id"), F.col(label_col).cast("double").alias("__op_y"))
              .orderBy(F.xxhash64("__op_id"), "__op_id", "__op_y").limit(max_rows))
    rows_of = docs.select(F.col(id_col).alias("__op_doc")).join(F.broadcast(chosen), F.col("__op_doc") == F.col("__op_id")).groupBy("__op_id").agg(F.count(F.lit(1)).alias("n"))
    # at most max_rows ids, so one small window
    taken = rows_of.select("__op_id", F.sum("n").over(Window.orderBy("n", F.xxhash64("__op_id"), "__op_id")).alias("so_far")).where(F.col("so_far") <= max_rows).select("__op_id")
    chosen = chosen.join(F.broadcast(taken), "__op_id")
    texts = docs.join(F.broadcast(chosen), docs[id_col] == F.col("__op_id")).select(F.col("__op_y").alias("y"), F.col(text_col).alias("text"))
    rows = texts.mapInArrow(_statistics_of, "y double, x array<double>").toArrow()
    y = rows.column("y").to_numpy()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, y))  # the fit must not depend on the order in which rows arrive
    return fit(x[order], y[order])


def with_score(docs: DataFrame, model: Model, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each row; null texts score as empty ones."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            score = [model.score(statistics(t)) for _, _, t in A.slices(A.text_of(b.column(at)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(score) if score else np.zeros(0))], [*b.schema.names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def held_out(id_col):
    """The fifth of documents that no fit may use: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row: trained on labelled rows that are not held
    out, scored on whole texts. predicted is 1 from ``cut`` on. Rows without an id are scored too."""
    model = train(docs, labels.where(~held_out("doc_id")))
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``cut``."""
    model = train(docs, labels.where(~held_out("doc_id")))
    return with_score(docs, model, "__op_score").where(F.col("__op_score") >= cut).drop("__op_score")
