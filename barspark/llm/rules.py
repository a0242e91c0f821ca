"""Quality rules: a learned decision list over document statistics.

Sequential covering in the manner of IREP: labelled rows are dealt into growing and pruning rows; a rule starts empty and
takes the threshold condition of largest information gain until it covers no good growing row, loses its
last conditions where a shorter rule is worth more on the pruning rows, and joins the list if it is precise there. The
rows that it covers leave, and the next rule follows. Rules say *drop*; what no rule covers is kept. The list
becomes one ordered conditional expression of Spark over the statistics' columns, which anyone can read.

Statistics are vectorised over the UTF-8 bytes and words of a batch of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from barspark.llm import arrays as A

#: Most labelled rows that the list is learned from; chosen by a hash of their id, repeated ones by row.
MAX_TRAINING_ROWS = 20_000
#: Least bad rows of a condition; least precision on the pruning rows; most rules and conditions of a rule.
LEAST, PRECISION, MAX_RULES, MAX_CONDITIONS = 3, 0.9, 24, 4
WINDOW = 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may test, besides the counts' shares: all from counts of the same pass.
SHARES = ["symbols_a_word", "dup_line_share", "repeat_share", "stutter_share", "mean_word_chars", "distinct_share", "upper_share", "digit_share", "stops_a_word", "bare_word_share", "words_a_line", "longest_word"]


def _table(members: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in members]] = True
    return t


SYMBOL = _table("#*$%&|<>")  # fixed values: the symbols that are counted
STOP = _table(".,;:?!")
UPPER, DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
#: Letters, as far as bytes tell: A-Z, a-z and every byte of wider characters.
LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
NEWLINE = _table("\n")


def _repeats(names: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which items equal an earlier one of their document; items are in document order."""
    order = np.lexsort((names, doc))
    k, d = names[order], doc[order]
    late = np.zeros(len(k), bool)
    late[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])  # the sort is stable: the first of equal ones stands first
    out = np.empty(len(k), bool)
    out[order] = late
    return out


def _repeated_windows(w: A.Words, size: int) -> np.ndarray:
    """Which words lie in a window of ``size`` words that its document holds twice or more."""
    at, n = A.window_starts(w.offsets, size)
    covered = np.zeros(len(w.names) + 1, np.int64)
    if len(at):
        doc = np.repeat(np.arange(len(n)), n)
        names = A.rolling(w.names, size)[at]
        order = np.lexsort((names, doc))
        k, d = names[order], doc[order]
        same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(k), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + size, -1)
    return np.cumsum(covered)[:-1] > 0


def statistics(text: A.Text) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS and SHARES of each document (rows); all are 0 for texts without words, but shares of bytes.

    Words and lines are named by 64-bit hashes. A line is what stands between line feeds, if it holds a word.
    """
    data, off = text
    n = len(off) - 1
    counts, shares = np.zeros((n, len(COUNTS)), np.int64), np.zeros((n, len(SHARES)))
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
    w = A.words(text)
    words = np.diff(w.offsets)
    word_doc = np.repeat(np.arange(n), words)
    per = lambda values: np.bincount(word_doc, values, n)
    first_bytes = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(first_bytes)])
    length = chars[w.ends] - chars[w.starts]
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    lines = A.words(text, breaks=NEWLINE)
    line_doc = np.repeat(np.arange(n), np.diff(lines.offsets))
    spoken = np.concatenate([[0], np.cumsum(~A.SPACE[data])])
    has = spoken[lines.ends] > spoken[lines.starts]
    line_doc = line_doc[has]
    counts[:, 0] = words
    counts[:, 1] = per(length)
    counts[:, 2] = total(SYMBOL[data])
    counts[:, 3] = np.bincount(line_doc[_repeats(lines.names[has], line_doc)], minlength=n)
    counts[:, 4] = per(_repeated_windows(w, WINDOW))
    stutter = np.zeros(len(w.names), bool)
    stutter[1:] = (w.names[1:] == w.names[:-1]) & (word_doc[1:] == word_doc[:-1])
    one = np.maximum(words, 1)
    size = np.maximum(total(first_bytes), 1)
    n_lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    longest = np.zeros(n)
    some = np.flatnonzero(words)
    if len(some):
        longest[some] = np.maximum.reduceat(length, w.offsets[some])
    shares[:] = np.stack([counts[:, 2] / one, counts[:, 3] / n_lines, counts[:, 4] / one, per(stutter) / one, counts[:, 1] / one, per(~_repeats(w.names, word_doc)) / one,
                          total(UPPER[data]) / size, total(DIGIT[data]) / size, total(STOP[data]) / one,
                          per(letters[w.ends] == letters[w.starts]) / one, words / n_lines, longest], 1)
    return counts, shares


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with a column for each of COUNTS and SHARES, their names after ``prefix``; null texts count as empty."""
    at = docs.columns.index(text_col)
    fields = [*[StructField(prefix + c, LongType()) for c in COUNTS], *[StructField(prefix + c, DoubleType()) for c in SHARES]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [statistics(t) for _, _, t in A.slices(A.text_of(b.column(at)))]
            counts = np.concatenate([c for c, _ in parts]) if parts else np.zeros((0, len(COUNTS)), np.int64)
            shares = np.concatenate([s for _, s in parts]) if parts else np.zeros((0, len(SHARES)))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c) for c in counts.T.copy()], *[pa.array(c) for c in shares.T.copy()]],
                                             [*b.schema.names, *[f.name for f in fields]])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *fields]))


class Condition(NamedTuple):
    """``statistic`` at most (or, if ``above``, over) ``cut``."""

    statistic: str
    above: bool
    cut: float

    def __str__(self):
        return f"{self.statistic} {'>' if self.above else '<='} {self.cut!r}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        v = x[:, names.index(c.statistic)]
        hit &= (v > c.cut) == c.above
    return hit


def _best(x: np.ndarray, bad: np.ndarray, names: list[str], least: int) -> Condition | None:
    """The condition of largest gain: bad rows that stay covered, times what they learn about being bad."""
    before = np.log2(bad.sum() / len(bad))
    best, found = 1e-9, None
    for j, name in enumerate(names):
        v = x[:, j]
        cuts = np.unique(v)[:-1]
        if not len(cuts):
            continue
        # rows at or below each value that occurs; the cut is set halfway to the next one
        order = np.sort(v)
        rank = np.searchsorted(order, cuts, "right")
        below = np.searchsorted(np.sort(v[bad]), cuts, "right")
        for above, p, n in ((False, below, rank), (True, bad.sum() - below, len(v) - rank)):
            gain = np.where(p >= least, p * (np.log2(np.maximum(p, 1) / np.maximum(n, 1)) - before), 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], Condition(name, above, float((cuts[k] + order[rank[k]]) / 2))
    return found


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str], precision: float) -> float:
    """Bad rows covered less good ones; nothing for a rule that is not precise."""
    hit = covers(rule, x, names)
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return p - n if p and p >= precision * (p + n) else -np.inf


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], least: int = LEAST, precision: float = PRECISION) -> list[Rule]:
    """An ordered list of rules that cover bad rows. Rows must come in an order that does not depend on the labels: every third prunes.
    Rows without both kinds give no rules."""
    pruning = np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        gx, gb, px, pb = x[~pruning], bad[~pruning], x[pruning], bad[pruning]
        if gb.sum() < least or gb.all():
            break
        rule: Rule = ()
        hit = np.ones(len(gx), bool)
        while (hit & ~gb).any() and len(rule) < MAX_CONDITIONS:
            c = _best(gx[hit], gb[hit], names, least)
            if c is None:
                break
            rule = (*rule, c)
            hit = covers(rule, gx, names)
        if not rule:
            break
        # the shortest of the best prefixes
        worth, shorter = max((_worth(rule[:k], px, pb, names, precision), -k) for k in range(1, len(rule) + 1))
        if worth == -np.inf:
            break
        rule = rule[:-shorter]
        rules.append(rule)
        keep = ~covers(rule, x, names)
        x, bad, pruning = x[keep], bad[keep], pruning[keep]
    return rules


def expression(rules: list[Rule], prefix: str = "") -> Column:
    """The list as one ordered conditional: the 1-based number of the first rule that covers a row, 0 if none does."""
    out = None
    for k, rule in enumerate(rules):
        test = F.lit(True)
        for c in rule:
            column = F.col(prefix + c.statistic)
            test = test & (column > c.cut if c.above else column <= c.cut)
        out = F.when(test, k + 1) if out is None else out.when(test, k + 1)
    return F.lit(0) if out is None else out.otherwise(0)


def described(rules: list[Rule]) -> list[str]:
    """The list in words, a line a rule."""
    return [f"{k + 1}: drop if {' and '.join(map(str, r))}" for k, r in enumerate(rules)] + ["else keep"]


def base_failed(prefix: str = "") -> Column:
    """The fixed rules: fewer than 10 words, or over 20 % of the words in repeated windows."""
    return (F.col(f"{prefix}n_words") < 10) | (F.col(f"{prefix}n_repeat_words") * 100 > F.col(f"{prefix}n_words") * 20)


def for_learning(id_col: str) -> Column:
    """Rows that may be learned from: all but the fifth whose id's CRC-32 is a multiple of 5, on which lists are measured."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 != 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """A decision list from at most ``max_rows`` labelled rows: those whose hashed id comes first, never held-out ones, without rows that the base drops.

    Label 0 is bad, 1 good; others and null are left out. The chosen ids (16 bytes each) are broadcast; rows that repeat an id are bounded too.
    """
    chosen = (labels.where(F.col(label_col).isin(0, 1) & for_learning(id_col)).select(F.col(id_col).alias("__op_id"), (F.col(label_col) == 0).alias("__op_bad"))
              .orderBy(F.xxhash64("__op_id"), "__op_id", "__op_bad").limit(max_rows))
    texts = docs.select(F.col(f"`{id_col}`").alias("__op_doc"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), F.col("__op_doc") == F.col("__op_id"))
    rows = with_statistics(texts.select("__op_id", "__op_bad", "text")).where(~base_failed()).drop("text")
    rows = rows.orderBy(F.xxhash64("__op_id"), "__op_id", *SHARES, "__op_bad").limit(max_rows).select("__op_bad", *SHARES).toArrow()
    bad = rows.column("__op_bad").to_numpy().astype(bool)
    x = np.stack([rows.column(c).to_numpy() for c in SHARES], 1)
    return learn(x, bad, SHARES)


def judged(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``rule`` (the first rule that covers the row, 0 if none) and ``kept`` of every row.

    Null and empty texts have no words and fail the base. Rows that repeat an id, or have none, are judged each. Other columns are
    not read. An empty table gives no rows."""
    x = with_statistics(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("__op_text")), "__op_text")
    x = x.withColumn("base_failed", base_failed()).withColumn("rule", expression(rules))
    return x.select("doc_id", *COUNTS, "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))


def rules_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept`` of every row, by the list learned from ``labels``."""
    return judged(docs, learned(docs, labels))
