"""Learned decision lists over text statistics.

Sequential covering: rules for rejected texts are grown one threshold at a time by information gain on two thirds of the
labelled statistics and pruned on the other third; each accepted rule removes what it covers. The list becomes an
ordered ``when`` expression, so that applying it is a projection.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import mark, ship, slices, utf8

SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
WINDOW = 8
MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(WINDOW)], dtype=np.uint64)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_marks", "n_digits")
#: SQL over COUNTS.
FEATURES = {
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(n_letters, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "n_words": "cast(n_words as double)",
}


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight that occur twice or more in the text; the first occurrence counts too."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    m = n - WINDOW + 1
    w = np.zeros(m, np.uint64)
    for j in range(WINDOW):
        w += (h[j : j + m] ^ (h[j : j + m] >> np.uint64(29))) * MULTIPLIERS[j]
    _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(raw: bytes | None) -> tuple[int, ...]:
    """COUNTS of a text given in UTF-8; all zero for a null one."""
    raw = raw or b""
    words = raw.split()  # of bytes: ASCII white space only
    joined = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(joined.decode("utf-8", "replace"))
    letters = len(joined) - len(joined.translate(None, LETTERS))
    upper = len(joined) - len(joined.translate(None, UPPER))
    digits = len(joined) - len(joined.translate(None, b"0123456789"))
    marks = joined.count(b"!") + joined.count(b"?")
    symbols = len(joined) - len(joined.translate(None, SYMBOLS.encode()))
    return (len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), len(set(words)), upper, letters, marks, digits)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = np.array([measure(x) for x in utf8(b, "text")], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], names=[*b.schema.names, *(f"q_{c}" for c in COUNTS)])


def statistics(docs: DataFrame) -> DataFrame:
    """The rows with COUNTS of their whole text, as q_n_words and so on. Null and empty texts count zero; repeated rows stay repeated."""
    schema = StructType([*docs.schema.fields, *(StructField(f"q_{c}", LongType()) for c in COUNTS)])
    ship(docs.sparkSession)
    return docs.mapInArrow(_measure, schema)


def _of(expression: str) -> str:
    """An expression over COUNTS as one over the columns of ``statistics``."""
    return re.sub(r"\b(" + "|".join(COUNTS) + r")\b", r"q_\1", expression)


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions (feature, sign, threshold); sign 1: value >= threshold, -1: value <= threshold."""

    conditions: tuple[tuple[str, int, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, at in self.conditions:
            out = out & (F.expr(_of(FEATURES[name])) >= at if sign > 0 else F.expr(_of(FEATURES[name])) <= at)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if s > 0 else '<='} {t:.4g}" for n, s, t in self.conditions)


def _met(x: np.ndarray, names: list[str], conditions: list[tuple[str, int, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, at in conditions:
        v = x[:, names.index(name)]
        out &= v >= at if sign > 0 else v <= at
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int) -> list[tuple[str, int, float]]:
    """Adds the condition with the largest gain until no good row is covered."""
    conditions: list[tuple[str, int, float]] = []
    inside = np.ones(len(x), bool)
    while len(conditions) < most and (p := int((inside & bad).sum())) and (n := int((inside & ~bad).sum())):
        before, best = math.log2(p / (p + n)), (1e-9, None)
        for i, name in enumerate(names):
            v, y = x[inside, i], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            low = np.cumsum(y)[cuts]
            for sign, pos, tot in ((-1, low, cuts + 1), (1, y.sum() - low, len(v) - cuts - 1)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1) / tot) - before), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (name, sign, float((v[cuts[k]] + v[cuts[k] + 1]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= _met(x, names, [best[1]])
    return conditions


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 16, max_conditions: int = 4, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """Ordered rules that reject. precision: least share of bad rows, on the pruning part, of what a rule covers."""
    order = np.random.default_rng(7).permutation(len(x))
    x, bad = x[order], bad[order]
    pruning = np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    live = np.ones(len(x), bool)
    for _ in range(max_rules):
        g, t = live & ~pruning, live & pruning
        if (bad & g).sum() < least:
            break
        conditions = _grow(x[g], bad[g], names, max_conditions)
        if not conditions:
            break

        def worth(c: list, t: np.ndarray = t) -> float:
            m = _met(x[t], names, c)
            p, n = int((m & bad[t]).sum()), int((m & ~bad[t]).sum())
            return (p - n) / (p + n) if p + n else -1

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        m = _met(x, names, conditions) & live
        on_t = m & t
        if (m & bad).sum() < least or (m & bad).sum() < precision * m.sum() or (on_t & bad).sum() < precision * on_t.sum():
            break
        rules.append(Rule(tuple(conditions)))
        live &= ~m
    return rules


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """text and label of a bounded sample: the ``max_rows`` ids first in the order of a hash, each with one text.

    An id with several labels has the smallest; of several texts with one id, the one with the smallest hash teaches. So the sample is the same in every run.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    ids = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select("doc_id", "text").join(ids, "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), mark()).alias("row")).select("row.text", F.col("row.label").alias(label))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> list[Rule]:
    """Rules from the texts of ``max_rows`` labelled ids at most (``labelled``).

    Rows without id or label don't teach; with no labelled rows the list is empty, and keeps all that the base rules keep.
    """
    names = list(FEATURES)
    stats = statistics(labelled(docs, labels, "quality", max_rows))
    rows = stats.select("quality", *(F.expr(_of(c)).alias(k) for k, c in FEATURES.items())).toArrow()
    x = np.column_stack([rows.column(k).to_numpy() for k in names]) if rows.num_rows else np.zeros((0, len(names)))
    y = rows.column("quality").to_numpy() == 0
    order = np.lexsort([*x.T, y]) if len(x) else []  # the same rules in whatever order the rows come
    return learn(x[order], y[order], names) if len(x) else []


def decide(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (number of the first rule met, 0: none) and kept."""
    rule = F.lit(0)
    for i, r in reversed(list(enumerate(rules, 1))):
        rule = F.when(r.column(), F.lit(i)).otherwise(rule)
    failed = (F.col("q_n_words") < 20) | (100 * F.col("q_n_repeat_words") > 30 * F.col("q_n_words"))
    return stats.withColumns({"base_failed": failed, "rule": rule}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, COUNTS, base_failed, rule, kept.

    The labelled texts are measured and learned from; then all are measured and judged in one pass, without a shuffle. Null and empty texts
    have no words and fail the base rules. Repeated rows are judged alike. Other columns of either table are ignored.
    """
    judged = decide(statistics(docs.select("doc_id", "text")), fit(docs, labels))
    return judged.select("doc_id", *(F.col(f"q_{c}").alias(c) for c in COUNTS), "base_failed", "rule", "kept")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns: each is judged where it is read, whatever its id."""
    plain = [c if c == "text" else f"column_{i}" for i, c in enumerate(docs.columns)]  # names that clash with none of ours
    judged = decide(statistics(docs.toDF(*plain)), fit(docs, labels))
    return judged.where("kept").select(*(F.col(p).alias(c) for p, c in zip(plain, docs.columns, strict=True)))
