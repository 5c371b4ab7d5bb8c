"""Quality classifier: a factorisation machine over hashed words, structure statistics and the declared length.

All pairs of features interact through low-rank factors. The sum over pairs is half of (square of the sum less sum of
squares) per factor, so scoring is linear in the number of features of a document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spendlake.llm.common import arrow_map, free_name
from spendlake.llm.labels import fold_of, training_sample

#: Labelled documents the machine learns from, at most.
SAMPLE = 4000
FOLDS, HELD_OUT, CUT = 5, 0, 0.3
WORD_BITS, RANK, BINS = 13, 4, 16
WORDS = 1 << WORD_BITS
_SHARES = (
    "upper letters", "upper words", "word repeats the last", "distinct words", "repeated lines", "symbols", "digits", "bars", "exclamation",
    "stops", "line feeds",
)
_SCALES = ("characters", "words", "word length", "declared length")
STATS = (len(_SHARES) + len(_SCALES) + 1) * BINS
SIZE = WORDS + STATS
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_LETTERS = _UPPER + _UPPER.lower() + bytes(range(128, 256))


class _Hashed(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        at = self[word] = zlib.crc32(word.lower().encode()) & (WORDS - 1)
        return at


def features(text: str, declared: int | None, hashed: _Hashed) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a whole text."""
    words, raw = text.split(), text.encode()
    n, m = max(len(raw), 1), max(len(words), 1)
    letters = n - len(raw.translate(None, _LETTERS)) if raw else 0
    counts, lines = Counter(words), text.split("\n")
    digits = len(raw) - len(raw.translate(None, _DIGITS))
    shares = (
        (len(raw) - len(raw.translate(None, _UPPER))) / max(letters, 1),
        sum(map(str.isupper, words)) / m,
        sum(map(eq, words, words[1:])) / m,
        len(counts) / m,
        1 - len(set(lines)) / len(lines),
        (n - letters - digits - len(words)) / n,
        digits / n,
        raw.count(b"|") / m,
        raw.count(b"!") / m,
        raw.count(b". ") / m,
        raw.count(b"\n") / m,
    )
    # Shares near 0 differ most, so bins grow with the root.
    bins = [min(BINS - 1, int(BINS * max(0.0, s) ** 0.5)) for s in shares]
    scales = (n, m, n / m * 4, 0 if declared is None else max(0, declared))
    bins += [min(BINS - 1, int(v).bit_length()) for v in scales]
    bins.append(2 if declared is None else int(declared == len(text)))
    stats = WORDS + BINS * np.arange(len(bins)) + np.array(bins)
    at = np.fromiter(map(hashed.__getitem__, counts), dtype=np.int64, count=len(counts))
    weight = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    norm = np.sqrt((weight * weight).sum()) or 1.0
    return np.concatenate((at, stats)), np.concatenate((weight / norm, np.ones(len(bins))))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Margins of documents whose features begin at ``starts``."""
        v = self.factors[at] * x[:, None]
        total, squares = np.add.reduceat(v, starts), np.add.reduceat(v * v, starts)
        return self.bias + np.add.reduceat(self.linear[at] * x, starts) + 0.5 * (total * total - squares).sum(axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 80, rate: float = 0.05, decay: float = 2e-3) -> Machine:
    """Full-batch Adam on the logistic loss; deterministic. Without rows or with one class only the bias is learned."""
    m = Machine(0.0, np.zeros(SIZE), np.random.default_rng(7).normal(0, 0.02, (SIZE, RANK)))
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Machine(float(np.log(share / (1 - share))), m.linear, np.zeros((SIZE, RANK)))
    at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    lengths = np.array([len(r[0]) for r in rows])
    starts, row = np.r_[0, lengths.cumsum()[:-1]], np.repeat(np.arange(len(rows)), lengths)
    order = np.argsort(at, kind="stable")
    used, first = np.unique(at[order], return_index=True)
    share = y.mean()
    m.bias = float(np.log(share / (1 - share)))
    # Both classes pull alike; their prior stays in the scores through the weights' square root.
    weight = np.where(y == 1, 1.0, np.sqrt(share / (1 - share)))
    weight = weight / weight.sum()
    moments: dict[str, list[np.ndarray]] = {}

    def step(name, value, g, t):
        a, b = moments.setdefault(name, [np.zeros_like(g), np.zeros_like(g)])
        a += 0.1 * (g - a)
        b += 0.01 * (g * g - b)
        return value - rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)

    for t in range(1, epochs + 1):
        v = m.factors[at] * x[:, None]
        total = np.add.reduceat(v, starts)
        z = m.bias + np.add.reduceat(m.linear[at] * x, starts) + 0.5 * (total * total - np.add.reduceat(v * v, starts)).sum(axis=1)
        g = (sigmoid(z) - y) * weight
        gx = (g[row] * x)[order]
        own = m.linear[used]
        m.linear[used] = step("linear", own, np.add.reduceat(gx, first) + decay * own / len(used) ** 0.5, t)
        gv = gx[:, None] * (total[row] - v)[order]
        own = m.factors[used]
        m.factors[used] = step("factors", own, np.add.reduceat(gv, first) + decay * own, t)
        m.bias = float(step("bias", np.array(m.bias), np.array(g.sum()), t))
    return m


_ROWS = pa.schema([("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32())), ("y", pa.int32())])


def _featured(batches):
    hashed = _Hashed()
    for batch in batches:
        found = [features(t or "", n, hashed) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32())), batch.column(2)],
            schema=_ROWS,
        )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine learned from at most ``sample`` labelled documents outside the held-out fold."""
    rows = training_sample(docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")), labels, "quality", FOLDS, HELD_OUT, sample)
    found = arrow_map(rows.select("text", "n_chars", "y"), _featured, "at array<int>, x array<float>, y int").toArrow()
    at, x = (found.column(k).combine_chunks() for k in ("at", "x"))
    pairs = [(np.asarray(a.values, dtype=np.int64), np.asarray(v.values, dtype=np.float64)) for a, v in zip(at, x)]
    y = np.asarray(found.column("y"), dtype=np.float64)
    # The rows come in any order; sums must not depend on it.
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), pairs[k][0].tobytes(), y[k]))
    return fit([pairs[k] for k in order], y[order])


def scored(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in a column ``name``. Null texts are scored as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    score = free_name(docs, name)

    def score_batches(batches):
        hashed = _Hashed()
        for batch in batches:
            texts, declared = (batch.column(k).to_pylist() for k in (-2, -1))
            found = [features(t or "", n, hashed) for t, n in zip(texts, declared)]
            if not found:
                continue
            lengths = np.array([len(a) for a, _ in found])
            z = shared.value.margins(
                np.concatenate([a for a, _ in found]), np.concatenate([x for _, x in found]), np.r_[0, lengths.cumsum()[:-1]]
            )
            kept = [batch.column(k) for k in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sigmoid(z))], names=[*batch.schema.names[:-2], score])

    text, length = free_name(docs, "text_in"), free_name(docs, "length_in")
    rows = docs.select("*", docs["text"].alias(text), docs["n_chars"].cast("long").alias(length))
    fields = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    return arrow_map(rows, score_batches, fields)


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    The score uses the whole text and the declared length only. Null and empty texts get a score too. Repeated rows
    are scored alike, extra columns are not read, an empty table gives no rows, and without labels scores are 0.5.
    """
    machine = train(docs, labels, sample)
    rows = scored(docs.select("doc_id", "text", "n_chars"), machine)
    return rows.select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents not rejected, with all their columns."""
    name = free_name(docs, "score")
    rows = scored(docs, train(docs, labels), "score")
    return rows.where(F.col(name) >= cut).drop(name)
