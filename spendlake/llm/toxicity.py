"""Toxicity by a finite-state grammar over clauses.

A clause is read as a string of symbols: insult, threat, target, negation, report, other; a lookup gives a word its
symbol. Three sequential transducers are composed into one machine. The first marks what stands after a word of reported
speech, the second what a negation precedes closely, and the last reduces the clause to its strongest match when it ends,
with a mark if the clause names a target anywhere. Arcs carry no weights: a document's score is a logistic function of the
matched clauses of each kind, weighted beside the machine by how strongly their words point to toxic documents. Insults
are learned from labelled documents as words and as word beginnings, since toxic words inflect freely.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spendlake.llm.common import arrow_map, free_name
from spendlake.llm.labels import fold_of, training_sample

#: Labelled documents the lexicon and the weights are learned from, and entries of the lexicon, at most.
SAMPLE, ENTRIES = 8000, 2000
FOLDS, HELD_OUT, CUT = 4, 2, 0.3
STEMS = (4, 5, 6, 7)

# Closed word classes of English, German, French and Spanish.
THREATS = "kill hurt destroy burn shoot stab beat töten schlagen umbringen tuer frapper brûler matar golpear quemar".split()
TARGETS = "you your yours yourself du dich dir dein euch tu toi ton vous votre tú ti usted vosotros they them".split()
NEGATIONS = "not never isn't aren't don't nobody nicht kein keine niemals jamais aucun nunca jamás ningún".split()
REPORTS = "said says wrote quoted claimed called alleged sagte schrieb zitierte behauptete dit écrit cité dijo escribió citó".split()

_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSES = re.compile(r"[.!?;:\n]+")


class Transducer:
    """A sequential transducer: (state, symbol) -> (state, symbol); symbols without an arc pass and keep the state."""

    def __init__(self, arcs: dict[tuple, tuple], start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))

    def states(self):
        return {self.start} | {s for s, _ in self.arcs} | {s for s, _ in self.arcs.values()}

    def symbols(self):
        return {a for _, a in self.arcs} | {b for _, b in self.arcs.values()}


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds what ``first`` writes to ``second``; only states that can be reached."""
    alphabet = first.symbols() | second.symbols()
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        a, b = state = todo.pop()
        for symbol in alphabet:
            a2, middle = first.step(a, symbol)
            b2, out = second.step(b, middle)
            arcs[state, symbol] = ((a2, b2), out)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return Transducer(arcs, start)


#: Symbols: insult I, threat H, target T, negation N, report R, other o, clause end ".". A match carries its marks.
MATCHES, MARKS = "IH", "rn"
KINDS = [base + "".join(m for m, on in zip("rnt", marks) if on) for base in MATCHES for marks in product((0, 1), repeat=3)]
NEAR = 3


def reported() -> Transducer:
    arcs = {(0, "R"): (1, "o"), (1, "R"): (1, "o"), (1, "."): (0, ".")}
    return Transducer(arcs | {(1, b): (1, b + "r") for b in MATCHES})


def negated() -> Transducer:
    """Marks a match up to NEAR symbols after a negation; a second negation undoes the first."""
    arcs: dict = {(0, "N"): (NEAR, "o")}
    for k in range(1, NEAR + 1):
        arcs |= {(k, "N"): (0, "o"), (k, "."): (0, "."), (k, "o"): (k - 1, "o"), (k, "T"): (k - 1, "T")}
        for base, r in product(MATCHES, ("", "r")):
            arcs[k, base + r] = (k - 1, base + r + "n")
    return Transducer(arcs)


def strongest() -> Transducer:
    """Writes, at the end of a clause, its strongest match with a mark if the clause names a target."""
    plain = [k for k in KINDS if "t" not in k]
    rank = {k: i for i, k in enumerate(sorted(plain, key=lambda k: ("r" in k, "n" in k, k[0] == "I")))}
    states = [(best, t) for best in ("", *plain) for t in (0, 1)]
    arcs = {}
    for best, t in states:
        arcs[(best, t), "."] = (("", 0), best + "t" * t if best else ".")
        arcs[(best, t), "T"] = ((best, 1), "o")
        for k in plain:
            arcs[(best, t), k] = ((k if not best or rank[k] < rank[best] else best, t), "o")
    return Transducer(arcs, ("", 0))


GRAMMAR = reduce(compose, (reported(), negated(), strongest()))


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray
    bias: float


class Classes(dict):
    """Word -> (symbol, strength), filled when asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.closed = {w: s for ws, s in ((TARGETS, "T"), (NEGATIONS, "N"), (REPORTS, "R")) for w in ws}

    def __missing__(self, word: str):
        if len(self) > 300_000:
            self.clear()
        strength = max([self.model.words.get(word, 0.0), *(self.model.stems.get(word[:k], 0.0) for k in STEMS if len(word) >= k)])
        if word in _THREATS:
            out = ("H", max(strength, 1.0))
        else:
            out = ("I", strength) if strength > 0 else (self.closed.get(word, "o"), 0.0)
        self[word] = out
        return out


_THREATS = frozenset(THREATS)


class Reader:
    """Clause features of whole texts."""

    def __init__(self, model: Model):
        self.classes = Classes(model)
        self.tokens: dict[str, tuple[str, ...]] = {}

    def _matched(self, token: str) -> tuple[str, ...]:
        """The insults and threats in a white-space token."""
        hit = self.tokens.get(token)
        if hit is None:
            if len(self.tokens) > 300_000:
                self.tokens.clear()
            hit = self.tokens[token] = tuple(w for w in _WORDS.findall(token) if self.classes[w][0] in MATCHES)
        return hit

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(len(KINDS))
        low = text.lower()
        hits = {w for t in set(low.split()) for w in self._matched(t)}
        if not hits:
            return out
        for clause in _CLAUSES.split(low):
            if not any(t in clause for t in hits):
                continue
            state, force = GRAMMAR.start, 0.0
            for word in _WORDS.findall(clause):
                symbol, strength = self.classes[word]
                force += strength
                state, _ = GRAMMAR.arcs[state, symbol]
            kind = GRAMMAR.arcs[state, "."][1]
            if kind != ".":
                out[_KIND[kind]] += force
        return np.log1p(out)


_KIND = {k: i for i, k in enumerate(KINDS)}


def lexicon(sample: DataFrame, entries: int = ENTRIES) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings that tell toxic documents, with strengths; at most ``entries`` of them.

    The bar of the likelihood ratio rises with the number of candidates, so chance finds do not pass.
    """
    tokens = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}']+"))
    stems = [_starts("w", k) for k in STEMS]
    rows = sample.select("y", tokens.alias("w")).select("y", F.explode(F.array_distinct(F.concat("w", *stems))).alias("f"))
    counts = rows.where("length(f) > 1").groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("a")).where("a >= 3")
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("a")).first()
    if not total["a"] or total["a"] == total["n"]:
        return {}, {}
    prior = total["a"] / total["n"]
    pi = F.col("a") / F.col("n")
    # Twice the log likelihood ratio against the prior share of toxic documents.
    part = lambda k, p, q: F.when(k > 0, k * F.log(p / q)).otherwise(F.lit(0.0))
    llr = 2 * (part(F.col("a"), pi, F.lit(prior)) + part(F.col("n") - F.col("a"), 1 - pi, F.lit(1 - prior)))
    candidates = counts.count()
    bar = 2 * np.log(max(candidates, 1))
    found = counts.withColumn("llr", llr).where((F.col("llr") > float(bar)) & (pi > 0.5)).orderBy(F.desc("llr"), "f").limit(entries)
    words, starts = {}, {}
    for row in found.collect():
        # Log odds against the prior, in units of a word seen 50 times in toxic documents only.
        strength = float(np.log((row["a"] + 0.5) / (row["n"] - row["a"] + 0.5) * (1 - prior) / prior) / np.log(101 * (1 - prior) / prior))
        if row["f"][0] == "^":
            starts[row["f"][1:]] = strength
        else:
            words[row["f"]] = strength
    return words, starts


def _starts(words: str, k: int):
    long = F.filter(words, lambda v: F.length(v) >= k)
    return F.transform(long, lambda v: F.concat(F.lit("^"), F.substring(v, 1, k)))


#: Where the weights start and are drawn to: plain matches count, negated and reported ones hardly.
PRIOR = np.array([3.0 * (0.3 if "r" in k else 1.0) * (0.2 if "n" in k else 1.0) * (1.2 if "t" in k else 1.0) for k in KINDS])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Ridge logistic regression around the prior weights by damped Newton steps."""
    w, bias = PRIOR.copy(), -2.0
    if not len(y):
        return w, bias
    a = np.c_[x, np.ones(len(x))]
    start = np.r_[PRIOR, -2.0]
    v, pull = start.copy(), np.r_[np.full(len(w), ridge), 0.05]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        g = a.T @ (p - y) + pull * (v - start)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(h, g)
        v = v - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return v[:-1], float(v[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    from spendlake.llm.common import staged

    rows = staged(training_sample(docs.select("doc_id", "text"), labels, "toxic", FOLDS, HELD_OUT, sample).select("text", "y"), "toxic-sample")
    words, starts = lexicon(rows)
    model = Model(words, starts, PRIOR, -2.0)

    def read(batches):
        reader = Reader(model)
        for batch in batches:
            x = [reader.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array([v.tolist() for v in x], pa.list_(pa.float64())), "y": batch.column(1)})

    found = sorted((tuple(r["x"]), r["y"]) for r in arrow_map(rows, read, "x array<double>, y int").collect())
    x, y = np.array([v for v, _ in found]).reshape(-1, len(KINDS)), np.array([v for _, v in found], dtype=float)
    weights, bias = fit(x, y)
    return Model(words, starts, weights, bias)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in a column ``name``. Null texts are scored as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    score = free_name(docs, name)

    def score_batches(batches):
        own = shared.value
        reader = Reader(own)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            x = np.array([reader.features(t or "") for t in texts]).reshape(-1, len(KINDS))
            z = x @ own.weights + own.bias
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p)], names=[*batch.schema.names[:-1], score])

    rows = docs.select("*", docs["text"].alias(free_name(docs, "text_in")))
    return arrow_map(rows, score_batches, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    The score uses the whole text only; null and empty texts have no clause and the lowest score. Repeated rows are
    scored alike, extra columns are not read, an empty table gives no rows, and without labels only threats count.
    """
    rows = scored(docs.select("doc_id", "text"), train(docs, labels, sample))
    return rows.select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
