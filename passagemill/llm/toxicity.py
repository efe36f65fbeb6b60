"""Toxicity by a linear-chain conditional random field over tokens.

Labels are of documents. Tokens are labelled from them: words, and beginnings of words, that occur in far more toxic than
clean documents of the training sample mark a token of a toxic document as toxic. A two-state chain over the tokens of
a line is trained on those by gradient ascent on the conditional likelihood, with forward-backward marginals; its
features are a token's word, beginnings and ending. For every document the marginals of its tokens give the largest, and
their sum; a logistic of both, fitted on the same sample, is the score. Tokens with a marginal of at least 0.5 are spans.

The model is fitted in one executor task on a bounded sample: at most SAMPLE labelled documents of each class, by hash of
id, one text of each (the one of least hash where an id has several), whole texts with all their lines, until
SAMPLE_BYTES of text. The driver gets the packed weights only. Scoring reads every whole text, however long. Nulls: a null
or empty text has no tokens and gets the score of none; a null id is scored like any other. A label of a document that
has several is the largest; labels without documents do not matter. Without labels of both classes every score is the
share of toxic labels, 0 if there are none. A score of exactly 0.5 is toxic. Repeated rows get equal scores. scored()
replaces columns named score, predicted or spans; filtered() returns the columns that it got, whatever their names.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .shared import held_out, table, unused

SAMPLE, SAMPLE_BYTES = 2000, 32 << 20
#: Of a word or beginning that marks tokens: least toxic documents, and least log of odds.
LEAST_DOCS, LEAST_ODDS = 3, 2.5
BEGINNINGS = (4, 5, 6)
CACHE = 400_000
_EDGE = ".,;:!?\"'()[]{}<>#*$%&|-_+=/\\~`^@“”‘’«»¡¿…"


def plain(token: str) -> str:
    return token.strip(_EDGE).lower() or token.lower()


def features(token: str) -> list[str]:
    w = plain(token)
    return [f"w{w}", *(f"{n}{w[:n]}" for n in BEGINNINGS if len(w) >= n), f"e{w[-3:]}", "b"]


@dataclass
class Model:
    """packed: pickled weights by feature, of state 1 against 0. chain: log weights of state pairs, from row to column."""

    packed: bytes = field(default_factory=lambda: pickle.dumps({}))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    logistic: tuple[float, ...] = (0.0, 0.0, 0.0)
    constant: float | None = None


def marginals(odds: np.ndarray, lengths: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of each token, and expected counts of state pairs, of padded rows of token log odds."""
    n, most = odds.shape
    step, e1 = np.exp(chain), np.exp(np.clip(odds, -30, 30))
    a0, a1, b = np.empty((most, n)), np.empty((most, n)), np.ones((most, n))
    x0, x1 = np.full(n, 0.5), np.full(n, 0.5) * e1[:, 0]
    for t in range(most):
        if t:
            x0, x1 = x0 * step[0, 0] + x1 * step[1, 0], (x0 * step[0, 1] + x1 * step[1, 1]) * e1[:, t]
        total = x0 + x1
        x0, x1 = x0 / total, x1 / total
        a0[t], a1[t] = x0, x1
    # backward: b is the weight of state 1 against 0, of what follows
    r = np.ones(n)
    pairs = np.zeros((2, 2))
    for t in range(most - 1, -1, -1):
        r = np.where(lengths - 1 <= t, 1.0, r)
        b[t] = r
        if t:
            live = lengths > t
            f0, f1 = np.ones(n), e1[:, t] * r
            w = [[a0[t - 1] * step[0, 0] * f0, a0[t - 1] * step[0, 1] * f1], [a1[t - 1] * step[1, 0] * f0, a1[t - 1] * step[1, 1] * f1]]
            z = w[0][0] + w[0][1] + w[1][0] + w[1][1]
            for i in (0, 1):
                for j in (0, 1):
                    pairs[i, j] += (w[i][j] / z)[live].sum()
            r = (step[1, 0] * f0 + step[1, 1] * f1) / (step[0, 0] * f0 + step[0, 1] * f1)
    p = a1 * b / (a0 + a1 * b)
    return p.T, pairs


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in rows])
    out = np.zeros((len(rows), lengths.max()))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.concatenate(rows)
    return out, lengths


def line_marginals(lines: list[np.ndarray], chain: np.ndarray, cells: int = 1 << 20) -> list[np.ndarray]:
    """Marginals of each line; lines of like length go together."""
    out: list[np.ndarray] = [np.empty(0)] * len(lines)
    order = np.argsort([len(x) for x in lines], kind="stable")
    k = 0
    while k < len(order):
        end, low = k, len(lines[order[k]])
        while end < len(order) and len(lines[order[end]]) <= 1.5 * low + 4 and (end - k + 1) * len(lines[order[end]]) <= max(cells, len(lines[order[end]])):
            end += 1
        end = max(end, k + 1)
        own = order[k:end]
        if low or len(lines[own[-1]]):
            odds, lengths = _padded([lines[i] for i in own])
            p, _ = marginals(odds, lengths, chain)
            for row, i in enumerate(own):
                out[i] = p[row, : lengths[row]]
        k = end
    return out


def marks(texts: list[str], labels: list[int]) -> set[str]:
    """Words (w...) and beginnings (4..., 5..., 6...) that mark a token as toxic, from documents and their labels."""

    def seen(label: int, of: set[str] | None = None) -> Counter:
        found: Counter = Counter()
        for text, y in zip(texts, labels):
            if y == label:
                own = {f for t in set(text.split()) for f in features(t)[:-2]}
                found.update(own if of is None else own & of)
        return found

    n = {y: max(1, sum(x == y for x in labels)) for y in (0, 1)}
    toxic = {f: k for f, k in seen(1).items() if k >= LEAST_DOCS}
    clean = seen(0, set(toxic))
    return {f for f, k in toxic.items() if np.log((k + 0.1) / n[1]) - np.log((clean[f] + 0.5) / n[0]) >= LEAST_ODDS}


def _batches(lengths: np.ndarray, rows: int, cells: int) -> list[np.ndarray]:
    """Lines of like length together, at most so many and so many padded cells, but one at least."""
    out, order, k = [], np.argsort(lengths, kind="stable"), 0
    while k < len(order):
        end = k + 1
        while end < len(order) and end - k < rows and (end - k + 1) * lengths[order[end]] <= cells:
            end += 1
        out.append(order[k:end])
        k = end
    return out


def train(texts: list[str], labels: list[int], rounds: int = 8, batch: int = 256, cells: int = 1 << 16, seed: int = 7) -> Model:
    """A line is a chain, however long; all lines of the texts count."""
    marked = marks(texts, labels)
    number: dict[str, int] = {}  # tokens by order of appearance
    lines, golds = [], []
    toxic: dict[str, float] = {}
    for text, y in zip(texts, labels):
        for line in text.split("\n"):
            if tokens := line.split():
                lines.append(np.array([number.setdefault(t, len(number)) for t in tokens], np.int32))
                if y:
                    for t in tokens:
                        if t not in toxic:
                            toxic[t] = float(any(f in marked for f in features(t)[:-2]))
                    golds.append(np.array([toxic[t] for t in tokens], np.float32))
                else:
                    golds.append(np.zeros(len(tokens), np.float32))
    if not lines:
        return Model(constant=float(np.mean(labels)))
    often = np.bincount(np.concatenate(lines), minlength=len(number))
    count: Counter = Counter()
    for t, n in zip(number, often.tolist()):
        for f in features(t):
            count[f] += n
    ids = {f: k for k, f in enumerate(sorted(f for f, n in count.items() if n >= 2))}
    wide = len(BEGINNINGS) + 3
    coded = np.full((len(number), wide), len(ids), np.int32)
    for k, t in enumerate(number):
        own = [ids[f] for f in features(t) if f in ids]
        coded[k, : len(own)] = own
    del count, toxic
    have = np.array([np.bincount(2 * y[:-1] + y[1:], minlength=4).reshape(2, 2) for y in (g.astype(int) for g in golds)])
    w, chain = np.zeros(len(ids) + 1), np.array([[0.5, -0.5], [-0.5, 0.5]])
    gw, gc = np.full(len(w), 1e-3), np.full((2, 2), 1e-3)
    rng = np.random.default_rng(seed)
    groups = _batches(np.array(list(map(len, lines))), batch, cells)
    for _ in range(rounds):
        for k in rng.permutation(len(groups)):
            own = groups[k]
            lengths, flat = np.array([len(lines[i]) for i in own]), coded[np.concatenate([lines[i] for i in own])]
            odds, _ = _padded(np.split(w[flat].sum(1), np.cumsum(lengths)[:-1]))
            p, pairs = marginals(odds, lengths, chain)
            live = np.arange(odds.shape[1]) < lengths[:, None]
            off = np.concatenate([golds[i] for i in own]) - p[live]
            g = np.bincount(flat.ravel(), np.repeat(off, wide), minlength=len(w)) / len(own) - 1e-4 * w
            g2 = (have[own].sum(0) - pairs) / len(own) - 1e-4 * chain
            gw += g * g
            gc += g2 * g2
            w += 0.3 * g / np.sqrt(gw)
            w[-1] = 0
            chain += 0.1 * g2 / np.sqrt(gc)
    model = Model(pickle.dumps({f: float(w[k]) for f, k in ids.items() if abs(w[k]) > 1e-3}), chain)
    del lines, golds, coded, number, ids
    odds_of = Odds(model)
    x = np.concatenate([summarised([t.split("\n") for t in texts[s : s + 500]], model, odds_of) for s in range(0, len(texts), 500)])
    y, b = np.array(labels, float), np.zeros(3)
    full = np.column_stack([np.ones(len(x)), x])
    for _ in range(30):  # Newton, with a ridge
        q = 1 / (1 + np.exp(-full @ b))
        b += np.linalg.solve(full.T @ (full * (q * (1 - q))[:, None]) + 1e-2 * np.eye(3), full.T @ (y - q) - 1e-2 * b)
    model.logistic = tuple(map(float, b))
    return model


class Odds(dict):
    """Log odds of a token by itself."""

    def __init__(self, model: Model):
        super().__init__()
        self.weights = pickle.loads(model.packed)

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        get = self.weights.get
        self[token] = out = sum(get(f, 0.0) for f in features(token))
        return out


def doc_marginals(lines: list[list[str]], model: Model, odds: Odds) -> list[np.ndarray]:
    """Marginals of the tokens of each document, given as lines."""
    flat, ends = [], [0]
    for doc in lines:
        for line in doc:
            if tokens := line.split():
                flat.append(np.fromiter(map(odds.__getitem__, tokens), float, len(tokens)))
        ends.append(len(flat))
    p = line_marginals(flat, model.chain)
    return [np.concatenate(p[a:b]) if b > a else np.empty(0) for a, b in zip(ends, ends[1:])]


def _summary(p: np.ndarray) -> tuple[float, float]:
    return (float(p.max()), float(np.log1p(p[p > 0.05].sum()))) if len(p) else (0.0, 0.0)


def summarised(lines: list[list[str]], model: Model, odds: Odds) -> np.ndarray:
    return np.array([_summary(p) for p in doc_marginals(lines, model, odds)]).reshape(-1, 2)


def _fit(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """One row, packed: the model of rows (text, y) in the order they come, until their texts have most bytes."""
    texts, labels, size = [], [], 0
    for batch in batches:
        for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist()):
            size += len(text.encode())
            if texts and size > most:
                break
            texts.append(text)
            labels.append(y)
    if len(set(labels)) < 2:
        model = Model(constant=float(np.mean(labels)) if labels else 0.0)
    else:
        model = train(texts, labels)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["packed"])


def fitted(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Model:
    """docs with doc_id and text, labels with doc_id and toxic; ids with crc32(id) mod parts = part are never read."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"), parts, part)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = own.select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic") > 0).cast("int").alias("y"))
    few = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
    ids = F.broadcast(few(0).union(few(1)))  # at most 2 x sample rows
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(ids, F.col("doc_id") == F.col("id"))
    one = found.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    packed = one.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("text", "y").mapInArrow(functools.partial(_fit, most=most), "packed binary")
    row = packed.first()
    return pickle.loads(row["packed"]) if row else Model(constant=0.0)


def _score(batches: Iterator[pa.RecordBatch], model, spans: bool, score: str, spans_as: str) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    odds = Odds(m)
    b0, b1, b2 = m.logistic
    for batch in batches:
        texts = batch["text"].to_pylist()
        scores, found = [], []
        if m.constant is not None:
            scores, found = [m.constant] * len(texts), [[] for _ in texts]
        else:
            for s in range(0, len(texts), 1000):
                part = [(t or "").split("\n") for t in texts[s : s + 1000]]
                for text, p in zip(texts[s : s + 1000], doc_marginals(part, m, odds)):
                    top, many = _summary(p)
                    scores.append(float(1 / (1 + np.exp(-(b0 + b1 * top + b2 * many)))))
                    hits = set(np.flatnonzero(p >= 0.5).tolist()) if spans and len(p) else ()
                    found.append([{"start": x.start(), "end": x.end(), "p": float(p[k])} for k, x in enumerate(re.finditer(r"\S+", text)) if k in hits] if hits else [])
        cols = {c: batch[c] for c in batch.schema.names} | {score: pa.array(scores, pa.float64())}
        if spans:
            cols[spans_as] = pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def scored(docs: DataFrame, model: Model, spans: bool = False, names: tuple[str, str, str] = ("score", "predicted", "spans")) -> DataFrame:
    """docs with score and predicted; with spans, also the toxic tokens' character offsets and marginals. names: of the
    three, which replace columns so named."""
    score, predicted, spans_as = names
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [*docs.schema.fields, StructField(score, DoubleType())]
    if spans:
        fields.append(StructField(spans_as, ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("p", DoubleType())]))))
    out = docs.mapInArrow(functools.partial(_score, model=shared, spans=spans, score=score, spans_as=spans_as), StructType(fields))
    return out.withColumn(predicted, (F.col(score) >= 0.5).cast("int"))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with their own columns."""
    names = (unused(docs, "_score"), unused(docs, "_predicted"), unused(docs, "_spans"))
    return scored(docs, fitted(docs, labels), names=names).where(F.col(names[1]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
