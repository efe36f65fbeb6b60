"""Language-model scores from Brown classes: a class bigram model whose classes are learnt by exchange clustering.

Every word of the training texts gets a class by its own neighbours, in batches from frequent to rare:
1. the CORE most frequent words by exchange, on the matrix of their bigrams (a bounded amount, in one task): a word in
   turn moves to the class that raises the likelihood of the class bigram most, until a round moves none;
2. the rest of the LEXICON most frequent words, by the classes of their neighbours in all training texts;
3. all other words, however many, likewise, with those two as neighbours: their contexts are gathered by word over the
   cluster, so what is counted grows with the corpus and only matrices of CLASSES stay in one place.
In 2 and 3 a word takes the class under which its neighbours are likeliest, which is the exchange criterion for a word
whose own counts are small beside the class's.

P(word | before) = (1 - new) * P(class | state) * c(word) / c(class). The state is the class of the word before, if it is in
the lexicon (a bounded broadcast), else one of its own; transitions are smoothed with the classes' frequencies. The share
new of unseen words is that of words seen once (Good-Turing), spread evenly over as many unseen types as there are seen
ones, or as estimated from words seen once and twice (Chao) if that is more: an unseen word is never likelier than one seen
once is by its count. Over all words, unseen ones included, probabilities sum to 1. Scores are sums of log10 over a text's
words and its end.

Nulls: a null text is empty, its only token is the end. A null doc_id is not held out. Repeated rows count as often as
they occur. Ties between classes go to the first. Texts of any length are read whole. Without training documents every
count is 0 and every token is new. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, drop, held_out, slices, table, words_of, written

CORE, CLASSES, LEXICON = 2000, 32, 100_000
#: States and classes: 0 is the end of a text, 1.. the classes of words, OTHER a word outside.
OTHER = CLASSES + 1
SLOTS = CLASSES + 2
#: Share of the class frequencies in a transition.
BACK_OFF = 0.1
#: The end of a text; no word is empty.
STOP = ""
_FLUSH, _TOKENS, _LOW = 200_000, 500_000, (1 << 40) - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        seen.clear()
        return got

    for batch in slices(batches):
        for text in as_bytes(batch["text"]):
            seen.update(words_of(text))
            seen[b""] += 1
            if len(seen) > _FLUSH:
                yield out()
    if seen:
        yield out()


def vocabulary(train: DataFrame) -> DataFrame:
    """word, c over all training texts; the end of a text is the word ''."""
    return written(train.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")))


class Numbers(dict):
    """Numbers of words: 0 for the end, 1.. for those listed; others get the next, or stay all the same number."""

    def __init__(self, words: list[bytes], grow: bool):
        super().__init__(zip([b"", *words], range(len(words) + 1)))
        self.listed, self.grow = len(words) + 1, grow

    def __missing__(self, word: bytes) -> int:
        if not self.grow:
            return self.listed
        self[word] = out = len(self)
        return out


def _runs(batches: Iterator[pa.RecordBatch], numbers) -> Iterator[tuple[np.ndarray, Numbers]]:
    """Numbers of half a million tokens at a time, whole texts, each text between ends; numbers() makes fresh ones where
    they grow. The caller lets go of a run before it asks for the next, or two stay in memory."""
    own, ids = numbers(), [0]
    for batch in slices(batches):
        for text in as_bytes(batch["text"]):
            ids += map(own.__getitem__, words_of(text))
            ids.append(0)
            if len(ids) > _TOKENS:
                run = np.array(ids)
                ids = [0]
                yield run, own
                del run
                if own.grow:
                    del own
                    own = numbers()
    if len(ids) > 1:
        yield np.array(ids), own


def _cells(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(total)
    for s in range(0, len(at), 200_000):
        k = at[s : s + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k].astype(np.int64))], ["cell", "n"])


def _pairs(batches: Iterator[pa.RecordBatch], words, core: int) -> Iterator[pa.RecordBatch]:
    """(cell, n): counts of pairs of core words, ends and others (the last number) that follow each other."""
    n = core + 2
    total = np.zeros(n * n, np.int32)
    for a, _ in _runs(batches, functools.partial(Numbers, words.value[:core], False)):
        np.add.at(total, a[:-1] * n + a[1:], 1)
        del a
    yield from _cells(total)


def _phi(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(classes: np.ndarray, pairs: np.ndarray, k: int, fixed: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Classes (0 to k - 1) of the rows of the matrix of pairs after exchange until no row moves: each in turn, from
    frequent to rare, goes to the class with the greatest likelihood of the class bigram. Rows and classes in fixed
    keep to themselves."""
    classes = classes.copy()
    pairs = pairs.astype(float, copy=False)
    one = np.eye(k)[classes]
    after, before = pairs @ one, pairs.T @ one
    counts = one.T @ after
    d = np.arange(k)
    closed = np.unique(classes[fixed])
    order = np.argsort(-pairs.sum(1), kind="stable")
    free = order[~np.isin(order, fixed)]
    for _ in range(rounds):
        moved = False
        for w in free:
            own, t = classes[w], pairs[w, w]
            f, g = after[w].copy(), before[w].copy()
            f[own] -= t
            g[own] -= t
            if not f.any() and not g.any() and not t:
                continue
            counts[own] -= f
            counts[:, own] -= g
            counts[own, own] -= t
            base = _phi(counts)
            diag = base[d, d]
            on = counts[d, d]
            gain = (_phi(counts + f) - base).sum(1) - (_phi(on + f) - diag) + (_phi(counts + g[:, None]) - base).sum(0) - (_phi(on + g) - diag) + _phi(on + f + g + t) - diag
            rows, cols = counts.sum(1), counts.sum(0)
            # the class's own margins grow by what the word adds to them; those of its neighbours by what they gain
            gain -= _phi(rows + f.sum() + g + t) - _phi(rows + g) + _phi(cols + g.sum() + f + t) - _phi(cols + f)
            gain[closed] = -np.inf
            gain[own] += 1e-9 * abs(gain[own])
            to = int(gain.argmax())
            counts[to] += f
            counts[:, to] += g
            counts[to, to] += t
            if to != own:
                moved = True
                classes[w] = to
                for x, col in ((after, pairs[:, w]), (before, pairs[w])):
                    x[:, own] -= col
                    x[:, to] += col
        if not moved:
            break
    return classes


def _exchanged(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(number, class): classes of the core's words, by number, from the cells of _pairs."""
    n = words + 2
    pairs = np.zeros(n * n)
    for batch in batches:
        pairs[batch["cell"].to_numpy()] = batch["n"].to_numpy()
    start = np.concatenate([[0], 1 + np.arange(words) % CLASSES, [OTHER]])
    classes = exchange(start, pairs.reshape(n, n), SLOTS, np.array([0, n - 1]))
    one = np.eye(SLOTS)[classes]
    counts = (one.T @ pairs.reshape(n, n) @ one).ravel()
    kind = np.concatenate([np.zeros(words, np.int32), np.ones(SLOTS * SLOTS, np.int32)])
    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([np.arange(1, words + 1), np.arange(SLOTS * SLOTS)]).astype(np.int64)), pa.array(np.concatenate([classes[1 : words + 1], counts]).astype(np.int64))], ["kind", "at", "n"])


def weights(counts: np.ndarray) -> np.ndarray:
    """Of neighbours (SLOTS before a word, then SLOTS after it) by class 1 to CLASSES of the word: the log probability of
    the neighbour's class, from counts of pairs of classes."""
    own = counts[:, 1:OTHER]
    left = np.log((own + 0.5) / (own.sum(0) + 0.5 * SLOTS))
    own = counts[1:OTHER].T
    return np.concatenate([left, np.log((own + 0.5) / (own.sum(0) + 0.5 * SLOTS))])


def _contexts(batches: Iterator[pa.RecordBatch], words, states: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
    """(cell, n): for each lexicon word from number first on, counts of states before and after it. states: by number."""
    listed = words.value
    total = np.zeros((len(listed) + 1 - first) * 2 * SLOTS, np.int32)
    for a, _ in _runs(batches, functools.partial(Numbers, listed, False)):
        s = states[a]
        at = np.flatnonzero((a >= first) & (a <= len(listed)))
        own = (a[at] - first) * (2 * SLOTS)
        np.add.at(total, own + s[at - 1], 1)
        np.add.at(total, own + SLOTS + s[at + 1], 1)
        del a, s, at, own
    yield from _cells(total)


def _best(batches: Iterator[pa.RecordBatch], size: int, w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(class) of each of size words in turn, from the cells of _contexts."""
    seen = np.zeros(size * 2 * SLOTS)
    for batch in batches:
        seen[batch["cell"].to_numpy()] = batch["n"].to_numpy()
    classes = 1 + (seen.reshape(size, -1) @ w).argmax(1) if size else np.empty(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(size).astype(np.int32)), pa.array(classes.astype(np.int32))], ["at", "class"])


_REST = "word string, seen array<long>, cell int, n long"


def _rest(batches: Iterator[pa.RecordBatch], words, states: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per word outside the lexicon the states beside it (slot << 40 | count), and cells of pairs of states."""
    listed = words.value
    total = np.zeros(SLOTS * SLOTS, np.int64)
    for a, own in _runs(batches, functools.partial(Numbers, listed, True)):
        first = own.listed
        s = states[np.minimum(a, first)]
        total += np.bincount(s[:-1] * SLOTS + s[1:], minlength=len(total))
        at = np.flatnonzero(a >= first)
        if not len(at):
            continue
        w = (a[at] - first) * (2 * SLOTS)
        cells, n = np.unique(np.concatenate([w + s[at - 1], w + SLOTS + s[at + 1]]), return_counts=True)
        ends = np.searchsorted(cells // (2 * SLOTS), np.arange(len(own) - first + 1))
        seen = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((cells % (2 * SLOTS)) << 40 | n))
        names = pa.array(list(own)[first:], pa.binary()).cast(pa.string())
        k = len(names)
        del a, own, s, at, w, cells, n, ends
        for b in range(0, k, 100_000):
            part = names[b : b + 100_000]
            yield pa.RecordBatch.from_arrays([part, seen[b : b + 100_000], pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.int64())], ["word", "seen", "cell", "n"])
        del seen, names, part
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.list_(pa.int64())), pa.array(at.astype(np.int32)), pa.array(total[at])], ["word", "seen", "cell", "n"])


_ASSIGNED = "word string, c long, class int, cell int, n long"


def _assign(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, c, class) of rows of _rest sorted by word, and cells (state before, class) with their counts."""
    total = np.zeros(SLOTS * SLOTS, np.int64)
    held: tuple[str, np.ndarray] | None = None  # the last word and its counts by slot: it may go on

    def done(names: list[str], counts: np.ndarray) -> pa.RecordBatch:
        classes = 1 + (counts @ w).argmax(1)
        np.add.at(total.reshape(SLOTS, SLOTS).T, classes, counts[:, :SLOTS].astype(np.int64))
        k = len(names)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts[:, :SLOTS].sum(1).astype(np.int64)), pa.array(classes.astype(np.int32)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], ["word", "c", "class", "cell", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        words, seen = batch["word"], batch["seen"]
        new = np.append(True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False))
        run = np.cumsum(new) - 1
        flat = seen.flatten().to_numpy()
        lengths = np.diff(seen.offsets.to_numpy())
        names = words.filter(pa.array(new)).to_pylist()
        counts = np.bincount(np.repeat(run, lengths) * (2 * SLOTS) + (flat >> 40), flat & _LOW, minlength=len(names) * 2 * SLOTS).reshape(len(names), -1)
        if held and held[0] == names[0]:
            counts[0] += held[1]
        elif held:
            yield done([held[0]], held[1][None])
        held = (names[-1], counts[-1])
        if len(names) > 1:
            yield done(names[:-1], counts[:-1])
    if held:
        yield done([held[0]], held[1][None])
    at = np.flatnonzero(total)
    k = len(at)
    yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["word", "c", "class", "cell", "n"])


class Model:
    """What scoring needs of the learnt counts, but for the words outside the lexicon; all of bounded size.

    words, c, classes: of the lexicon. counts: (state, class) of all training tokens, by class of the token. n, v: tokens
    and distinct tokens, once and twice: of words seen so often. stops: ends of texts."""

    def __init__(self, words: list[bytes], c: np.ndarray, classes: np.ndarray, counts: np.ndarray, n: int, v: int, once: int, twice: int, stops: int):
        self.words, self.n, self.v, self.stops = words, n, v, stops
        new = (once + 1) / (n + 2)
        self.unseen = float(np.log10(new / (max(v, once * once / (2 * max(twice, 1))) + 1)))
        own = counts[:, :OTHER].sum(0)
        share = own / max(1, own.sum())
        rows = counts[:, :OTHER].sum(1, keepdims=True)
        with np.errstate(divide="ignore"):
            #: log10 P(class | state), of seen words, and of a class's count: what a word's count is divided by.
            self.step = np.log10((1 - new) * ((1 - BACK_OFF) * (counts[:, :OTHER] + share) / (rows + 1) + BACK_OFF * share))
            self.sizes = np.log10(own)
            #: By number: state, and score of the word given its class; numbers past the lexicon are others.
            self.states = np.concatenate([[0], classes, [OTHER]])
            self.emit = np.concatenate([[0.0 if stops else self.unseen], np.log10(c) - self.sizes[classes], [0.0]])
        self.base = np.concatenate([[np.log10(stops + 1)], np.log10(c + 1.0), [0.0]])
        if not stops:
            self.step = np.zeros_like(self.step)


def _square(df: DataFrame) -> np.ndarray:
    """The sums of (cell, n) as a matrix of states by states."""
    out = np.zeros(SLOTS * SLOTS, np.int64)
    for cell, n in df.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(SLOTS, SLOTS)


def learnt(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and word, c, class of the words outside the lexicon."""
    spark, texts = train.sparkSession, train.select("text")
    vocab = vocabulary(train)
    top = vocab.where(F.col("word") != STOP).orderBy(F.desc("c"), "word").limit(LEXICON).select("word", "c").toArrow()
    totals = vocab.agg(F.sum("c"), F.count("*"), F.count_if(F.expr("c = 1 AND word <> ''")), F.count_if(F.expr("c = 2 AND word <> ''")), F.sum(F.when(F.col("word") == STOP, F.col("c")))).first()
    drop(vocab)
    words, c = as_bytes(top["word"].combine_chunks()), top["c"].to_numpy().astype(float)
    listed = spark.sparkContext.broadcast(words)
    core = min(CORE, len(words))
    add = lambda df: df.groupBy("cell").agg(F.sum("n").alias("n"))
    # 1
    cells = add(texts.mapInArrow(functools.partial(_pairs, words=listed, core=core), "cell int, n long"))
    found = cells.repartition(1).mapInArrow(functools.partial(_exchanged, words=core), "kind int, at long, n long").toArrow()
    kind, at, n = (found[x].to_numpy() for x in ("kind", "at", "n"))
    classes = np.zeros(len(words), np.int64)
    classes[at[kind == 0] - 1] = n[kind == 0]
    counts = np.zeros(SLOTS * SLOTS)
    counts[at[kind == 1]] = n[kind == 1]
    # 2
    states = np.full(len(words) + 2, OTHER)
    states[0], states[1 : core + 1] = 0, classes[:core]
    if len(words) > core:
        cells = add(texts.mapInArrow(functools.partial(_contexts, words=listed, states=states, first=core + 1), "cell int, n long"))
        found = cells.repartition(1).mapInArrow(functools.partial(_best, size=len(words) - core, w=weights(counts.reshape(SLOTS, SLOTS))), "at int, class int").toArrow()
        classes[core + found["at"].to_numpy()] = found["class"].to_numpy()
        states[1:-1] = classes
    # 3
    rest = written(texts.mapInArrow(functools.partial(_rest, words=listed, states=states), _REST))
    counts = _square(rest)
    sorted_ = rest.where("word IS NOT NULL").select("word", "seen").repartition("word").sortWithinPartitions("word")
    others = written(sorted_.mapInArrow(functools.partial(_assign, w=weights(counts.astype(float))), _ASSIGNED))
    counts[:, OTHER] = 0
    counts += _square(others)
    drop(rest)
    listed.destroy()
    return Model(words, c, classes, counts.astype(float), totals[0] or 0, totals[1] or 0, totals[2] or 0, totals[3] or 0, totals[4] or 0), others.where("word IS NOT NULL").select("word", "c", "class")


#: Rows of documents have no word; rows of words outside the lexicon only row, word, state and n.
_PART = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word", pa.string()), ("state", pa.int32()), ("n", pa.int64())])
_SOME = 500


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Per document a row of what the lexicon settles, and rows for the other words of it, by state before them."""
    from pyspark import TaskContext

    m: Model = model.value
    numbers, last = Numbers(m.words, False), len(m.words) + 1
    row = TaskContext.get().partitionId() << 40
    for whole in batches:
        for at in range(0, whole.num_rows, _SOME):
            batch = whole.slice(at, _SOME)
            docs, rest = [], []
            for doc_id, held, text in zip(batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), as_bytes(batch["text"])):
                tokens = words_of(text)
                ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
                ids = np.append(ids, 0)
                before, on = np.append(0, m.states[ids[:-1]]), ids < last
                score = float(m.emit[ids].sum() + m.step[before[on], m.states[ids[on]]].sum())
                others = np.flatnonzero(~on)
                for (w, s), n in Counter(zip(map(tokens.__getitem__, others.tolist()), before[others].tolist())).items():
                    rest.append((row, w, s, n))
                docs.append((row, doc_id, held, len(ids), len(ids) - len(others) - (not m.stops), float(m.base[ids].sum()), score))
                row += 1
            for rows, names in ((docs, _PART.names[:7]), (rest, ["row", "word", "state", "n"])):
                cols = dict(zip(names, zip(*rows))) if rows else {}
                words = {"word": pa.array(cols.pop("word"), pa.binary()).cast(pa.string())} if "word" in cols else {}
                yield pa.RecordBatch.from_arrays([words[f.name] if f.name in words else pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(len(rows), f.type) for f in _PART], schema=_PART)


def scored(docs: DataFrame, held) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row per row of docs (doc_id, text).
    Learns from the rows where held is false."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    model, others = learnt(docs.where("NOT held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word string, state int, n long"
    parts = written(docs.mapInArrow(functools.partial(_score, model=shared), schema))
    shared.destroy()
    # log10 P(class | state) - log10 of the class's count, by state and class
    each = np.where(np.isfinite(model.step) & np.isfinite(model.sizes), np.nan_to_num(model.step) - np.nan_to_num(model.sizes), 0.0).ravel()
    step = F.element_at(F.array(*(F.lit(float(x)) for x in each)), F.expr(f"state * {OTHER} + class + 1").cast("int"))
    rest = parts.where("word IS NOT NULL").select("row", "word", "state", "n").join(others, "word", "left")
    rest = rest.withColumns({"s": F.col("n") * F.when(F.col("c").isNotNull(), step + F.log10("c")).otherwise(F.lit(model.unseen)), "b": F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1), "k": F.when(F.col("c").isNotNull(), F.col("n"))})
    sums = rest.groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    out = parts.where("word IS NULL").drop("word", "state", "n").join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "k").cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), (plus("base", "b") - F.col("n_tokens") * F.lit(float(np.log10(model.n + model.v + 1)))).alias("base_score"), plus("score", "s").alias("score"))


def op6_classlm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, held_out(F.col("doc_id"), 7, 2))
