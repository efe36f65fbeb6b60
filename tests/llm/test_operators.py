"""Brute-force versions, round trips, held-out accuracy and edge cases of the ten operators."""

from __future__ import annotations

import collections
import html as html_
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from passagemill.llm import classlm, embeddings, html, license_rules, licenses, minhash, mixing, packing, quality, queries, shared, token_counts, tokens, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 30_000 + "\n" + "x" * 50_000
EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (None, "no id here", "en", "a", 1), (4, "Same Text of six words here", "en", "b", 1), (4, "Same Text of six words here", "en", "b", 1), (5, "same text OF six words here", "de", "b", 1), (6, LONG, "en", None, 9), (7, "\x00 ß İ 中文 \x1c\xa0z", "fr", "c", 3)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert sorted(repr([r[k] for k in cols]) for r in df.collect()) == sorted(repr([dict(zip(names, r))[k] for k in cols]) for r in found.fetchall())


# 1

PAGES = [
    ("<html><head><title>T</title></head><body><nav>menu</nav><article><h1>Hi</h1><p>A &amp; b<br>c<p>D  d</article><footer>f</footer>", "Hi\nA & b c\nD d"),
    ("<body><div class='sidebar'><p>Side, side, side, words and words and words</p></div><main><p>Main</p><!-- <p>no --><script>'<p>no</p>'</script></main>", "Main"),
    ("<div id=wrap><div class=content><p>First one, with commas, and enough of words to count.</p><p>Second one, as long as the first, or nearly.</p></div><div class='comments'><p>Me too, I think, and so on, for a long, long time, really.</p></div></div>", "First one, with commas, and enough of words to count.\nSecond one, as long as the first, or nearly."),
    ("<article><p>x</p><form>send</form><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul><aside>y</aside><p>z &lt; &#65;&nbsp;&eacute", "x\nz < A é"),
    ("<header>Site</header><article><header><h1>Own</h1></header><p>t</p></article>", "Own\nt"),
    ("", ""), (None, ""), ("plain words only", "plain words only"), ("<p>unclosed <b>bold", "unclosed bold"), ("<!-- never closed <p>x", ""), ("<script>never closed", ""), ("<a \"<a \"" * 500, "<a \"<a \"" * 500 and None),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_html(page, want):
    got = html.extracted(page)
    assert want is None or got == want


def test_html_without_article():
    """Split sections, short paragraphs, lists, tables and bare text all stay; menus and furniture go."""
    long = "A sentence, with commas, of some length, that goes on, and on, for a while."
    parts = ["<h2>Title</h2>", "<p>Short.</p>", f"<section><p>{long}</p><p>{long}</p><p>{long}</p></section>", f"<section><p>{long}</p></section>", "<section><p>Brief part</p></section>", "<ul><li>one</li><li>two</li><li>three</li></ul>", "<table><tr><td>cell</td></tr></table>", "<figure><figcaption>A figure</figcaption></figure>", "bare text"]
    want = ["Title", "Short.", long, long, long, long, "Brief part", "one", "two", "three", "cell", "A figure", "bare text"]
    menu = "<div><a href=1>Home</a> <a href=2>About</a></div>"
    rest = "<footer>f</footer><div class='comments'><p>Me too, I think.</p></div>"
    assert html.extracted(f"<body>{menu}<div>{''.join(parts)}</div>{rest}</body>").split("\n") == want
    nested = f"<body>{menu}<div id=a>{''.join(f'<div>{x}</div>' for x in parts)}</div>{rest}</body>"
    assert html.extracted(nested).split("\n") == want


def test_html_of_articles(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        parts = (" ".join(html_.unescape(re.sub(r"<(?!/?(?:p|h1)\b)[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert html.extracted(r["html"]) == "\n".join(x for x in parts if x)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, None, "n"), (None, "u", "<p>a</p>", "n")], "page_id long, url string, html string, text string")
    assert sorted(map(repr, map(tuple, html.main_texts(df).collect()))) == ["(1, None, '', 0)", "(None, 'u', 'a', 1)"]


# 2

def test_vectors_edge(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(40, 16))
    rows = [(i, i % 2, list(map(float, v))) for i, v in enumerate(a)] + [(100 + i, i % 2, list(map(float, v * 3 + 1e-3))) for i, v in enumerate(a)]
    rows += [(200, 0, None), (201, 0, [0.0] * 16), (202, 0, [math.nan] * 16), (203, 0, [None] * 16), (204, None, rows[0][2]), (None, 0, rows[0][2]), (205, 0, rows[0][2][:8]), (0, 0, rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: r for r in embeddings.clustered(df).collect()}
    assert all(got[i]["n_links"] == 1 and got[100 + i]["component_id"] == i and not got[100 + i]["kept"] for i in range(40))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (200, 201, 202, 203, 204, 205, None)) and len(got) == 87
    assert embeddings.clustered(df.limit(0)).count() == 0


def test_vectors_in_blocks(monkeypatch):
    """A large group of near copies, dealt to lists and pairs of blocks, has each link once."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(3, 32))
    rows = np.concatenate([base[rng.integers(0, 3, 150)] + 0.15 * rng.normal(size=(150, 32)), rng.normal(size=(50, 32))])
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    ids, near, block = np.arange(200), embeddings.nearest(rows, rows[:40]), rng.integers(0, 3, 200)
    total = np.zeros(200, int)
    for p in range(40):
        on = (near == p).any(1)
        for i in range(3):
            for j in range(i, 3):
                k = np.flatnonzero(on & ((block == i) | (block == j)))
                k = k[np.argsort(block[k] != i, kind="stable")]
                if len(k):
                    n, _ = embeddings.linked(ids[k], rows[k], near[k], p, None if i == j else int((block[k] == i).sum()))
                    total[k] += n
    want = (rows @ rows.T >= 0.93).sum(1) - 1
    assert abs(total - want).sum() <= 0.01 * want.sum() and (total <= want).all()


@pytest.mark.parametrize("inner", [0.95, 0.9, 0.6])
def test_vectors_of_a_large_group(inner):
    """Recall against all pairs in a group that holds a third of the rows, with hundreds of pivots."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    base /= np.linalg.norm(base)
    noise = rng.normal(size=(1365, 64))
    group = math.sqrt(inner) * base + math.sqrt(1 - inner) * noise / np.linalg.norm(noise, axis=1)[:, None]
    copies = group[:300] + 0.03 * rng.normal(size=(300, 64))
    sample = np.concatenate([group, rng.normal(size=(2731, 64))])
    sample, rows = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.permutation(sample), np.concatenate([group[:300], copies])))
    pivots = embeddings.apart(sample, 316)
    near = embeddings.nearest(rows, pivots)
    has = np.zeros((len(rows), len(pivots)))
    has[np.arange(len(rows))[:, None], near] = 1
    want = rows @ rows.T >= embeddings.COSINE
    assert len(pivots) == 316 and want.sum() > len(rows)
    assert (want & (has @ has.T >= embeddings.SHARED)).sum() >= 0.999 * want.sum()


def test_vectors_of_one_group(spark):
    """Near copies alone, so few pivots: each link is found."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=64) + 0.2 * rng.normal(size=(900, 64))
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    df = spark.createDataFrame([(i, 0, list(map(float, v))) for i, v in enumerate(rows)], "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.clustered(df).collect()}
    assert [got[i] for i in range(900)] == ((unit @ unit.T >= embeddings.COSINE).sum(1) - 1).tolist()


# 3

def test_mix(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mixed(df).collect()
    again = {r["doc_id"]: r["copies"] for r in mixing.mixed(df.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}
    size = {i: len(WORD.findall(t)) for i, t in df.select("doc_id", "text").collect()}
    per, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["copies"] <= 3
        per[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    want, left, names = {}, float(sum(per.values())), sorted(per)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    while True:  # the excess is reshared until none is above
        open_ = [s for s in names if s not in want]
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * per[s]]
        if not over:
            want |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        for s in over:
            want[s] = 3.0 * per[s]
        left = sum(per.values()) - sum(want.values())
    for s in names:
        assert math.isclose(target[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 300


def test_mix_edge(edge, none):
    rows = mixing.mixed(edge).collect()
    assert len(rows) == len(EDGE) and all(r["size"] == len(WORD.findall(dict((e[0], e[1]) for e in EDGE)[r["doc_id"]] or "")) for r in rows)
    assert set(mixing.repeated(edge).columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    assert mixing.mixed(none).count() == 0


# 4

def test_sketch_agrees_with_similarity():
    rng = np.random.default_rng(2)
    for n, share in ((3, 2), (400, 300), (5000, 1000)):
        a = rng.integers(0, 2**63, 2 * n - share, dtype=np.uint64)
        x, y = minhash.sketch(a[:n]), minhash.sketch(a[n - share :])
        j = share / (2 * n - share)
        assert (x != 2**64 - 1).all() and abs((x == y).mean() - j) < 5 * math.sqrt(j * (1 - j) / minhash.COORDS)


def test_links_like_all_pairs():
    rng = random.Random(4)
    sets = [np.unique(np.array([rng.randrange(30) for _ in range(rng.randrange(1, 25))], np.uint64)) for _ in range(60)] + [np.arange(29, dtype=np.uint64)] * 2
    ids = np.arange(len(sets))

    def classes(pairs):
        low = {i: i for i in range(len(sets))}
        for _ in sets:
            for a, b in pairs:
                low[a] = low[b] = min(low[a], low[b])
        return low

    want = [(i, j) for i in ids for j in ids if i < j and 100 * len(set(sets[i]) & set(sets[j])) >= 85 * len(set(sets[i]) | set(sets[j]))]
    assert classes(minhash.links(ids, sets)) == classes(want)
    cut = 20
    assert set(map(tuple, minhash.links(ids, sets, cut))) <= {(i, j) for i, j in want if i < cut <= j}


def test_near_duplicates_edge(edge, none, spark):
    rows = [tuple(r) for r in minhash.clustered(edge).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 1, None, True), (4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False), (6, 2, 6, True), (7, 1, 7, True)]))
    assert minhash.clustered(none).count() == 0
    assert sorted(r["doc_id"] or 0 for r in minhash.deduplicated(edge).collect()) == [0, 1, 2, 3, 4, 4, 6, 7]


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 5)
    rng = random.Random(5)
    base = [f"w{rng.randrange(999)}" for _ in range(120)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(rng.randrange(120) for _ in range(30))]
    got = minhash.clustered(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = {i: minhash.shingle_set(shared.words_of(t.encode())) for i, t in rows}
    low = {i: i for i, _ in rows}
    for _ in range(5):
        for i in low:
            for j in low:
                if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])):
                    low[i] = low[j] = min(low[i], low[j])
    assert {r["doc_id"]: r["component_id"] for r in got} == low


# 5

def test_quality_edge(edge, none):
    rows = quality.rated(edge).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        t = next((e[1] for e in EDGE if e[0] == r["doc_id"]), None) or ""
        w = WORD.findall(t)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(hit))
        assert r["base_failed"] and not r["kept"]
    assert quality.rated(none).count() == 0 and quality.filtered(none).count() == 0


def test_quality_keeps_clean(spark):
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    df = quality.rated(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("NOT base_failed").join(good, "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in df.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.03 * n[1, True] and n.get((0, True), 0) <= n[0, False]


# 6

def test_class_scores(spark, docs):
    rows = {r["doc_id"]: r for r in classlm.op6_classlm(spark, SF).collect()}
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    toks = {i: [*(t or "").encode().lower().split(), b""] for i, t in docs}
    c = collections.Counter(w for i in toks if i not in held for w in toks[i])
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        r = rows[i]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(t), sum(c[w] > 0 for w in t), n) and math.isclose(r["base_score"], base, rel_tol=1e-9)
    assert sum(rows[i]["score"] for i in held) > sum(rows[i]["base_score"] for i in held)


def test_class_model_sums_to_one():
    """Over all words, in the lexicon, outside and unseen, whatever stands before."""
    rng = np.random.default_rng(3)
    c = rng.integers(1, 50, 400).astype(float)
    classes = 1 + rng.integers(0, classlm.CLASSES, 400)
    sizes = np.bincount(classes, c, minlength=classlm.SLOTS)
    sizes[0] = 30  # ends
    counts = np.array([rng.multinomial(int(x), np.full(classlm.SLOTS, 1 / classlm.SLOTS)) for x in sizes], float).T
    words = [str(i).encode() for i in range(300)]
    m = classlm.Model(words, c[:300], classes[:300], counts, int(c.sum()) + 30, 401, int((c == 1).sum()), int((c == 2).sum()), 30)
    for state in range(classlm.SLOTS):
        seen = 10 ** m.step[state, 0] + sum(10 ** (m.step[state, k] + math.log10(n) - m.sizes[k]) for k, n in zip(classes, c))
        listed = 10 ** m.step[state, 0] + sum(10 ** (m.step[state, k] + e) for k, e in zip(classes[:300], m.emit[1:301]))
        once, twice = (c == 1).sum(), (c == 2).sum()
        types = max(401, once * once / (2 * max(twice, 1))) + 1
        assert math.isclose(seen + types * 10**m.unseen, 1) and listed < seen
    assert m.unseen < -math.log10(m.n)


def _likelihood(classes, pairs, k):
    m = np.zeros((k, k))
    np.add.at(m, (classes[:, None].repeat(len(classes), 1), classes[None, :].repeat(len(classes), 0)), pairs)
    return classlm._phi(m).sum() - classlm._phi(m.sum(1)).sum() - classlm._phi(m.sum(0)).sum()


def test_exchange_raises_likelihood():
    """To a fixed point, at which no single move of any row is better, by counting anew."""
    rng = np.random.default_rng(4)
    n, k = 30, 4
    side = np.arange(n) % 3
    pairs = rng.poisson(np.where((side[:, None] + 1) % 3 == side[None, :], 40, 1))
    start = np.concatenate([[0], 1 + rng.integers(0, k - 1, n - 1)])
    classes = classlm.exchange(start, pairs, k, np.array([0]))
    best = _likelihood(classes, pairs, k)
    assert best > _likelihood(start, pairs, k) and classes[0] == 0 and (classes[1:] > 0).all()
    for w in range(1, n):
        for c in range(1, k):
            then = classes.copy()
            then[w] = c
            assert _likelihood(then, pairs, k) <= best + 1e-6


def test_class_model_by_brute_force(spark, docs, monkeypatch):
    """Classes outside the core, and scores, from the definitions; gibberish comes last."""
    monkeypatch.setattr(classlm, "CORE", 60)
    monkeypatch.setattr(classlm, "LEXICON", 300)
    rng = random.Random(5)
    df = spark.createDataFrame(docs + [(5001, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(300)))], "doc_id long, text string")
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 == 2} | {5001}
    from pyspark.sql import functions as F

    is_held = shared.held_out(F.col("doc_id"), 7, 2) | (F.col("doc_id") == 5001)
    model, others = classlm.learnt(df.where(~is_held))
    toks = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in df.collect()}
    c = collections.Counter(w for i, t in toks.items() if i not in held for w in [*t, b""])
    ranked = sorted((w for w in c if w), key=lambda w: (-c[w], w))
    assert model.words == ranked[:300]
    classes = dict(zip(model.words, model.states[1:-1].tolist())) | {r["word"].encode(): r["class"] for r in others.collect()} | {b"": 0}
    assert set(classes) == set(c) and all(1 <= classes[w] <= classlm.CLASSES for w in ranked)
    state = lambda w: classes[w] if w in listed else classlm.OTHER
    listed = {b"", *model.words}
    counts, seen, cells = np.zeros((classlm.SLOTS,) * 2), collections.defaultdict(lambda: np.zeros(2 * classlm.SLOTS)), np.zeros((classlm.SLOTS,) * 2)
    for i, t in toks.items():
        if i not in held:
            line = [b"", *t, b""]
            for a, b in zip(line, line[1:]):
                counts[state(a), classes[b]] += 1
                cells[state(a), state(b)] += 1
            for k in range(1, len(line) - 1):
                seen[line[k]][state(line[k - 1])] += 1
                seen[line[k]][classlm.SLOTS + state(line[k + 1])] += 1
    w = classlm.weights(cells)
    for word in ranked[300:]:
        s = seen[word] @ w
        assert s[classes[word] - 1] >= s.max() - 1e-9
    rows = {r["doc_id"]: r for r in classlm.scored(df, is_held).collect()}
    n, v = sum(c.values()), len(c)
    once, twice = (sum(c[x] == k for x in ranked) for k in (1, 2))
    new = (once + 1) / (n + 2)
    unseen = new / (max(v, once * once / (2 * max(twice, 1))) + 1)
    size, total = counts.sum(0), counts.sum()
    for i, t in toks.items():
        want, before = 0.0, b""
        for x in [*t, b""]:
            if x in c:
                row, k = counts[state(before)], classes[x]
                p = (1 - classlm.BACK_OFF) * (row[k] + size[k] / total) / (row.sum() + 1) + classlm.BACK_OFF * size[k] / total
                want += math.log10((1 - new) * p * c[x] / size[k])
            else:
                want += math.log10(unseen)
            before = x
        assert math.isclose(rows[i]["score"], want, rel_tol=1e-9), i
    per = {i: r["score"] / r["n_tokens"] for i, r in rows.items() if i in held}
    assert min(per, key=per.get) == 5001


def test_class_scores_edge(edge, none):
    from pyspark.sql import functions as F

    rows = classlm.scored(edge, shared.held_out(F.col("doc_id"), 7, 2)).collect()
    assert len(rows) == len(EDGE) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert classlm.scored(none, shared.held_out(F.col("doc_id"), 7, 2)).count() == 0


# 7, 9

def test_tokens_are_the_tokenizers():
    c = tokens.Chunks(tokens.tokenizer_path())
    r, letters = random.Random(6), "aAzZ09 \t\n\x0b\x1c\x85\xa0'sStTreE<|>endoftxt!#éÉßΣς́ 　İ½²×÷ĸŉſ中‍😀\x00\x7f_-"
    for _ in range(3000):
        x = "".join(r.choice(letters) for _ in range(r.randrange(15))) + r.choice(["", "<|endoftext|>", "it's I'LL"])
        assert c.text(x) == np.array(c.whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_separator_scan(spark, edge, docs, block):
    to = shared.new_path(spark)
    token_counts.token_files(edge, to, file_docs=4)
    got = token_counts.counted(spark, to, block=max(block, 1) if block > 3 else 4096 * block + 1).collect()
    c = tokens.Chunks(tokens.tokenizer_path())
    assert sorted(r["n_tokens"] for r in got) == sorted(len(c.text(e[1])) // 4 for e in EDGE) and all(r["ended"] for r in got)


@pytest.mark.parametrize("block", [1, 2, 5])
def test_scan_of_blocks(spark, block, tmp_path):
    ids = [7, 9, 9, 1, 2, 3, 4, 5, 6, 9, 8, 8]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    got = sorted((r["doc"], r["n_tokens"], r["ended"]) for r in token_counts.counted(spark, f"file://{tmp_path}", end=9, block=block).collect())
    assert got == [(0, 1, True), (1, 0, True), (2, 6, True), (3, 2, False)]


def test_separator_in_text(spark):
    """A text that spells the tokenizer's own end is one document."""
    texts = ["a b <|endoftext|> c d", "<|endoftext|>", "", "x"]
    to = shared.new_path(spark)
    token_counts.token_files(spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1), to)
    got = sorted((r["doc"], r["n_tokens"], r["ended"]) for r in token_counts.counted(spark, to).collect())
    assert got == [(0, 5, True), (1, 1, True), (2, 0, True), (3, 1, True)]


def _best_fit(lengths, window):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - n)
        else:
            bins.append(window - n)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    r = random.Random(7)
    for _ in range(300):
        window = r.choice([8, 20, 64])
        lengths = [r.randint(1, window - 1) for _ in range(r.randrange(60))]
        steps, n = packing.plan(collections.Counter(lengths), window)
        room = collections.Counter({k: window for k in range(n)})
        for length, a, b, first, offset in steps:
            for k in range(b - a):
                assert window - room[first + k] == offset
                room[first + k] -= length
        assert sorted(room.values()) == _best_fit(lengths, window)


def test_packing_round_trip(spark, edge, none):
    rows = packing.packed(edge, ids=True).collect()
    c = tokens.Chunks(tokens.tokenizer_path())
    whole, slots = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        whole[r["doc_id"]].append((r["start"], r["ids"]))
        slots[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in {e[0]: e[1] for e in EDGE}.items():
        want = [*np.frombuffer(c.text(t), "<u4").tolist(), 1]
        got = [x for _, part in sorted(whole[i]) for x in part]
        assert got == want if i != 4 else sorted(got) == sorted(want * 2)
    for s in slots.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.packed(none).count() == 0


# 8

def test_marginals_like_enumeration():
    import itertools

    rng = np.random.default_rng(8)
    chain, odds = rng.normal(size=(2, 2)), rng.normal(size=(1, 5))
    p, pairs = toxicity.marginals(odds, np.array([5]), chain)
    total, one, two = 0.0, np.zeros(5), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=5):
        w = math.exp(sum(odds[0, i] * s for i, s in enumerate(y)) + sum(chain[a, b] for a, b in zip(y, y[1:])))
        total += w
        one += w * np.array(y)
        for a, b in zip(y, y[1:]):
            two[a, b] += w
    assert np.allclose(p[0], one / total) and np.allclose(pairs, two / total)
    rows = [rng.normal(size=n) for n in (5, 0, 3, 40, 1)]
    for x, q in zip(rows, toxicity.line_marginals(rows, chain)):
        assert len(x) == len(q) and (not len(x) or np.allclose(q, toxicity.marginals(x[None], np.array([len(x)]), chain)[0][0]))


def test_toxicity_held_out(spark, edge, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fitted(df, labels)
    rows = toxicity.scored(df, model).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").select("score", "toxic", "predicted").collect()
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(clean) <= 0.08 * len(clean) and np.mean([r["score"] for r in rows if r["toxic"]]) > 3 * np.mean([r["score"] for r in rows if not r["toxic"]])
    out = toxicity.scored(edge, model, spans=True).collect()
    assert len(out) == len(EDGE) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.scored(none, model).count() == 0
    assert toxicity.fitted(none, labels.limit(0)).constant == 0.0


# 10

def _base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark, edge, none, docs):
    extra = [(9001, "MIT License mit, LICENSE! GNU general-public  license", None, None, None), (9002, "Licensed under the Apache License, Version 2.0", None, None, None)]
    more = [(10_000 + i, t, None, None, None) for i, t in docs]
    df = edge.union(spark.createDataFrame(extra + more, DOCS))
    texts = {e[0]: e[1] for e in EDGE + extra + more}
    by = {r["doc_id"]: r for r in licenses.scanned(df).collect()}
    for i, r in by.items():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == _base(texts[i])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert all(a["end"] <= b["end"] for a, b in zip(r["spans"], r["spans"][1:]))
    assert by[9001]["base_labels"] == "gpl,mit"
    assert by[9002]["labels"] == "apache" and [(x["start"], x["end"]) for x in by[9002]["spans"]] == [(0, 46)] and by[9002]["score"] == 1.0
    assert by[1]["labels"] == "" and by[1]["score"] == 0.0
    assert licenses.scanned(none).count() == 0


def _match(items, rng):
    """A random text that the parsed pattern matches."""
    out = ""
    for kind, value in items:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(value)
        elif kind == "SUBPATTERN":
            out += _match(value[-1], rng)
        elif kind == "BRANCH":
            out += _match(rng.choice(value[1]), rng)
        elif kind == "MAX_REPEAT":
            out += "".join(_match(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 2))))
        elif kind == "IN":
            of = [c for c in map(chr, range(127)) if _in(value, c)]
            out += rng.choice(of)
        elif kind == "ANY":
            out += "x"
    return out


def _in(items, c):
    no, found = False, False
    for kind, value in items:
        kind = str(kind)
        no |= kind == "NEGATE"
        found |= kind == "LITERAL" and ord(c) == value or kind == "RANGE" and value[0] <= ord(c) <= value[1] or kind == "CATEGORY" and c in " \t\n\x0b\f\r"
    return found != no


def test_license_keywords():
    """Random matches of each rule, wrapped and doubly spaced ones included, hold its gate and its keyword."""
    rng, n = random.Random(10), 0
    for r in license_rules.RULES:
        tree = license_rules._parser.parse(r.pattern)
        for _ in range(40):
            text = _match(tree, rng)
            if re.search(r.pattern, text):
                n += 1
                flat = re.sub(r"[ \t\n\x0b\f\r]+", " ", text)
                assert any(k in flat for k in r.gate) and any(k in flat for k in r.keyword), (r, text)
    assert n > 30 * len(license_rules.RULES)


def test_licenses_wrapped(spark):
    texts = {"permission is hereby\ngranted, free of charge, to any person obtaining a copy": "mit", "Academic\r\n  Free\tLicense": "afl", "creative\ncommons": "creative-commons", "All rights\n\nreserved": "proprietary", "SPDX-License-Identifier: 0BSD": "bsd", "no part of this book may be reproduced without permission": "proprietary", "do not distribute": "proprietary", "\u00a9 2020": "copyright", "the Expat license": "mit"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scanned(df).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)]
    low = {i: i for e in edges for i in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {x["node"]: x["root"] for x in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {i: got.get(i, i) for i in low} == low
