"""Edge cases made by hand, and small independent versions in plain Python."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from passagemill.functions import jsonx, text
from passagemill.operators import clean, records, retrieval, split
from passagemill.plans import generate, report, training
from passagemill.sources import files
from passagemill.streaming import resume

CASES = ["", " ", "a", " a  b ", "　a\x85", "\x1cx\xa0y", "‌", "a\tb\nc", None]


def test_text_agrees_with_python(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(CASES)], "i long, t string")
    for i, s, n, w in df.select("i", text.strip(F.col("t")), text.normalized(F.col("t")), text.word_count(F.col("t"))).collect():
        x = CASES[i]
        assert (s, n, w) == ((None, None, None) if x is None else (x.strip(), " ".join(x.split()), len(x.split())))


def test_white_space_is_these_characters(spark):
    c = F.col("c")
    df = spark.range(0x3100).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    got = {r[0] for r in df.select("c", text.word_count(F.concat(F.lit("a"), c, F.lit("b"))).alias("n"), text.normalized(F.concat(F.lit("a"), c, c, F.lit("b"))).alias("t")).where("n = 2 AND t = 'a b'").collect()}
    assert got == set(text.WHITE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_word_bounds_are_double_products(spark):
    df = spark.createDataFrame([(100, 0.29), (1, 1.0), (5, 0.0)], "n int, t double")
    for n, t in df.collect():
        low, high = spark.range(1).select(*text.word_bounds(F.lit(n), t)).first()
        m = int(n * t)
        assert (low, high) == (max(1, n - m), n + m)


def test_tolerant_json(spark):
    cases = {'{"text": "a"}': "a", '```JSON\n{"text": "b"}\n```': "b", 'x {"text": "c"} y': "c", "[1]": None, "": None, '{"text": 5}': None, "} {": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r[0]: r[1] for r in df.select("s", jsonx.text_at(jsonx.tolerant_object(F.col("s")), "$.text")).collect()}
    assert got == cases


def _plain_clean(rows, count):
    """The cleaning rules, one row after another."""
    pool = list(dict.fromkeys(p for _, _, p, _ in rows))
    seen, out = set(), []
    for line, q, p, negs in rows:
        if q in seen:
            continue
        seen.add(q)
        kept = []
        for t in negs:
            if t != p and t not in kept and len(kept) < count:
                kept.append(t)
        for k in range(2 * len(pool)):
            if len(kept) == count:
                break
            t = pool[(line - 1 + k) % len(pool)]
            if t not in (p, q) and t not in kept:
                kept.append(t)
        out.append((line, kept))
    return out


def test_cleaning_like_a_loop(spark):
    rng = random.Random(3)
    rows = [(i + 1, f"q{rng.randrange(20)}", f"d{rng.randrange(12)}", [rng.choice(["d1", "d2", "q3", "n1", "n2", "n3", "n4", "n5"]) for _ in range(rng.randrange(7))]) for i in range(40)]
    item = lambda t: (0, "t", "h", "v", t)
    df = spark.createDataFrame([(a, b, c, list(map(item, d))) for a, b, c, d in rows], f"line_no long, query string, positive string, hard_negatives array<{records.ITEM}>")
    out = clean.cleaned(df, 4)
    got = {r["line_no"]: [x["text"] for x in r["hard_negatives"]] for r in out.collect()}
    assert got == dict(_plain_clean(rows, 4))
    assert all([x["id"] for x in r["hard_negatives"]] == [1, 2, 3, 4] and r["error"] is None for r in out.collect())


def test_clean_command_keeps_extra_keys(spark, tmp_path, monkeypatch):
    from passagemill import __main__ as command

    own = {"id": 9, "type": "t", "text": " n1 ", "score": 0.5, "note": None, "tags": [1, {"a": "b"}]}
    lines = [{"source_index": 4, "query": " q1 ", "positive_document": "d1", "information_need": "need", "critical_requirements": ["r", 2], "empty": None, "hard_negatives": [own, {"text": "n1", "late": 1}, {"text": "d1"}]}, {"query": "q2", "positive_document": "d2", "hard_negatives": []}]
    (tmp_path / "in.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    monkeypatch.setattr(command, "session", lambda: spark)
    assert command.main(["clean", str(tmp_path / "in.jsonl"), str(tmp_path / "out"), "--negative-count", "1"]) == 0
    got = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    filled = {"id": 1, "type": "random_negative", "hardness": "random", "violated_requirement": "Added during dataset cleaning.", "text": "d1"}
    assert got == [lines[0] | {"query": "q1", "hard_negatives": [own | {"id": 1, "text": "n1"}]}, lines[1] | {"hard_negatives": [filled]}]


def test_small_pool_is_an_error(spark):
    df = spark.createDataFrame([(1, "q", "p", [])], f"line_no long, query string, positive string, hard_negatives array<{records.ITEM}>")
    assert clean.cleaned(df, 3).first()["error"] == "not enough distinct documents"
    with pytest.raises(ValueError):
        clean.check_pool(df)


def test_split_like_a_loop(spark):
    rows = [(i, f"p{i % 23}") for i in range(200)]
    df = spark.createDataFrame(rows, "line_no long, positive string")
    ordered = split.hashed_order(split.groups(df), 1)
    want, filled = {}, [0, 0, 0]
    for r in sorted(ordered.collect(), key=lambda r: r["order_key"]):
        ratios = [c / t for c, t in zip(filled, (200 * 0.8, 200 * 0.1, 200 * 0.1))]
        i = ratios.index(min(ratios))
        filled[i] += r["n"]
        want[r["positive"]] = split.SPLITS[i]
    got = {r["positive"]: r["split"] for r in split.assigned(ordered, (80.0, 10.0, 10.0)).collect()}
    assert got == want
    assert split.leaked(split.split(df, (80.0, 10.0, 10.0), 1, compatible=True)).count() == 0
    with pytest.raises(ValueError):
        split.check_ratios((80.0, 20.0, 0.0))
    split.check_ratios((80.0, 10.0, 9.9999999999))


def test_neighbours_ties_and_zero(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_index long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_index long, embedding array<double>")
    assert [r["doc_index"] for r in retrieval.neighbours(q, docs).orderBy("rank").collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="zero-length"):
        retrieval.normalize(spark.createDataFrame([([0.0, 0.0],)], "embedding array<double>")).collect()


def test_lines_and_records(spark, tmp_path):
    good = {"query": " q ", "positive_document": "p", "hard_negatives": [{"text": "n"}]}
    lines = ["﻿" + json.dumps(good), "", "not json", json.dumps(good | {"query": 5}), "[1]", json.dumps(good | {"hard_negatives": [{"text": 1}]}), json.dumps(good | {"positive_document": " "})]
    (tmp_path / "x.jsonl").write_text("\n".join(lines), encoding="utf-8")
    rows = records.parsed(files.read_json_lines(spark, str(tmp_path / "x.jsonl"))).orderBy("line_no").collect()
    assert [(r["line_no"], r["error"]) for r in rows] == [(1, None), (3, "invalid record"), (4, "invalid query"), (5, "invalid record"), (6, "a negative has no text"), (7, "invalid positive_document")]
    assert rows[0]["query"] == "q"


def test_csv_pairs(spark, tmp_path):
    (tmp_path / "p.csv").write_text('﻿question,content_text,more\n"a ""b""","c\nd",1\n , x,2\ny,z,3\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_pairs(spark, str(tmp_path / "p.csv")).orderBy("source_index").collect()] == [(0, 'a "b"', "c\nd"), (2, "y", "z")]
    (tmp_path / "q.csv").write_text("question\na\n")
    with pytest.raises(files.InputError):
        files.read_pairs(spark, str(tmp_path / "q.csv"))


def test_resume_scans(spark):
    lines = spark.createDataFrame([(1, '{"source_index": 1}'), (2, "x"), (3, '{"source_index": 1}')], "line_no long, line string").withColumn("value", F.try_parse_json("line"))
    assert [r[0] for r in files.completed(lines, strict=False).collect()] == [1]
    with pytest.raises(files.InputError, match="Line 2"):
        files.completed(lines)
    assert files.repaired('{"a": 1}\n{"b"') == '{"a": 1}\n' and files.repaired('{"a": 1}') == '{"a": 1}\n' and files.repaired("") == ""
    assert files.errors_path("a/b.jsonl") == "a/b.jsonl.errors.jsonl"


def test_generation_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"q{i}", f"one two three four five {i}") for i in range(3)], "source_index long, query string, positive string")
    where = f"file://{tmp_path}/run"
    assert generate.run(spark, rows, where, lambda: generate.stub, 0.5, batch_size=2, retries=1, delay=0.0) == {"processed": 3, "saved": 3, "incomplete": 0, "requested": 21}
    assert generate.run(spark, rows, where, lambda: generate.stub, 0.5, batch_size=2, retries=1, delay=0.0)["processed"] == 0
    with pytest.raises(ValueError):
        generate.check_manifest(generate.manifest("a", 0.1), generate.manifest("a", 0.2))
    with pytest.raises(ValueError):
        generate.limited(rows, 0)


def test_failed_answers_are_rows(spark):
    def broken():
        def ask(_):
            raise OSError("down")

        return ask

    rows = spark.createDataFrame([(1, 0, "q", "one two")], "source_index long, strategy_index int, query string, positive string")
    assert generate.answered(rows, broken, 0.5, retries=2, delay=0.0).first()["error"] == "2 attempts: OSError: down"


def test_stream_appends_once(spark, tmp_path):
    src, out, at = (f"file://{tmp_path}/{x}" for x in ("src", "out", "at"))
    spark.createDataFrame([(1, "q", "p"), (1, "q", "p"), (2, "r", "s")], resume.PAIRS).write.parquet(src)
    resume.ingest(spark, src, out, at)
    spark.createDataFrame([(2, "r", "s"), (3, "t", "u")], resume.PAIRS).write.mode("append").parquet(src)
    resume.ingest(spark, src, out, at)
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_report_and_training(tmp_path):
    rep = report.report({"query_count": 1234, "recall_at_1": 0.5}, {"mode": "<x>"}, 1.0)
    found = report.save(rep, str(tmp_path / "r"))
    assert "1,234" in report.as_text(rep) and "0.500000 (50.00%)" in report.as_text(rep) and "&lt;x&gt;" in report.as_html(rep) and set(found) == {"json", "text", "html"}
    (tmp_path / "t.jsonl").write_text("{}")
    t = training.Training(train_file=str(tmp_path / "t.jsonl"), num_gpus=2, precision="bf16")
    argv = training.command(t)
    assert "--bf16" in argv and "--fp16" not in argv and "--negatives_cross_device" in argv
    with pytest.raises(ValueError):
        training.check(training.Training(train_file=str(tmp_path / "t.jsonl"), train_group_size=1))


def test_keys_stand_for_texts(spark):
    """Keys are short whatever the text, and cleaning by keys picks what cleaning by texts picks."""
    rows = [(i + 1, f"q{i % 9}", ["", "d0", f"d{i % 5}", "q3"][i % 4], ["", "d1", "q3", f"n{i}"][: i % 5]) for i in range(30)]
    df = spark.createDataFrame(rows, "line_no long, query string, positive string, texts array<string>")
    item = lambda x: F.struct(F.lit(0).alias("id"), F.lit("t").alias("type"), F.lit("h").alias("hardness"), F.lit("v").alias("violated_requirement"), x.alias("text"))
    plain = df.withColumn("hard_negatives", F.transform("texts", item)).drop("texts")
    keyed = df.select("line_no", text.text_key(F.col("query")).alias("query"), text.text_key(F.col("positive")).alias("positive"), F.transform("texts", lambda x: item(text.text_key(x))).alias("hard_negatives"))
    want, got = ({r["line_no"]: [x["text"] for x in r["hard_negatives"]] for r in clean.cleaned(x, 4).collect()} for x in (plain, keyed))
    long = {x: k for x, k in spark.createDataFrame([(x,) for v in want.values() for x in v] + [("y" * 5000,)], "t string").select("t", text.text_key(F.col("t"))).collect()}
    assert {k: [long[x] for x in v] for k, v in want.items()} == got
    assert max(map(len, long.values())) == 48 and long[""] == ""


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_split_groups_by_key(spark):
    df = spark.createDataFrame([(i, f"p{i % 7}") for i in range(50)], "line_no long, positive string")
    for compatible in (False, True):
        done = split.split(df, (80.0, 10.0, 10.0), 1, compatible)
        for plan in map(_plan, (split.counts(done), split.leaked(done))):
            assert "Join" in plan and not any(f"{x}positive#" in plan for x in ("Aggregate [", "Join Inner, ("))


def test_rows_move_once_before_strategies(spark):
    rows = spark.createDataFrame([(i, f"q{i}", "p") for i in range(4)] + [(None, "q", "p")], "source_index long, query string, positive string")
    saved = spark.createDataFrame([(0, 1), (0, 6), (2, 0), (2, 0), (None, 3)], "source_index long, strategy_index int")
    work = generate.missing(rows, saved)
    gone = {(0, 1), (0, 6), (2, 0)}
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2], r[3]) for r in work.collect()) == sorted((i, k, f"q{i}" if i >= 0 else "q", "p") for i in range(-1, 4) for k in range(7) if (i, k) not in gone)
    plan = _plan(work)
    assert plan.index("Generate explode") < plan.index("Join LeftOuter")


def test_pool_numbers_lines_without_texts(spark):
    df = spark.createDataFrame([(i, f"p{i % 7}") for i in range(50)], "line_no long, positive string")
    lines = _plan(clean.positive_pool(df)).split("\n")
    below = [lines[i + 1] for i, x in enumerate(lines) if "Window [row_number" in x]
    assert below and not any("positive#" in x.split("Project [")[-1] for x in below)
    assert sorted(map(tuple, clean.positive_pool(df).collect())) == [(i, f"p{i}") for i in range(7)]


def test_lines_in_order_of_blocks(spark, tmp_path):
    """Files that are cut into blocks of several sizes; a scan deals the large ones first."""
    want = []
    for f, n in enumerate((700, 400, 901)):
        own = [f"{f}-{i} " + "x" * (i % 13) for i in range(n)]
        (tmp_path / f"part-{f}.txt").write_text("".join(x + "\n" for x in own))
        want += own
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = [tuple(r) for r in files.read_lines(spark, f"file://{tmp_path}").orderBy("line_no").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == list(enumerate(want, 1))
