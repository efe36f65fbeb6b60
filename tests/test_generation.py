"""Generation: one call per request and attempt, manifests, versions of the state, one request for all strategies."""

from __future__ import annotations

import json
import random

import pytest

from passagemill import __main__ as command
from passagemill.operators import records, split
from passagemill.plans import generate, training
from passagemill.sources import files


def _rows(spark, n):
    return spark.createDataFrame([(i, f"q{i}", f"one two three four five {i}") for i in range(n)], "source_index long, query string, positive string")


def _counting(path, answer):
    def make():
        def ask(prompt):
            with open(path, "a") as f:
                f.write(json.dumps(prompt) + "\n")
            return answer(prompt, path)

        return ask

    return make


def _calls(path):
    return [json.loads(x) for x in open(path)]


def test_one_call_per_missing_candidate(spark, tmp_path):
    log = str(tmp_path / "log")
    got = generate.run(spark, _rows(spark, 5), f"file://{tmp_path}/run", _counting(log, lambda p, _: generate.stub(p)), 0.5, batch_size=2, retries=3, delay=0.0)
    calls = _calls(log)
    assert got == {"processed": 5, "saved": 5, "incomplete": 0, "requested": 35} and len(calls) == len(set(calls)) == 35


def _by_turn(prompt, path):
    """The first answer to a prompt is no JSON, the second too long, the third right."""
    n = sum(x == prompt for x in _calls(path))
    return "sorry" if n == 1 else json.dumps({"text": "far " * 99, "violated_requirement": "v"}) if n == 2 else generate.stub(prompt)


def test_wrong_answers_are_asked_again(spark, tmp_path):
    log, where = str(tmp_path / "log"), f"file://{tmp_path}/run"
    once = generate.run(spark, _rows(spark, 1), where, _counting(log, _by_turn), 0.5, retries=2, delay=0.0)
    assert once == {"processed": 1, "saved": 0, "incomplete": 1, "requested": 7} and len(_calls(log)) == 14
    errors = spark.read.json(f"{where}/errors").collect()
    assert len(errors) == 7 and all(r["error"] == "2 attempts: word count out of bounds" for r in errors)
    again = generate.run(spark, _rows(spark, 1), where, _counting(log, _by_turn), 0.5, retries=2, delay=0.0)
    assert again == {"processed": 1, "saved": 1, "incomplete": 0, "requested": 7} and len(_calls(log)) == 21


def _alike(prompt, path):
    """The second strategy repeats the first until it is asked once more."""
    own = generate.stub(prompt)
    if "Kind of mistake: attribute" in prompt and sum("attribute" in x for x in _calls(path)) == 1:
        return generate.stub(prompt.replace("attribute_confusion", "entity_confusion"))
    return own


def test_a_repeated_candidate_is_asked_for_again(spark, tmp_path):
    log, where = str(tmp_path / "log"), f"file://{tmp_path}/run"
    first = generate.run(spark, _rows(spark, 1), where, _counting(log, _alike), 0.5, delay=0.0)
    assert (first["saved"], first["requested"]) == (0, 7)
    second = generate.run(spark, _rows(spark, 1), where, _counting(log, _alike), 0.5, delay=0.0)
    assert (second["saved"], second["requested"], len(_calls(log))) == (1, 1, 8)


def test_state_of_other_settings_is_refused(spark, tmp_path):
    where = f"file://{tmp_path}/run"
    generate.run(spark, _rows(spark, 1), where, lambda: generate.stub, 0.5, delay=0.0, input_path="a")
    for settings in ({"tolerance": 0.4, "input_path": "a"}, {"tolerance": 0.5, "input_path": "b"}):
        with pytest.raises(ValueError, match="other settings"):
            generate.run(spark, _rows(spark, 1), where, lambda: generate.stub, delay=0.0, **settings)
    assert generate.Folder(spark, where).versions("state") == [2]


def _combined(prompt, _=None):
    positive = prompt.split("Correct passage: ")[1].split("\n")[0]
    if positive.endswith(" 2"):
        return "[]"
    items = [{"id": i + 1, "type": t, "hardness": h, "violated_requirement": "v", "text": f"{t} x", "more": [i]} for i, (t, h) in enumerate(records.STRATEGIES)]
    return json.dumps({"query": "not the query", "information_need": "n", "critical_requirements": ["a", 5], "hard_negatives": items, "extra": 1})


def test_combined(spark, tmp_path):
    log, where = str(tmp_path / "log"), f"file://{tmp_path}/run"
    got = generate.run_combined(spark, _rows(spark, 3), where, _counting(log, _combined), batch_size=2, retries=2, delay=0.0)
    assert got == {"processed": 3, "saved": 2, "incomplete": 1} and len(_calls(log)) == 4
    lines = sorted((json.loads(r[0]) for r in spark.read.text(f"{where}/output-jsonl").collect()), key=lambda x: x["source_index"])
    assert [x["query"] for x in lines] == ["q0", "q1"] and lines[1]["positive_document"] == "one two three four five 1"
    assert lines[0]["critical_requirements"] == ["a", 5] and lines[0]["hard_negatives"][6]["more"] == [6] and list(lines[0]) == ["source_index", "query", "positive_document", "information_need", "critical_requirements", "hard_negatives"]
    assert generate.run_combined(spark, _rows(spark, 3), where, _counting(log, _combined), retries=1, delay=0.0)["processed"] == 1


def test_numbers_without_python(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.jsonl").write_text("".join(f"{i} {k}\n" for k in range(i * 3)))
    df = spark.read.option("wholetext", False).text(str(tmp_path))
    want = [(i, r[0]) for i, r in enumerate(df.collect(), 5)]
    assert sorted(tuple(r) for r in files.numbered(df, "n", 5).collect()) == want


def test_compatible_shuffle_like_the_rule(spark):
    """Groups, then each split's rows in turn, by one generator."""
    rng = random.Random(3)
    rows = [(i + 1, f"p{rng.randrange(40)}") for i in range(120)]
    df = spark.createDataFrame(rows, "line_no long, positive string")
    got = {}
    for r in split.split(df, (60.0, 20.0, 20.0), 9, compatible=True).orderBy("order_key").collect():
        got.setdefault(r["split"], []).append(r["line_no"])
    groups: dict = {}
    for n, p in rows:
        groups.setdefault(p, []).append(n)
    own, filled, want = random.Random(9), [0, 0, 0], [[], [], []]
    order = list(groups.values())
    own.shuffle(order)
    for g in order:
        share = [c / (120 * t) for c, t in zip(filled, (0.6, 0.2, 0.2))]
        i = share.index(min(share))
        filled[i] += len(g)
        want[i] += g
    for g in want:
        own.shuffle(g)
    assert got == dict(zip(split.SPLITS, want))


def test_settings_reach_what_takes_them():
    assert command._made("tests.test_generation:made_of", system="s", model="m", timeout=1.0) == ("s", 1.0)


def made_of(system, timeout):
    return system, timeout


def test_training_flags(tmp_path):
    argv = training.command(training.Training(precision="fp32"))
    at = {k: argv[i + 1] for i, k in enumerate(argv[:-1]) if k.startswith("--")}
    assert at["--same_dataset_within_batch"] == "True" and at["--knowledge_distillation"] == "False" and json.loads(at["--gradient_checkpointing_kwargs"]) == {"use_reentrant": False} and "--gradient_checkpointing" in argv and "--fp16" not in argv


def test_empty_input(tmp_path):
    (tmp_path / "x.jsonl").write_text("\n \n")
    with pytest.raises(ValueError, match="no records"):
        command.main(["split", str(tmp_path / "x.jsonl"), *(str(tmp_path / n) for n in "abc"), "--train-ratio", "80", "--validation-ratio", "10", "--test-ratio", "10", "--seed", "1"])
