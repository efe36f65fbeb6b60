"""Command line: clean, split, evaluate, generate (one request a strategy), generate-combined (one a row), train."""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import inspect
import os
import shlex
import subprocess
import time

from .session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="passagemill")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("clean")
    c.add_argument("input", nargs="?", default="data/raw/hard_negatives_all.jsonl")
    c.add_argument("output", nargs="?", default="data/processed/hard_negatives_clean.jsonl")
    c.add_argument("--negative-count", type=int, default=7)
    s = sub.add_parser("split")
    for name in ("input", "train", "validation", "test"):
        s.add_argument(name)
    for name in ("train", "validation", "test"):
        s.add_argument(f"--{name}-ratio", type=float, required=True)
    s.add_argument("--seed", type=int, required=True)
    s.add_argument("--compatible-shuffle", action="store_true")
    e = sub.add_parser("evaluate")
    e.add_argument("test_file")
    e.add_argument("encoder", help="module:function; function(...) returns an object with encode_queries and encode_corpus; it gets those of query_max_length, passage_max_length, devices and fp16 that it has parameters for")
    e.add_argument("--devices")
    e.add_argument("--fp16", action="store_true")
    e.add_argument("--full-corpus", action="store_true")
    e.add_argument("--output-dir")
    for name, value in (("encode-batch-size", 16), ("search-batch-size", 64), ("query-max-length", 512), ("passage-max-length", 512)):
        e.add_argument(f"--{name}", type=int, default=value)
    for name, output in (("generate", "data/generated"), ("generate-combined", "data/generated-combined")):
        g = sub.add_parser(name)
        g.add_argument("provider", help="module:function; function(...) returns ask(prompt) -> str; it gets those of system, model, base_url, api_key, timeout, temperature and max_tokens that it has parameters for")
        g.add_argument("--input", default="data/raw/pairs.csv")
        g.add_argument("--output", default=output)
        g.add_argument("--limit", type=int)
        for option in ("model", "base-url", "api-key"):
            g.add_argument(f"--{option}")
        g.add_argument("--thinking", action=argparse.BooleanOptionalAction, default=name == "generate")
        numbers = [("batch-size", int, 50), ("workers", int, 50), ("retries", int, 4), ("retry-delay", float, 2.0), ("timeout", float, 300.0), ("temperature", float, 0.3), ("max-tokens", int, 8192)]
        for option, kind, value in numbers + [("length-tolerance", float, 0.15)] * (name == "generate"):
            g.add_argument(f"--{option}", type=kind, default=value)
    t = sub.add_parser("train")
    from .plans.training import Training

    for f in dataclasses.fields(Training):
        name = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            t.add_argument(name, action="store_true")
        else:
            t.add_argument(name, type=type(f.default) if f.default is not None else str, default=f.default)
    t.add_argument("--dry-run", action="store_true")
    return p


def check(p: argparse.ArgumentParser, a: argparse.Namespace) -> None:
    def need(ok: bool, what: str) -> None:
        if not ok:
            p.error(what)

    paths = {"clean": ("input", "output"), "split": ("input", "train", "validation", "test")}.get(a.command, ())
    real = [os.path.abspath(getattr(a, x)) for x in paths]
    need(len(set(real)) == len(real), "paths must differ")
    source = {"clean": "input", "split": "input", "evaluate": "test_file", "generate": "input", "generate-combined": "input"}.get(a.command)
    need(not source or os.path.exists(getattr(a, source)), f"no such input: {source and getattr(a, source)}")
    if a.command == "clean":
        need(a.negative_count >= 1, "--negative-count must be at least 1")
    if a.command == "evaluate":
        need(min(a.encode_batch_size, a.search_batch_size, a.query_max_length, a.passage_max_length) >= 1, "sizes must be at least 1")
    if a.command.startswith("generate"):
        need(min(a.batch_size, a.workers, a.retries, a.max_tokens) >= 1 and a.retry_delay >= 0 and a.timeout > 0 and 0 <= getattr(a, "length_tolerance", 0) <= 1 and (a.limit is None or a.limit >= 1), "a number is out of bounds")


def _load(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _made(name: str, **settings):
    """What the function makes with those settings that it takes."""
    function = _load(name)
    takes = inspect.signature(function).parameters.values()
    every = any(x.kind is x.VAR_KEYWORD for x in takes)
    return function(**{k: v for k, v in settings.items() if every or k in {x.name for x in takes}})


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    check(p, a)
    if a.command == "train":
        from .plans import training

        t = training.Training(**{f.name: getattr(a, f.name) for f in dataclasses.fields(training.Training)})
        training.check(t)
        argv = training.command(t)
        print(shlex.join(argv))
        return 0 if a.dry_run else subprocess.run(argv, check=True, env=training.environment(t, dict(os.environ))).returncode
    spark = session()
    from pyspark.sql import functions as F

    from .operators import clean, records, retrieval, split
    from .plans import generate, report
    from .sources import files

    if a.command.startswith("generate"):
        name, settings = a.provider, {"system": generate.system_prompt(a.thinking)} | {k: getattr(a, k) for k in ("model", "base_url", "api_key", "timeout", "temperature", "max_tokens")}
        make = lambda: _made(name, **settings)
        rows, often = files.read_pairs(spark, a.input), {"retries": a.retries, "delay": a.retry_delay, "workers": a.workers}
        if a.command == "generate":
            counters = generate.run(spark, rows, a.output, make, a.length_tolerance, a.batch_size, a.limit, os.path.abspath(a.input), **often)
        else:
            counters = generate.run_combined(spark, rows, a.output, make, a.batch_size, a.limit, **often)
        print(counters)
        return int(counters["incomplete"] > 0)
    lines = files.read_json_lines(spark, a.test_file if a.command == "evaluate" else a.input)
    if lines.isEmpty():
        raise ValueError("the input has no records")
    if a.command == "evaluate":
        began = time.perf_counter()
        records.raise_first(records.evaluation_errors(lines))
        v = F.col("value")
        examples = lines.select("line_no", F.try_variant_get(v, "$.query", "string").alias("query"), F.try_variant_get(v, "$.pos", "array<string>").alias("pos"), F.try_variant_get(v, "$.neg", "array<string>").alias("neg"))
        docs = retrieval.corpus(examples, a.full_corpus)
        name, settings = a.encoder, {k: getattr(a, k) for k in ("query_max_length", "passage_max_length", "devices", "fp16")}
        make = lambda: _made(name, **settings)
        texts = retrieval.encoded(docs, lambda: make().encode_corpus, batch_size=a.encode_batch_size)
        asked = records.ordinal(examples.select("line_no", "query"), "line_no", "query_index")
        queries = retrieval.encoded(asked, lambda: make().encode_queries, column="query", batch_size=a.encode_batch_size)
        found = retrieval.neighbours(retrieval.normalize(queries), retrieval.normalize(texts), at_once=a.search_batch_size)
        row = retrieval.metrics(retrieval.ranks(found, retrieval.qrels(examples, docs))).first().asDict() | {"document_count": docs.count()}
        mode = "full-corpus" if a.full_corpus else "positive-only"
        rep = report.report(row, {"mode": mode, "encoder": a.encoder}, time.perf_counter() - began)
        report.save(rep, report.output_dir(a.output_dir, mode, a.encoder))
        print(report.as_text(rep))
        return 0
    rows = records.raise_first(records.parsed(lines, whole=a.command == "clean"))
    if a.command == "clean":
        clean.check_pool(rows)
        out = records.raise_first(clean.cleaned(rows, a.negative_count))
        clean.as_json(out.orderBy("line_no")).write.mode("overwrite").text(a.output)
        print(clean.stats(rows, a.negative_count).first().asDict())
        return 0
    done = split.split(rows, (a.train_ratio, a.validation_ratio, a.test_ratio), a.seed, a.compatible_shuffle)
    examples = records.training_examples(done)
    records.raise_first(examples.withColumnRenamed("example_error", "error").select("line_no", "error"))
    for name in split.SPLITS:
        files.write_json_lines(examples.where(F.col("split") == name).orderBy("order_key").select("query", "pos", "neg"), getattr(a, name))
    print({r["split"]: r["n"] for r in split.counts(done).collect()})
    return 0


if __name__ == "__main__":
    try:
        raise SystemExit(main())
    except KeyboardInterrupt:
        raise SystemExit(130) from None
