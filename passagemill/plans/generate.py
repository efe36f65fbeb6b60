"""Generating negatives with an injected provider: missing work, retries, validation, keyed state, resumable runs.

State is an append-only Parquet table of candidates; the latest row of a key counts, and a row without text is a
tombstone. Answers are written once, as they come, and all else is read from them: a provider is asked once per missing
candidate and attempt, whatever reads the answer. Every write is one atomic job, so a run that dies is resumed from
what it wrote: output is written before the state is compacted, its keys are authoritative, and compaction writes a new
version of the state, which counts once it is complete. A manifest refuses state written by other settings.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.text import strip, word_bounds, word_count
from ..operators import records

PROMPT_VERSION = "1"
STATE = "source_index long, strategy_index int, violated_requirement string, text string, version long"


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    return rows.join(done.select("source_index"), "source_index", "left_anti")


def limited(rows: DataFrame, limit: int) -> DataFrame:
    """The first limit rows by source_index. A limit below 1 is refused."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return rows.orderBy("source_index").limit(limit)


def missing(rows: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows times strategies (seven, by explode) that have no saved candidate. A row is joined once with all that it has and
    exploded after that, so that its texts move once and not once for each strategy."""
    had = saved.groupBy("source_index").agg(F.collect_set(F.col("strategy_index").cast("int")).alias("_had"))
    left = F.array_except(F.array(*(F.lit(i) for i in range(len(records.STRATEGIES)))), F.coalesce("_had", F.array().cast("array<int>")))
    joined = rows.join(had, "source_index", "left")
    return joined.select("source_index", F.explode(left).alias("strategy_index"), *(c for c in rows.columns if c != "source_index"))


def latest(state: DataFrame) -> DataFrame:
    """The last version of each key, tombstones left out."""
    last = state.groupBy("source_index", "strategy_index").agg(F.max(F.struct("version", "violated_requirement", "text")).alias("s"))
    return last.select("source_index", "strategy_index", "s.violated_requirement", "s.text").where("text IS NOT NULL")


def complete(saved: DataFrame) -> DataFrame:
    return saved.groupBy("source_index").agg(F.count_distinct("strategy_index").alias("n")).where(F.col("n") == len(records.STRATEGIES)).select("source_index")


def compacted(saved: DataFrame, done: DataFrame) -> DataFrame:
    """State that is still needed: of rows not in the output."""
    return saved.join(done.select("source_index"), "source_index", "left_anti")


def prompt(tolerance: float):
    """The request for one negative, in the library's own words."""
    target = word_count(F.col("positive"))
    low, high = word_bounds(target, tolerance)
    kinds = F.array(*(F.lit(t) for t, _ in records.STRATEGIES))
    return F.concat_ws("\n", F.lit("Write one passage that looks like an answer to the query but is none."), F.concat(F.lit("Kind of mistake: "), F.get(kinds, F.col("strategy_index"))), F.format_string("Length: about %d words, %d at least and %d at most.", target, low, high), F.concat(F.lit("Query: "), "query"), F.concat(F.lit("Correct passage: "), "positive"), F.lit('Answer with a JSON object: {"violated_requirement": ..., "text": ...}'))


def system_prompt(thinking: bool) -> str:
    own = "You write hard negative passages for retrieval training. Answer with JSON only."
    return own if thinking else "/no_think\n" + own


def stub(prompt_: str) -> str:
    """A provider without a network, for tests: the passage's words in reverse."""
    passage = prompt_.split("Correct passage: ", 1)[1].rsplit("\nAnswer with", 1)[0]
    kind = prompt_.split("Kind of mistake: ", 1)[1].split("\n", 1)[0]
    words = passage.split()
    return "```json\n" + json.dumps({"violated_requirement": kind, "text": " ".join([*words[:0:-1], f"{kind}"] if len(words) > 1 else [kind])}, ensure_ascii=False) + "\n```"


def called(asked: DataFrame, provider: Callable[[], Callable[[str], str]], retries: int, delay: float, workers: int) -> DataFrame:
    """asked with answer and failed for its prompt: one of them is null."""
    keep = [c for c in asked.columns if c != "prompt"]

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        ask = provider()

        def one(text: str) -> tuple[str | None, str | None]:
            error = "no attempt"
            for attempt in range(1, retries + 1):
                try:
                    out = ask(text)
                    if out and out.strip():
                        return out, None
                    error = "empty answer"
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                if attempt < retries:
                    time.sleep(delay * 2 ** (attempt - 1) + random.random() * bool(delay))
            return None, f"{retries} attempts: {error}"

        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                got = list(pool.map(one, frame["prompt"].tolist()))
                yield frame[keep].assign(answer=[a for a, _ in got], failed=[e for _, e in got])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields if f.name in keep)
    return asked.mapInPandas(call, f"{types}, answer string, failed string")


def answered(work: DataFrame, provider: Callable[[], Callable[[str], str]], tolerance: float, retries: int = 4, delay: float = 2.0, workers: int = 8) -> DataFrame:
    """source_index, strategy_index, violated_requirement, text, error of (source_index, strategy_index, query, positive).
    provider() is made once per worker; requests of a batch run in threads; failures become rows, never exceptions."""
    asked = work.withColumn("prompt", prompt(tolerance))
    low, high = word_bounds(word_count(F.col("positive")), tolerance)
    asked = asked.withColumns({"low": low, "high": high}).select("source_index", "strategy_index", "positive", "prompt", "low", "high")

    raw = called(asked, provider, retries, delay, workers)
    v = jsonx.tolerant_object(F.col("answer"))
    got = raw.withColumn("v", v).withColumns({"text": jsonx.text_at(F.col("v"), "$.text"), "violated_requirement": jsonx.text_at(F.col("v"), "$.violated_requirement")})
    wrong = records.candidate_error(F.col("text"), F.col("violated_requirement"), F.col("positive"), F.col("low"), F.col("high"))
    error = F.coalesce("failed", F.when(F.col("v").isNull(), "not a JSON object"), wrong)
    return got.select("source_index", "strategy_index", strip(F.col("violated_requirement")).alias("violated_requirement"), strip(F.col("text")).alias("text"), error.alias("error"))


def combined_prompt():
    """The request for all strategies at once, in the library's own words."""
    kinds = ", ".join(t for t, _ in records.STRATEGIES)
    return F.concat_ws("\n", F.lit(f"Write {len(records.STRATEGIES)} passages that look like answers to the query but are none, one for each kind of mistake, in this order: {kinds}."), F.format_string("Length of each: %d words.", word_count(F.col("positive"))), F.concat(F.lit("Query: "), "query"), F.concat(F.lit("Correct passage: "), "positive"), F.lit('Answer with a JSON object: {"information_need": ..., "critical_requirements": [...], "hard_negatives": [{"id": 1, "type": ..., "hardness": ..., "violated_requirement": ..., "text": ...}, ...]}'))


def answered_combined(work: DataFrame, provider: Callable[[], Callable[[str], str]], retries: int = 4, delay: float = 2.0, workers: int = 8) -> DataFrame:
    """source_index, value (the record as JSON), error of (source_index, query, positive). Query and positive are those
    of the source, whatever the answer says; the negatives are the answer's, with all their keys."""
    raw = called(work.select("source_index", "query", "positive", combined_prompt().alias("prompt")), provider, retries, delay, workers)
    got = raw.withColumn("v", jsonx.tolerant_object(F.col("answer")))
    error = F.coalesce("failed", records.combined_error(F.col("v")))
    part = lambda name: F.try_variant_get("v", f"$.{name}", "variant").alias(name)
    record = F.struct("source_index", "query", F.col("positive").alias("positive_document"), *map(part, ("information_need", "critical_requirements", "hard_negatives")))
    return got.withColumn("error", error).select("source_index", F.when(F.col("error").isNull(), F.to_json(record, {"ignoreNullFields": "false"})).alias("value"), "error")


def manifest(input_path: str, tolerance: float) -> dict[str, str]:
    return {"prompt_version": PROMPT_VERSION, "input": input_path, "length_tolerance": repr(float(tolerance))}


def check_manifest(saved: dict[str, str], now: dict[str, str]) -> None:
    off = sorted(k for k in now if saved.get(k) != now[k])
    if off:
        raise ValueError(f"state was written by other settings: {', '.join(off)}")


def process(rows: DataFrame, saved: DataFrame, new: DataFrame, version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One batch of rows, with the candidates it had and those it got: (state rows to append, finished records, errors).
    Candidates that repeat an earlier one of their row get a tombstone, so that they are asked for again."""
    good = new.where("error IS NULL").select("source_index", "strategy_index", "violated_requirement", "text")
    whole = records.assembled(rows, saved.unionByName(good))
    finished = whole.where("later_duplicate IS NULL").select("source_index", "query", "positive", "hard_negatives")
    again = whole.where("later_duplicate IS NOT NULL")
    graves = again.select("source_index", F.col("later_duplicate").cast("int").alias("strategy_index"), F.lit(None).cast("string").alias("violated_requirement"), F.lit(None).cast("string").alias("text"), F.lit(version + 1).cast("long").alias("version"))
    append = good.withColumn("version", F.lit(version).cast("long")).unionByName(graves)
    kinds = F.array(*(F.lit(t) for t, _ in records.STRATEGIES))
    now = F.unix_timestamp().cast("double")
    errors = new.where("error IS NOT NULL").select("source_index", F.get(kinds, F.col("strategy_index")).alias("strategy"), "error", now.alias("time"))
    return append, finished, errors.unionByName(again.select("source_index", F.lit(None).cast("string").alias("strategy"), F.format_string("duplicate text at strategy index %d", "later_duplicate").alias("error"), now.alias("time")))


class Folder:
    """Tables under a folder of any file system that Spark reaches; a table counts once its job has committed."""

    def __init__(self, spark: SparkSession, where: str):
        self.spark, self.where = spark, where.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.where).getFileSystem(spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        return self.fs.exists(self.path(f"{self.where}/{name}/_SUCCESS"))

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.where}/{name}") if self.has(name) else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        df.write.mode(mode).parquet(f"{self.where}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.where}/{name}")

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.where}/{name}"), True)

    def versions(self, name: str) -> list[int]:
        """Numbers of the complete tables name-1, name-2, ..., in order."""
        if not self.fs.exists(self.path(self.where)):
            return []
        found = (str(x.getPath().getName()) for x in self.fs.listStatus(self.path(self.where)))
        return sorted(int(x.rpartition("-")[2]) for x in found if x.rpartition("-")[0] == name and x.rpartition("-")[2].isdigit() and self.has(x))

    def settle(self, settings: dict[str, str]) -> None:
        """Writes the manifest, or compares it with the one that is there."""
        if self.has("manifest"):
            check_manifest(json.loads(self.spark.read.text(f"{self.where}/manifest").first()[0]), settings)
        else:
            self.spark.createDataFrame([(json.dumps(settings),)], "value string").write.mode("overwrite").text(f"{self.where}/manifest")


def batches(rows: DataFrame, done: DataFrame, size: int, limit: int | None) -> DataFrame:
    """source_index and batch of the rows that are not done, in order; numbered without a task that sees all rows."""
    todo = pending(rows, done)
    if limit is not None:
        todo = limited(todo, limit)
    placed = records.ordinal(todo.select(F.col("source_index").cast("long").alias("source_index")), "source_index", "place")
    return placed.select("source_index", F.floor(F.col("place") / size).alias("batch"))


def attempted(ask: Callable[[DataFrame], DataFrame], work: DataFrame, keys: list[str], at: Folder, retries: int, delay: float) -> tuple[DataFrame, int]:
    """Answers to work, each attempt one written table: what fails, in the call or by its content, is asked again, up to
    retries times in all. Also the number of requests of the first attempt."""
    left, parts, first = at.write(work, "asked"), [], 0
    for k in range(1, retries + 1):
        got = at.write(ask(left), f"answers-{k}")
        n, bad = got.agg(F.count("*"), F.count("error")).first()
        first = first or n
        parts.append(got.where("error IS NULL"))
        if not bad:
            break
        if k == retries:
            parts.append(got.where("error IS NOT NULL").withColumn("error", F.concat(F.lit(f"{k} attempts: "), F.regexp_replace("error", "^1 attempts: ", ""))))
            break
        left = at.write(left.join(got.where("error IS NOT NULL").select(*keys), keys, "left_semi"), f"asked-{k}")
        time.sleep(delay * 2 ** (k - 1) + random.random() * bool(delay))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return at.write(out, "step"), first


def run(spark: SparkSession, rows: DataFrame, where: str, provider, tolerance: float = 0.15, batch_size: int = 50, limit: int | None = None, input_path: str = "", retries: int = 4, delay: float = 2.0, workers: int = 8) -> dict[str, int]:
    """Generates in batches under the folder where (state, output, errors), resuming what is there. Returns counters; a run
    is complete if incomplete is 0; requested counts the missing candidates, each once."""
    from ..sources.files import json_text

    at = Folder(spark, where)
    at.settle(manifest(input_path, tolerance))
    schema = f"source_index long, query string, positive string, hard_negatives array<{records.ITEM}>"
    old = at.versions("state")
    now = old[-1] if old else 1
    state = at.read(f"state-{now}", STATE)
    work = at.write(batches(rows, at.read("output", schema), batch_size, limit), "work")
    # what each batch has already, found in one pass over the state
    kept = work.join(latest(state), "source_index").select("batch", "source_index", "strategy_index", "violated_requirement", "text")
    kept.write.mode("overwrite").partitionBy("batch").parquet(f"{at.where}/saved")
    saved = spark.read.schema("source_index long, strategy_index int, violated_requirement string, text string, batch long").parquet(f"{at.where}/saved")
    last, total = work.agg(F.max("batch"), F.count("*")).first()
    version = (state.agg(F.max("version")).first()[0] or 0) + 1
    requested = saved_n = 0
    for b in range(0 if last is None else int(last) + 1):
        own = at.write(rows.join(work.where(F.col("batch") == b).select("source_index"), "source_index").select("source_index", "query", "positive"), "rows")
        had = saved.where(F.col("batch") == b).drop("batch")
        new, asked = attempted(lambda left: answered(left, provider, tolerance, 1, 0.0, workers), missing(own, had), ["source_index", "strategy_index"], at, retries, delay)
        append, finished, errors = process(own, had, new, version)
        at.write(append, f"state-{now}", "append")
        saved_n += at.write(finished, "finished").count()
        at.write(spark.read.schema(schema).parquet(f"{at.where}/finished"), "output", "append")
        errors.write.mode("append").json(f"{at.where}/errors")
        requested += asked
        version += 2
    output = at.read("output", schema)
    keep = compacted(latest(at.read(f"state-{now}", STATE)), output).withColumn("version", F.lit(version).cast("long"))
    at.write(keep, f"state-{now + 1}")
    for n in [*old, now]:
        at.drop(f"state-{n}")
    _clear(at, retries, "work", "saved", "rows", "finished")
    json_text(output.withColumnRenamed("positive", "positive_document")).write.mode("overwrite").text(f"{at.where}/output-jsonl")
    return {"processed": total, "saved": saved_n, "incomplete": total - saved_n, "requested": requested}


def _clear(at: Folder, retries: int, *names: str) -> None:
    for name in (*names, "step", "asked", *(f"{x}-{k}" for x in ("asked", "answers") for k in range(1, retries + 1))):
        at.drop(name)


def run_combined(spark: SparkSession, rows: DataFrame, where: str, provider, batch_size: int = 50, limit: int | None = None, retries: int = 4, delay: float = 2.0, workers: int = 8) -> dict[str, int]:
    """One request a row for all strategies, in batches under the folder where (output, errors), resuming what is there.
    A row that fails is an error row and is asked again by the next run."""
    at = Folder(spark, where)
    schema = "source_index long, value string"
    work = at.write(batches(rows, at.read("output", schema), batch_size, limit), "work")
    last, total = work.agg(F.max("batch"), F.count("*")).first()
    saved_n = 0
    for b in range(0 if last is None else int(last) + 1):
        own = rows.join(work.where(F.col("batch") == b).select("source_index"), "source_index").select("source_index", "query", "positive")
        new, _ = attempted(lambda left: answered_combined(left, provider, 1, 0.0, workers), own, ["source_index"], at, retries, delay)
        at.write(new.where("error IS NULL").select("source_index", "value"), "output", "append")
        new.where("error IS NOT NULL").select("source_index", "error", F.unix_timestamp().cast("double").alias("time")).write.mode("append").json(f"{at.where}/errors")
        saved_n += new.where("error IS NULL").count()
    at.read("output", schema).select("value").write.mode("overwrite").text(f"{at.where}/output-jsonl")
    _clear(at, retries, "work")
    return {"processed": total, "saved": saved_n, "incomplete": total - saved_n}
