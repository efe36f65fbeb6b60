"""Records: (line_no, query, positive, hard_negatives array<struct<id, type, hardness, violated_requirement, text>>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.text import blank, normalized, strip, text_key, word_bounds, word_count

ITEM = "struct<id:int,type:string,hardness:string,violated_requirement:string,text:string>"
#: The strategies in order, with the hardness each is given.
STRATEGIES = [
    ("entity_confusion", "very_hard"),
    ("attribute_confusion", "very_hard"),
    ("relation_confusion", "very_hard"),
    ("intent_drift", "hard"),
    ("constraint_violation", "hard"),
    ("partial_relevance", "medium_hard"),
    ("lexical_trap", "hard"),
]
#: Fixed values of a negative that fills up a record.
FILLED = ("random_negative", "random", "Added during dataset cleaning.")


def strategies(spark: SparkSession) -> DataFrame:
    """strategy_index, type, hardness: seven rows."""
    return spark.createDataFrame([(i, *x) for i, x in enumerate(STRATEGIES)], "strategy_index int, type string, hardness string")


def parsed(lines: DataFrame, whole: bool = False) -> DataFrame:
    """Records of lines (line_no, value as a variant) with error: what is wrong first, or null. With whole, the value
    stays, and each negative has its own as raw."""
    v = F.col("value")
    item = F.from_json(F.to_json(F.try_variant_get(v, "$.hard_negatives", "variant")), f"array<{ITEM}>")
    items = F.try_variant_get(v, "$.hard_negatives", "array<variant>")
    bad_item = F.exists(items, lambda x: ~F.coalesce(jsonx.kind(x, "$.text") == "STRING", F.lit(False)))
    empty_item = F.exists(items, lambda x: blank(F.try_variant_get(x, "$.text", "string")))
    error = F.coalesce(
        F.when(v.isNull() | (jsonx.kind(v) != "OBJECT"), "invalid record"),
        F.when(~jsonx.is_string(v, "$.positive_document") | blank(jsonx.text_at(v, "$.positive_document")), "invalid positive_document"),
        F.when(~jsonx.is_string(v, "$.query") | blank(jsonx.text_at(v, "$.query")), "invalid query"),
        F.when(~jsonx.is_array(v, "$.hard_negatives"), "hard_negatives is not a list"),
        F.when(bad_item, "a negative has no text"),
        F.when(empty_item, "a negative is empty"),
    )
    if whole:
        item = F.transform(item, lambda x, i: x.withField("raw", F.get(items, i)))
    return lines.select("line_no", *["value"] * whole, strip(jsonx.text_at(v, "$.query")).alias("query"), strip(jsonx.text_at(v, "$.positive_document")).alias("positive"), item.alias("hard_negatives"), error.alias("error"))


def candidate_error(text: Column, violated: Column, positive: Column, low: Column, high: Column) -> Column:
    """What is wrong with a generated negative first, or null."""
    return F.coalesce(
        F.when(blank(text), "text is missing"),
        F.when(blank(violated), "violated_requirement is missing"),
        F.when(strip(text) == positive, "identical to the positive"),
        F.when(~word_count(text).between(low, high), "word count out of bounds"),
    )


def validated(candidates: DataFrame, tolerance: float) -> DataFrame:
    """Adds trimmed text and violated_requirement, low, high and error to (positive, text, violated_requirement)."""
    low, high = word_bounds(word_count(F.col("positive")), tolerance)
    df = candidates.withColumns({"low": low, "high": high})
    df = df.withColumn("error", candidate_error(F.col("text"), F.col("violated_requirement"), F.col("positive"), F.col("low"), F.col("high")))
    return df.withColumns({"text": strip(F.col("text")), "violated_requirement": strip(F.col("violated_requirement"))})


def combined_error(value: Column) -> Column:
    """What is wrong with an answer that holds all strategies at once, or null: a need, requirements, and exactly the
    seven strategies, numbered and in order, each with a text and what it violates."""
    items = F.try_variant_get(value, "$.hard_negatives", "array<variant>")
    names = F.array(*(F.lit(t) for t, _ in STRATEGIES))
    wrong = lambda x, i: ~F.coalesce((F.try_variant_get(x, "$.id", "int") == i + 1) & (F.try_variant_get(x, "$.type", "string") == F.get(names, i)), F.lit(False))
    empty = lambda x: blank(F.try_variant_get(x, "$.text", "string")) | blank(F.try_variant_get(x, "$.violated_requirement", "string"))
    return F.coalesce(
        F.when(value.isNull(), "not a JSON object"),
        F.when(blank(jsonx.text_at(value, "$.information_need")), "information_need is missing"),
        F.when(~jsonx.is_array(value, "$.critical_requirements") | (F.coalesce(F.size(F.try_variant_get(value, "$.critical_requirements", "array<variant>")), F.lit(0)) < 1), "critical_requirements is missing"),
        F.when(items.isNull() | (F.size(items) != len(STRATEGIES)), "not exactly seven negatives"),
        F.when(F.exists(F.transform(items, wrong), lambda x: x), "negatives out of order"),
        F.when(F.exists(items, empty), "a negative is empty"),
    )


def assembled(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Records of rows (source_index, query, positive) that have a candidate for each strategy, from (source_index,
    strategy_index, text, violated_requirement), with later_duplicate: the index of the first candidate that repeats an
    earlier one but for white space, or null."""
    dim = F.broadcast(strategies(rows.sparkSession))
    item = F.struct((F.col("strategy_index") + 1).cast("int").alias("id"), "type", "hardness", "violated_requirement", "text")
    sets = candidates.join(dim, "strategy_index").groupBy("source_index").agg(F.array_sort(F.collect_list(item)).alias("hard_negatives"))
    sets = sets.where(F.size("hard_negatives") == len(STRATEGIES))
    plain = F.transform("hard_negatives", lambda x: normalized(x["text"]))
    later = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(len(STRATEGIES) - 1)), lambda i: F.array_position(F.col("_plain"), F.get(F.col("_plain"), i)) < i + 1))
    return rows.join(sets, "source_index").withColumn("_plain", plain).withColumn("later_duplicate", later).drop("_plain")


def example_error(query: Column, positive: Column, items: Column) -> Column:
    """Why a record can't become a training example, or null."""
    texts = F.transform(items, lambda x: strip(x["text"]))
    return F.coalesce(
        F.when(query.isNull() | positive.isNull(), "missing field"),
        F.when(F.exists(texts, lambda x: F.coalesce(x == "", F.lit(True))), "empty negative"),
        F.when(F.exists(texts, lambda x: x == strip(positive)), "mislabeled positive"),
        F.when(F.size(F.array_distinct(texts)) < F.size(texts), "duplicate negatives"),
        F.when(items.isNull() | (F.size(items) == 0), "no negatives"),
    )


def training_examples(records: DataFrame) -> DataFrame:
    """query, pos, neg and error of each record; split and line columns stay."""
    keep = [c for c in records.columns if c not in ("query", "positive", "hard_negatives")]
    return records.select(*keep, "query", F.array("positive").alias("pos"), F.transform("hard_negatives", lambda x: strip(x["text"])).alias("neg"), example_error(F.col("query"), F.col("positive"), F.col("hard_negatives")).alias("example_error"))


def evaluation_errors(lines: DataFrame) -> DataFrame:
    """line_no, query, error of evaluation lines (line_no, value): a unique query, one positive, texts for negatives."""
    v = F.col("value")
    pos, neg = F.try_variant_get(v, "$.pos", "array<variant>"), F.try_variant_get(v, "$.neg", "array<variant>")
    no_text = lambda x: ~F.coalesce(jsonx.kind(x) == "STRING", F.lit(False)) | blank(F.try_variant_get(x, "$", "string"))
    error = F.coalesce(
        F.when(v.isNull() | (jsonx.kind(v) != "OBJECT"), "invalid JSON"),
        F.when(blank(jsonx.text_at(v, "$.query")), "invalid query"),
        F.when(pos.isNull() | (F.size(pos) != 1) | F.coalesce(F.exists(pos, no_text), F.lit(True)), "not exactly one positive"),
        F.when(neg.isNull() | F.coalesce(F.exists(neg, no_text), F.lit(True)), "invalid negatives"),
    )
    df = lines.select("line_no", strip(jsonx.text_at(v, "$.query")).alias("query"), error.alias("error"))
    first = df.where("error IS NULL").groupBy("query").agg(F.min("line_no").alias("first"))
    return df.join(first, "query", "left").select("line_no", "query", F.coalesce("error", F.when(F.col("line_no") > F.col("first"), "duplicate query")).alias("error"))


def raise_first(df: DataFrame, what: str = "line") -> DataFrame:
    """df without its error column; raises the error with the least line_no if there is one."""
    bad = df.where("error IS NOT NULL").agg(F.min(F.struct("line_no", "error")).alias("e")).first()["e"]
    if bad is not None:
        raise ValueError(f"{what} {bad['line_no']}: {bad['error']}")
    return df.drop("error")


def first_per(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with the least order of each key, a text. A partial aggregation finds them, so a frequent key is no hot task."""
    first = df.groupBy(text_key(F.col(key)).alias("_key")).agg(F.min(order).alias("_first"))
    return df.join(first.select("_first"), F.col(order) == F.col("_first"), "left_semi")


def ordinal(df: DataFrame, order: str, name: str, first: int = 0, chunk: int = 100_000) -> DataFrame:
    """df with its rank by order, a unique and roughly dense integer: ranks within chunks of order plus a prefix sum over
    the chunks' counts, so that no task sees all rows."""
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    sizes = cut.groupBy("_chunk").agg(F.count("*").alias("_n"))
    base = sizes.select("_chunk", F.coalesce(F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_chunk").orderBy(order))
    return cut.withColumn("_rank", rank).join(base, "_chunk").withColumn(name, (F.col("_base") + F.col("_rank") - 1 + first).cast("long")).drop("_chunk", "_rank", "_base")
