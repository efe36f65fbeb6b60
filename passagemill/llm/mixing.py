"""Mixing sources to target weights by entropy balancing.

A document of source s is taken at rate min(3, exp(lambda_s * size / mean size of s)): of all rates up to 3, those
nearest to 1 in relative entropy that give the source its target of words. The convex dual has one multiplier per
source; Newton iterations, kept in a bracket that a step leaves for its middle, solve it for all sources at once. Each is
one distributed aggregation over the counts of documents by source and size, with terms rounded to decimals so that sums
do not depend on their order, and one written table of a row per source; a source that is not solved is an error. Rates
become copies in salted blocks of a source, from long to short documents, each rounded down or up so that the words taken
follow the words wanted; a block is off by about half its shortest documents. No source is one task; what orders the
sources by name and level holds one row of each.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; a target stops at 3 times their
source's size, the excess reshared by weight. Nulls: a null text has size 0; a null source is a source, the last; a null
doc_id is an id. Rows with equal doc_id, source and size get equal copies. An empty table gives no rows. Documents of
size 0 are taken once; sizes are of whole texts, however long. repeated() returns the columns that it got, whatever their
names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .shared import GAP, drop, table, unused, written

MOST, WEIGHTS = 3, (1, 2, 3)
BLOCK, ROUNDS, CLOSE = 2000, 200, 1e-7


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{GAP}]+")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, docs, target from (source, size, n). One row per source."""
    src = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1)
    src = src.withColumn("weight", weight).withColumn("top", MOST * F.col("source_size"))
    # sources by the level at which they stop: those below the level get their top, the others their weight times it
    by = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("level", F.when(level <= F.col("top") / F.col("weight"), level))
    first = F.first("level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return src.withColumn("target", F.least(F.col("top").cast("double"), first * F.col("weight"))).select("source", "source_size", "docs", "target")


def rate(lam: Column, x: Column) -> Column:
    return F.when(lam * x > 2, F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.exp(lam * x)))


def balanced(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, lam, mean: the multiplier of each source. At 3 times the size every rate is 3."""
    full = F.col("target") >= MOST * F.col("source_size")
    state = written(wanted.select("source", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.when(full, F.lit(1e9)).otherwise(F.lit(0.0)).alias("lam"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), full.alias("done")))
    hist = sizes.where("size > 0").withColumnRenamed("source", "s")
    exact = lambda c: F.sum(F.round(c, 6).cast("decimal(38,6)")).cast("double")
    for _ in range(ROUNDS):
        x = F.col("size") / F.col("mean")
        r = rate(F.col("lam"), x)
        words = F.col("n") * F.col("size") * r
        at = hist.join(state.where("NOT done"), F.expr("s <=> source")).groupBy("source").agg(exact(words).alias("g"), exact(F.when(r < MOST, words * x).otherwise(0.0)).alias("h"))
        step = state.join(at.withColumnRenamed("source", "s"), F.expr("s <=> source"), "left").drop("s")
        off = F.col("g") - F.col("target")
        low, high = F.when(off < 0, F.col("lam")).otherwise(F.col("low")), F.when(off > 0, F.col("lam")).otherwise(F.col("high"))
        step = step.withColumns({"low": low, "high": high, "close": F.coalesce(F.abs(off) <= CLOSE * F.col("target") + 0.5, F.lit(True)), "newton": F.col("lam") - F.when(F.col("h") > 0, off / F.col("h"))})
        middle = F.when((F.col("low") > -1e5) & (F.col("high") < 1e5), (F.col("low") + F.col("high")) / 2).when(off < 0, F.col("lam") * 2 + 1).otherwise(F.col("lam") * 2 - 1)
        fine = F.col("newton").isNotNull() & (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        done = F.col("done") | F.col("close") | (F.col("high") - F.col("low") < 1e-12)  # no number lies between
        step = step.withColumn("then", F.when(done, F.col("lam")).when(fine, F.col("newton")).otherwise(middle))
        left = Observation()
        then = step.select("source", "target", "mean", F.col("then").alias("lam"), "low", "high", done.alias("done"))
        then = written(then.observe(left, F.count_if(~F.col("done")).alias("n")))
        drop(state)
        state = then
        if not left.get["n"]:
            return state.select("source", "lam", "mean")
    raise RuntimeError(f"balanced: {left.get['n']} sources not solved after {ROUNDS} rounds")


def _copies(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Copies of each row of a block: rates rounded so that the running sum of words stays near the wanted one."""
    group = group.sort_values(["size", "doc_id", "n"], ascending=[False, True, True], kind="stable")
    out, off = [], 0.0
    for size, r, n in zip(group["size"].tolist(), group["rate"].tolist(), group["n"].tolist()):
        off += r * size * n
        whole = int(r)
        c = whole + (r > whole and off - whole * size * n > size * n / 2)
        off -= c * size * n
        out.append(c)
    return group.assign(copies=out)[["doc_id", "source", "size", "copies"]]


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, a row per distinct (doc_id, source, size) with n, their number."""
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size")))
    sizes = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    wanted = written(targets(sizes))
    solved = balanced(sizes, wanted)
    # at most a row per source and size; Spark broadcasts it only if it is small
    rates = sizes.select("source", "size").join(wanted.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s").join(solved.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
    rates = rates.select(F.col("source").alias("s"), F.col("size").alias("z"), "docs", rate(F.col("lam"), F.col("size") / F.col("mean")).alias("rate"), F.col("source_size"), "target")
    keyed = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    dealt = keyed.join(rates, F.expr("source <=> s AND size = z")).withColumn("block", F.expr(f"pmod(xxhash64(doc_id), ceil(docs / {BLOCK}))"))
    some = dealt.where("size > 0").select("doc_id", "source", "size", "n", "rate", "block")
    kind = docs.schema["source"].dataType.simpleString()
    copies = some.groupBy("source", "block").applyInPandas(_copies, f"doc_id long, source {kind}, size long, copies long")
    copies = written(copies.union(dealt.where("size = 0").select("doc_id", "source", "size", F.lit(1).cast("long"))))
    src = wanted.select(F.col("source").alias("s"), "source_size", "target")
    return rows.select(F.col("doc_id").alias("d"), F.col("source").alias("o"), F.col("size").alias("z")).join(copies, F.expr("d <=> doc_id AND o <=> source AND z = size")).drop("d", "o", "z").join(src, F.expr("source <=> s")).drop("s")


def repeated(docs: DataFrame) -> DataFrame:
    """The mix: each document as often as it is taken, with its own columns."""
    d, o, z, n = (unused(docs, x) for x in ("_doc", "_source", "_size", "_copies"))
    copies = mixed(docs.select("doc_id", "source", "text")).select(F.col("doc_id").alias(d), F.col("source").alias(o), F.col("size").alias(z), F.col("copies").alias(n)).distinct()
    out = docs.join(copies, (F.col("doc_id").cast("long").eqNullSafe(F.col(d))) & F.col("source").eqNullSafe(F.col(o)) & (size_of(F.col("text")) == F.col(z)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(1).cast("long"), F.col(n)))).alias(z)).drop(z)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
