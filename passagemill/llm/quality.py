"""Quality rules with thresholds that adapt to language and source (native: DataFrame functions only).

Each metric of a document, in whole thousandths, goes into a KLL quantile sketch of its language and source. Sketches
merge, so those of the sources of a language, and of all languages, are made of theirs without another pass. A group's
cut-off lies above its upper octile by SPREAD times the distance from its median, or by the metric's resolution where
most documents have the same value (as none of a symbol) and the distance says nothing. A group with fewer than min_docs
documents takes its language's merged sketch, and a small language the sketch of the whole corpus. Documents above any
cut-off of their group are rejected. A sketch is exact for up to K documents and then off by some 0.1 % in rank.

Nulls: a null text has no words (base_failed); null lang or source is a group of its own. Empty tables give empty
results. Extra columns stay in filtered(), whatever their names; rated() returns its own columns only. Repeated rows
count as often as they occur; a document at a cut-off stays; texts of any length are measured whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import GAP, drop, unused, written

#: metric: (numerator, denominator, resolution), in thousandths.
METRICS = {
    "symbol_share": ("n_symbols", "word_chars", 50),
    "dup_line_share": ("n_dup_lines", "n_lines", 400),
    "repeat_share": ("n_repeat_words", "n_words", 300),
    "word_length": ("word_chars", "n_words", 500),
}
#: The upper quantile that cut-offs start from (a binary fraction, so that ranks are exact), their distance, and the sketches' size.
UPPER, SPREAD, MIN_DOCS, K = 0.875, 4, 30, 2000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def without(text: Column, chars: str, to: str = "") -> Column:
    """text with each of chars replaced; a byte search per character, several times faster than translate or a regex."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(to))
    return text


def once(value: Column, then) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array.

    Distinct hashes of all windows tell whether any is found twice; only then are the windows sorted by hash, and
    neighbours count as equal if their words are.
    """
    n = F.size(words)
    at = F.sequence(F.lit(1), n - 2)
    hashes = F.transform(at, lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))
    word = lambda x, k: F.get(words, x["i"] - 1 + k)
    full = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))

    def covered(rows: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce((x["h"] == y["h"]) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2)), F.lit(False))

        kept = F.filter(rows, lambda x, i: same(x, F.get(rows, i + 1)) | same(x, F.get(rows, i - 1)))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def total(starts: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-2).alias("p"))
        return F.aggregate(starts, none, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["p"])).alias("n"), p.alias("p")), lambda a: a["n"])

    twice = (n >= 4) & (F.size(F.array_distinct(hashes)) < n - 2)
    return F.when(twice, once(once(full, covered), total)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, into: str) -> DataFrame:
    """docs with a struct column into: MEASURES, the metrics in whole thousandths, and base_failed."""
    text = F.coalesce("text", F.lit(""))
    words = unused(docs, "_words")
    df = docs.withColumn(words, F.array_remove(F.split(without(text, "\t\n\x0b\f\r", " "), " "), ""))
    lines = unused(df, "_lines")
    df = df.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{GAP}]"))))
    found = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(without(text, " \t\n\x0b\f\r")).cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, "#*$%&|<>"))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(F.col(words)),
    }
    # one row by explode: filters on measures must not be pushed below, where each use would compute them anew
    one_row = F.explode(F.array(F.struct(*(x.alias(m) for m, x in found.items()))))
    df = df.select(*(F.col(f"`{c}`") for c in docs.columns), one_row.alias(into))
    part = lambda a, b: F.expr(f"CAST(CASE WHEN {into}.{b} > 0 THEN {into}.{a} * 1000 DIV {into}.{b} ELSE 0 END AS BIGINT)")
    failed = F.expr(f"{into}.n_words < 50 OR 100 * {into}.n_repeat_words > 50 * {into}.n_words")
    return df.withColumn(into, F.struct(f"{into}.*", *(part(a, b).alias(m) for m, (a, b, _) in METRICS.items()), failed.alias("base_failed")))


def sketches(df: DataFrame, of: str) -> DataFrame:
    """lang, source, docs and a sketch per metric, of the documents of measured() that pass the base rules."""
    own = df.where(f"NOT {of}.base_failed")
    return own.groupBy("lang", "source").agg(F.count("*").alias("docs"), *(F.kll_sketch_agg_bigint(f"{of}.{m}", K).alias(m) for m in METRICS))


def cutoffs(found: DataFrame) -> Column:
    """A struct of the cut-off of each metric, from its sketch."""
    q = lambda m, p: F.kll_sketch_get_quantile_bigint(m, F.lit(p))
    return F.struct(*((q(m, UPPER) + F.greatest(SPREAD * (q(m, UPPER) - q(m, 0.5)), F.lit(least))).cast("long").alias(m) for m, (_, _, least) in METRICS.items()))


def thresholds(own: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, docs and cut, a struct of cut-offs by metric, of each group of sketches()."""
    merged = [F.sum("docs").alias("docs"), *(F.kll_merge_agg_bigint(m).alias(m) for m in METRICS)]
    by_lang = own.groupBy("lang").agg(*merged)
    whole = by_lang.groupBy(F.lit(1).alias("one")).agg(*merged).select("one", cutoffs(by_lang).alias("all_cut"))  # no row without documents: an empty sketch has no quantile
    by_lang = by_lang.select(F.col("lang").alias("of_lang"), F.col("docs").alias("lang_docs"), cutoffs(by_lang).alias("lang_cut"))
    groups = own.select("lang", "source", "docs", cutoffs(own).alias("cut"), F.lit(1).alias("one"))
    best = F.when(F.col("docs") >= min_docs, F.col("cut")).when(F.col("lang_docs") >= min_docs, F.col("lang_cut")).otherwise(F.col("all_cut"))
    return groups.join(by_lang, F.expr("lang <=> of_lang")).join(whole, "one").select("lang", "source", "docs", best.alias("cut"))


def judged(df: DataFrame, of: str, cuts: DataFrame, into: str) -> DataFrame:
    """df of measured() with into: false for base_failed, or a metric above its group's cut-off."""
    lang, source = unused(df, "_lang"), unused(df, "_source")
    cut = unused(df, "_cut")
    own = cuts.select(F.col("lang").alias(lang), F.col("source").alias(source), F.col("cut").alias(cut))
    over = " OR ".join(f"coalesce({of}.{m} > {cut}.{m}, false)" for m in METRICS)
    out = df.join(own, F.expr(f"lang <=> {lang} AND source <=> {source}"), "left")
    return out.withColumn(into, F.expr(f"NOT {of}.base_failed AND NOT ({over})")).drop(lang, source, cut)


def rated(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, measures, metrics, base_failed and kept of every document; texts are read once."""
    df = written(measured(docs.select("doc_id", "lang", "source", "text"), "m").drop("text"))
    return judged(df, "m", written(thresholds(sketches(df, "m"))), "kept").select("doc_id", "lang", "source", "m.*", "kept")


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. Measures are taken once for the sketches and once more beside the
    texts: a table of both would be another copy of the corpus on disk until the result is read."""
    own = written(measured(docs.select("doc_id", "lang", "source", "text"), "m").drop("text", "doc_id"))
    cuts = written(thresholds(sketches(own, "m")))
    drop(own)
    of = unused(docs, "_quality")
    df = measured(docs, of)
    kept = unused(df, "_kept")
    return judged(df, of, cuts, kept).where(f"`{kept}`").select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return rated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_sql() -> str:
    """The same rules for DuckDB, with exact quantiles: those of sketches of at most K documents."""
    ws = r"[^\x20\x09-\x0D]"
    metric = ", ".join(f"CAST(CASE WHEN {b} > 0 THEN {a} * 1000 // {b} ELSE 0 END AS BIGINT) AS {m}" for m, (a, b, _) in METRICS.items())

    def cut(name: str, keys: str) -> str:
        each = ", ".join(f"quantile_disc({m}, {UPPER}) + greatest({SPREAD} * (quantile_disc({m}, {UPPER}) - quantile_disc({m}, 0.5)), {least}) AS {m}" for m, (_, _, least) in METRICS.items())
        return f"{name} AS (SELECT {keys}{', ' if keys else ''}count(*) AS docs, {each} FROM shares WHERE NOT base_failed {'GROUP BY ' + keys if keys else ''})"

    best = ", ".join(f"CASE WHEN own.docs >= {MIN_DOCS} THEN own.{m} WHEN by_lang.docs >= {MIN_DOCS} THEN by_lang.{m} ELSE whole.{m} END AS {m}" for m in METRICS)
    over = " OR ".join(f"coalesce(s.{m} > c.{m}, false)" for m in METRICS)
    return f"""WITH split AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{ws}+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{ws}')) AS lines FROM documents),
 windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) > 2)),
 twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
 repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
 counted AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM split LEFT JOIN repeats USING (doc_id)),
 shares AS (SELECT *, {metric}, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counted),
 {cut('own', 'lang, source')}, {cut('by_lang', 'lang')}, {cut('whole', '')},
 cuts AS (SELECT own.lang, own.source, {best} FROM own JOIN by_lang ON own.lang IS NOT DISTINCT FROM by_lang.lang CROSS JOIN whole)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT ({over})) AS kept FROM shares s LEFT JOIN cuts c ON s.lang IS NOT DISTINCT FROM c.lang AND s.source IS NOT DISTINCT FROM c.source"""
