"""License scans by ordered signature rules (native: DataFrame functions only).

A text is lower-cased (A-Z) and scanned by the rules whose keywords it holds, with white space made one blank; a text that
holds none of the first is not scanned. Detections are spans. Runs of spans that overlap are resolved by themselves: from
the strongest priority on, then from long to short and from left to right, a span stays unless it lies in one that
stays, or overlaps one that stays and has a stronger priority; so what one span suppresses does not depend on spans that
go themselves. Labels of spans that stay are added to those of the base phrases, which are looked up word by word. The
score is the largest weight of what was found.

Nulls: a null text is empty: no words, no labels, empty label strings, score 0, null positions. Repeated rows and null
ids stay. Extra columns are ignored. Texts of any length are scanned whole; the cost of a match does not grow with the text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES, Rule
from .quality import once, without
from .shared import lower_az, table

#: What parts words, of text as it is and in lower case.
_PARTS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
BASE_WEIGHT = 0.8
GATES = {k for r in RULES for k in r.gate}
GATES = sorted(k for k in GATES if not any(x in k for x in GATES - {k}))


def flat(text: Column) -> Column:
    """text with each run of what patterns take for white space as one blank."""
    return F.regexp_replace(without(text, "\t\n\x0b\f\r", " "), "  +", " ")


_SPAN = "struct<start:int,back:int,priority:int,label:string,weight:double>"


def rule_table(rules: list[Rule]) -> Column:
    """The rules by keywords, as one constant: array of g, k (keyword sets) and r (pattern, label, priority, weight)."""
    by_key: dict[tuple, list] = {}
    for r in rules:
        by_key.setdefault((r.gate, r.keyword), []).append({"p": r.pattern, "l": r.label, "o": r.priority, "w": r.weight})
    rows = [{"g": g, "k": k, "r": rs} for (g, k), rs in sorted(by_key.items(), key=lambda x: x[0])]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<g:array<string>,k:array<string>,r:array<struct<p:string,l:string,o:int,w:double>>>>")


#: Elements that are folded at a time.
CHUNK = 64


def before(values: Column, fold, plus) -> Column:
    """For each of an array's numbers the fold of all before it, from folds of whole chunks: aggregate() copies what it
    has so far at every step, so an array must not grow in it."""
    where = lambda i: F.floor(i / CHUNK).cast("int")
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def of(xs: Column) -> Column:
        whole = F.transform(numbers(F.ceil(F.size(xs) / CHUNK).cast("int")), lambda c: fold(F.slice(xs, c * CHUNK + 1, F.lit(CHUNK))))
        start = lambda sums: F.transform(numbers(F.size(sums)), lambda c: fold(F.slice(sums, F.lit(1), c)))
        own = lambda starts: F.transform(xs, lambda x, i: plus(F.get(starts, where(i)), fold(F.slice(xs, where(i) * CHUNK + 1, i % CHUNK))))
        return once(once(whole, start), own)

    return once(values, of)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _max(xs: Column) -> Column:
    return F.coalesce(F.array_max(xs), F.lit(0))


def spans(text: Column) -> Column:
    """Sorted spans of all matches of rules whose keywords text holds; back is the end, negative."""
    rules = rule_table(RULES)
    holds = lambda keys, t: F.exists(keys, lambda k: F.contains(t, k))
    asked = once(flat(text), lambda t: F.flatten(F.transform(F.filter(rules, lambda x: holds(x["g"], t) & holds(x["k"], t)), lambda x: x["r"])))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def placed(found: Column, between: Column) -> Column:
        lengths = F.transform(found, lambda x, i: F.length(F.get(between, i)) + F.length(x))
        place = lambda x, at: F.struct((at - F.length(x)).alias("start"), at.alias("end"))
        ends = lambda n: F.zip_with(before(n, _sum, lambda x, y: x + y), n, lambda x, y: x + y)
        return F.zip_with(found, once(lengths, ends), place)

    def matches(r: Column) -> Column:
        # what a rule finds and what stands between are taken once, not once a match
        some = lambda found: F.when(F.size(found) > 0, once(F.split(text, r["p"], -1), lambda between: placed(found, between))).otherwise(none)
        return once(F.regexp_extract_all(text, r["p"], F.lit(0)), some)

    each = F.transform(asked, lambda r: F.transform(matches(r), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), r["o"].alias("priority"), r["l"].alias("label"), r["w"].alias("weight"))))
    return F.sort_array(F.flatten(each))


def resolved(found: Column) -> Column:
    """The spans that stay of a sorted array of spans(), sorted."""
    none = F.array().cast(f"array<{_SPAN}>")
    def cut(xs: Column, past: Column) -> Column:
        """Runs of spans, each of which begins before an earlier one of its run ends."""
        firsts = F.filter(F.transform(xs, lambda x, i: F.when(x["start"] >= F.get(past, i), i)), lambda i: i.isNotNull())
        return once(firsts, lambda at: F.transform(at, lambda i, k: F.slice(xs, i + 1, F.coalesce(F.get(at, k + 1), F.size(xs)) - i)))

    runs = once(found, lambda xs: once(before(F.transform(xs, lambda x: -x["back"]), _max, F.greatest), lambda past: cut(xs, past)))

    def kept(run: Column) -> Column:
        ranked = F.array_sort(run, lambda x, y: _order([x["priority"], x["start"] + x["back"], x["start"], x["label"]], [y["priority"], y["start"] + y["back"], y["start"], y["label"]]))
        lies = lambda x, k: (x["start"] >= k["start"]) & (x["back"] >= k["back"])
        meets = lambda x, k: (x["start"] < -k["back"]) & (-x["back"] > k["start"])
        goes = lambda a, x: F.exists(a, lambda k: lies(x, k) | (meets(x, k) & (k["priority"] < x["priority"])))
        return F.aggregate(ranked, none, lambda a, x: F.when(goes(a, x), a).otherwise(F.concat(a, F.array(x))))

    return F.sort_array(F.flatten(F.transform(runs, lambda run: F.when(F.size(run) > 1, kept(run)).otherwise(run))))


def _order(x: list[Column], y: list[Column]) -> Column:
    out = F.lit(0)
    for a, b in reversed(list(zip(x, y))):
        out = F.when(a < b, -1).when(a > b, 1).otherwise(out)
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans, a row per row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("_text"))
    # lower() changes at least A-Z, so it holds each keyword that the text in lower A-Z holds
    some = " OR ".join(f'contains(_any, "{k}")' for k in GATES)
    df = df.withColumn("_any", flat(F.lower("_text"))).withColumn("_gate", F.expr(some)).withColumn("_licensed", F.expr("contains(_any, 'license')"))
    low = lower_az(F.col("_text"))
    words = F.array_remove(F.split(low, f"[{_PARTS}]+"), "")

    def base(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(w) - 1), lambda i: (F.get(w, i) == "license") & (F.get(w, i - 1).isin("mit", "apache") | ((F.get(w, i - 1) == "public") & (i > 1) & (F.get(w, F.greatest(i - 2, F.lit(0))) == "general"))))
        place = lambda i: F.struct((F.when(F.get(w, i - 1) == "public", i - 2).otherwise(i - 1)).cast("long").alias("at"), F.when(F.get(w, i - 1) == "public", F.lit("gpl")).otherwise(F.get(w, i - 1)).alias("label"))
        return F.transform(at, place)

    none = F.array().cast("array<struct<at:bigint,label:string>>")
    nothing = F.array().cast(f"array<{_SPAN}>")
    df = df.withColumn("_base", F.when(F.col("_licensed"), once(words, lambda w: F.when(F.size(w) > 1, base(w)).otherwise(none))).otherwise(none))
    df = df.withColumn("_spans", F.when(F.col("_gate"), once(low, lambda t: resolved(spans(t)))).otherwise(nothing))
    labels = lambda *arrays: F.array_join(F.sort_array(F.array_distinct(F.concat(*arrays))), ",")
    own, more = F.transform("_base", lambda x: x["label"]), F.transform("_spans", lambda x: x["label"])
    return df.select(
        "doc_id",
        F.regexp_count("_text", F.lit(f"[^{_PARTS}]+")).cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["at"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x["at"])).alias("last_word"),
        labels(own).alias("base_labels"),
        labels(own, more).alias("labels"),
        F.greatest(F.when(F.size("_base") > 0, F.lit(BASE_WEIGHT)).otherwise(0.0), F.coalesce(F.array_max(F.transform("_spans", lambda x: x["weight"])), F.lit(0.0))).alias("score"),
        F.transform("_spans", lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["label"].alias("label"), x["weight"].alias("weight"))).alias("spans"),
    )


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).drop("spans")
