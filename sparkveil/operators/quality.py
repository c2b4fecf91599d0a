"""Detection quality: annotated texts, matching, precision, recall, F1, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import matches

MARKUP = r"\[\[([A-Z_]+)\|([^\]]*)\]\]"


def parse_annotated(cases: DataFrame, case: str = "case_id", markup: str = "text") -> DataFrame:
    """'... [[TYPE|value]] ...' -> (case, text, gold: array<type,start,end,value>), offsets in the plain text."""
    found = matches(F.col(markup), MARKUP)

    def step(acc: Column, x: Column) -> Column:
        kind, value = F.regexp_extract(x["m"], MARKUP, 1), F.regexp_extract(x["m"], MARKUP, 2)
        start = x["at"] - acc["cut"]
        gold = F.struct(kind.alias("type"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))
        return F.struct((acc["cut"] + F.length(x["m"]) - F.length(value)).alias("cut"), F.concat(acc["out"], F.array(gold)).alias("out"))

    none = F.array().cast("array<struct<type:string,start:int,end:int,value:string>>")
    gold = F.aggregate(found, F.struct(F.lit(0).alias("cut"), none.alias("out")), step, lambda acc: acc["out"])
    return cases.select(F.col(case), F.regexp_replace(F.col(markup), MARKUP, "$2").alias("text"), gold.alias("gold"))


def covers_half(p: Column, g: Column) -> Column:
    """Same type, and the overlap is at least half of each."""
    overlap = F.least(p["end"], g["end"]) - F.greatest(p["start"], g["start"])
    return (p["type"] == g["type"]) & (overlap * 2 >= g["end"] - g["start"]) & (overlap * 2 >= p["end"] - p["start"])


def outcomes(cases: DataFrame, case: str = "case_id", gold: str = "gold", predicted: str = "spans") -> DataFrame:
    """One row per gold span and unmatched prediction: case, type, value, outcome (tp, fn, fp). A gold span takes the
    first matching prediction that no earlier one took."""
    preds, golds = F.col(predicted), F.col(gold)

    def step(acc: Column, g: Column) -> Column:
        free = lambda i: ~F.array_contains(acc["used"], i) & covers_half(F.get(preds, i), g)
        places = F.when(F.size(preds) > 0, F.sequence(F.lit(0), F.size(preds) - 1)).otherwise(F.array().cast("array<int>"))
        hit = F.get(F.filter(places, free), F.lit(0))
        row = F.struct(g["type"].alias("type"), g["value"].alias("value"), F.when(hit.isNull(), "fn").otherwise("tp").alias("outcome"))
        return F.struct(F.when(hit.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(hit))).alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<type:string,value:string,outcome:string>>").alias("out"))
    matched = cases.select(case, preds.alias("sv_p"), F.aggregate(golds, start, step).alias("sv_m"))
    left = F.filter(F.transform("sv_p", lambda p, i: F.struct(p["type"].alias("type"), p["value"].alias("value"), F.when(F.array_contains(F.col("sv_m.used"), i), "").otherwise("fp").alias("outcome"))), lambda x: x["outcome"] == "fp")
    return matched.select(case, F.explode(F.concat(F.col("sv_m.out"), left)).alias("x")).select(case, "x.*")


def scores(counted: DataFrame) -> DataFrame:
    """``counted`` (tp, fp, fn) with precision and recall (1 on empty denominators) and F1 (0)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counted.withColumn("precision", F.when(tp + fp == 0, 1.0).otherwise(tp / (tp + fp))).withColumn("recall", F.when(tp + fn == 0, 1.0).otherwise(tp / (tp + fn)))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def metrics(found: DataFrame, by: list[str] = ["type"]) -> DataFrame:
    counts = found.groupBy(*by).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")])
    return scores(counts)


def mistakes_between(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new mistakes, mistakes that are gone) of two detectors on the same cases."""
    wrong = lambda d: d.where("outcome <> 'tp'")
    return wrong(new).exceptAll(wrong(old)), wrong(old).exceptAll(wrong(new))


def sweep(scored: DataFrame, positives: DataFrame, thresholds: list[float], label: str = "label") -> DataFrame:
    """Per label and threshold, tp/fp/fn/F1 of scored spans (label, score, correct); ``positives`` has (label, n).

    The thresholds are a short literal list: every span is exploded over those it passes.
    """
    passed = F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("score") >= t)
    hits = scored.select(label, "correct", F.explode(passed).alias("threshold")).groupBy(label, "threshold").agg(F.count_if("correct").alias("tp"), F.count_if(~F.col("correct")).alias("fp"))
    grid = positives.select(label, "n", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return scores(grid.join(hits, [label, "threshold"], "left").select(label, "threshold", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"), (F.col("n") - F.coalesce("tp", F.lit(0))).alias("fn")))


def best_thresholds(swept: DataFrame, label: str = "label") -> DataFrame:
    """Of equal F1 the highest threshold."""
    return swept.groupBy(label).agg(F.max_by("threshold", F.struct("f1", "threshold")).alias("threshold"), F.max("f1").alias("f1"))


def upper_median(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The element at floor(n / 2) of the sorted values, and the largest, per group."""
    low = rows.groupBy(*by).agg(F.count(column).alias("n"), F.max(column).alias("largest"), F.expr(f"percentile_disc(0.5) within group (order by `{column}`)").alias("low"))
    v = F.col(column)
    # an even number of values has its upper median one place further: the next larger value, if no more equal the lower
    near = rows.join(low, by).groupBy(*by, "n", "largest", "low").agg(F.count_if(v <= F.col("low")).alias("le"), F.min(F.when(v > F.col("low"), v)).alias("next"))
    further = (F.col("n") % 2 == 0) & (F.col("le") * 2 == F.col("n"))
    return near.select(*by, F.when(further, F.col("next")).otherwise(F.col("low")).alias("median"), "largest")


def training_statistics(cases: DataFrame, text: str = "text", gold: str = "gold") -> DataFrame:
    """One row of a training set: cases, those without a span, mean words, and spans by type as a map."""
    words = F.size(F.regexp_extract_all(F.col(text), F.lit(r"\\S+"), F.lit(0)))
    base = cases.agg(F.count("*").alias("n_cases"), F.count_if(F.size(gold) == 0).alias("n_negative"), F.avg(words).alias("mean_words"))
    kinds = cases.select(F.explode(gold).alias("s")).groupBy("s.type").agg(F.count("*").alias("n"))
    return base.crossJoin(F.broadcast(kinds.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_type"))))  # one row
