"""Profiles, charts and comparisons of a table, by aggregation.

A chart's columns are read once: cells become a key and a measure, and everything after is a grouped aggregate. Only
results bounded by the number of columns or periods reach the driver.

Defined cases: rows whose measure is no number, or whose key is empty, do not count; a gap between periods is 0; an
average over nothing is 0; of labels that differ by case the first (in comparisons the last) in row order is shown.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..functions.numbers import DAY, MONTH, YEAR, change_percent, granularity, parse_date, parse_number, period_key, period_label
from ..functions.text import cell_text, is_empty

# Shares, limits and header words that results are compared by.
MIN_SHARE, TOP, FEW, MANY, MAX_PERIODS = 0.8, 10, 15, 200, 1000
ID_HEADER = r"(?iu)\b(?:dni|cuit|cuil|cbu|cvu|alias|tel[eé]fono|tel|celular|c[oó]digo|cod|id|legajo|cp|c\.p\.|nro|n[uú]mero|factura|comprobante|pedido|orden|tarjeta|patente|a[nñ]o)\b"
MONEY_HEADER = r"(?i)\b(?:monto|importe|precio|total|venta|ventas|saldo|sueldo|salario|costo|cobro|pago|deuda|facturado|ingreso|egreso|gasto)s?\b"
SUM, AVERAGE, COUNT = "suma", "promedio", "conteo"
DATE_KIND, NUMBER_KIND, CATEGORY_KIND, OTHER_KIND = "fecha", "numero", "categoria", "otro"


@dataclass(frozen=True)
class Profile:
    index: int
    header: str
    kind: str
    filled: int
    distinct: int
    money: bool


@dataclass(frozen=True)
class ChartSpec:
    dimension: int
    measure: int | None
    operation: str


def _cell(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.simpleString()
    return cell_text(F.col(f"`{column}`"), kind)


def date_of(df: DataFrame, column: str) -> Column:
    """A date column as it is, text by the accepted formats."""
    kind = df.schema[column].dataType.simpleString()
    return F.to_date(F.col(f"`{column}`")) if kind in ("date", "timestamp", "timestamp_ntz") else parse_date(F.col(f"`{column}`"))


def number_of(df: DataFrame, column: str | None) -> Column:
    if column is None:
        return F.lit(1.0)
    kind = df.schema[column].dataType.simpleString()
    numeric = kind.startswith("decimal") or kind in ("double", "float", "int", "bigint", "smallint", "tinyint")
    return F.col(f"`{column}`").cast("double") if numeric else parse_number(F.col(f"`{column}`"))


def profile_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: idx, header, filled, distinct_values, dates, numbers. One pass over the cells of all columns."""
    cells = [F.struct(F.lit(i).alias("idx"), F.lit(c).alias("header"), _cell(df, c).alias("v"), date_of(df, c).isNotNull().alias("d"), number_of(df, c).isNotNull().alias("n")) for i, c in enumerate(columns)]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("v <> ''")
    values = long.groupBy("idx", "header", F.lower("v").alias("v")).agg(F.count("*").alias("k"), F.count_if("d").alias("d"), F.count_if("n").alias("n"))
    return values.groupBy("idx", "header").agg(F.sum("k").alias("filled"), F.count("*").alias("distinct_values"), F.sum("d").alias("dates"), F.sum("n").alias("numbers"))


def kind_of(stats: DataFrame) -> DataFrame:
    """``stats`` with ``kind`` and ``money``: dates, then numbers (unless the header is an id's), then categories."""
    d, f = F.col("distinct_values"), F.col("filled")
    is_id = F.col("header").rlike(ID_HEADER)
    category = F.when(d < 2, False).when(d <= FEW, d / f <= 0.8).otherwise((d <= MANY) & (d / f <= 0.3))
    kind = (
        F.when(f < 2, OTHER_KIND)
        .when(F.col("dates") / f >= MIN_SHARE, DATE_KIND)
        .when(F.col("numbers") / f >= MIN_SHARE, F.when(is_id, OTHER_KIND).otherwise(NUMBER_KIND))
        .when(~is_id & category, CATEGORY_KIND)
        .otherwise(OTHER_KIND)
    )
    return stats.withColumn("kind", kind).withColumn("money", (F.col("kind") == NUMBER_KIND) & F.col("header").rlike(MONEY_HEADER))


def profile_columns(df: DataFrame, columns: list[str]) -> list[Profile]:
    found = {r["idx"]: r for r in kind_of(profile_stats(df, columns)).collect()}
    return [Profile(i, c, r["kind"], r["filled"], r["distinct_values"], r["money"]) if (r := found.get(i)) else Profile(i, c, OTHER_KIND, 0, 0, False) for i, c in enumerate(columns)]


def main_measure(profiles: list[Profile]) -> Profile | None:
    """The number column that looks like money, else the one with most values."""
    numbers = [p for p in profiles if p.kind == NUMBER_KIND]
    return max(numbers, key=lambda p: (p.money, p.filled, -p.index), default=None)


def suggest_charts(profiles: list[Profile]) -> list[ChartSpec]:
    """Up to four: over the first date, by categories with few values first, and a count."""
    measure = main_measure(profiles)
    m, op = (measure.index, SUM) if measure else (None, COUNT)
    dates = [p for p in profiles if p.kind == DATE_KIND]
    categories = sorted((p for p in profiles if p.kind == CATEGORY_KIND and p.distinct >= 2), key=lambda p: p.distinct)
    wanted = [ChartSpec(p.index, m, op) for p in [*dates[:1], *categories]][:4]
    if len(wanted) < 4 and measure and categories:
        wanted.append(ChartSpec(categories[0].index, None, COUNT))
    return wanted


def _value(operation: str) -> Column:
    return {SUM: F.coalesce(F.sum("v"), F.lit(0.0)), AVERAGE: F.coalesce(F.avg("v"), F.lit(0.0)), COUNT: F.count("v").cast("double")}[operation]


def time_chart(df: DataFrame, date: str, measure: str | None, operation: str) -> DataFrame:
    """key, label, value of every period from the first to the last, at most 1000. The granularity follows the range."""
    dated = df.select(date_of(df, date).alias("d"), number_of(df, measure).alias("v")).where("d is not null and v is not null")
    days = dated.groupBy("d").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    span = days.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).withColumn("g", granularity(F.col("lo"), F.col("hi")))
    unit = F.when(F.col("g") == DAY, "DAY").when(F.col("g") == MONTH, "MONTH").otherwise("YEAR")
    cut = lambda c: F.when(F.col("g") == DAY, F.col(c)).when(F.col("g") == MONTH, F.trunc(c, "month")).otherwise(F.trunc(c, "year"))
    step = {DAY: F.expr("interval 1 day"), MONTH: F.expr("interval 1 month"), YEAR: F.expr("interval 1 year")}
    all_periods = F.when(F.col("g") == DAY, F.sequence(cut("lo"), F.col("hi"), step[DAY])).when(F.col("g") == MONTH, F.sequence(cut("lo"), F.col("hi"), step[MONTH])).otherwise(F.sequence(cut("lo"), F.col("hi"), step[YEAR]))
    spine = span.where("lo is not null").select("g", unit.alias("unit"), F.explode(F.slice(all_periods, 1, MAX_PERIODS)).alias("p"))
    spine = spine.withColumn("key", period_key(F.col("p"), F.col("g"))).withColumn("label", period_label(F.col("p"), F.col("g")))
    # one row of range, so the join below needs no shuffle of the days
    keyed = days.crossJoin(F.broadcast(span.select("g"))).groupBy(period_key(F.col("d"), F.col("g")).alias("key")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    value = {SUM: F.col("s"), AVERAGE: F.col("s") / F.col("n"), COUNT: F.col("n").cast("double")}[operation]
    return spine.join(keyed, "key", "left").select("key", "label", F.coalesce(value, F.lit(0.0)).alias("value")).orderBy("key")


def ranking_chart(df: DataFrame, category: str, measure: str | None, operation: str, row: str, top: int = TOP) -> DataFrame:
    """rank, label, value: the ``top`` groups and the sum of the others as 'Otras (n)', which an average leaves out."""
    cell = F.trim(_cell(df, category))
    rows = df.select(cell.alias("t"), number_of(df, measure).alias("v"), F.col(row).alias("r")).where("t <> '' and v is not null")
    groups = rows.groupBy(F.lower("t").alias("k")).agg(_value(operation).alias("value"), F.min(F.struct("r", "t")).alias("first"))
    flat = groups.select("k", F.col("first.t").alias("label"), F.col("first.r").alias("r"), "value")
    best = flat.orderBy(F.desc("value"), "r", "k").limit(top)
    ranked = best.withColumn("rank", F.row_number().over(Win.orderBy(F.desc("value"), "r", "k")))
    head = ranked.select("rank", "label", "value")
    if operation == AVERAGE:
        return head.orderBy("rank")
    rest = flat.join(F.broadcast(best.select("k")), "k", "left_anti").agg(F.count("*").alias("n"), F.sum("value").alias("value")).where("n > 0")
    other = rest.select(F.lit(top + 1).alias("rank"), F.concat(F.lit("Otras ("), F.col("n").cast("string"), F.lit(")")).alias("label"), "value")
    return head.unionByName(other).orderBy("rank")


def numeric_summary(df: DataFrame, column: str, row: str) -> DataFrame:
    """count, total, average, and the largest and smallest value with the earliest row that holds it."""
    v = df.select(number_of(df, column).alias("v"), F.col(row).alias("r")).where("v is not null")
    out = v.agg(
        F.count("*").alias("count"), F.sum("v").alias("total"), F.avg("v").alias("average"),
        F.max("v").alias("max_value"), F.max_by("r", F.struct("v", (-F.col("r")).alias("n"))).alias("max_row"),
        F.min("v").alias("min_value"), F.min_by("r", F.struct("v", "r")).alias("min_row"),
    )
    return out.where("count > 0")


def variation(points: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """First and last period that are not zero, and the change; no row with less than two."""
    some = points.where(F.col(value) != 0)
    out = some.agg(F.count("*").alias("n"), F.min_by(F.struct(key, value), key).alias("a"), F.max_by(F.struct(key, value), key).alias("b")).where("n >= 2")
    return out.select(F.col(f"a.{key}").alias("from_key"), F.col(f"a.{value}").alias("from_value"), F.col(f"b.{key}").alias("to_key"), F.col(f"b.{value}").alias("to_value"), change_percent(F.col(f"a.{value}"), F.col(f"b.{value}")).alias("pct"))


def table_granularity(df: DataFrame, date: str) -> str:
    """Of a date column's range; one row comes to the driver."""
    lo, hi = df.agg(F.min(date_of(df, date)), F.max(date_of(df, date))).first()
    if lo is None:
        return MONTH
    days = (hi - lo).days
    return DAY if days <= 62 else MONTH if days <= 1098 else YEAR


def period_options(df: DataFrame, date: str) -> DataFrame:
    """Periods with data, in order: key, label."""
    g = F.lit(table_granularity(df, date))
    d = df.select(date_of(df, date).alias("d")).where("d is not null")
    return d.groupBy(period_key(F.col("d"), g).alias("key")).agg(F.min(period_label(F.col("d"), g)).alias("label")).orderBy("key")


def category_options(df: DataFrame, column: str, row: str) -> DataFrame:
    """Values of a category, most frequent first: label, n."""
    t = F.trim(_cell(df, column))
    rows = df.select(t.alias("t"), F.col(row).alias("r")).where("t <> ''")
    return rows.groupBy(F.lower("t").alias("k")).agg(F.min_by("t", "r").alias("label"), F.count("*").alias("n"), F.min("r").alias("r")).orderBy(F.desc("n"), "r").select("label", "n")


def _two(operation: str, side: str) -> Column:
    v = F.when(F.col(f"in_{side}"), F.col("v"))
    return {SUM: F.coalesce(F.sum(v), F.lit(0.0)), AVERAGE: F.coalesce(F.avg(v), F.lit(0.0)), COUNT: F.count(v).cast("double")}[operation]


def compare(df: DataFrame, measure: str | None, operation: str, in_a: Column, in_b: Column) -> DataFrame:
    """total_a, total_b and the change of b against a: one pass, one row."""
    rows = df.select(number_of(df, measure).alias("v"), F.coalesce(in_a, F.lit(False)).alias("in_a"), F.coalesce(in_b, F.lit(False)).alias("in_b")).where("v is not null")
    out = rows.agg(_two(operation, "a").alias("total_a"), _two(operation, "b").alias("total_b"))
    return out.withColumn("pct", change_percent(F.col("total_a"), F.col("total_b")))


def compare_periods(df: DataFrame, date: str, a: str, b: str, measure: str | None, operation: str, by: str, row: str, granularity_: str | None = None, top: int = TOP) -> DataFrame:
    """Two periods by a category: label, a, b of the ``top`` categories with the larger side, rows of two zeros left out."""
    g = F.lit(granularity_ or table_granularity(df, date))
    key = period_key(date_of(df, date), g)
    rows = df.select(F.trim(_cell(df, by)).alias("t"), number_of(df, measure).alias("v"), F.coalesce(key == a, F.lit(False)).alias("in_a"), F.coalesce(key == b, F.lit(False)).alias("in_b"), F.col(row).alias("r"))
    grouped = rows.where("t <> '' and v is not null").groupBy(F.lower("t").alias("k")).agg(_two(operation, "a").alias("a"), _two(operation, "b").alias("b"), F.max_by("t", "r").alias("label"), F.min("r").alias("r"))
    return grouped.where("a <> 0 or b <> 0").orderBy(F.desc(F.greatest("a", "b")), "r").limit(top).select("label", "a", "b")


def compare_categories(df: DataFrame, column: str, a: str, b: str, date: str, measure: str | None, operation: str, granularity_: str | None = None) -> DataFrame:
    """Two values of a category over all periods of the table: key, label, a, b."""
    g = F.lit(granularity_ or table_granularity(df, date))
    d = date_of(df, date)
    t = F.lower(F.trim(_cell(df, column)))
    rows = df.select(period_key(d, g).alias("key"), period_label(d, g).alias("label"), number_of(df, measure).alias("v"), (t == a.lower()).alias("in_a"), (t == b.lower()).alias("in_b")).where("key is not null")
    value = rows.withColumn("in_a", F.col("in_a") & F.col("v").isNotNull()).withColumn("in_b", F.col("in_b") & F.col("v").isNotNull())
    return value.groupBy("key").agg(F.min("label").alias("label"), _two(operation, "a").alias("a"), _two(operation, "b").alias("b")).orderBy("key")


def is_id_header(header: str) -> bool:
    return re.search(ID_HEADER.replace("(?iu)", "(?i)"), header) is not None


def describe_rows(summary: DataFrame, df: DataFrame, row: str, category: str | None = None, date: str | None = None) -> DataFrame:
    """``numeric_summary`` with the category and date of the rows that hold the largest and the smallest value."""
    none = F.lit(None).cast("string")
    facts = df.select(F.col(row).alias("sv_row"), (F.trim(_cell(df, category)) if category else none).alias("c"), (date_of(df, date).cast("string") if date else none).alias("d"))
    out = summary
    for side in ("max", "min"):
        own = facts.select(F.col("sv_row").alias(f"{side}_row"), F.col("c").alias(f"{side}_category"), F.col("d").alias(f"{side}_date"))
        out = own.join(F.broadcast(out), f"{side}_row", "right")  # the summary is one row
    return out
