"""Charts and comparisons over orders and line items; money is summed as decimals so that results agree to the cent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import parse_date, parse_number
from ..operators import charts as C
from .base import Query, register, table

CHARTS: dict[str, Query] = {}


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a table of a user: date, price in whole cents, priority, row."""
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("_row"), F.to_date("o_orderdate").alias("Fecha"), cents.cast("double").alias("Monto"), F.col("o_orderpriority").alias("Prioridad"), F.col("o_orderstatus").alias("Estado"))


def brands(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("Marca"))
    lines = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("_row"), F.col("l_quantity").alias("Cantidad"))
    return lines.join(parts, "l_partkey")


SALES_SQL = "WITH sales AS (SELECT o_orderkey AS r, o_orderdate::DATE AS d, floor(o_totalprice * 100 + 0.5) AS v, o_orderpriority AS p, o_orderstatus AS s FROM orders) "
BRANDS_SQL = "WITH brands AS (SELECT p_brand AS b, l_quantity AS v, l_orderkey * 8 + l_linenumber AS r FROM lineitem JOIN part ON p_partkey = l_partkey), "
MONTH_LABEL = "['ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sept', 'oct', 'nov', 'dic'][month({0})] || ' ' || strftime({0}, '%y')"


@register(CHARTS, SALES_SQL + f""", folded AS (SELECT make_date(1995 + year(d) % 3, quarter(d) * 3 - 2, 1) AS d, v FROM sales)
SELECT strftime(m, '%Y-%m') AS key, {MONTH_LABEL.format("m")} AS label, coalesce((SELECT sum(v) FROM folded WHERE d = m), 0.0)::DOUBLE AS value
FROM (SELECT unnest(generate_series((SELECT min(d) FROM folded), (SELECT max(d) FROM folded), INTERVAL 1 MONTH))::DATE AS m)""")  # fmt: skip
def chart_monthly_gapfill(spark: SparkSession, sf: str) -> DataFrame:
    """All orders, dated by the first day of their quarter and with the years folded onto three: two months of each
    quarter have no sales."""
    d = F.col("Fecha")
    folded = sales(spark, sf).withColumn("Fecha", F.make_date(1995 + F.year(d) % 3, F.quarter(d) * 3 - 2, F.lit(1)))
    return C.time_chart(folded, "Fecha", "Monto", C.SUM)


@register(CHARTS, SALES_SQL + "SELECT strftime(d, '%Y') AS key, strftime(d, '%Y') AS label, count(*)::DOUBLE AS value FROM sales GROUP BY 1")
def chart_yearly_count(spark: SparkSession, sf: str) -> DataFrame:
    return C.time_chart(sales(spark, sf), "Fecha", None, C.COUNT)


RANK_SQL = "g AS (SELECT b, {agg} AS value, min(r) AS r FROM brands GROUP BY b), k AS (SELECT *, row_number() OVER (ORDER BY value DESC, r) AS rank FROM g) SELECT rank::INTEGER AS rank, b AS label, value FROM k WHERE rank <= 10"


@register(CHARTS, BRANDS_SQL + RANK_SQL.format(agg="sum(v)") + " UNION ALL SELECT 11, 'Otras (' || count(*)::VARCHAR || ')', sum(value) FROM k WHERE rank > 10 HAVING count(*) > 0")
def chart_top10_other(spark: SparkSession, sf: str) -> DataFrame:
    return C.ranking_chart(brands(spark, sf), "Marca", "Cantidad", C.SUM, "_row")


@register(CHARTS, BRANDS_SQL + RANK_SQL.format(agg="sum(v) / count(*)"))
def chart_avg_top10(spark: SparkSession, sf: str) -> DataFrame:
    return C.ranking_chart(brands(spark, sf), "Marca", "Cantidad", C.AVERAGE, "_row")


@register(CHARTS, SALES_SQL + "SELECT count(*) AS count, sum(v) AS total, sum(v) / count(*) AS average, max(v) AS max_value, arg_max(r, (v, -r)) AS max_row, min(v) AS min_value, arg_min(r, (v, r)) AS min_row FROM sales")
def numeric_summary(spark: SparkSession, sf: str) -> DataFrame:
    return C.numeric_summary(sales(spark, sf), "Monto", "_row")


@register(CHARTS, SALES_SQL + """, m AS (SELECT strftime(d, '%Y') AS k, sum(v) AS v FROM sales GROUP BY 1)
SELECT min(k) AS from_key, arg_min(v, k) AS from_value, max(k) AS to_key, arg_max(v, k) AS to_value, (arg_max(v, k) - arg_min(v, k)) / abs(arg_min(v, k)) * 100 AS pct FROM m""")  # fmt: skip
def variation_first_last(spark: SparkSession, sf: str) -> DataFrame:
    return C.variation(C.time_chart(sales(spark, sf), "Fecha", "Monto", C.SUM))


@register(CHARTS, """
SELECT idx, header, count(*) AS filled, count(DISTINCT lower(v)) AS distinct_values, kind, money FROM (
  SELECT unnest([0, 1, 2, 3, 4]) AS idx, unnest(['o_orderkey', 'Fecha', 'Monto total', 'Prioridad', 'cliente id']) AS header,
    unnest([o_orderkey::VARCHAR, o_orderdate::DATE::VARCHAR, o_totalprice::VARCHAR, o_orderpriority, o_custkey::VARCHAR]) AS v,
    unnest(['numero', 'fecha', 'numero', 'categoria', 'otro']) AS kind, unnest([false, false, true, false, false]) AS money FROM orders)
GROUP BY idx, header, kind, money""")  # fmt: skip
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("Fecha"), F.col("o_totalprice").alias("Monto total"), F.col("o_orderpriority").alias("Prioridad"), F.col("o_custkey").alias("cliente id"))
    return C.kind_of(C.profile_stats(o, o.columns)).select("idx", "header", "filled", "distinct_values", "kind", "money")


@register(CHARTS, "SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1")
def category_options(spark: SparkSession, sf: str) -> DataFrame:
    return C.category_options(sales(spark, sf), "Prioridad", "_row")


@register(CHARTS, "SELECT DISTINCT strftime(o_orderdate, '%Y') AS key, strftime(o_orderdate, '%Y') AS label FROM orders")
def period_options(spark: SparkSession, sf: str) -> DataFrame:
    return C.period_options(sales(spark, sf), "Fecha")


@register(CHARTS, SALES_SQL + """SELECT p AS label, coalesce(sum(v) FILTER (year(d) = 1996), 0.0) AS a, coalesce(sum(v) FILTER (year(d) = 1997), 0.0) AS b FROM sales GROUP BY p HAVING a <> 0 OR b <> 0""")
def compare_periods(spark: SparkSession, sf: str) -> DataFrame:
    return C.compare_periods(sales(spark, sf), "Fecha", "1996", "1997", "Monto", C.SUM, "Prioridad", "_row")


@register(CHARTS, SALES_SQL + """SELECT strftime(d, '%Y') AS key, strftime(d, '%Y') AS label, coalesce(sum(v) FILTER (s = 'F') / count(*) FILTER (s = 'F'), 0.0) AS a, coalesce(sum(v) FILTER (s = 'O') / count(*) FILTER (s = 'O'), 0.0) AS b FROM sales GROUP BY 1""")
def compare_categories(spark: SparkSession, sf: str) -> DataFrame:
    return C.compare_categories(sales(spark, sf), "Estado", "f", "O", "Fecha", "Monto", C.AVERAGE)


@register(CHARTS, SALES_SQL + """SELECT a AS total_a, b AS total_b, (b - a) / abs(a) * 100 AS pct FROM (SELECT sum(v) FILTER (s = 'F') AS a, sum(v) FILTER (s = 'O') AS b FROM sales)""")
def compare_totals(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("Estado")
    return C.compare(sales(spark, sf), "Monto", C.SUM, s == "F", s == "O")


@register(CHARTS, """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN c::DOUBLE / 100 WHEN 1 THEN c::DOUBLE / 100 WHEN 2 THEN c::DOUBLE WHEN 3 THEN (c // 100)::DOUBLE WHEN 4 THEN NULL ELSE (c % 1000)::DOUBLE END AS n
FROM (SELECT o_orderkey, floor(o_totalprice * 100 + 0.5)::BIGINT AS c FROM orders)""")  # fmt: skip
def parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Prices written in six ways, among them no number at all, read back."""
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    english = F.format_number(cents.cast("decimal(20,2)") / 100, 2)
    local = F.translate(english, ",.", ".,")
    k = F.col("o_orderkey") % 6
    whole = F.translate(F.format_number(F.floor(cents / 100), 0), ",", ".")
    text = F.when(k == 0, F.concat(F.lit("$ "), local)).when(k == 1, english).when(k == 2, cents.cast("string")).when(k == 3, F.concat(F.lit("u$s "), whole)).when(k == 4, F.concat(local, F.lit(" unidades"))).otherwise(F.concat((cents % 1000).cast("string"), F.lit("%")))
    return table(spark, sf, "orders").select("o_orderkey", parse_number(text).alias("n"))


@register(CHARTS, """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate)) ELSE o_orderdate::DATE END AS d FROM orders""")
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written in three ways, and impossible ones. Years of two digits are read as of this century."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "d-M-yy")).otherwise(F.date_format(d, "31/02/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", parse_date(text).alias("d"))
