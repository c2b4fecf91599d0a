"""Tables made by rule from a seed: the same rows on every run, however they are partitioned.

``stream`` is a linear congruential generator that a row can enter anywhere: a step is x -> a x + c, and so is any number of
steps, with other factors; those of 1, 2, 4, 8... steps are a short table, of which a position takes the ones of its bits. So
every partition goes on with the one sequential stream.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import TYPES


def draw(seed: int, *parts: Column | str) -> Column:
    """A number from 0 to below 1 that depends on the seed and the parts only: 32 bits of MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text.cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def usage_events(spark: SparkSession, users: int, days: int, last: date, seed: int = 42, per_day: int = 3) -> DataFrame:
    """event_id, user_id, day, hour, sensitive: up to ``per_day`` events of each user and weekday."""
    grid = spark.range(users * days * per_day).select("id", (F.col("id") % users).alias("user_id"), (F.floor(F.col("id") / users) % days).cast("int").alias("back"))
    dated = grid.withColumn("day", F.date_sub(F.lit(last), F.col("back"))).where(F.weekday("day") < 5)
    some = dated.where(draw(seed, F.lit("has"), "id") < 0.7)
    return some.select(F.col("id").alias("event_id"), "user_id", "day", (9 + F.floor(draw(seed, F.lit("hour"), "id") * 9)).cast("int").alias("hour"), (draw(seed, F.lit("sensitive"), "id") < 0.4).alias("sensitive"))


def usage_detections(events: DataFrame, seed: int = 42, most: int = 4) -> DataFrame:
    """event_id, type, amount of the sensitive events: each type at most once an event."""
    kinds = F.array(*map(F.lit, TYPES))
    picked = events.where("sensitive").select("event_id", F.explode(F.sequence(F.lit(1), (1 + F.floor(draw(seed, F.lit("kinds"), "event_id") * most)).cast("int"))).alias("n"))
    kind = F.element_at(kinds, (1 + F.floor(draw(seed, F.lit("type"), "event_id", "n") * len(TYPES))).cast("int"))
    rows = picked.select("event_id", kind.alias("type"), (1 + F.floor(draw(seed, F.lit("amount"), "event_id", "n") * 20)).cast("long").alias("amount"))
    return rows.groupBy("event_id", "type").agg(F.max("amount").alias("amount"))


#: Factor, addend and bits of the state. Fixed values.
FACTOR, ADDEND, STATE_BITS = 1103515245, 12345, 31
POSITION_BITS = 48


def stream(position: Column, seed: int = 42) -> Column:
    """State after so many steps from the seed, from 0 to below 2 ** ``STATE_BITS``."""
    size = 1 << STATE_BITS
    a, c, steps = FACTOR, ADDEND, []
    for _ in range(POSITION_BITS):
        steps.append((a, c))
        a, c = a * a % size, (a * c + c) % size
    table = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c"), F.lit(1 << k).cast("long").alias("bit")) for k, (a, c) in enumerate(steps)])
    taken = F.filter(table, lambda s: position.cast("long").bitwiseAND(s["bit"]) != 0)
    return F.aggregate(taken, F.lit(seed % size).cast("long"), lambda x, s: (s["a"] * x + s["c"]) % size)


FIRST = ("Azucena", "Bruno", "Carla", "Darío", "Elena", "Fabián", "Gloria", "Hernán", "Irene", "Joaquín", "Karina", "Leandro")
LAST = ("Aguirre", "Bustos", "Cáceres", "Duarte", "Escobar", "Funes", "Godoy", "Herrera", "Ibarra", "Juárez", "Ledesma", "Molina", "Navarro", "Ojeda")
#: Numbers that a person takes from the stream.
DRAWS = 4


def people(rows: DataFrame, position: str, seed: int = 42) -> DataFrame:
    """``rows`` with the made-up person of their position (from 0): name, dni, amount. Positions tell what is drawn, so any
    order and partitioning of rows gives the same persons as drawing them one after another."""
    size = 1 << STATE_BITS
    drawn = rows.withColumn("sv_x", F.transform(F.sequence(F.lit(1), F.lit(DRAWS)), lambda k: stream(F.col(position) * DRAWS + k, seed)))
    below = lambda k, n: F.expr(f"(sv_x[{k}] * {n}L) div {size}L")
    pick = lambda k, of: F.element_at(F.array(*map(F.lit, of)), (below(k, len(of)) + 1).cast("int"))
    return drawn.withColumns({"name": F.concat(pick(0, FIRST), F.lit(" "), pick(1, LAST)), "dni": below(2, 39_000_000) + 10_000_000, "amount": below(3, 2_000_000) + 300_000}).drop("sv_x")


def annotated(persons: DataFrame, case: str) -> DataFrame:
    """(case, text): a marked sentence about each person, from which ``writers.training_examples`` makes examples."""
    dni = F.regexp_replace(F.col("dni").cast("string"), r"^(\d{2})(\d{3})(\d{3})$", "$1.$2.$3")
    parts = ("La Sra. [[NOMBRE_PERSONA|", F.col("name"), "]], DNI [[DNI|", dni, "]], cobra un sueldo de [[SALARIO|$ ", F.col("amount").cast("string"), "]] por mes")
    return persons.select(case, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("text"))
