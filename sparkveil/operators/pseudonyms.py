"""Consistent pseudonyms by joins and aggregation.

A value gets ``Prefix_NN`` by the order in which its key first occurs in its scope. A lone surname or given name means
the only full name known so far that holds the word; with none or with several it is a value of its own. Because the
number of full names that hold a word only grows, the full name is unique exactly between the first and the second one
that holds it, so this needs no sequential registry: two minima per word decide.

Defined cases: what is already a pseudonym or a marker stays as it is and takes no number; null and empty values take
none either; equal keys of several types in one prefix share a number; ties of the order must not occur within a scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..functions.text import equivalence_key, is_protected, name_words
from ..storage import materialize

#: Slices of one long numbering; results do not depend on it.
SLICES = 64


def code(prefix: Column, number: Column) -> Column:
    """Prefix_07, Prefix_123."""
    return F.concat(prefix, F.lit("_"), F.when(number < 10, F.concat(F.lit("0"), number.cast("string"))).otherwise(number.cast("string")))


def number_rows(rows: DataFrame, groups: list[str], order: list[str], out: str, slices: int = SLICES) -> DataFrame:
    """1, 2, 3... within ``groups`` by ``order``, also where one group holds most rows.

    The first order column is cut at approximate quantiles; rows are numbered within a slice, and a slice starts after
    the rows of those before it. Rows with one value of that column share a slice. The cuts are written before they are
    used: approximate quantiles differ with the order in which executors' parts arrive, and sizes and numbers must be of
    the same slices.
    """
    share = [k / slices for k in range(1, slices)]
    cuts = rows.groupBy(*groups).agg(F.percentile_approx(F.col(order[0]), F.array(*map(F.lit, share)), F.lit(10_000)).alias("sv_cuts"))
    cuts = materialize(cuts)
    cut = rows.join(cuts, groups).withColumn("sv_slice", F.size(F.filter(F.array_distinct("sv_cuts"), lambda x: x < F.col(order[0])))).drop("sv_cuts")
    sizes = cut.groupBy(*groups, "sv_slice").agg(F.count("*").alias("sv_n"))
    before = Win.partitionBy(*groups).orderBy("sv_slice").rowsBetween(Win.unboundedPreceding, -1)
    starts = sizes.withColumn("sv_start", F.coalesce(F.sum("sv_n").over(before), F.lit(0))).drop("sv_n")
    own = F.row_number().over(Win.partitionBy(*groups, "sv_slice").orderBy(*order))
    return cut.withColumn("sv_own", own).join(starts, [*groups, "sv_slice"]).withColumn(out, (F.col("sv_start") + F.col("sv_own")).cast("long")).drop("sv_slice", "sv_own", "sv_start")


def keyed(occurrences: DataFrame, order: list[str], kind: str = "type", raw: str = "raw") -> DataFrame:
    """Occurrences to number: with ``key``, ``ord`` (struct of the order), ``word`` (of a lone name) and ``full`` words."""
    words = F.filter(F.array_distinct(name_words(F.col(raw))), lambda w: F.length(w) >= 4)
    is_name = F.col(kind) == "NOMBRE_PERSONA"
    all_words = name_words(F.col(raw))
    lone = is_name & (F.size(all_words) == 1) & (F.length(all_words[0]) >= 4)
    fine = occurrences.where(F.col(raw).isNotNull() & (F.col(raw) != "") & ~is_protected(F.col(raw)))
    return fine.select(
        "*",
        equivalence_key(F.col(kind), F.col(raw)).alias("key"),
        F.struct(*order).alias("ord"),
        F.when(lone, all_words[0]).alias("word"),
        F.when(is_name & (F.size(all_words) >= 2), words).alias("full"),
    )


def equivalences(occurrences: DataFrame, order: list[str], scope: list[str] = [], kind: str = "type", raw: str = "raw", prefix: str = "prefix") -> tuple[DataFrame, DataFrame]:
    """(rows, targets): the table scope..., prefix, number, pseudonym, original, key, and for every key with a lone name
    what it stands for before ``since``: (scope..., prefix, key, since, before_key)."""
    at = [*scope, prefix]
    occ = keyed(occurrences, order, kind, raw)
    keys = occ.groupBy(*at, "key").agg(F.min("ord").alias("first"), F.min_by(raw, "ord").alias("original"), F.max("word").alias("word"), F.bool_and(F.col("word").isNotNull()).alias("lone"), F.min_by("full", "ord").alias("full"))
    full = keys.where(~F.col("lone"))
    index = full.select(*at, "key", "first", F.explode("full").alias("word"))
    one = index.groupBy(*at, "word").agg(F.min(F.struct("first", "key")).alias("one"))
    two = index.join(one, [*at, "word"]).where(F.col("first") > F.col("one.first")).groupBy(*at, "word").agg(F.min("first").alias("t2"))
    spans = one.join(two, [*at, "word"], "left").select(*at, "word", F.col("one.first").alias("t1"), F.col("one.key").alias("owner"), "t2")
    lone_keys = keys.where("lone").select(*at, "key", "word")
    lone = occ.where(F.col("word").isNotNull()).select(*at, "key", "ord", raw).join(lone_keys, [*at, "key"]).join(spans, [*at, "word"], "left")
    known = F.coalesce((F.col("ord") > F.col("t1")) & (F.col("t2").isNull() | (F.col("ord") < F.col("t2"))), F.lit(False))
    own = F.when(~known, F.col("ord"))
    since = lone.groupBy(*at, "key").agg(F.min(own).alias("since"), F.min_by(raw, own).alias("original"), F.first("owner").alias("before_key"))
    rows = full.select(*at, "key", "original", F.col("first").alias("since")).unionByName(since.where(F.col("since").isNotNull()).select(*at, "key", "original", "since"))
    flat = rows.select(*at, "key", "original", *[F.col(f"since.{c}").alias(f"sv_o{i}") for i, c in enumerate(order)])
    flat_order = [f"sv_o{i}" for i in range(len(order))]
    if scope:
        numbered = flat.withColumn("number", F.row_number().over(Win.partitionBy(*at).orderBy(*flat_order)).cast("long"))
    else:
        numbered = number_rows(flat, at, flat_order, "number")
    table = numbered.select(*at, "number", code(F.col(prefix), F.col("number")).alias("pseudonym"), "original", "key")
    return table, since.select(*at, "key", "since", "before_key")


def assign(occurrences: DataFrame, order: list[str], scope: list[str] = [], kind: str = "type", raw: str = "raw", prefix: str = "prefix") -> tuple[DataFrame, DataFrame]:
    """(``occurrences`` with ``pseudonym``, the table of equivalences)."""
    at = [*scope, prefix]
    table, targets = equivalences(occurrences, order, scope, kind, raw, prefix)
    step = occurrences.withColumn("sv_key", equivalence_key(F.col(kind), F.col(raw)))
    targets = targets.select(*[F.col(c).alias(f"sv_t_{c}") for c in at], F.col("key").alias("sv_t_key"), "since", "before_key")
    match = F.col("sv_key") == F.col("sv_t_key")
    for c in at:
        match = match & F.col(c).eqNullSafe(F.col(f"sv_t_{c}"))
    step = step.join(targets, match, "left")
    early = F.col("sv_t_key").isNotNull() & (F.col("since").isNull() | (F.struct(*order) < F.col("since")))
    step = step.withColumn("sv_key", F.when(early, F.col("before_key")).otherwise(F.col("sv_key"))).drop(*[f"sv_t_{c}" for c in at], "sv_t_key", "since", "before_key")
    names = table.select(*[F.col(c).alias(f"sv_n_{c}") for c in at], F.col("key").alias("sv_n_key"), "pseudonym")
    match = F.col("sv_key") == F.col("sv_n_key")
    for c in at:
        match = match & F.col(c).eqNullSafe(F.col(f"sv_n_{c}"))
    joined = step.join(names, match, "left").withColumn("pseudonym", F.when(is_protected(F.col(raw)), F.col(raw)).otherwise(F.col("pseudonym")))
    return joined.drop("sv_key", "sv_n_key", *[f"sv_n_{c}" for c in at]), table.drop("key")
