"""Restoring: pseudonyms in an answer back to the data, by a join.

Answers rewrite pseudonyms freely ('Persona 3', 'persona_03', 'PERSONA-03', '**Persona_03**'); they are found by their
prefixes and joined on (scope, folded prefix, number). The known prefixes are few by nature; their number is checked.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..types import TOKENS
from .spans import clean, matches, replace_spans

MAX_PREFIXES = 1000
IRREVERSIBLE = "|".join(re.escape(t) for t in TOKENS.values()) + r"|\*\*\*@[\w.\-]+\.\w+|\*{4} \d{4}"


def group_key(g: Column) -> Column:
    return fold(F.trim(F.regexp_replace(g, "[ _]+", " ")))


def pseudonym_keys(table: DataFrame, pseudonym: str = "pseudonym") -> DataFrame:
    """``table`` with ``sv_group`` (as written), ``sv_key`` and ``sv_number``; rows that are no pseudonyms go."""
    shape = r"^(.*?)[ _\-]?(\d+)$"
    out = table.where(F.col(pseudonym).rlike(shape)).withColumn("sv_group", F.regexp_extract(pseudonym, shape, 1)).withColumn("sv_number", F.regexp_extract(pseudonym, shape, 2).try_cast("long"))
    return out.withColumn("sv_key", group_key(F.col("sv_group")))


def restore(texts: DataFrame, equivalences: DataFrame, keys: list[str], scope: list[str] = [], text: str = "text") -> DataFrame:
    """``texts`` with ``restored``, ``replaced`` (map pseudonym -> times), ``unknown`` and ``irreversible`` (arrays)."""
    known = pseudonym_keys(equivalences).select(*scope, "sv_key", "sv_number", "sv_group", "pseudonym", "original")
    groups = [r[0] for r in known.select("sv_group").distinct().limit(MAX_PREFIXES + 1).collect()]
    if len(groups) > MAX_PREFIXES:
        raise ValueError(f"over {MAX_PREFIXES} prefixes in the table of equivalences")
    base = texts.withColumn("sv_text", clean(F.col(text)))
    irreversible = F.array_distinct(F.regexp_extract_all(F.col("sv_text"), F.lit(IRREVERSIBLE), F.lit(0)))
    if not groups:
        empty = F.array().cast("array<string>")
        return base.select(*texts.columns, F.col(text).alias("restored"), F.create_map().cast("map<string,bigint>").alias("replaced"), empty.alias("unknown"), irreversible.alias("irreversible"))
    alternatives = "|".join(re.sub(r"(?:\\ |_| )+", "[ _]+", re.escape(g)) for g in sorted(groups, key=len, reverse=True))
    shape = rf"(?iu)(?<![\p{{L}}\p{{N}}_])({alternatives})([ _\-]?)0*(\d{{1,18}})(?![\p{{L}}\p{{N}}]|[.,]\d)"
    carried = list(dict.fromkeys([*keys, *scope]))
    found = base.select(*carried, F.explode(matches(F.col("sv_text"), shape)).alias("x")).select(*carried, F.col("x.at").alias("start"), F.col("x.m").alias("m"))
    part = lambda k: F.regexp_extract("m", f"^{shape[shape.index('('):]}".replace("^(?iu)", "(?iu)^"), k)
    split = found.withColumn("sv_group", part(1)).withColumn("gap", part(2)).withColumn("sv_number", part(3).try_cast("long"))
    split = split.where((F.col("gap") != " ") | F.col("sv_group").rlike(r"^\p{Lu}")).withColumn("sv_key", group_key(F.col("sv_group"))).drop("sv_group")
    joined = split.join(known.drop("sv_group").dropDuplicates([*scope, "sv_key", "sv_number"]), [*scope, "sv_key", "sv_number"], "left")
    hit = F.col("original").isNotNull()
    lists = joined.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(hit, F.struct("start", (F.col("start") + F.length("m")).alias("end"), "original", "pseudonym")))).alias("sv_hits"),
        F.array_sort(F.collect_set(F.when(~hit, F.col("m")))).alias("sv_unknown"),
    )
    out = base.join(lists, keys, "left")
    hits = F.col("sv_hits")
    names = F.transform(hits, lambda s: s["pseudonym"])
    counts = F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("key"), F.size(F.filter(names, lambda x: x == n)).cast("long").alias("value"))))
    restored = F.when(F.col(text).isNull() | hits.isNull(), F.col(text)).otherwise(replace_spans(F.col(text), hits, lambda s: s["original"]))
    return out.select(
        *[out[c] for c in texts.columns],
        restored.alias("restored"),
        F.coalesce(counts, F.create_map().cast("map<string,bigint>")).alias("replaced"),
        F.coalesce("sv_unknown", F.array().cast("array<string>")).alias("unknown"),
        irreversible.alias("irreversible"),
    )
