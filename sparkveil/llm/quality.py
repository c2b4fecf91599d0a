"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Defined cases: a null or blank text has no words, so it fails the base rule; repeated rows are judged alike; an empty
table gives no rows; extra columns stay, but ``q``, ``base_failed`` and ``kept`` are added and replace columns of these
names. Two three-word windows count as equal if their chained 64-bit hashes are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, fresh, let, words

#: Frequent function words of the languages that the rules serve; a parameter of ``quality_stats``.
STOP_WORDS = (
    "the and of to in that is with for are was this from by "
    "der die das und ist von mit den im ein eine zu nicht auf "
    "le la les de des et est un une dans pour que qui en du pas "
    "el los las y por para con del se una como su al"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a missing bound doesn't bind, an empty denominator counts as 1."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None


#: The production thresholds. They are wide: a rule rejects what no clean prose shows.
RULES = (
    Rule("mean_word", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("bangs", "n_bangs", "n_words", None, 0.3),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.5),
)
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 50, 50, 3


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, given one hash per window start."""

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"]

    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(marked, covered)).cast("long")


def quality_stats(docs: DataFrame, text: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """``docs`` with a struct column ``q`` of counts. Three projections, no shuffle, no Python."""
    t = F.coalesce(F.col(text), F.lit(""))
    nw, nl, nq, nh = fresh(docs, "sv_w", "sv_l", "sv_q", "sv_h")
    parts = docs.withColumn(nw, words(F.col(text))).withColumn(nl, F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS)) != ""))
    w, lines = F.col(nw), F.col(nl)
    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[w[i + k] for k in range(1, WINDOW)]))
    q = {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(t, WS, "")),
        "n_symbols": _count(t, "#*$%&|<>"),
        "n_bangs": _count(t, "!"),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(list(stop_words)))),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("- ") | F.ltrim(x).startswith("* ") | F.ltrim(x).startswith("•"))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
    }
    counted = parts.withColumn(nq, F.struct(*[v.cast("long").alias(k) for k, v in q.items()])).withColumn(nh, hashes)
    return counted.withColumn("q", F.col(nq).withField("n_repeat_words", _repeat_words(F.col(nh)))).drop(nw, nl, nq, nh)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule holds."""
    verdict = F.lit(True)
    for r in rules:
        ratio = F.col(f"q.{r.numerator}").cast("double") / (F.greatest(F.col(f"q.{r.denominator}"), F.lit(1)) if r.denominator else F.lit(1))
        if r.low is not None:
            verdict &= ratio >= r.low
        if r.high is not None:
            verdict &= ratio <= r.high
    return verdict


def base_failed() -> Column:
    return (F.col("q.n_words") < MIN_WORDS) | (100 * F.col("q.n_repeat_words") > MAX_REPEATED_PERCENT * F.col("q.n_words"))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``q``, ``base_failed`` and ``kept``."""
    return quality_stats(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


_SQL_STOPS = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))

ORACLE_OP5 = (
    r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid),
q AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(regexp_extract_all(t, '!'))::BIGINT AS n_bangs,
         len(list_filter(w, lambda x: lower(x) IN (@STOPS)))::BIGINT AS n_stop_words,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^ *([-*] |•)')))::BIGINT AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '([.][.][.]|…) *$')))::BIGINT AS n_ellipsis_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN covered c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars::DOUBLE / greatest(n_words, 1) BETWEEN 2.0 AND 15.0
       AND n_symbols::DOUBLE / greatest(n_words, 1) <= 0.1 AND n_bangs::DOUBLE / greatest(n_words, 1) <= 0.3
       AND n_stop_words::DOUBLE / greatest(n_words, 1) >= 0.01 AND n_dup_lines::DOUBLE / greatest(n_lines, 1) <= 0.5
       AND n_bullet_lines::DOUBLE / greatest(n_lines, 1) <= 0.9 AND n_ellipsis_lines::DOUBLE / greatest(n_lines, 1) <= 0.5 AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
"""
).replace("@STOPS", _SQL_STOPS)
