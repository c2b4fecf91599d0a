"""Finding, protecting and restoring: documents, conversations and columns of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import validators as V
from ..functions.anonymize import age_range, mask_card, mask_email, salary_range
from ..functions.text import equivalence_key, mask, normalize_text
from ..operators import documents as D
from ..operators import table as T
from ..operators.pseudonyms import assign
from ..operators.restore import restore
from ..operators.scan import PLACEHOLDER, SECRET_NAME, base_patterns, scan_for
from ..operators.spans import matches
from ..sources.readers import html_tables, html_text, json_leaves
from ..storage import materialize, shared_dir
from ..types import PSEUDONYMIZE, TYPES
from .base import Query, register, table

PROTECTION: dict[str, Query] = {}

EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
DIGITS_RE = r"[0-9]{13,19}"


def _found(spark: SparkSession, sf: str, pattern: str) -> DataFrame:
    """doc_id, lang, start, value of a pattern's matches; texts without a match are filtered in the scan's stage."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text").where(F.col("text").rlike(pattern))
    return docs.select("doc_id", "lang", F.explode(matches(F.translate("text", "\x01\x02", "  "), pattern)).alias("x")).select("doc_id", "lang", F.col("x.at").alias("start"), F.col("x.m").alias("value"))


def _ruled(spark: SparkSession, sf: str, kind: str, priority: int | None = None) -> DataFrame:
    """doc_id, lang, value of what the scanner's rules of one type find."""
    rules = [r for r in base_patterns() if r.type == kind and priority in (None, r.priority)]
    found = scan_for(table(spark, sf, "documents").select("doc_id", "lang", "text"), rules)
    return found.select("doc_id", "lang", F.explode("spans").alias("s")).select("doc_id", "lang", F.col("s.value").alias("value"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.lit(0).alias("seg_id"), "text")


@register(PROTECTION)
def protect_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: every document scanned and protected by the default actions; doc_id, type, count."""
    analyzed = D.analyze(segments(spark, sf))
    done = D.protect(analyzed).segments
    kept = done.select("doc_id", F.explode_outer(F.transform("spans", lambda s: s["type"])).alias("type"), F.length("protected").alias("n_chars"))
    return kept.groupBy("doc_id", "type", "n_chars").agg(F.count("type").alias("spans"))


@register(PROTECTION)
def document_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.summarize(D.analyze(segments(spark, sf))).select("type", "count", "distinct", "review")


@register(PROTECTION, """
SELECT o_orderkey AS doc_id, concat('u', concat(o_orderkey, ''), '@mail.example.com') AS leaked FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, concat('S', concat(o_orderkey * 7919 + 100000, ''), 'xyz') FROM orders WHERE o_orderkey % 3 = 0""")  # fmt: skip
def leak_check(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a mail address and a password, of which every fifth is then spoilt by its address inside a word,
    and every third by its password: exactly these are found, anonymised originals included."""
    k = F.col("o_orderkey")
    mail, secret = F.concat(F.lit("u"), k.cast("string"), F.lit("@mail.example.com")), F.concat(F.lit("S"), (k * 7919 + 100000).cast("string"), F.lit("xyz"))
    docs = table(spark, sf, "orders").select(k.alias("doc_id"), F.lit(0).alias("seg_id"), F.concat(F.lit("Escribir a "), mail, F.lit(" con password = "), secret, F.lit(" hoy")).alias("text"), mail.alias("mail"), secret.alias("secret"))
    analyzed = D.analyze(materialize(docs))
    clean = D.protect(analyzed).segments
    spoilt = F.concat("protected", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" x"), "mail", F.lit("x"))).otherwise(""), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" y"), "secret", F.lit("y"))).otherwise(""))
    found = D.leaks(clean.select("doc_id", spoilt.alias("protected")), D.originals(analyzed, scope=["doc_id"]), ["doc_id"], ["doc_id"])
    return found.select("doc_id", F.explode("leaked").alias("leaked"))


@register(PROTECTION)
def leaks_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Originals that still stand somewhere in their own protected document, in a place that no rule took for data."""
    analyzed = D.analyze(segments(spark, sf))
    done = D.protect(analyzed).segments.select("doc_id", "protected")
    return D.leaks(done, D.originals(analyzed, scope=["doc_id"]), ["doc_id"], ["doc_id"]).select("doc_id", F.explode("leaked").alias("leaked"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """All turns, numbered where a conversation repeats one."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    place = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("text"))
    return rows.withColumn("seg", F.col("turn") * (1 << 24) + place)


@register(PROTECTION)
def protect_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as segments of a conversation, with one registry for all of its turns."""
    analyzed = D.analyze(_turns(spark, sf), doc="conv_id", seg="seg")
    return D.protect(analyzed, doc="conv_id", seg="seg").segments.select("conv_id", "turn", "protected")


#: Every type gets a pseudonym, so that a text can be restored in full.
REVERSIBLE = dict.fromkeys(TYPES, PSEUDONYMIZE)


@register(PROTECTION, "SELECT conv_id, turn, md5(lower(text)) AS restored FROM conversations WHERE text IS NOT NULL")
def conversation_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations protected with pseudonyms of one registry each, and restored from its table."""
    done = D.protect(D.analyze(_turns(spark, sf), doc="conv_id", seg="seg"), REVERSIBLE, doc="conv_id", seg="seg")
    turns = done.segments.where("protected is not null").select("conv_id", "turn", "seg", F.col("protected").alias("text"))
    back = restore(turns, done.equivalences, ["conv_id", "seg"], ["conv_id"])
    return back.select("conv_id", "turn", F.md5(F.lower("restored")).alias("restored"))


@register(PROTECTION, "SELECT doc_id, md5(lower(text)) AS restored FROM documents WHERE text IS NOT NULL")
def document_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every document protected with pseudonyms, and restored: what was found went, and came back, at its place, but for
    its case: values that differ in case share a pseudonym and come back as the first of them."""
    done = D.protect(D.analyze(segments(spark, sf)), REVERSIBLE)
    back = restore(done.segments.where("protected is not null").select("doc_id", F.col("protected").alias("text")), done.equivalences, ["doc_id"], ["doc_id"])
    return back.select("doc_id", F.md5(F.lower("restored")).alias("restored"))


@register(PROTECTION, """
WITH t AS (SELECT '20' || lpad((c_custkey + 10000000)::VARCHAR, 8, '0') AS b FROM customer),
n AS (SELECT count(*) AS n FROM t WHERE (11 - list_sum(list_transform(range(0, 10), lambda i: b[i + 1]::INTEGER * [5, 4, 3, 2, 7, 6, 5, 4, 3, 2][i + 1])) % 11) % 11 <> 10)
SELECT idx::INTEGER AS idx, header, kind, type, confidence, CASE WHEN type IS NULL THEN 0 ELSE n END AS count, action FROM n, (VALUES (0, 'CUIT', 'columna', 'CUIT_CUIL', 'alta', 'seudonimizar'),
  (1, 'Correo', 'columna', 'EMAIL', 'alta', 'anonimizar'), (2, 'Sueldo', 'columna', 'SALARIO', 'alta', 'anonimizar'), (3, 'Rubro', 'ninguno', NULL, NULL, 'mantener'), (4, 'Edad', 'columna', 'EDAD', 'alta', 'anonimizar')) v(idx, header, kind, type, confidence, action)""")  # fmt: skip
def classify_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of a table made from customers: names, valid tax numbers, mails and amounts."""
    c = F.col("c_custkey")
    base = F.format_string("20%08d", c + 10_000_000)
    weights = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
    total = sum((F.substring(base, k + 1, 1).cast("int") * w for k, w in enumerate(weights)), F.lit(0))
    rest = (F.lit(11) - total % 11) % 11
    rows = table(spark, sf, "customer").where(rest != 10).select(
        c.alias("_row"), F.concat(base, rest.cast("string")).alias("CUIT"), F.concat(F.lit("u"), c.cast("string"), F.lit("@mail.example.com")).alias("Correo"),
        F.col("c_acctbal").alias("Sueldo"), F.col("c_mktsegment").alias("Rubro"), (c % 80 + 18).cast("int").alias("Edad"),
    )
    found = T.classify(rows, "_row")
    return spark.createDataFrame([(f.index, f.header, f.kind, f.type, f.confidence, f.count, f.action) for f in found], "idx int, header string, kind string, type string, confidence string, count long, action string")


@register(PROTECTION, rf"""
SELECT coalesce(lang, '-') AS lang, count(*) AS n_docs, sum(n)::BIGINT AS n_mails FROM (
  SELECT lang, len(regexp_extract_all(text, '{EMAIL_RE}')) AS n FROM documents) WHERE n > 0 GROUP BY 1""")  # fmt: skip
def email_count_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ruled(spark, sf, "EMAIL")
    return rows.groupBy(F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_mails"))


@register(PROTECTION, rf"""
SELECT doc_id, '***' || substr(m, strpos(m, '@')) AS masked FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL_RE}')) AS m FROM documents)""")
def email_mask(spark: SparkSession, sf: str) -> DataFrame:
    return _ruled(spark, sf, "EMAIL").select("doc_id", mask_email(F.col("value")).alias("masked"))


@register(PROTECTION, r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{13,19}')) AS d FROM documents),
c AS (SELECT doc_id, d, list_sum(list_transform(range(0, len(d)), lambda i: CASE WHEN (len(d) - i) % 2 = 1 THEN d[i + 1]::INTEGER
  ELSE CASE WHEN d[i + 1]::INTEGER > 4 THEN d[i + 1]::INTEGER * 2 - 9 ELSE d[i + 1]::INTEGER * 2 END END)) % 10 = 0 AS luhn FROM m)
SELECT doc_id, '**** ' || right(d, 4) AS masked, luhn AND regexp_matches(d, '^(?:4|5[0-9]|222[1-9]|22[3-9][0-9]|2[3-6][0-9][0-9]|27[01][0-9]|2720|3[4-8]|30[0-5]|6)') AND length(replace(d, d[1], '')) > 0 AS valid FROM c""")  # fmt: skip
def card_mask_luhn(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, DIGITS_RE).select("doc_id", mask_card(F.col("value")).alias("masked"), V.is_card(F.col("value")).alias("valid"))


@register(PROTECTION, rf"""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:versi[oó]n\s*|\bv\s*)?[0-9.]+')) AS run FROM documents),
m AS (SELECT doc_id, regexp_extract(run, '^({V.IP})(?:\.?$|\.\.)', 1) AS m FROM r)
SELECT m AS ip, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM m WHERE m <> '' GROUP BY 1""")  # fmt: skip
def ip_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _ruled(spark, sf, "IP").groupBy(F.col("value").alias("ip")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@register(PROTECTION, rf"""
SELECT doc_id, m AS secret FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i){SECRET_NAME}["'']?\s*[:=]\s*["'']?([^\s"'',;]{{6,}})', 1)) AS m FROM documents) WHERE NOT regexp_matches(m, '{PLACEHOLDER}')""")
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Values that are assigned to something named like a secret."""
    return _ruled(spark, sf, "CREDENCIAL", 94).select("doc_id", F.col("value").alias("secret"))


def _tax_numbers(keys: Column) -> Column:
    """Eleven digits, of which about one in eleven is a valid tax number."""
    return F.concat(F.element_at(F.array(*map(F.lit, ("20", "27", "30", "99"))), (keys % 4 + 1).cast("int")), F.lpad(((keys * 7919 + 12345678) % 100000000).cast("string"), 8, "0"), ((keys * 31) % 10).cast("string"))


TAX_SQL = "SELECT o_orderkey, ['20', '27', '30', '99'][o_orderkey % 4 + 1] || lpad(((o_orderkey * 7919 + 12345678) % 100000000)::VARCHAR, 8, '0') || ((o_orderkey * 31) % 10)::VARCHAR AS d FROM orders"


@register(PROTECTION, f"""
WITH t AS ({TAX_SQL}), s AS (SELECT o_orderkey, d, (11 - list_sum(list_transform(range(0, 10), lambda i: d[i + 1]::INTEGER * [5, 4, 3, 2, 7, 6, 5, 4, 3, 2][i + 1])) % 11) % 11 AS c FROM t)
SELECT o_orderkey, d[1:2] IN ('20', '23', '24', '27', '30', '33', '34') AND c < 10 AND c = d[11]::INTEGER AS valid FROM s""")  # fmt: skip
def tax_number_check(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", V.is_cuit(_tax_numbers(F.col("o_orderkey"))).alias("valid"))


@register(PROTECTION, """
WITH d AS (SELECT o_orderkey, lpad(((o_orderkey * 104729 + 1) % 100000000)::VARCHAR, 8, '0') || lpad(((o_orderkey * 999983 + 7) % 100000000000000)::VARCHAR, 14, '0') AS d FROM orders),
s AS (SELECT *, (10 - list_sum(list_transform(range(0, 7), lambda i: d[i + 1]::INTEGER * [7, 1, 3, 9, 7, 1, 3][i + 1])) % 10) % 10 AS a,
  (10 - list_sum(list_transform(range(0, 13), lambda i: d[i + 9]::INTEGER * [3, 9, 7, 1, 3, 9, 7, 1, 3, 9, 7, 1, 3][i + 1])) % 10) % 10 AS b FROM d)
SELECT o_orderkey, a = d[8]::INTEGER AND b = d[22]::INTEGER AS valid FROM s""")  # fmt: skip
def bank_account_check(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = F.concat(F.lpad(((k * 104729 + 1) % 100000000).cast("string"), 8, "0"), F.lpad(((k * 999983 + 7) % 100000000000000).cast("string"), 14, "0"))
    return table(spark, sf, "orders").select("o_orderkey", V.is_cbu(d).alias("valid"))


@register(PROTECTION, """
SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 119 THEN (p_size // 10 * 10)::VARCHAR || '-' || (p_size // 10 * 10 + 9)::VARCHAR ELSE '[EDAD]' END AS decade FROM part""")
def age_decade(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", age_range(F.col("p_size").cast("string")).alias("decade"))


def _dots(x: str) -> str:
    return f"replace(format('{{:,}}', {x}), ',', '.')"


@register(PROTECTION, f"""
WITH c AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n FROM orders), m AS (SELECT *, (10 ** (length(n::VARCHAR) - 1 - CASE WHEN n >= 1000000 THEN 1 ELSE 0 END))::BIGINT AS s FROM c)
SELECT o_orderkey, CASE WHEN n <= 0 THEN '[SALARIO]' ELSE '$ ' || {_dots("n // s * s")} || ' – ' || {_dots("n // s * s + s")} END AS band FROM m""")  # fmt: skip
def salary_band(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", salary_range(F.floor("o_totalprice").cast("string")).alias("band"))


@register(PROTECTION, """
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_brand || ' - ' || p_name || ', S.A.'), '[.,;:''"()]', '', 'g'), '[_\\-/]+', ' ', 'g'), '\\s+', ' ', 'g')) AS norm,
  regexp_replace(lpad(p_partkey::VARCHAR, 8, '0'), '(..)(...)(...)', '\\1\\2\\3') AS digits FROM part""")  # fmt: skip
def key_normalise(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat("p_brand", F.lit(" - "), "p_name", F.lit(", S.A."))
    dni = F.regexp_replace(F.lpad(F.col("p_partkey").cast("string"), 8, "0"), "(..)(...)(...)", "$1.$2.$3")
    return table(spark, sf, "part").select("p_partkey", normalize_text(raw).alias("norm"), equivalence_key(F.lit("DNI"), dni).alias("digits"))


@register(PROTECTION, """
SELECT c_custkey, c_name[1:2] || repeat('•', least(length(c_name) - 4, 10)) || right(c_name, 2) AS masked FROM customer""")
def display_mask(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", mask(F.col("c_name")).alias("masked"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """Names in row order: mostly two words, each fifth row one of them alone."""
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.chr(F.lit(97) + F.col("p_size") % 10))).alias("full"))
    first = F.split_part("full", F.lit(" "), F.lit(1))
    last = F.split_part("full", F.lit(" "), F.lit(2))
    raw = F.when(F.col("p_partkey") % 5 == 4, F.when(F.col("p_partkey") % 2 == 0, first).otherwise(last)).otherwise(F.col("full"))
    return p.select("p_partkey", F.lit("NOMBRE_PERSONA").alias("type"), raw.alias("raw"), F.lit("Persona").alias("prefix"))


NAMES_SQL = """
WITH p AS (SELECT p_partkey AS o, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) || chr(97 + p_size % 10) AS f FROM part),
occ AS (SELECT o, lower(CASE WHEN o % 5 = 4 THEN CASE WHEN o % 2 = 0 THEN split_part(f, ' ', 1) ELSE split_part(f, ' ', 2) END ELSE f END) AS k FROM p),
fulls AS (SELECT k, min(o) AS o FROM occ WHERE contains(k, ' ') GROUP BY k),
words AS (SELECT DISTINCT k, o, unnest(string_split(k, ' ')) AS w FROM fulls),
lone AS (SELECT o, k, (SELECT count(DISTINCT w.k) FROM words w WHERE w.w = occ.k AND w.o < occ.o) AS n,
  (SELECT min(w.k) FROM words w WHERE w.w = occ.k AND w.o < occ.o) AS owner FROM occ WHERE NOT contains(k, ' ')),
made AS (SELECT k, min(o) AS o FROM lone WHERE n <> 1 OR length(k) < 4 GROUP BY k),
rows_ AS (SELECT k, o, row_number() OVER (ORDER BY o) AS num FROM (SELECT * FROM fulls UNION ALL SELECT * FROM made)),
target AS (SELECT occ.o, CASE WHEN contains(occ.k, ' ') THEN occ.k WHEN made.o IS NOT NULL AND made.o <= occ.o THEN occ.k ELSE lone.owner END AS k
  FROM occ LEFT JOIN lone ON lone.o = occ.o LEFT JOIN made ON made.k = occ.k)
SELECT target.o AS p_partkey, 'Persona_' || CASE WHEN num < 10 THEN '0' ELSE '' END || num::VARCHAR AS pseudonym FROM target JOIN rows_ USING (k)"""


@register(PROTECTION, NAMES_SQL)
def pseudonym_names(spark: SparkSession, sf: str) -> DataFrame:
    """Numbering by first occurrence over the whole table, lone names resolved to the only full name known so far."""
    return assign(_names(spark, sf), ["p_partkey"])[0].select("p_partkey", "pseudonym")


@register(PROTECTION, """
WITH k AS (SELECT l_suppkey AS g, l_partkey AS k, min(l_orderkey * 8 + l_linenumber) AS o FROM lineitem GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o, k) AS num FROM k)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, 'DNI_' || CASE WHEN num < 10 THEN '0' ELSE '' END || num::VARCHAR AS pseudonym
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem) JOIN n ON g = l_suppkey AND k = l_partkey""")  # fmt: skip
def pseudonym_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers within a scope: part keys as identity numbers of one supplier's file."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").distinct()
    occ = line.withColumn("o", F.col("l_orderkey") * 8 + F.col("l_linenumber")).withColumn("type", F.lit("DNI")).withColumn("prefix", F.lit("DNI")).withColumn("raw", F.format_string("%08d", "l_partkey"))
    done = assign(occ, ["o", "l_partkey"], ["l_suppkey"])[0]
    return done.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "pseudonym")


@register(PROTECTION, """
WITH a AS (SELECT c_custkey, c_custkey % 7 < 5 AS long, c_custkey * 2 AS k, p_name FROM customer LEFT JOIN part ON p_partkey = c_custkey * 2)
SELECT c_custkey, coalesce(p_name, 'Persona ' || k::VARCHAR) || CASE WHEN long THEN ' y **' || coalesce(p_name, 'PERSONA-00' || k::VARCHAR) || '** de persona ' || k::VARCHAR ELSE ' y [DNI]' END AS restored,
  CASE WHEN p_name IS NULL THEN 0 WHEN long THEN 2 ELSE 1 END::BIGINT AS n_replaced, CASE WHEN p_name IS NOT NULL THEN 0 WHEN long THEN 2 ELSE 1 END::INTEGER AS n_unknown FROM a""")  # fmt: skip
def restore_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that write pseudonyms freely, restored from the names of all parts; about a third have no such part."""
    number = (F.col("c_custkey") * 2).cast("string")
    short = F.concat(F.lit("Persona "), number, F.lit(" y [DNI]"))
    long = F.concat(F.lit("Persona "), number, F.lit(" y **PERSONA-00"), number, F.lit("** de persona "), number)
    answers = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 < 5, long).otherwise(short).alias("text"))
    rows = table(spark, sf, "part").select(F.format_string("Persona_%02d", "p_partkey").alias("pseudonym"), F.col("p_name").alias("original"))
    out = restore(answers, rows, ["c_custkey"])
    total = F.aggregate(F.map_values("replaced"), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("c_custkey", "restored", total.alias("n_replaced"), F.size("unknown").alias("n_unknown"))


@register(PROTECTION, r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS w FROM documents)
SELECT doc_id, w AS term, count(*) AS n FROM t WHERE w IN ('the', 'ist', 'dans', 'como', 'was') GROUP BY ALL""")  # fmt: skip
def term_search(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary searched as whole words, whatever the case and accents."""
    terms = spark.createDataFrame([("THE", "X", 0), ("ist", "X", 1), ("dáns", "X", 2), ("como", "X", 3), ("Was", "X", 4)], "value string, type string, ord long")
    found = D.term_spans(table(spark, sf, "documents").select("doc_id", "text"), terms, ["doc_id"])
    return found.select("doc_id", F.explode("sv_terms").alias("s")).groupBy("doc_id", normalize_text(F.col("s.value")).alias("term")).agg(F.count("*").alias("n"))


@register(PROTECTION, """
SELECT event_type, count(*) AS n, sum((props::JSON->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1""")
def json_leaf_totals(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    leaves = json_leaves(e, "props", "event_id").where("hint = 'k'").select("event_id", F.col("text").cast("long").alias("k"))
    return e.select("event_id", "event_type").join(leaves, "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@register(PROTECTION, """
SELECT o_orderkey, 0 AS table_id, r AS row_id, CASE r WHEN 0 THEN 'Clave|Prioridad & más' ELSE o_orderkey::VARCHAR || '|' || o_orderpriority END AS cells FROM orders, (SELECT unnest([0, 1]) AS r)""")
def html_table_cells(spark: SparkSession, sf: str) -> DataFrame:
    page = F.concat(F.lit("<p>x</p><TABLE class='a'><tr><th>Clave</th><th>Prioridad<br/>&amp; m&#225;s</th></tr><tr><td> "), F.col("o_orderkey").cast("string"), F.lit("</td><td><b>"), "o_orderpriority", F.lit("</b></td></tr><tr><td></td></tr></TABLE>"))
    pages = table(spark, sf, "orders").select("o_orderkey", page.alias("html"))
    return html_tables(pages, "o_orderkey").select("o_orderkey", "table_id", "row_id", F.array_join("cells", "|").alias("cells"))


@register(PROTECTION, r"""
WITH h AS (SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h, regexp_extract(html, '(?is)<a href="[^"]*">(.*?)</a>', 1) AS a FROM pages),
t AS (SELECT page_id, unnest([h, a]) AS x, unnest([0, 1]) AS part FROM h),
d AS (SELECT page_id, part, regexp_replace(x, '<[^>]+>', '', 'g') AS x FROM t)
SELECT page_id, part, trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM d""")
def page_headings(spark: SparkSession, sf: str) -> DataFrame:
    """The headings and first links of all pages as text: tags gone, entities decoded."""
    pages = table(spark, sf, "pages")
    parts = [F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), F.regexp_extract("html", r'(?is)<a href="[^"]*">(.*?)</a>', 1)]
    return pages.select("page_id", F.posexplode(F.array(*parts)).alias("part", "x")).select("page_id", "part", html_text(F.col("x")).alias("text"))


@register(PROTECTION, """
WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer), p AS (SELECT c_custkey, CASE WHEN n < 10 THEN '0' ELSE '' END || n::VARCHAR AS n FROM n)
SELECT c_custkey AS _row, 'Empresa_' || n AS Empresa, '***@x.example.com' AS Correo, 'Llamar a Empresa_' || n || ', escribir a Email_' || n || ' hoy' AS Notas FROM p""")  # fmt: skip
def protect_customer_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table with a name column and free text that mentions the names: one numbering for both."""
    c = table(spark, sf, "customer")
    rows = c.select(F.col("c_custkey").alias("_row"), F.concat(F.lit("Cliente "), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"), F.lit(" SA")).alias("Empresa"), F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@x.example.com")).alias("Correo"))
    rows = rows.withColumn("Notas", F.concat(F.lit("Llamar a "), "Empresa", F.lit(", escribir a "), "Correo", F.lit(" hoy")))
    plan = {"Empresa": T.Decision("seudonimizar", "RAZON_SOCIAL"), "Correo": T.Decision("anonimizar", "EMAIL"), "Notas": T.Decision("seudonimizar", None, "texto")}
    return materialize(T.apply_decisions(rows, plan, "_row").table)


@register(PROTECTION, "SELECT ts::DATE AS day, event_type, count(*) AS events, sum(floor(value * 100 + 0.5)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL")
def streaming_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The events table read as a stream, deduplicated and counted in windows with a watermark."""
    from ..streaming.ingest import deduplicated, keep_latest, latest_counts, windowed_counts

    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("value", F.floor(F.col("value") * 100 + 0.5))
    counts, path = windowed_counts(deduplicated(stream), late=None), f"{shared_dir(spark)}/veil-{uuid.uuid4().hex}"
    keep_latest(counts, f"{path}/rows", f"{path}/state").awaitTermination()
    latest = latest_counts(spark, f"{path}/rows", ["start", "event_type"], ["events", "total"], counts.schema)
    return latest.select(F.to_date("start").alias("day"), "event_type", "events", F.col("total").cast("long").alias("cents"))
