"""Reports: orders as events, line items as detections, customers as users, nations as areas, regions as organisations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import report as R
from ..types import TABLE_ACTIONS
from .base import Query, register, table

REPORTS: dict[str, Query] = {}
ORG, FIRST, LAST, K = 1, date(1996, 1, 1), date(1997, 12, 31), 8
SHORT_LAST = date(1996, 1, 31)


def areas(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("org_id"), F.col("n_name").alias("name"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("area_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("active"))
    return c.join(areas(spark, sf).select(F.col("id").alias("area_id"), "org_id"), "area_id")


def events(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("input_kind"),
        F.when(F.col("o_orderstatus") == "F", "ignorado").when(F.col("o_orderstatus") == "O", "protegido").alias("decision"),
        F.when(F.col("o_orderstatus") == "P", "web").otherwise("extension").alias("origin"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("s"), (F.col("o_orderkey") % 6).cast("string"), F.lit(".example.com"))).alias("site"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("sensitive"),
    )
    return o.join(users(spark, sf).select(F.col("id").alias("user_id"), "area_id", "org_id"), "user_id")


def detections(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("EMAIL", "DNI", "TELEFONO", "TARJETA"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    action = F.when(F.col("l_returnflag") == "A", "eliminar").when(F.col("l_returnflag") == "R", "seudonimizar").otherwise("mantener")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), kind.alias("type"), action.alias("action"), F.col("l_quantity").cast("long").alias("amount"))


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).where((F.col("id") % 5 == 0) & (F.col("decision") == "ignorado"))
    state = F.when(F.col("id") % 15 == 0, "confirmado").otherwise("abierto")
    return e.select((F.col("id") + 1_000_000).alias("id"), "org_id", F.col("id").alias("event_id"), state.alias("state"), "ts")


BASE_SQL = """
WITH areas AS (SELECT n_nationkey AS id, n_regionkey AS org_id, n_name AS name FROM nation),
users AS (SELECT c_custkey AS id, c_nationkey AS area_id, c_name AS name, c_acctbal > 0 AS active, n_regionkey AS org_id
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
events_ AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS ts, o_orderpriority AS input_kind,
  CASE o_orderstatus WHEN 'F' THEN 'ignorado' WHEN 'O' THEN 'protegido' END AS decision,
  CASE WHEN o_orderstatus = 'P' THEN 'web' ELSE 'extension' END AS origin,
  CASE WHEN o_orderstatus <> 'P' THEN 's' || (o_orderkey % 6)::VARCHAR || '.example.com' END AS site,
  o_orderpriority IN ('1-URGENT', '2-HIGH') AS sensitive, u.area_id, u.org_id
  FROM orders JOIN users u ON u.id = o_custkey),
det_ AS (SELECT l_orderkey AS event_id, ['EMAIL', 'DNI', 'TELEFONO', 'TARJETA'][l_linenumber % 4 + 1] AS type,
  CASE l_returnflag WHEN 'A' THEN 'eliminar' WHEN 'R' THEN 'seudonimizar' ELSE 'mantener' END AS action, l_quantity::BIGINT AS amount FROM lineitem),
incidents AS (SELECT id + 1000000 AS id, org_id, id AS event_id, CASE WHEN id % 15 = 0 THEN 'confirmado' ELSE 'abierto' END AS state, ts
  FROM events_ WHERE id % 5 = 0 AND decision = 'ignorado'),
ev AS (SELECT * FROM events_ WHERE org_id = 1 AND ts >= DATE '1996-01-01' AND ts < DATE '@LAST' + 1),
det AS (SELECT d.*, ev.area_id, ev.ts FROM det_ d JOIN ev ON ev.id = d.event_id),
raw AS (SELECT a.name AS area, count(DISTINCT ev.user_id) AS persons, count(DISTINCT ev.id) AS events,
  coalesce((SELECT sum(amount) FROM det WHERE det.area_id = a.id), 0)::BIGINT AS detections
  FROM areas a JOIN ev ON ev.area_id = a.id GROUP BY a.id, a.name)
"""
LONG, SHORT = BASE_SQL.replace("@LAST", str(LAST)), BASE_SQL.replace("@LAST", str(SHORT_LAST))


def _range(spark: SparkSession, sf: str, last: date = LAST) -> tuple[DataFrame, DataFrame]:
    ev = R.events_in(events(spark, sf), ORG, FIRST, last)
    return ev, R.detections_of(detections(spark, sf), ev)


@register(REPORTS, LONG + """
SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM ev WHERE sensitive) AS events_sensitive,
  (SELECT count(*) FROM ev WHERE origin = 'extension' AND decision = 'ignorado') AS sent_outside,
  (SELECT coalesce(sum(amount), 0)::BIGINT FROM det) AS detections,
  (SELECT coalesce(sum(amount), 0)::BIGINT FROM det WHERE action = 'eliminar') AS blocked,
  (SELECT coalesce(sum(amount), 0)::BIGINT FROM det WHERE action IN ('anonimizar', 'seudonimizar')) AS anonymized,
  (SELECT coalesce(sum(amount), 0)::BIGINT FROM det WHERE action = 'mantener') AS allowed,
  (SELECT count(*) FROM incidents WHERE org_id = 1 AND state = 'confirmado' AND ts >= DATE '1996-01-01' AND ts < DATE '1998-01-01') AS incidents_confirmed""")  # fmt: skip
def panel_totals(spark: SparkSession, sf: str) -> DataFrame:
    ev, det = _range(spark, sf)
    return R.totals(ev, det, R.events_in(incidents(spark, sf), ORG, FIRST, LAST))


@register(REPORTS, LONG + "SELECT strftime(ts, '%Y-%m') AS month, sum(amount)::BIGINT AS detections FROM det GROUP BY 1")
def panel_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return R.by_month(_range(spark, sf)[1])


@register(REPORTS, LONG + "SELECT type, sum(amount)::BIGINT AS amount FROM det GROUP BY type")
def panel_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return R.by_type(_range(spark, sf)[1])


@register(REPORTS, SHORT + """, small AS (SELECT sum(persons) AS persons, sum(events)::BIGINT AS events, sum(detections)::BIGINT AS detections FROM raw WHERE persons < 8)
SELECT area, events, detections FROM raw WHERE persons >= 8
UNION ALL SELECT 'Otras áreas', events, detections FROM small WHERE persons >= 8""")  # fmt: skip
def panel_by_area(spark: SparkSession, sf: str) -> DataFrame:
    ev, det = _range(spark, sf, SHORT_LAST)
    return R.by_area(R.by_area_raw(ev, det, areas(spark, sf)), K)


@register(REPORTS, SHORT + "SELECT (CASE WHEN sum(persons) FILTER (persons < 40) < 40 THEN count(*) FILTER (persons < 40) ELSE 0 END)::BIGINT AS areas_left_out FROM raw")
def panel_areas_left_out(spark: SparkSession, sf: str) -> DataFrame:
    ev, det = _range(spark, sf, SHORT_LAST)
    return R.areas_left_out(R.by_area_raw(ev, det, areas(spark, sf)), 40)


@register(REPORTS, LONG + """
SELECT us.name AS user_name, a.name AS area, count(DISTINCT e.id) AS events, coalesce(sum(d.amount), 0)::BIGINT AS detections,
  count(DISTINCT e.id) FILTER (e.decision = 'ignorado') AS ignored_warnings
FROM ev e JOIN users us ON us.id = e.user_id LEFT JOIN areas a ON a.id = e.area_id LEFT JOIN det_ d ON d.event_id = e.id
GROUP BY us.name, a.name""")  # fmt: skip
def panel_user_detail(spark: SparkSession, sf: str) -> DataFrame:
    ev, det = _range(spark, sf)
    return R.user_detail(ev, det, users(spark, sf), areas(spark, sf))


@register(REPORTS, LONG + """
SELECT e.id AS event_id, e.ts::DATE AS day,
  CASE WHEN (SELECT count(*) FROM users x WHERE x.area_id = a.id AND x.active) >= 8 THEN a.name ELSE 'Otras áreas' END AS area, e.site, e.input_kind,
  coalesce((SELECT string_agg(t, ',' ORDER BY o) FROM (SELECT DISTINCT type AS t, list_position(['EMAIL', 'TELEFONO', 'DNI', 'TARJETA'], type) AS o FROM det_ d WHERE d.event_id = e.id)), '') AS types,
  coalesce((SELECT sum(amount) FROM det_ d WHERE d.event_id = e.id), 0)::BIGINT AS detections, i.id AS incident_id, i.state AS incident_state
FROM ev e LEFT JOIN areas a ON a.id = e.area_id LEFT JOIN incidents i ON i.event_id = e.id
WHERE e.decision = 'ignorado' ORDER BY e.ts DESC, e.id LIMIT 200""")  # fmt: skip
def panel_risk_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = R.events_in(events(spark, sf), ORG, FIRST, LAST)
    out = R.risk_events(ev, detections(spark, sf), users(spark, sf), areas(spark, sf), incidents(spark, sf), K)
    return out.withColumn("types", F.array_join("types", ","))


@register(REPORTS, BASE_SQL.replace("@LAST", str(LAST)) + "SELECT event_id, type, action, amount FROM det_ d WHERE EXISTS (SELECT 1 FROM events_ e WHERE e.id = d.event_id AND e.org_id = 2)")
def secured_detections(spark: SparkSession, sf: str) -> DataFrame:
    own = R.secured(events(spark, sf), 2)
    return R.secured_detections(detections(spark, sf), own)


@register(REPORTS, LONG + "SELECT event_id, type, action, sum(amount)::BIGINT AS amount FROM det_ GROUP BY ALL")
def ingest_dedupe_sum(spark: SparkSession, sf: str) -> DataFrame:
    return R.ingest_detections(R.valid_detections(detections(spark, sf)))


@register(REPORTS, """
WITH d AS (SELECT unnest(['EMAIL', 'TELEFONO', 'DNI', 'CUIT_CUIL', 'CBU_CVU', 'TARJETA', 'PATENTE', 'NOMBRE_PERSONA', 'RAZON_SOCIAL', 'DIRECCION', 'FECHA_NACIMIENTO', 'EDAD', 'PASAPORTE', 'SALARIO', 'DATO_SENSIBLE', 'CREDENCIAL', 'IP']) AS type,
  unnest(['anonimizar', 'eliminar', 'seudonimizar', 'seudonimizar', 'eliminar', 'eliminar', 'seudonimizar', 'seudonimizar', 'seudonimizar', 'eliminar', 'anonimizar', 'anonimizar', 'seudonimizar', 'anonimizar', 'eliminar', 'eliminar', 'anonimizar']) AS suggested),
own AS (SELECT ['EMAIL', 'DNI', 'TELEFONO', 'TARJETA', 'IP'][r_regionkey + 1] AS type, ['eliminar', 'mantener', 'anonimizar', 'seudonimizar', 'eliminar'][r_regionkey + 1] AS action FROM region)
SELECT type, coalesce(action, suggested) AS action, action IS NOT NULL AS enforced FROM d LEFT JOIN own USING (type)""")  # fmt: skip
def policy_overlay(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda *values: F.element_at(F.array(*map(F.lit, values)), F.col("r_regionkey") + 1)
    own = table(spark, sf, "region").select(at("EMAIL", "DNI", "TELEFONO", "TARJETA", "IP").alias("type"), at("eliminar", "mantener", "anonimizar", "seudonimizar", "eliminar").alias("action"))
    return R.policy_actions(own, TABLE_ACTIONS)


@register(REPORTS, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    history = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("version"))
    return R.latest_state(history, ["user_id"], "version").select("user_id", "event_id", "event_type")


@register(REPORTS, "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 11 <> 0")
def upsert_delete(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    gone = F.col("c_custkey") % 11 == 0
    changes = base.where((F.col("c_custkey") % 7 == 0) | gone).withColumn("c_mktsegment", F.when(~gone, F.lit("CHANGED")))
    return R.upsert(base, changes, ["c_custkey"])


@register(REPORTS, "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an order, by names that are compared whatever the case and accents."""
    name = lambda key: F.concat(F.lit("Peña "), F.col(key).cast("string"))
    o = table(spark, sf, "orders").select(F.upper(name("o_custkey")).alias("name"))
    return R.not_listed(table(spark, sf, "customer").select("c_custkey", name("c_custkey").alias("name")), o, "name").select("c_custkey")


@register(REPORTS, """
SELECT c_mktsegment, n, floor(n * 100.0 / sum(n) OVER () + 0.5)::BIGINT AS share FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)""")
def share_of_total(spark: SparkSession, sf: str) -> DataFrame:
    return R.shares(table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), "n")


@register(REPORTS, """
WITH o AS (SELECT coalesce(source, '-') AS type, CASE WHEN toxic = 1 AND quality = 0 THEN 'tp' WHEN quality = 0 THEN 'fp' WHEN toxic = 1 THEN 'fn' ELSE 'tn' END AS outcome FROM labels JOIN documents USING (doc_id)),
c AS (SELECT type, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM o WHERE outcome <> 'tn' GROUP BY type),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall FROM c)
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p""")  # fmt: skip
def prf_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Low quality as a guess at toxic texts: spans over whole texts, matched one to one, by source."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("-")).alias("source")), "doc_id")
    span = F.array(F.struct(F.col("source").alias("type"), F.lit(0).alias("start"), F.lit(10).alias("end"), F.lit("").alias("value")))
    found = lambda c: F.when(c, span).otherwise(F.filter(span, lambda _: F.lit(False)))
    cases = rows.select(F.col("doc_id").alias("case_id"), found(F.col("toxic") == 1).alias("gold"), found(F.col("quality") == 0).alias("spans"))
    return Q.metrics(Q.outcomes(cases))


@register(REPORTS, """
WITH o AS (SELECT coalesce(source, '-') AS type, doc_id % 12 AS s FROM documents),
c AS (SELECT type, sum((s <= 5)::INT + (s >= 1)::INT)::BIGINT AS tp, sum(2 - (s <= 5)::INT - (s >= 1)::INT)::BIGINT AS fp, sum(2 - (s <= 5)::INT - (s >= 1)::INT)::BIGINT AS fn FROM o GROUP BY type)
SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall, CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)) END AS f1 FROM c""")  # fmt: skip
def prf_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Two marked spans a document and two guesses that slide past them: half an overlap counts, and a guess counts once."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("-")).alias("source"), (F.col("doc_id") % 12).cast("int").alias("s"))
    span = lambda at: F.struct(F.col("source").alias("type"), at.alias("start"), (at + 10).alias("end"), F.lit("").alias("value"))
    cases = docs.select(F.col("doc_id").alias("case_id"), F.array(span(F.lit(0)), span(F.lit(12))).alias("gold"), F.array(span(F.col("s")), span(F.col("s") + 6)).alias("spans"))
    return Q.metrics(Q.outcomes(cases))


SWEEP = [0.02, 0.04, 0.06, 0.08]


@register(REPORTS, """
WITH s AS (SELECT l_linestatus AS label, l_discount AS score, l_returnflag = 'R' AS correct FROM lineitem),
t AS (SELECT unnest([0.02, 0.04, 0.06, 0.08]::DOUBLE[]) AS threshold),
c AS (SELECT label, threshold, count(*) FILTER (score >= threshold AND correct) AS tp, count(*) FILTER (score >= threshold AND NOT correct) AS fp, count(*) FILTER (correct AND score < threshold) AS fn FROM s, t GROUP BY ALL),
p AS (SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall FROM c)
SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM p""")  # fmt: skip
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("label"), F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").alias("correct"))
    return Q.sweep(scored, scored.groupBy("label").agg(F.count_if("correct").alias("n")), SWEEP)


@register(REPORTS, """
SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS median, max(value) AS largest FROM events GROUP BY event_type""")
def latency_upper_median(spark: SparkSession, sf: str) -> DataFrame:
    return Q.upper_median(table(spark, sf, "events").select("event_type", "value"), "value", ["event_type"])


@register(REPORTS, """
WITH o AS (SELECT doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN 'tp' WHEN quality = 0 THEN 'fp' WHEN toxic = 1 THEN 'fn' END AS outcome FROM labels),
n AS (SELECT doc_id, CASE WHEN toxic = 1 AND lang = 'en' THEN 'tp' WHEN lang = 'en' THEN 'fp' WHEN toxic = 1 THEN 'fn' END AS outcome FROM labels JOIN documents USING (doc_id)),
a AS (SELECT * FROM n WHERE outcome <> 'tp'), b AS (SELECT * FROM o WHERE outcome <> 'tp')
SELECT doc_id, outcome, 'new' AS state FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT doc_id, outcome, 'gone' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")  # fmt: skip
def except_mistakes(spark: SparkSession, sf: str) -> DataFrame:
    """Mistakes of two detectors of toxic texts, by quality and by language: the new ones and those that are gone."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    truth = F.col("toxic") == 1
    judged = lambda guess: rows.select("doc_id", F.when(guess & truth, "tp").when(guess, "fp").when(truth, "fn").alias("outcome"))
    new, gone = Q.mistakes_between(judged(F.col("quality") == 0), judged(F.coalesce(F.col("lang") == "en", F.lit(False))))
    return new.withColumn("state", F.lit("new")).unionByName(gone.withColumn("state", F.lit("gone")))


@register(REPORTS, LONG + """SELECT user_id, string_agg(type, ',' ORDER BY list_position(['EMAIL', 'TELEFONO', 'DNI', 'TARJETA'], type)) AS types
FROM (SELECT DISTINCT e.user_id, d.type FROM det_ d JOIN events_ e ON e.id = d.event_id) GROUP BY user_id""")  # fmt: skip
def ordered_distinct_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = detections(spark, sf).join(events(spark, sf).select(F.col("id").alias("event_id"), "user_id"), "event_id")
    return rows.groupBy("user_id").agg(F.array_join(R.ordered_types(("EMAIL", "TELEFONO", "DNI", "TARJETA")), ",").alias("types"))


SEED_SQL = """SELECT a.code, n.i AS number, a.code || '-' || lpad(CAST(n.i AS STRING), 3, '0') AS login, r.r_name AS region
FROM (VALUES (0, 'VEN', 7), (1, 'RRHH', 5), (2, 'FIN', 5), (3, 'MKT', 3), (4, 'SIS', 2)) AS a(idx, code, people)
JOIN region r ON r.r_regionkey = a.idx, LATERAL (SELECT explode(sequence(1, a.people)) AS i) AS n"""


@register(REPORTS, """
SELECT a.code, n.i::INTEGER AS number, a.code || '-' || lpad(n.i::VARCHAR, 3, '0') AS login, r.r_name AS region
FROM (VALUES (0, 'VEN', 7), (1, 'RRHH', 5), (2, 'FIN', 5), (3, 'MKT', 3), (4, 'SIS', 2)) AS a(idx, code, people)
JOIN region r ON r.r_regionkey = a.idx, LATERAL (SELECT unnest(range(1, a.people + 1)) AS i) AS n""")  # fmt: skip
def seed_people(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts of each area from a list of values, a series and a lateral join."""
    return spark.sql(SEED_SQL.replace("JOIN region r", "JOIN {region} r"), region=table(spark, sf, "region"))


@register(REPORTS, """
SELECT o_orderkey AS event_id, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE ['DNI', 'EMAIL'] END) AS type, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE ['eliminar', 'mantener'] END) AS action,
  unnest(CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE [o_custkey, o_orderkey % 9] END)::BIGINT AS amount FROM orders""")  # fmt: skip
def json_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Detections that arrive as a JSON array beside their event."""
    o = table(spark, sf, "orders")
    text = F.format_string('[{"type": "DNI", "action": "eliminar", "amount": %d}, {"type": "EMAIL", "action": "mantener", "amount": %d}]', "o_custkey", F.col("o_orderkey") % 9)
    return R.parse_detections(o.select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("[]")).otherwise(text).alias("detections")))


@register(REPORTS, BASE_SQL.replace("@LAST", str(LAST)) + """SELECT u.id, u.name, a.name AS area, u.active FROM users u LEFT JOIN areas a ON a.id = u.area_id WHERE u.org_id = 1""")
def employee_list(spark: SparkSession, sf: str) -> DataFrame:
    return R.employees(users(spark, sf).withColumn("role", F.lit("empleado")), areas(spark, sf), 1)
