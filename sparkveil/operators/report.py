"""Usage reports over metadata events, without showing groups too small to hide a person.

Tables (columns as named here): events (id, org_id, area_id, user_id, ts, origin, sensitive, decision, site, input_kind),
detections (event_id, type, action, amount), areas (id, org_id, name), users (id, org_id, area_id, name, active),
incidents (id, org_id, event_id, state, ts, updated). Every report is a lazy plan: the range filter stands below the joins,
dimension tables are small and Spark broadcasts them by size.
"""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold
from ..types import ACTIONS, ANONYMIZE, DROP, KEEP, PSEUDONYMIZE, TYPES

# The range cap, the row cap of the risk list, the merged group's name and the limits of an event.
MAX_DAYS, MAX_RISK_EVENTS, OTHER_AREAS, MIN_GROUP = 731, 200, "Otras áreas", 5
MAX_DETECTIONS, MAX_AMOUNT = 100, 10_000_000


def check_range(first: date, last: date) -> None:
    if last < first or (last - first).days > MAX_DAYS:
        raise ValueError("invalid range of dates (two years at most)")


def in_range(ts: Column, first: date, last: date) -> Column:
    """From the first day to the end of the last one."""
    check_range(first, last)
    return (ts >= F.lit(first)) & (ts < F.date_add(F.lit(last), 1))


def events_in(events: DataFrame, org: object, first: date, last: date) -> DataFrame:
    return events.where((F.col("org_id") == org) & in_range(F.col("ts"), first, last))


def detections_of(detections: DataFrame, events: DataFrame) -> DataFrame:
    """Detections of those events, with their area and time."""
    return detections.join(events.select(F.col("id").alias("event_id"), "area_id", "ts"), "event_id")


def totals(events: DataFrame, det: DataFrame, incidents: DataFrame | None = None) -> DataFrame:
    """One row; the three inputs are aggregated each on its own grain."""
    e = events.agg(F.count("*").alias("events"), F.count_if("sensitive").alias("events_sensitive"), F.count_if((F.col("origin") == "extension") & (F.col("decision") == "ignorado")).alias("sent_outside"))
    amount = lambda *actions: F.coalesce(F.sum(F.when(F.col("action").isin(*actions), F.col("amount"))), F.lit(0)).cast("long")
    d = det.agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("long").alias("detections"), amount(DROP).alias("blocked"), amount(ANONYMIZE, PSEUDONYMIZE).alias("anonymized"), amount(KEEP).alias("allowed"))
    out = e.crossJoin(d)
    if incidents is not None:
        out = out.crossJoin(incidents.agg(F.count_if(F.col("state") == "confirmado").alias("incidents_confirmed")))
    return out


def by_month(det: DataFrame, zone: str | None = None) -> DataFrame:
    ts = F.from_utc_timestamp("ts", zone) if zone else F.col("ts")
    return det.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.sum("amount").cast("long").alias("detections")).orderBy("month")


def by_type(det: DataFrame) -> DataFrame:
    return det.groupBy("type").agg(F.sum("amount").cast("long").alias("amount")).orderBy(F.desc("amount"), "type")


def by_area_raw(events: DataFrame, det: DataFrame, areas: DataFrame) -> DataFrame:
    """area, persons, events, detections of areas with events."""
    e = events.groupBy("area_id").agg(F.countDistinct("user_id").alias("persons"), F.countDistinct("id").alias("events"))
    d = det.groupBy("area_id").agg(F.sum("amount").cast("long").alias("detections"))
    named = areas.select(F.col("id").alias("area_id"), F.col("name").alias("area"))
    return named.join(e, "area_id").join(d, "area_id", "left").select("area", "persons", "events", F.coalesce("detections", F.lit(0)).cast("long").alias("detections"))


def by_area(raw: DataFrame, k: int = MIN_GROUP) -> DataFrame:
    """Areas of ``k`` persons or more; the others merged, and shown only if they reach ``k`` together."""
    large = F.col("persons") >= k
    merged = raw.where(~large).agg(F.sum("persons").alias("persons"), F.sum("events").alias("events"), F.sum("detections").alias("detections")).where(large)
    other = merged.select(F.lit(OTHER_AREAS).alias("area"), "events", "detections")
    return raw.where(large).select("area", "events", "detections").unionByName(other).orderBy(F.desc("detections"), "area")


def areas_left_out(raw: DataFrame, k: int = MIN_GROUP) -> DataFrame:
    """How many areas are in no row of ``by_area``."""
    small = F.col("persons") < k
    out = raw.agg(F.sum(F.when(small, F.col("persons"))).alias("p"), F.count_if(small).alias("n"))
    return out.select(F.when(F.col("p") < k, F.col("n")).otherwise(0).cast("long").alias("areas_left_out"))


def user_detail(events: DataFrame, det: DataFrame, users: DataFrame, areas: DataFrame) -> DataFrame:
    """Per user and area name; detections are summed per event before the join, so nothing is counted twice."""
    per_event = det.groupBy("event_id").agg(F.sum("amount").alias("amount"))
    e = events.join(users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name")), "user_id").join(areas.select(F.col("id").alias("area_id"), F.col("name").alias("area")), "area_id", "left")
    e = e.join(per_event, e["id"] == per_event["event_id"], "left")
    out = e.groupBy("user_name", "area").agg(F.countDistinct("id").alias("events"), F.coalesce(F.sum("amount"), F.lit(0)).cast("long").alias("detections"), F.countDistinct(F.when(F.col("decision") == "ignorado", F.col("id"))).alias("ignored_warnings"))
    return out.orderBy(F.desc("detections"), "user_name", "area")


def ordered_types(type_order: tuple[str, ...] = TYPES, column: str = "type") -> Column:
    """Aggregate: the distinct types of a group, in the order given."""
    place = F.array_position(F.array(*map(F.lit, type_order)), F.col(column))
    return F.transform(F.array_sort(F.collect_set(F.struct(place.alias("o"), F.col(column).alias("t")))), lambda x: x["t"])


def not_listed(rows: DataFrame, listed: DataFrame, column: str, listed_column: str | None = None) -> DataFrame:
    """``rows`` whose value is in no row of ``listed``, whatever the case and accents; a null value is never listed."""
    own = listed.select(fold(F.col(listed_column or column).cast("string")).alias("sv_fold")).where("sv_fold is not null").distinct()
    return rows.join(own, fold(rows[column].cast("string")) == own["sv_fold"], "left_anti")


def risk_events(events: DataFrame, detections: DataFrame, users: DataFrame, areas: DataFrame, incidents: DataFrame, k: int = MIN_GROUP, limit: int = MAX_RISK_EVENTS, type_order: tuple[str, ...] = TYPES) -> DataFrame:
    """The newest events whose warning was ignored, without user or time of day. The row cap is the feature: the newest
    are picked first, and only their detections are joined."""
    newest = events.where(F.col("decision") == "ignorado").orderBy(F.desc("ts"), "id").limit(limit)
    active = users.where("active").groupBy("area_id").agg(F.count("*").alias("active_users"))
    named = areas.select(F.col("id").alias("area_id"), "name").join(active, "area_id", "left")
    det = detections.join(newest.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    found = det.groupBy("event_id").agg(ordered_types(type_order).alias("types"), F.sum("amount").cast("long").alias("detections"))
    inc = incidents.where("event_id is not null").select("event_id", F.col("id").alias("incident_id"), F.col("state").alias("incident_state"))
    out = newest.withColumnRenamed("id", "event_id").join(named, "area_id", "left").join(found, "event_id", "left").join(inc, "event_id", "left")
    return out.select(
        "event_id", F.to_date("ts").alias("day"), F.when(F.col("active_users") >= k, F.col("name")).otherwise(OTHER_AREAS).alias("area"), "site", "input_kind",
        F.coalesce("types", F.array().cast("array<string>")).alias("types"), F.coalesce("detections", F.lit(0)).cast("long").alias("detections"), "incident_id", "incident_state",
    )


def secured(table: DataFrame, org: object, columns: list[str] | None = None, user: object | None = None) -> DataFrame:
    """What a role may read: rows of one organisation (and user), and the granted columns only."""
    rows = table.where(F.col("org_id") == org)
    rows = rows if user is None else rows.where(F.col("user_id") == user)
    return rows.select(*columns) if columns else rows


def secured_detections(detections: DataFrame, own_events: DataFrame) -> DataFrame:
    """Detections of readable events (EXISTS)."""
    return detections.join(own_events.select(F.col("id").alias("event_id")), "event_id", "left_semi")


def valid_event() -> Column:
    """The constraints of an event: sites and extensions by pattern, a site if and only if it comes from the extension."""
    site = F.col("site").rlike(r"^[a-z0-9.-]{1,100}$")
    return ((F.col("origin") == "extension") == F.col("site").isNotNull()) & (F.col("site").isNull() | site) & (F.col("rows").isNull() | (F.col("rows") >= 0)) & (F.col("extension").isNull() | F.col("extension").rlike(r"^[a-z0-9]{1,10}$"))


def split_valid(rows: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows)."""
    fine = F.coalesce(rule, F.lit(False))
    return rows.where(fine), rows.where(~fine)


def valid_detections(detections: DataFrame) -> DataFrame:
    """Known types and actions, amounts from 1 to ten million."""
    return detections.where(F.col("type").isin(*TYPES) & F.col("action").isin(*ACTIONS) & F.col("amount").between(1, MAX_AMOUNT))


def ingest_detections(raw: DataFrame) -> DataFrame:
    """Repeated (event, type, action) rows become one, their amounts summed."""
    return raw.groupBy("event_id", "type", "action").agg(F.sum("amount").cast("long").alias("amount"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``changes`` replace rows of equal keys; a change whose other columns are all null deletes."""
    rest = [c for c in table.columns if c not in keys]
    gone = F.coalesce(*[F.col(c).cast("string") for c in rest]).isNull() if rest else F.lit(False)
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes.where(~gone).select(*table.columns))


def latest_state(history: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last row of each key: aggregated before the shuffle, no sort."""
    rest = [c for c in history.columns if c not in keys]
    last = history.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("x"))
    return last.select(*keys, "x.*")


def policy_actions(policy: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """type, action, enforced: the company's policy before the suggestion."""
    spark = policy.sparkSession
    base = spark.createDataFrame(list(defaults.items()), "type string, suggested string")
    return base.join(policy.select("type", F.col("action").alias("own")), "type", "left").select("type", F.coalesce("own", "suggested").alias("action"), F.col("own").isNotNull().alias("enforced"))


def shares(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with their rounded share of the total in percent; null if it is 0."""
    total = F.broadcast(rows.agg(F.sum(value).alias("sv_total")))  # one row
    share = F.when(F.col("sv_total") != 0, F.floor(F.col(value) * 100.0 / F.col("sv_total") + 0.5).cast("long"))
    return rows.crossJoin(total).withColumn("share", share).drop("sv_total")


def nested_report(events: DataFrame, det: DataFrame, areas: DataFrame, incidents: DataFrame | None = None, k: int = MIN_GROUP) -> DataFrame:
    """All sections as one JSON document. Their rows are bounded by months, types and areas."""
    raw = by_area_raw(events, det, areas)
    listed = lambda df, order: df.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*df.columns).alias("x")))), lambda y: y["x"])).alias("j"))
    parts = {
        "totals": totals(events, det, incidents).select(F.to_json(F.struct("*")).alias("j")),
        "by_month": listed(by_month(det), F.col("month")),
        "by_type": listed(by_type(det), -F.col("amount")),
        "by_area": listed(by_area(raw, k), -F.col("detections")),
        "areas_left_out": areas_left_out(raw, k).select(F.col("areas_left_out").cast("string").alias("j")),
    }
    out = None
    for name, df in parts.items():
        one = df.withColumnRenamed("j", name)
        out = one if out is None else out.crossJoin(one)
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), F.col(n)) for n in parts])
    return out.select(F.concat(F.lit("{"), body, F.lit(f',"min_group":{k}}}')).alias("report"))


def employees(users: DataFrame, areas: DataFrame, org: object, role: str = "empleado") -> DataFrame:
    """The employees of an organisation with their area, if any; active ones first, then by name."""
    named = areas.select(F.col("id").alias("area_id"), F.col("name").alias("area"))
    own = users.where((F.col("org_id") == org) & (F.col("role") == role))
    return own.join(named, "area_id", "left").select("id", "name", "area", "active").orderBy(F.desc("active"), "name", "id")


def whoami(users: DataFrame, orgs: DataFrame, areas: DataFrame, user: object | None = None) -> DataFrame:
    """A user (or every user) with organisation and area; users without an organisation don't appear."""
    some = users if user is None else users.where(F.col("id") == user)
    named = some.join(orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org")), "org_id")
    return named.join(areas.select(F.col("id").alias("area_id"), F.col("name").alias("area")), "area_id", "left").select("id", "name", "org", "area")


def partial_months(by_month: DataFrame, first: date, last: date, month: str = "month") -> DataFrame:
    """``by_month`` (months as yyyy-MM) with ``partial``: the period begins after the month's first day or ends before its last."""
    start = F.to_date(F.concat(month, F.lit("-01")))
    lo, hi = F.lit(first), F.lit(last)
    return by_month.withColumn("partial", ((F.trunc(lo, "month") == start) & (lo > start)) | ((F.trunc(hi, "month") == start) & (hi < F.last_day(start))))


class NotAllowed(PermissionError):
    """``code`` is that of SQL: 28000 for an unknown user, 42501 for one without the right."""

    def __init__(self, code: str, text: str):
        super().__init__(text)
        self.code = code


def require(users: DataFrame, user: object, roles: tuple[str, ...] = (), verified: bool = True) -> dict:
    """The active user of that id, for a report to be built for; raises ``NotAllowed`` before any plan is made."""
    found = users.where((F.col("id") == user) & F.col("active")).limit(1).collect()
    if not found:
        raise NotAllowed("28000", "no active user")
    if roles and found[0]["role"] not in roles:
        raise NotAllowed("42501", f"only for {', '.join(roles)}")
    if roles and not verified:
        raise NotAllowed("42501", "a second factor is asked for")
    return found[0].asDict()


def audit(spark: SparkSession, path: str, user: object, action: str, detail: dict | None = None) -> None:
    """Appends one row (user_id, action, detail as JSON, ts) to the log of reads and changes."""
    row = spark.range(1).select(F.lit(user).alias("user_id"), F.lit(action).alias("action"), F.lit(json.dumps(detail or {}, ensure_ascii=False)).alias("detail"), F.current_timestamp().alias("ts"))
    row.write.mode("append").parquet(path)


def parse_detections(events: DataFrame, column: str = "detections", event: str = "event_id") -> DataFrame:
    """Events with their detections as a JSON array -> (event_id, type, action, amount); no array, no rows."""
    kind = "array<struct<type:string,action:string,amount:bigint>>"
    return events.select(F.col(event).alias("event_id"), F.inline(F.from_json(F.col(column), kind)))


def same_values(a: DataFrame, b: DataFrame) -> bool:
    """Whether two one-column tables hold the same values, each as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
