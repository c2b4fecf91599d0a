"""Charts and reports on small tables with known results."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import charts as C
from sparkveil.operators import report as R

SALES = [
    (0, "01/01/2025", "Ana", "Córdoba", "30111222", "$ 100.000"),
    (1, "15/01/2025", "Ana", "cordoba ", "30111223", "$ 50.000"),
    (2, "10/03/2025", "Luis", "Salta", "30111224", "$ 200.000"),
    (3, "12/04/2025", "Luis", "Córdoba", "30111225", "sin dato"),
    (4, None, "Eva", None, "30111226", "$ 10"),
    (5, "20/04/2025", "Eva", "CÓRDOBA", "30111227", "$ 40.000"),
]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALES, "_row int, Fecha string, Cliente string, Provincia string, `DNI contacto` string, Monto string")


def test_profile_and_suggestions(sales):
    found = C.profile_columns(sales, ["Fecha", "Cliente", "Provincia", "DNI contacto", "Monto"])
    assert [p.kind for p in found] == ["fecha", "categoria", "categoria", "otro", "numero"] and found[4].money and found[2].distinct == 3
    specs = C.suggest_charts(found)
    assert specs[0] == C.ChartSpec(0, 4, "suma") and specs[-1].measure is None and len(specs) == 4


def test_gaps_are_zero_and_bad_measures_drop(sales):
    got = [(r.key, r.label, r.value) for r in C.time_chart(sales, "Fecha", "Monto", C.SUM).collect()]
    assert got == [("2025-01", "ene 25", 150000), ("2025-02", "feb 25", 0), ("2025-03", "mar 25", 200000), ("2025-04", "abr 25", 40000)]
    few = C.time_chart(sales.where("_row < 2"), "Fecha", None, C.COUNT).collect()
    assert len(few) == 15 and few[0].label == "1 ene" and sum(r.value for r in few) == 2
    assert C.time_chart(sales.where("_row = 4"), "Fecha", "Monto", C.SUM).count() == 0


def test_ranking_keeps_the_first_label(sales):
    got = [(r["rank"], r.label, r.value) for r in C.ranking_chart(sales, "Provincia", "Monto", C.SUM, "_row", top=2).collect()]
    assert got == [(1, "Salta", 200000), (2, "Córdoba", 140000), (3, "Otras (1)", 50000)]
    assert C.ranking_chart(sales, "Provincia", "Monto", C.AVERAGE, "_row", top=2).count() == 2


def test_summary_and_variation(sales):
    s = C.numeric_summary(sales, "Monto", "_row").first()
    assert (s["count"], s.total, s.max_row, s.min_row) == (5, 390010, 2, 4)
    v = C.variation(C.time_chart(sales, "Fecha", "Monto", C.SUM)).first()
    assert (v.from_key, v.to_key) == ("2025-01", "2025-04") and round(v.pct, 1) == -73.3
    assert C.numeric_summary(sales, "Cliente", "_row").count() == 0


def test_comparisons(sales):
    got = [(r.label, r.a, r.b) for r in C.compare_periods(sales, "Fecha", "2025-01", "2025-04", "Monto", C.SUM, "Cliente", "_row").collect()]
    assert got == [("Ana", 150000, 0), ("Eva", 0, 40000)]
    rows = C.compare_categories(sales, "Provincia", "salta", "córdoba", "Fecha", "Monto", C.SUM).collect()
    assert [(r.key, r.a, r.b) for r in rows] == [("2025-01", 0, 100000), ("2025-03", 200000, 0), ("2025-04", 0, 40000)]
    assert C.compare(sales, "Monto", C.SUM, F.col("Cliente") == "Nadie", F.col("Cliente") == "Ana").first().pct is None
    assert [r.label for r in C.category_options(sales, "Cliente", "_row").collect()] == ["Ana", "Luis", "Eva"]


@pytest.fixture(scope="module")
def world(spark):
    areas = spark.createDataFrame([(k, 1, n) for k, n in enumerate(["Ventas", "RRHH", "Legal", "Vacía"])], "id int, org_id int, name string")
    users = spark.createDataFrame([(u, 1, u // 4 if u < 8 else 2, f"u{u}", True) for u in range(10)], "id int, org_id int, area_id int, name string, active boolean")
    ev = [(i, 1, (i % 10) // 4 if i % 10 < 8 else 2, i % 10, datetime(2025, 1 + i % 3, 10, 23), "extension", i % 2 == 0, "ignorado" if i % 4 == 0 else "protegido", "a.com", "texto") for i in range(30)]
    events = spark.createDataFrame([*ev, (99, 2, 0, 0, datetime(2025, 1, 1), "web", True, None, None, "texto")], "id int, org_id int, area_id int, user_id int, ts timestamp, origin string, sensitive boolean, decision string, site string, input_kind string")
    det = spark.createDataFrame([(i, ["EMAIL", "DNI"][i % 2], ["eliminar", "mantener"][i % 2], 2) for i in range(30)] + [(0, "IP", "anonimizar", 5), (99, "IP", "eliminar", 7)], "event_id int, type string, action string, amount int")
    incidents = spark.createDataFrame([(1, 1, 0, "confirmado", datetime(2025, 1, 11))], "id int, org_id int, event_id int, state string, ts timestamp")
    return areas, users, events, det, incidents


def test_small_groups_are_merged_or_left_out(world):
    areas, _users, events, det, incidents = world
    ev = R.events_in(events, 1, date(2025, 1, 1), date(2025, 3, 10))
    own = R.detections_of(det, ev)
    t = R.totals(ev, own, incidents).first()
    assert (t.events, t.detections, t.blocked, t.anonymized, t.allowed, t.sent_outside, t.incidents_confirmed) == (30, 65, 30, 5, 30, 8, 1)
    raw = R.by_area_raw(ev, own, areas)
    assert {r.area: r.persons for r in raw.collect()} == {"Ventas": 4, "RRHH": 4, "Legal": 2}
    assert [r.area for r in R.by_area(raw, 3).collect()] == ["Ventas", "RRHH"] and R.areas_left_out(raw, 3).first()[0] == 1
    assert [(r.area, r.events) for r in R.by_area(raw, 5).collect()] == [("Otras áreas", 30)] and R.areas_left_out(raw, 5).first()[0] == 0
    assert R.areas_left_out(raw, 1).first()[0] == 0
    assert [r.month for r in R.by_month(own).collect()] == ["2025-01", "2025-02", "2025-03"]
    report = R.nested_report(ev, own, areas, incidents, 5).first().report
    assert '"areas_left_out":0' in report and '"min_group":5' in report


def test_detail_does_not_count_twice(world):
    areas, users, events, det, _ = world
    ev = R.events_in(events, 1, date(2025, 1, 1), date(2025, 3, 31))
    rows = R.user_detail(ev, R.detections_of(det, ev), users, areas).collect()
    assert sum(r.events for r in rows) == 30 and sum(r.detections for r in rows) == 65


def test_risk_list(world):
    areas, users, events, det, incidents = world
    rows = R.risk_events(events, det, users, areas, incidents, k=3).collect()
    by = {r.event_id: r for r in rows}
    assert len(rows) == 8 and by[0].types == ["EMAIL", "IP"] and by[0].incident_state == "confirmado" and by[8].area == "Otras áreas" and by[0].area == "Ventas"


def test_ranges_rows_and_policies(spark, world):
    with pytest.raises(ValueError):
        R.check_range(date(2025, 1, 2), date(2025, 1, 1))
    with pytest.raises(ValueError):
        R.check_range(date(2020, 1, 1), date(2025, 1, 1))
    assert R.secured(world[2], 2, ["id"]).columns == ["id"] and R.secured_detections(world[3], R.secured(world[2], 2)).count() == 1
    raw = spark.createDataFrame([(1, "EMAIL", "eliminar", 2), (1, "EMAIL", "eliminar", 3), (1, "NADA", "eliminar", 3), (1, "DNI", "eliminar", 0)], "event_id int, type string, action string, amount int")
    assert [r.amount for r in R.ingest_detections(R.valid_detections(raw)).collect()] == [5]
    policy = spark.createDataFrame([("EMAIL", "eliminar")], "type string, action string")
    got = {r.type: (r.action, r.enforced) for r in R.policy_actions(policy, {"EMAIL": "anonimizar", "DNI": "seudonimizar"}).collect()}
    assert got == {"EMAIL": ("eliminar", True), "DNI": ("seudonimizar", False)}
    changed = R.upsert(policy, spark.createDataFrame([("EMAIL", None), ("IP", "mantener")], "type string, action string"), ["type"])
    assert [tuple(r) for r in changed.collect()] == [("IP", "mantener")]
    events = spark.createDataFrame([("extension", "a.com", 1, "csv"), ("web", "a.com", 1, None), ("web", None, -1, None), ("web", None, None, "CSV!")], "origin string, site string, rows int, extension string")
    fine, bad = R.split_valid(events, R.valid_event())
    assert (fine.count(), bad.count()) == (1, 3)
