"""Literal cases of the health-record jobs."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caretrail.functions import scalars as S
from caretrail.operators import merge, placement, rules, text, views


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("name", "value", "unit", "sex", "found"),
    [
        ("HbA1c", 6.5, "%", None, ["Type 2 diabetes mellitus"]),
        ("HbA1c", 6.0, "%", None, ["Pre-diabetes"]),
        ("HbA1c", 5.5, "%", None, []),
        ("GLYCATED HEMOGLOBIN", 7.0, "%", None, ["Type 2 diabetes mellitus"]),
        ("Fasting Glucose", 126.0, "mg/dL", None, ["Type 2 diabetes mellitus"]),
        ("Fasting Blood Glucose", 110.0, "mg/dL", None, ["Pre-diabetes"]),
        ("Fasting Glucose", 7.0, "mmol/L", None, ["Type 2 diabetes mellitus"]),
        ("Fasting Glucose", 6.0, "mmol/L", None, ["Pre-diabetes"]),
        ("LDL Cholesterol", 160.0, "mg/dL", None, ["Hyperlipidaemia"]),
        ("Total Cholesterol", 240.0, "mg/dL", None, ["Hyperlipidaemia"]),
        ("Hemoglobin", 12.5, "g/dL", "male", ["Anaemia"]),
        ("Hemoglobin", 12.5, "g/dL", "female", []),
        ("eGFR", 59.0, "mL/min", None, ["Chronic kidney disease"]),
    ],
)
def test_thresholds(spark, name, value, unit, sex, found):
    m = spark.createDataFrame([(1, 1, name, value, unit, "2020-01-01")], "record_id long, seq long, name string, value_numeric double, unit string, date string")
    c = spark.createDataFrame([], "record_id long, name_medical string")
    p = spark.createDataFrame([(1, sex)], "record_id long, sex string")
    out = rules.infer_conditions(m, c, p).collect()
    assert [r.name_medical for r in out] == found
    assert all(r.date_diagnosed == "2020-01-01" for r in out)


def test_one_hypertension(spark):
    m = spark.createDataFrame(
        [(1, 1, "Blood Pressure Systolic", 150.0, "mmHg", None), (1, 2, "Blood Pressure Diastolic", 95.0, "mmHg", "2020-01-02")],
        "record_id long, seq long, name string, value_numeric double, unit string, date string",
    )
    none = spark.createDataFrame([], "record_id long, name_medical string")
    assert [r.evidence for r in rules.infer_conditions(m, none).collect()] == ["Systolic BP 150 mmHg (≥140 mmHg threshold)"]
    known = spark.createDataFrame([(1, "High blood pressure")], "record_id long, name_medical string")
    assert rules.infer_conditions(m, known).count() == 0


def test_merge_does_not_depend_on_row_order(spark):
    data = [
        (1, 1, "HTN", "cardio", None, "2020-05-05", True, "documented"),
        (1, 2, "hypertension", "heart", "Heart", "2021-01-01", False, "resolved"),
        (1, 3, "Hypertension", "x", None, None, False, "suspected"),
    ]
    schema = "patient_id long, seq long, name_medical string, system string, organ string, date_diagnosed string, date_inherited boolean, status string"
    for order in (data, data[::-1]):
        out = merge.merge_conditions(spark.createDataFrame(order, schema).repartition(3)).orderBy("seq").collect()
        assert [(r.condition_key, r.date_diagnosed, r.status) for r in out] == [("hypertension||", "2020-05-05", "documented"), ("hypertension|heart|", "2021-01-01", "resolved")]


def test_dates(spark):
    d = spark.createDataFrame([("1982-MAR-17",), ("2020",), ("2017–2024",), ("x",), ("2020-02-30",)], "d string")
    got = rows(d.select(F.round(S.parse_date_frac(F.col("d")), 4), F.round(S.year_frac(F.col("d")), 4)))
    assert [g[0] for g in got] == [round(1982 + (2 * 30.44 + 17) / 365.25, 4), 2020.0, 2017.0, 0.0, round(2020 + (30.44 + 30) / 365.25, 4)]
    assert [g[1] for g in got] == [0.0, round(2020 + 182 / 366, 4), 0.0, 0.0, round(2020 + 60 / 366, 4)]


def test_redaction(spark):
    note = "Patient: Jane Roe\nDOB: 1980-01-02\nJane Roe felt well, glucose 126 mg/dL; jane ROE again. mail a.b@c.org"
    d = text.redact(spark.createDataFrame([(1, note), (2, None), (3, "姓名：王小明\n王小明 HbA1c 7")], "id long, text string"))
    got = {r.id: r for r in d.collect()}
    assert got[1].text == "[PATIENT NAME]\n[DATE OF BIRTH]\n[PATIENT NAME] felt well, glucose 126 mg/dL; [PATIENT NAME] again. mail [EMAIL]"
    assert got[2].text is None and got[2].edits == []
    assert got[3].text == "[PATIENT NAME]\n[PATIENT NAME] HbA1c 7"
    moved = d.where("id = 1").select(text.remap_offsets(F.array(F.lit(0), F.lit(18), F.lit(34)), F.col("edits"))).first()[0]
    assert moved == [0, 15, 31]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab \n", max_size=300), st.lists(st.tuples(st.sampled_from(["a", "ab", "zz", ""]), st.integers(-5, 400)), max_size=6), st.integers(5, 60), st.integers(0, 30))
def test_chunks_cover_the_text(body, heads, longest, shortest):
    sections = [{"heading": h, "startOffset": o, "sectionType": "labs", "inferredDate": None, "imageWorthy": False} for h, o in heads]
    parts = text.cut(body, sections, longest, shortest)
    assert "".join(body[a:b] for a, b, *_ in parts) == body
    assert all(b - a <= longest for a, b, *_ in parts)


@pytest.mark.parametrize(
    ("size", "opaque", "at", "to"),
    [((3, 3), [(2, 1)], (0, 0), (100, 50)), ((5, 5), [(0, 0), (2, 4)], (50, 50), (50, 100)), ((2, 2), [(1, 1)], (150, 150), (100, 100)), ((2, 2), [], (10, 10), (None, None))],
)
def test_mask_repair(spark, size, opaque, at, to):
    w, h = size
    alpha = bytearray(w * h)
    for x, y in opaque:
        alpha[y * w + x] = 255
    masks = spark.createDataFrame([("renal", w, h, bytes(alpha))], "system string, width int, height int, alpha binary")
    points = spark.createDataFrame([("renal", float(at[0]), float(at[1])), ("other", 1.0, 2.0)], "system string, cx double, cy double")
    got = {r.system: (r.cx, r.cy) for r in placement.repair_coordinates(points, masks).collect()}
    assert got == {"renal": to, "other": (1.0, 2.0)}


def test_placement_moves_collisions(spark):
    c = spark.createDataFrame([(1, "renal", f"c{i}", i, 50.0, 50.0) for i in range(4)] + [(1, "nervous", "n", 9, 50.0, 50.0)], "patient_id long, system string, condition_id string, seq long, cx double, cy double")
    got = {r.condition_id: (r.cx, r.cy) for r in placement.place_conditions(c, ["patient_id"]).collect()}
    assert got["c0"] == got["n"] == (50.0, 50.0)
    assert len({got[f"c{i}"] for i in range(4)}) == 4


def test_placement_takes_missing_points(spark):
    rows = [(1, "renal", "a", 1, None, None, "Nephrolithiasis", [(None, 7.0), (1.0, 2.0)]), (1, "kidney", "b", 2, float("nan"), 3.0, "x", []), (1, "odd", "c", 3, None, None, None, None)]
    c = spark.createDataFrame(rows, "patient_id long, system string, condition_id string, seq long, cx double, cy double, name_medical string, locations array<struct<cx:double,cy:double>>")
    got = {r.condition_id: r for r in placement.place_conditions(c, ["patient_id"]).collect()}
    assert got["a"].cy == 7.0 and got["a"].cx == placement._default("renal", "Nephrolithiasis:renal")[0]
    assert got["b"].cy == 3.0 and got["b"].cx == placement._default("renal", "x:kidney")[0]
    assert (got["c"].cx, got["c"].cy) == placement._default("integumentary", ":odd") and got["c"].locations == []
    assert [tuple(p) for p in got["a"].locations] == [(None, 7.0), (1.0, 2.0)]
    empty = spark.createDataFrame([], "system string, width int, height int, alpha binary")
    assert placement.place_conditions(c.limit(0), ["patient_id"], empty).count() == 0


def test_visibility_keeps_null_records(spark):
    c = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", None), (2, "d", 3)], "patient_id long, id string, record_id long")
    h = spark.createDataFrame([(1, 1, "demo"), (1, 2, None), (2, 3, "demo")], "patient_id long, id long, record_type string")
    assert sorted(r.id for r in views.visible_conditions(c, h).collect()) == ["b", "c", "d"]
    assert sorted(r.id for r in views.visible_conditions(c, h, "demo").collect()) == ["a", "d"]


def test_secondary_locations_are_whole(spark):
    """Each condition's second location at its default point and third at its own; the first is the primary one."""
    from pyspark.sql import functions as F

    from caretrail.functions import scalars
    from caretrail.plans import store_queries

    sf = "/root/testdata/sf0.001"
    e = store_queries._enriched(spark, sf)
    spot = scalars.default_position(scalars.normalize_system(F.col("system")), F.concat_ws(":", "name_medical", F.lit("Left"), F.lit(""), F.lit("1")))
    want = {}
    for r in e.select("condition_id", "seq", "cx", "cy", spot.alias("p")).collect():
        if r.seq % 4 > 1 and max(abs(r.p.cx - r.cx), abs(r.p.cy - r.cy)) >= 0.01:
            want[f"{r.condition_id}-loc-1"] = (r.p.cx, r.p.cy)
        if r.seq % 4 > 2:
            want[f"{r.condition_id}-loc-2"] = (r.cx + 2, r.cy)
    rows = store_queries.secondary_locations_all(spark, sf).collect()
    assert len(rows) == len(want) and {r.id: (r.cx, r.cy) for r in rows} == want
    assert len(rows) == store_queries.secondary_locations(spark, sf).count()


def test_cooldown_across_stretches(spark):
    """Against one pass over all calls; failures with a retry-after of their own."""
    import random

    r = random.Random(4)
    calls = [(k, r.choice("ab"), 1_700_000_000 + r.randrange(40_000), r.choice([200, 200, 429, 500]), r.choice([None, None, 5, 9000])) for k in range(1500)]
    df = spark.createDataFrame(calls, "seq long, model string, t long, http_status int, retry_after int").withColumn("ts", F.timestamp_seconds("t"))
    want, until = set(), {}
    for seq, model, t, status, retry in sorted(calls, key=lambda c: (c[2], c[0])):
        if t < until.get(model, 0):
            want.add(seq)
        if status == 429:
            until[model] = t + (60 if retry is None else retry)
    for span in ("1 hour", "1 minute", "1 day"):
        assert {x.seq for x in views.cooldown_blocked(df, 60.0, span).collect()} == want


def test_snap_with_ties(spark):
    rails = spark.createDataFrame([(1, 2000.0, 2010.0), (2, 2000.0, 2000.0)], "patient_id int, low double, high double")
    conditions = spark.createDataFrame([(1, "b", 2001.0), (1, "a", 2001.0), (1, "c", 2005.0), (1, "d", 1990.0), (1, "e", 1995.0), (2, "x", 2000.0), (2, "y", 1999.0)], "patient_id int, id string, year_frac double")
    probes = spark.createDataFrame([(0, 1, 2001.001), (1, 1, 2004.999), (2, 1, 2003.0), (3, 1, 1980.0), (4, 2, 2000.0), (5, 3, 2000.0)], "probe_id int, patient_id int, year double")
    got = {r.probe_id: r.snapped for r in views.snap_to_nearest(probes, conditions, rails).collect()}
    assert got == {0: 2001.0, 1: 2005.0, 2: 2003.0, 3: 2000.0, 4: 2000.0}  # clamped ends; no rail, no row


def test_merged_lists(spark):
    """Lists of three mentions are united with the events' people; a single mention's stay as they are."""
    p = lambda name, email=None: (name, None, email)
    mentions = [
        (1, 1, "Asthma", None, "2020-01-01", [p("Ann"), p("ann")], [("Clinic", "Rome")], [("seen", p("Eve"), ("Lab", None))], [("Left lung", None, None, None, None)], ["notes", "date_diagnosed"], {"fr": "asthme"}),
        (1, 2, "asthma", None, "2021-01-01", [p("ANN"), p("Bob")], [("CLINIC", "rome")], [("seen", p("Cy"), None)], [("left lung", "", 1.0, 2.0, "x")], [], None),
        (1, 3, "asthma", None, None, [p("Dan")], None, [("seen", p("Bob"), ("Lab", None))], None, ["date_onset"], None),
        (1, 4, "Gout", None, None, [p("Zed"), p("zed")], [], [("seen", p("Eve"), None)], [("Toe", None, None, None, None), ("toe", None, 1.0, None, None)], ["date_diagnosed"], None),
    ]
    provider, facility = "struct<name:string,specialty:string,email:string>", "struct<name:string,city:string>"
    df = spark.createDataFrame(mentions, f"patient_id int, seq int, name_medical string, organ string, date_diagnosed string, providers array<{provider}>, facilities array<{facility}>, care_events array<struct<event_type:string,provider:{provider},facility:{facility}>>, locations array<struct<anatomical_location:string,laterality:string,cx:double,cy:double,evidence:string>>, inferred_from_structure array<string>, local_names map<string,string>")
    out = {r.name_medical: r for r in merge.merge_conditions(df.withColumn("system", F.lit("other")).withColumn("status", F.lit("documented"))).collect()}
    a, g = out["Asthma"], out["Gout"]
    assert [x.name for x in a.providers] == ["Ann", "Bob", "Eve", "Cy", "Dan"] and [x.name for x in g.providers] == ["Zed", "zed"]
    assert [(x.name, x.city) for x in a.facilities] == [("Clinic", "Rome"), ("Lab", None)]
    assert [tuple(x) for x in a.locations] == [("Left lung", None, 1.0, 2.0, "x")] and [x.anatomical_location for x in g.locations] == ["Toe", "toe"]
    assert a.date_diagnosed == "2021-01-01" and a.inferred_from_structure == ["notes"] and g.inferred_from_structure == ["date_diagnosed"] and a.local_names == {"fr": "asthme"}
    assert len(a.care_events) == 3


def test_normalized_records(spark):
    """Measurements with the day of the run, and the record's own providers and facilities."""
    from caretrail.sources import store

    none = "array<struct<name:string,email:string,phone:string>>"
    enriched = spark.sql(f"""SELECT 1 AS patient_id, 7 AS record_id, '1:1' AS condition_id, 1 AS seq, 'Gout' AS name_medical, 'other' AS system, 'documented' AS status, CAST(NULL AS STRING) AS date_diagnosed, CAST(NULL AS STRING) AS date_onset,
      '' AS evidence, 1.0D AS cx, 2.0D AS cy, array(named_struct('event_type', 'treated', 'date', '2020', 'provider_name', 'Ann', 'facility_name', 'Lab')) AS care_events, CAST(array() AS {none}) AS providers,
      array(named_struct('name', 'Clinic')) AS facilities, CAST(array() AS array<struct<anatomical_location:string,laterality:string,cx:double,cy:double>>) AS locations""")
    measured = spark.createDataFrame([(1, 7, 1, "LDL", 170.0, "mg/dL", None, []), (1, 7, 0, "eGFR", 50.0, None, "2020-01-01", ["date"])], "patient_id int, record_id int, seq int, name string, value_numeric double, unit string, date string, inferred_from_structure array<string>")
    people = spark.createDataFrame([(1, 7, 0, "Ann", None, None), (1, 7, 1, "Bob", None, "5"), (1, 7, 2, "Bob", None, "5")], "patient_id int, record_id int, seq int, name string, email string, phone string")
    places = spark.createDataFrame([(1, 7, 0, " ", None, None, None, None), (1, 7, 1, "Lab", None, None, None, None)], "patient_id int, record_id int, seq int, name string, address string, city string, state string, country string")
    t = store.normalize(enriched, enriched.select("condition_id", "cx", "cy"), "2024-05-05", measured, people, places)
    assert sorted((r.id, r.name, r.date, r.inferred_fields) for r in t["measurements"].collect()) == [("7-measurement-0", "eGFR", "2020-01-01", ["date"]), ("7-measurement-1", "LDL", "2024-05-05", None)]
    assert sorted((r.id, r.name, r.condition_id) for r in t["providers"].collect()) == [("1:1-care-0-provider", "Ann", "1:1"), ("7-provider-0", "Bob", None)]
    assert sorted((r.id, r.condition_id) for r in t["facilities"].collect()) == [("1:1-facility-0", "1:1"), ("7-facility-0", None)]


def test_store_batches(spark, tmp_path):
    """Only touched buckets are written; a batch tried again changes nothing."""
    from caretrail.streaming import jobs

    df = lambda rows: spark.createDataFrame(rows, "id long, v string")
    root, seen = str(tmp_path), lambda: {r.id: r.v for r in jobs.read_snapshot(spark, root, "s").collect()}
    jobs.upsert_batch(df([(i, "a") for i in range(40)]), 0, root, "s", ["id"], 8)
    jobs.upsert_batch(df([(1, "b"), (99, "b")]), 1, root, "s", ["id"], 8)
    want = {i: "a" for i in range(40)} | {1: "b", 99: "b"}
    assert seen() == want and len(list((tmp_path / "s" / "batch=1").glob("bucket=*"))) <= 2
    jobs.upsert_batch(df([(1, "b"), (99, "b")]), 1, root, "s", ["id"], 8)
    assert seen() == want


def test_one_key_twice_in_a_batch(spark, tmp_path):
    """The winner does not depend on the order of rows: the caller's order, else the larger row."""
    from caretrail.streaming import jobs

    root, seen = str(tmp_path), lambda s: {r.id: (r.v, r.seq) for r in jobs.read_snapshot(spark, root, s).collect()}
    rows = [(1, "new", 5), (1, "old", 9), (2, "a", None), (2, "b", 0)]
    for k, turned in enumerate((rows, rows[::-1])):
        df = spark.createDataFrame(turned, "id long, v string, seq int").repartition(3)
        jobs.upsert_batch(df, 0, root, f"plain{k}", ["id"], 4)
        jobs.upsert_batch(df, 0, root, f"ordered{k}", ["id"], 4, order="seq")
        assert seen(f"plain{k}") == {1: ("old", 9), 2: ("b", 0)} and seen(f"ordered{k}") == {1: ("old", 9), 2: ("b", 0)}
    jobs.upsert_batch(spark.createDataFrame([(1, "late", 1)], "id long, v string, seq int"), 1, root, "ordered0", ["id"], 4, order="seq")
    assert seen("ordered0")[1] == ("late", 1)


def test_validation_checks_every_field(spark):
    from caretrail.sources import backup

    records = spark.createDataFrame([(1, "r", None)], "patient_id int, id string, filename string")
    conditions = spark.createDataFrame([(1, "a", "r", "Gout", "documented", "1.5"), (1, "b", "r", None, "odd", "x")], "patient_id int, id string, record_id string, name_medical string, status string, cx string")
    found = {(r.store, r.field, r.id, r.rule) for r in backup.validate_backup({"health_records": records, "conditions": conditions}).collect()}
    assert found == {("health_records", "filename", "r", "value"), ("conditions", "name_medical", "b", "value"), ("conditions", "status", "b", "value"), ("conditions", "cx", "b", "number")}


def test_evidence_dates(spark):
    """Values that are parts of the evidence's numbers count; the first by seq wins."""
    inferred = spark.createDataFrame([(1, 5, "LDL 170 mg/dL (≥160 threshold)"), (1, 6, "HbA1c 6.5% (≥6.5% threshold)"), (2, 1, "none")], "record_id int, seq int, evidence string")
    m = spark.createDataFrame([(1, 1, 17.0, "mg/dL", "2001-01-01"), (1, 0, 70.0, "mmol", "1999-01-01"), (1, 2, 170.0, "mg/dL", "2002-01-01"), (1, 3, 6.5, "%", None), (1, 4, 5.0, "%", "2004-01-01"), (2, 1, None, "x", "2000-01-01")], "record_id int, seq int, value_numeric double, unit string, date string")
    got = {(r.record_id, r.seq): r.date_diagnosed for r in rules.attach_measurement_date(inferred, m, ["record_id"]).collect()}
    assert got == {(1, 5): "2001-01-01", (1, 6): None, (2, 1): None}


def test_whole_document_answers(spark):
    content = """{"schema_version":1,"report_context":{"providers":[{"name":1},{"name":"Dr. Report","specialty":null,"email":null,"phone":null,"evidence":null}],
      "facilities":[{"name":"Clinic","address":null,"city":"Rome","state":null,"country":null}]},
      "conditions":[{"name_medical":"Gout","system":"other","severity":"mild","date_diagnosed":"2020-01-01","cx":"bad","source_pages":[1,2],"provenance":["p"],"local_names":{"fr":"goutte"}},
       {"name_medical":"Asthma","provider":{"name":"Dr. Own"},"care_events":[{"event_type":"treated","date":"2019","provider":{"name":"X"},"facility":{"name":"Clinic"}}],"date_onset":"2018","cx":3}],
      "measurements":[{"name":"LDL","value_numeric":170,"unit":"mg/dL","reference_high":160.5,"flag":"H"}]}"""
    rest = [(2, "no json"), (3, '{"schema_version":2,"conditions":[],"measurements":[]}'), (4, '{"schema_version":1,"conditions":[]}'), (5, None)]
    out = text.parse_longitudinal_full(spark.createDataFrame([(1, content), *rest], "document int, content string"), ["document"])
    gout, asthma = sorted(out["conditions"].collect(), key=lambda r: r["index"])
    assert (gout.name_medical, gout.severity, gout.cx, gout.source_pages, gout.local_names) == ("Gout", "mild", None, [1, 2], {"fr": "goutte"})
    assert gout.provider.name == "Dr. Report" and gout.provenance == ["p", "provider:report_context", "facility:report_context"]
    assert [(e.event_type, e.date, e.provider.name, e.facility.name) for e in gout.care_events] == [("other", "2020-01-01", "Dr. Report", "Clinic")]
    assert asthma.provider.name == "Dr. Own" and asthma.cx == 3.0 and len(asthma.care_events) == 1 and asthma.provenance == ["facility:report_context"]
    assert [(r.name, r.value_numeric, r.reference_high, r.flag) for r in out["measurements"].collect()] == [("LDL", 170.0, 160.5, "H")]
    assert [r.name for r in out["providers"].collect()] == ["Dr. Report"] and [r.city for r in out["facilities"].collect()] == ["Rome"]


def test_conditions_from_summaries(spark):
    s = spark.createDataFrame([(1, 0, "Gout", None, "2020", True, "Ann", "Lab"), (1, 1, "Asthma", None, None, False, "Bob", None)], "patient_id int, index int, name_medical string, notes string, earliest_date string, earliest_date_inherited boolean, provider string, facility string")
    a = spark.createDataFrame([(1, 0, "musculoskeletal", "suspected", "toe", "Toe", "left", 5.0, 6.0)], "patient_id int, index int, system string, status string, organ string, anatomical_location string, laterality string, cx double, cy double")
    gout, asthma = sorted(views.join_anatomy(s, a).collect(), key=lambda r: r["index"])
    assert (gout.status, gout.organ, gout.date_diagnosed, gout.inferred_from_structure, gout.cx) == ("suspected", "toe", "2020", ["date_diagnosed"], 5.0)
    assert [tuple(x) for x in gout.locations] == [("Toe", "left", 5.0, 6.0, None)] and [x.name for x in gout.facilities] == ["Lab"]
    assert [(e.event_type, e.date, e.provider.name, e.facility.name) for e in gout.care_events] == [("other", "2020", "Ann", "Lab")]
    assert (asthma.status, asthma.care_events, asthma.locations, asthma.inferred_from_structure, asthma.facilities) == ("documented", [], [], [], []) and [x.name for x in asthma.providers] == ["Bob"]
