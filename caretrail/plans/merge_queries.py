"""Queries of the merging, attribution and rule operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caretrail import reference_data as R
from caretrail.functions import scalars as S
from caretrail.operators import merge as M
from caretrail.operators import rules
from caretrail.plans.bindings import bind, view_sql

C = F.col
_NKEY = "trim(regexp_replace(lower(trim({})), '[^a-z0-9]+', ' ', 'g'))"
_KEY = f"concat({_NKEY.format('name_medical')}, '|', {_NKEY.format(chr(99) + 'oalesce(organ, chr(32))')}, '|')"  # no alias occurs among the part names
_MENTIONS = view_sql("condition_mentions")


def _mentions(spark, sf):
    return bind(spark, sf, "condition_mentions")


def merge_conditions(spark, sf):
    m = M.merge_conditions(_mentions(spark, sf), ["patient_id"])
    return m.select("patient_id", "condition_key", "n_mentions", "name_medical", "system", "organ", "status", "date_diagnosed", "provider_name", "facility_name")


MERGED_SQL = f"""merged AS (SELECT patient_id, {_KEY} AS condition_key, count(*)::BIGINT AS n_mentions, min(seq) AS seq, arg_min(name_medical, seq) AS name_medical, arg_min(system, seq) AS system,
 arg_min(organ, seq) FILTER (organ IS NOT NULL) AS organ,
 arg_max(status, (coalesce(date_diagnosed, ''), seq)) AS status,
 coalesce(min(date_diagnosed) FILTER (NOT date_inherited), min(date_diagnosed) FILTER (date_inherited)) AS date_diagnosed,
 arg_min(provider_name, seq) AS provider_name, arg_min(facility_name, seq) AS facility_name FROM condition_mentions GROUP BY 1, 2)"""


def latest_status(spark, sf):
    return _mentions(spark, sf).groupBy("patient_id", "name_medical").agg(M.latest_status("date_diagnosed").alias("status"))


def _located(spark, sf):
    m = _mentions(spark, sf)
    return m.select(
        "patient_id", "seq", "name_medical", "system", "organ", "provider_name", "date_diagnosed",
        F.when(C("seq") % 5 == 0, F.substring("date_diagnosed", 1, 4)).when(C("seq") % 5 == 1, F.lit("2001-02")).alias("date_onset"),
        F.when(C("seq") % 2 == 0, C("facility_name")).alias("anatomical_location"), F.when(C("seq") % 3 > 0, C("status")).otherwise("").alias("evidence"),
    )


_LOCATED_SQL = """, x AS (SELECT patient_id, seq, name_medical, system, organ, provider_name, date_diagnosed,
 CASE WHEN seq % 5 = 0 THEN substring(date_diagnosed, 1, 4) WHEN seq % 5 = 1 THEN '2001-02' END AS date_onset, CASE WHEN seq % 2 = 0 THEN facility_name END AS anatomical_location,
 CASE WHEN seq % 3 > 0 THEN status ELSE '' END AS evidence FROM condition_mentions),
v AS (SELECT *, CASE WHEN regexp_matches(date_onset, '^\\d{4}(-\\d{2}-\\d{2})?$') THEN date_onset END AS o FROM x)
"""


def merge_longitudinal_located(spark, sf):
    return M.merge_longitudinal_located(_located(spark, sf), ["patient_id"])


def merge_longitudinal_pages(spark, sf):
    m = _mentions(spark, sf).withColumn("source_pages", F.array((C("seq") % 4 + 1).cast("int"), (C("record_id") % 3 + 1).cast("int")))
    return M.merge_longitudinal_pages(m, ["patient_id"]).withColumn("source_pages", F.array_join("source_pages", ","))


def _summaries(spark, sf):
    return _mentions(spark, sf).select(
        "patient_id", (C("seq") - 1).alias("index"), "name_medical", C("date_diagnosed").alias("earliest_date"),
        F.when(C("seq") % 3 == 0, F.lit("2000-01-01")).when(C("seq") % 3 == 1, F.lit("")).alias("section_date"), F.when(C("seq") % 2 == 0, C("status")).alias("notes"),
        F.when(C("seq") % 4 == 0, C("provider_name")).alias("provider"), F.when(C("patient_id") % 3 == 0, F.when(C("seq") % 5 == 0, F.concat(F.lit("Clinic "), (C("patient_id") % 2).cast("string")))).otherwise(F.when(C("seq") % 4 == 1, C("facility_name"))).alias("facility"),
    )


_SUMMARIES_SQL = """, s AS (SELECT patient_id, seq - 1 AS index, name_medical, date_diagnosed AS earliest_date, CASE WHEN seq % 3 = 0 THEN '2000-01-01' WHEN seq % 3 = 1 THEN '' END AS section_date,
 CASE WHEN seq % 2 = 0 THEN status END AS notes, CASE WHEN seq % 4 = 0 THEN provider_name END AS provider,
 CASE WHEN patient_id % 3 = 0 THEN CASE WHEN seq % 5 = 0 THEN concat('Clinic ', (patient_id % 2)::VARCHAR) END ELSE CASE WHEN seq % 4 = 1 THEN facility_name END END AS facility FROM condition_mentions)"""


def merge_summaries(spark, sf):
    s = _summaries(spark, sf)
    groups = s.where("index % 3 < 2").select("patient_id", "index", (C("index") % 4).alias("group"))
    return M.merge_summaries(s, groups, ["patient_id"]).withColumnRenamed("index", "first_index")


def backfill_attribution(spark, sf):
    s = _summaries(spark, sf)
    reports = s.where("index = 2").select("patient_id", C("provider"), F.lit(None).cast("string").alias("facility"))
    return M.backfill_attribution(s, reports, ["patient_id"]).select("patient_id", C("index").alias("i"), "provider", "facility")


def resolve_date_tiers(spark, sf):
    docs = bind(spark, sf, "patients").select("patient_id", F.when(C("patient_id") % 2 == 0, F.lit("1999-09-09")).alias("document_date"))
    return M.resolve_date_tiers(_summaries(spark, sf), docs, ["patient_id"]).select("patient_id", C("index").alias("i"), "earliest_date", "inherited")


def _locations(spark, sf):
    return _mentions(spark, sf).select(
        "patient_id", "seq", F.when(C("seq") % 3 == 0, F.concat(F.lit(" "), C("organ"))).alias("anatomical_location"), F.when(C("seq") % 6 == 0, "Left").alias("laterality"),
        F.when(C("seq") % 2 == 0, (C("record_id") % 7).cast("double")).alias("cx"), F.when(C("seq") % 2 == 0, (C("record_id") % 5).cast("double")).alias("cy"), F.when(C("seq") % 4 == 0, C("status")).alias("evidence"),
    )


def merge_locations(spark, sf):
    return M.merge_locations(_locations(spark, sf).where("anatomical_location IS NOT NULL"), ["patient_id"]).drop("k")


def _contacts(spark, sf):
    return _mentions(spark, sf).select("patient_id", "seq", F.when(C("seq") % 2 == 0, F.upper("provider_name")).otherwise(C("provider_name")).alias("name"), F.lit(None).cast("string").alias("email"), F.when(C("seq") % 3 == 0, "5").alias("phone"))


def dedupe_providers(spark, sf):
    return M.dedupe_providers(_contacts(spark, sf), ["patient_id"])


def _facilities(spark, sf):
    none = F.lit(None).cast("string")
    return _mentions(spark, sf).select(
        "patient_id", "record_id", "seq", F.when(C("seq") % 5 == 0, " ").when(C("seq") % 2 == 0, F.lower("facility_name")).otherwise(C("facility_name")).alias("name"),
        none.alias("address"), none.alias("city"), none.alias("state"), F.when(C("seq") % 3 == 0, "US").alias("country"),
    )


_FAC_SQL = ", f AS (SELECT patient_id, record_id, seq, CASE WHEN seq % 5 = 0 THEN ' ' WHEN seq % 2 = 0 THEN lower(facility_name) ELSE facility_name END AS name, CASE WHEN seq % 3 = 0 THEN 'US' END AS country FROM condition_mentions)"


def dedupe_facilities(spark, sf):
    return M.dedupe_facilities(_facilities(spark, sf), ["patient_id"]).select("patient_id", "seq", "name", "country")


def drop_blank_facilities(spark, sf):
    return _facilities(spark, sf).where(F.trim("name") != "").select("patient_id", "seq", "name")


def record_facilities(spark, sf):
    return M.record_facilities(_facilities(spark, sf)).select("record_id", "seq", "id", "name", "country")


def _sections(spark, sf):
    return bind(spark, sf, "dated").select(
        (C("o_custkey") % 400).alias("record_id"), C("id").alias("seq"), (C("id") % 5 + 1).cast("int").alias("page_start"), (C("id") % 5 + 1 + C("id") % 3).cast("int").alias("page_end"),
        F.concat(F.lit("H"), C("id").cast("string")).alias("heading"), F.nullif(C("d"), F.lit("")).alias("date"), F.array((C("id") % 6).cast("string"), (C("id") % 4).cast("string")).alias("condition_keys"),
    )


_SECTIONS_SQL = ", sec AS (SELECT o_custkey % 400 AS record_id, id AS seq, (id % 5 + 1)::INT AS page_start, (id % 5 + 1 + id % 3)::INT AS page_end, concat('H', id) AS heading, nullif(d, '') AS date, [(id % 6)::VARCHAR, (id % 4)::VARCHAR] AS keys FROM dated)"


def coalesce_image_sections(spark, sf):
    return M.coalesce_image_sections(_sections(spark, sf)).withColumn("condition_keys", F.array_join("condition_keys", ","))


def section_images(spark, sf):
    s = _sections(spark, sf)
    only = s.select("record_id").distinct().select("record_id", F.explode(F.array(F.lit(7), F.lit(8))).alias("page"))
    cond = s.select("record_id", F.explode(F.array(F.lit("1"), F.lit("3"))).alias("condition_key")).distinct().withColumn("condition_id", F.concat_ws(":", C("record_id").cast("string"), "condition_key"))
    return M.section_images(s, only, cond).withColumn("condition_ids", F.array_join("condition_ids", ","))


def carry_section_date(spark, sf):
    chunks = bind(spark, sf, "dated").select(C("o_custkey").alias("record_id"), C("id").alias("chunk_no"), C("d").alias("date"))
    return M.carry_section_date(chunks, ["record_id"]).select("record_id", "chunk_no", "carried_date")


def _measured(spark, sf):
    return bind(spark, sf, "measurements"), bind(spark, sf, "known_conditions")


def _sexed(spark, sf):
    return bind(spark, sf, "known_conditions").select("record_id", F.when(C("record_id") % 2 == 0, "male").otherwise("female").alias("sex"))


def infer_conditions(spark, sf):
    m, c = _measured(spark, sf)
    return rules.infer_conditions(m, c, _sexed(spark, sf)).drop("code")


def attach_measurement_date(spark, sf):
    m, c = _measured(spark, sf)
    inferred = m.where("name LIKE 'LDL%'").select("record_id", "seq", F.concat(F.lit("LDL "), S.js_number(C("value_numeric")), F.lit(" "), C("unit")).alias("evidence"))
    return rules.attach_measurement_date(inferred, m, ["record_id"]).select("record_id", "seq", "date_diagnosed")


def already_documented(spark, sf):
    return rules.already_documented(bind(spark, sf, "known_conditions"), ["record_id"])


def all_conditions(spark, sf):
    m, c = _measured(spark, sf)
    return M.all_conditions(c, rules.infer_conditions(m, c, _sexed(spark, sf)).select("record_id", "name_medical", "evidence")).select("record_id", "name_medical", "evidence")


def infer_body_type(spark, sf):
    t = bind(spark, sf, "terms").select((C("id") % 97).alias("patient_id"), C("name").alias("label"))
    return rules.infer_body_type(t, ["patient_id"])


_JS = "regexp_replace(regexp_replace(value_numeric::DECIMAL(30,10)::VARCHAR, '0+$', ''), '\\.$', '')"
_DOC = ", ".join(f"coalesce(bool_or(regexp_matches(lower(name_medical), '{'|'.join(t)}')), false) AS has_{k}" for k, t in R.DOCUMENTED.items())
_RULES_SQL = f""", doc AS (SELECT record_id, {_DOC} FROM known_conditions GROUP BY 1),
m AS (SELECT *, lower(name) AS n, {_JS} AS j, CASE WHEN lower(unit) = 'mmol/l' THEN value_numeric * 18.018::DOUBLE ELSE value_numeric END AS mg, CASE WHEN record_id % 2 = 0 THEN 13 ELSE 12 END AS lim FROM measurements),
h AS (SELECT *, CASE WHEN regexp_matches(n, '{rules.A1C}') THEN CASE WHEN value_numeric >= 6.5 THEN 'diabetes|HbA1c ' || j || unit || ' (≥6.5% threshold)' WHEN value_numeric >= 5.7 THEN 'prediabetes|HbA1c ' || j || unit || ' (5.7–6.4% range)' END
 WHEN regexp_matches(n, '{rules.FASTING}') THEN CASE WHEN mg >= 126 THEN 'diabetes|Fasting glucose ' || j || ' ' || unit || ' (≥126 mg/dL threshold)' WHEN mg >= 100 THEN 'prediabetes|Fasting glucose ' || j || ' ' || unit || ' (100–125 mg/dL range)' END
 WHEN n LIKE '%systolic%' AND value_numeric >= 140 THEN 'hypertension|Systolic BP ' || j || ' ' || unit || ' (≥140 mmHg threshold)'
 WHEN n LIKE '%diastolic%' AND value_numeric >= 90 THEN 'hypertension|Diastolic BP ' || j || ' ' || unit || ' (≥90 mmHg threshold)'
 WHEN n LIKE '%ldl%' AND value_numeric >= 160 THEN 'hyperlipid|LDL ' || j || ' ' || unit || ' (≥160 mg/dL threshold)'
 WHEN n LIKE '%total cholesterol%' AND value_numeric >= 240 THEN 'hyperlipid|Total cholesterol ' || j || ' ' || unit || ' (≥240 mg/dL threshold)'
 WHEN regexp_matches(n, 'hemoglobin|haemoglobin|hgb|hb') THEN CASE WHEN value_numeric < lim THEN 'anaemia|Hemoglobin ' || j || ' ' || unit || ' (below ' || lim || ' g/dL threshold)' END
 WHEN n LIKE '%gfr%' AND value_numeric < 60 THEN 'ckd|eGFR ' || j || ' ' || unit || ' (<60 mL/min/1.73m² threshold)' END AS hit FROM m),
k AS (SELECT h.record_id, seq, string_split(hit, '|')[1] AS code, string_split(hit, '|')[2] AS evidence FROM h LEFT JOIN doc USING (record_id) WHERE hit IS NOT NULL AND NOT coalesce(
 CASE string_split(hit, '|')[1] WHEN 'diabetes' THEN has_diabetes WHEN 'prediabetes' THEN has_prediabetes OR has_diabetes WHEN 'hypertension' THEN has_hypertension WHEN 'hyperlipid' THEN has_hyperlipid WHEN 'anaemia' THEN has_anaemia ELSE has_ckd END, false)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, code ORDER BY seq) AS nth FROM k) WHERE code <> 'hypertension' OR nth = 1),
dt AS (SELECT record_id, seq, date FROM (SELECT f.record_id, f.seq, m.date, row_number() OVER (PARTITION BY f.record_id, f.seq ORDER BY m.seq) AS r FROM f JOIN m ON m.record_id = f.record_id AND contains(f.evidence, m.j) AND contains(f.evidence, m.unit)) WHERE r = 1),
inf AS (SELECT f.record_id, f.seq, evidence, CASE code {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in rules.RESULTS.items())} END AS name_medical, CASE code {' '.join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in rules.RESULTS.items())} END AS name_common,
 CASE code {' '.join(f"WHEN '{k}' THEN '{v[2]}'" for k, v in rules.RESULTS.items())} END AS system, CASE code {' '.join(f"WHEN '{k}' THEN '{v[3]}'" for k, v in rules.RESULTS.items())} END AS organ,
 'inferred' AS status, 'suspected' AS certainty, dt.date AS date_diagnosed, dt.date AS date_onset FROM f LEFT JOIN dt ON f.record_id = dt.record_id AND f.seq = dt.seq)
"""
_MEAS = view_sql("measurements", "known_conditions")

QUERIES = {f.__name__: f for f in (
    merge_conditions, latest_status, merge_longitudinal_located, merge_longitudinal_pages, merge_summaries, backfill_attribution, resolve_date_tiers, merge_locations,
    dedupe_providers, dedupe_facilities, drop_blank_facilities, record_facilities, coalesce_image_sections, section_images, carry_section_date, infer_conditions,
    attach_measurement_date, already_documented, all_conditions, infer_body_type,
)}

SQL = {
    "merge_conditions": _MENTIONS + ", " + MERGED_SQL + " SELECT * EXCLUDE (seq) FROM merged",
    "latest_status": _MENTIONS + "SELECT patient_id, name_medical, arg_max(status, (coalesce(date_diagnosed, ''), seq)) AS status FROM condition_mentions GROUP BY 1, 2",
    "merge_longitudinal_located": _MENTIONS + _LOCATED_SQL + """SELECT patient_id, concat(lower(trim(name_medical)), '|', lower(trim(coalesce(system, ''))), '|', lower(trim(coalesce(anatomical_location, '')))) AS k, count(*)::BIGINT AS n_mentions,
 arg_min(name_medical, seq) AS name_medical, arg_min(organ, seq) AS organ, min(least(date_diagnosed, o)) AS date_diagnosed,
 CASE WHEN count(*) = 1 THEN any_value(date_onset) ELSE min(o) END AS date_onset, nullif(string_agg(nullif(evidence, ''), ' ' ORDER BY seq), '') AS evidence, arg_min(provider_name, seq) AS provider_name FROM v GROUP BY 1, 2""",
    "merge_longitudinal_pages": _MENTIONS + """SELECT patient_id, concat(lower(trim(name_medical)), '|', lower(trim(coalesce(system, '')))) AS k, arg_min(name_medical, seq) AS name_medical, arg_min(status, seq) AS status, min(date_diagnosed) AS date_diagnosed,
 array_to_string(list_sort(list_distinct(flatten(list([(seq % 4 + 1)::INT, (record_id % 3 + 1)::INT])))), ',') AS source_pages FROM condition_mentions GROUP BY 1, 2""",
    "merge_summaries": _MENTIONS + _SUMMARIES_SQL + """SELECT patient_id, CASE WHEN index % 3 < 2 THEN (index % 4)::VARCHAR ELSE concat('ungrouped-', index) END AS group_key, min(index) AS first_index, arg_min(name_medical, index) AS name_medical,
 min(nullif(earliest_date, '')) AS earliest_date, min(nullif(section_date, '')) AS section_date, string_agg(notes, ' | ' ORDER BY index) AS notes, arg_min(provider, index) AS provider, arg_min(facility, index) AS facility FROM s GROUP BY 1, 2""",
    "backfill_attribution": _MENTIONS + _SUMMARIES_SQL + """, p AS (SELECT patient_id, arg_min(provider, i) AS v FROM (SELECT patient_id, provider, index AS i FROM s UNION ALL SELECT patient_id, provider, -1 FROM s WHERE index = 2) GROUP BY 1 HAVING count(DISTINCT lower(provider)) = 1),
 f AS (SELECT patient_id, arg_min(facility, index) AS v FROM s GROUP BY 1 HAVING count(DISTINCT lower(facility)) = 1)
 SELECT s.patient_id, index AS i, coalesce(provider, p.v) AS provider, coalesce(facility, f.v) AS facility FROM s LEFT JOIN p USING (patient_id) LEFT JOIN f USING (patient_id)""",
    "resolve_date_tiers": _MENTIONS + _SUMMARIES_SQL + """SELECT patient_id, index AS i, coalesce(nullif(earliest_date, ''), nullif(section_date, ''), CASE WHEN patient_id % 2 = 0 THEN '1999-09-09' END) AS earliest_date,
 nullif(earliest_date, '') IS NULL AND coalesce(nullif(section_date, ''), CASE WHEN patient_id % 2 = 0 THEN '1999-09-09' END) IS NOT NULL AS inherited FROM s""",
    "merge_locations": _MENTIONS + """, l AS (SELECT patient_id, seq, CASE WHEN seq % 3 = 0 THEN ' ' || organ END AS al, CASE WHEN seq % 6 = 0 THEN 'Left' END AS la, CASE WHEN seq % 2 = 0 THEN (record_id % 7)::DOUBLE END AS cx, CASE WHEN seq % 2 = 0 THEN (record_id % 5)::DOUBLE END AS cy,
 CASE WHEN seq % 4 = 0 THEN status END AS ev FROM condition_mentions) SELECT patient_id, min(seq) AS seq, arg_min(al, seq) AS anatomical_location, arg_min(la, seq) AS laterality, arg_min(cx, seq) AS cx, arg_min(cy, seq) AS cy, arg_min(ev, seq) AS evidence FROM l WHERE al IS NOT NULL GROUP BY patient_id, lower(trim(al)), lower(trim(coalesce(la, '')))""",
    "dedupe_providers": _MENTIONS + """, p AS (SELECT patient_id, seq, CASE WHEN seq % 2 = 0 THEN upper(provider_name) ELSE provider_name END AS name, NULL::VARCHAR AS email, CASE WHEN seq % 3 = 0 THEN '5' END AS phone FROM condition_mentions)
 SELECT patient_id, seq, name, email, phone FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, lower(name), phone ORDER BY seq) AS n FROM p) WHERE n = 1""",
    "dedupe_facilities": _MENTIONS + _FAC_SQL + "SELECT patient_id, seq, name, country FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, lower(name), country ORDER BY seq) AS n FROM f) WHERE n = 1",
    "drop_blank_facilities": _MENTIONS + _FAC_SQL + "SELECT patient_id, seq, name FROM f WHERE trim(name) <> ''",
    "record_facilities": _MENTIONS + _FAC_SQL + """, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, name, country ORDER BY seq) AS n FROM f WHERE trim(name) <> '') WHERE n = 1)
 SELECT record_id, seq, concat(record_id, '-facility-', row_number() OVER (PARTITION BY record_id ORDER BY seq) - 1) AS id, name, country FROM o""",
    "coalesce_image_sections": view_sql("dated") + _SECTIONS_SQL + "SELECT record_id, page_start, page_end, array_to_string(list_sort(list_distinct(flatten(list(keys)))), ',') AS condition_keys FROM sec GROUP BY 1, 2, 3",
    "section_images": view_sql("dated") + _SECTIONS_SQL + """, p AS (SELECT *, unnest(range(page_start, page_end + 1))::INT AS page FROM sec),
 a AS (SELECT record_id, page, arg_min(heading, seq) AS title, arg_min(date, seq) AS date, list_distinct(flatten(list(keys))) AS ks FROM p GROUP BY 1, 2),
 o AS (SELECT DISTINCT record_id, unnest([7, 8])::INT AS page FROM sec)
 SELECT record_id, page, title, date, CASE WHEN len(list_intersect(ks, ['1', '3'])) > 0 THEN array_to_string(list_sort([concat(record_id, ':', k) FOR k IN list_intersect(ks, ['1', '3'])]), ',') END AS condition_ids FROM a
 UNION ALL SELECT o.record_id, o.page, NULL, NULL, NULL FROM o LEFT JOIN a USING (record_id, page) WHERE a.page IS NULL""",
    "carry_section_date": view_sql("dated") + "SELECT o_custkey AS record_id, id AS chunk_no, last_value(nullif(d, '') IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY id ROWS UNBOUNDED PRECEDING) AS carried_date FROM dated",
    "infer_conditions": _MEAS + _RULES_SQL + "SELECT * FROM inf",
    "attach_measurement_date": _MEAS + f""", m AS (SELECT *, {_JS} AS j FROM measurements), i AS (SELECT record_id, seq, 'LDL ' || j || ' ' || unit AS evidence FROM m WHERE name LIKE 'LDL%')
 SELECT record_id, seq, date AS date_diagnosed FROM (SELECT i.record_id, i.seq, m.date, row_number() OVER (PARTITION BY i.record_id, i.seq ORDER BY m.seq) AS r FROM i JOIN m ON m.record_id = i.record_id AND contains(evidence, m.j) AND contains(evidence, m.unit)) WHERE r = 1""",
    "already_documented": view_sql("known_conditions") + f"SELECT record_id, {_DOC} FROM known_conditions GROUP BY 1",
    "all_conditions": _MEAS + _RULES_SQL + "SELECT record_id, name_medical, NULL AS evidence FROM known_conditions UNION ALL SELECT record_id, name_medical, evidence FROM inf",
    "infer_body_type": view_sql("terms") + f"SELECT id % 97 AS patient_id, CASE WHEN bool_or(regexp_matches(lower(name), '{R.MALE_TERMS}')) THEN 'male' WHEN bool_or(regexp_matches(lower(name), '{R.FEMALE_TERMS}')) THEN 'female' ELSE 'unknown' END AS body_type FROM terms GROUP BY 1",
}
