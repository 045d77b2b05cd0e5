"""Queries of the reads over the condition tables and of the call log, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caretrail import reference_data as R
from caretrail.functions import scalars as S
from caretrail.operators import merge as M
from caretrail.operators import views as V
from caretrail.plans.bindings import bind, view_sql
from caretrail.plans.merge_queries import _SUMMARIES_SQL, MERGED_SQL, _summaries
from caretrail.plans.scalar_queries import _CLASS, _MODEL_SCORE, _SYSTEM
from caretrail.sources.shared import written

C = F.col


def _conditions(spark, sf):
    """Merged conditions as stored rows: id, record, year."""
    # the record of a condition's first mention comes with the merge (as its id, which is never null), not by another pass and a join
    mentions = bind(spark, sf, "condition_mentions").where("patient_id IS NOT NULL").withColumns({"notes": F.when(C("seq") % 2 == 0, C("status")), "id": C("record_id")})
    m = M.merge_conditions(mentions, ["patient_id"])
    return m.select(
        "patient_id", F.concat_ws(":", C("patient_id").cast("string"), C("seq").cast("string")).alias("id"), F.when(C("seq") % 7 > 0, C("id")).alias("record_id"), "name_medical", F.when(C("seq") % 3 == 0, F.upper("name_medical")).alias("name_common"),
        "system", "status", C("date_diagnosed").alias("date"), F.round(S.parse_date_frac(F.coalesce("date_diagnosed", F.lit(""))), 6).alias("year_frac"),
        F.lit(None).cast("string").alias("note"), C("provider_name").alias("evidence"), (C("seq") % 90).cast("double").alias("cx"), (C("seq") % 70).cast("double").alias("cy"), "seq", "provider_name", "facility_name",
    )


_BASE = view_sql("condition_mentions", "health_records") + ", " + MERGED_SQL + """, cond AS (SELECT m.patient_id, concat(m.patient_id, ':', m.seq) AS id, CASE WHEN m.seq % 7 > 0 THEN c.record_id END AS record_id, m.name_medical, CASE WHEN m.seq % 3 = 0 THEN upper(m.name_medical) END AS name_common,
 m.system, m.status, m.date_diagnosed AS date, round(CASE WHEN m.date_diagnosed IS NULL THEN 0 ELSE substring(m.date_diagnosed, 1, 4)::INT + ((substring(m.date_diagnosed, 6, 2)::INT - 1) * 30.44::DOUBLE + substring(m.date_diagnosed, 9, 2)::INT) / 365.25::DOUBLE END, 6)::DOUBLE AS year_frac,
 m.provider_name AS evidence, (m.seq % 90)::DOUBLE AS cx, (m.seq % 70)::DOUBLE AS cy, m.seq, m.provider_name, m.facility_name FROM merged m JOIN condition_mentions c ON c.patient_id = m.patient_id AND c.seq = m.seq),
own AS (SELECT patient_id, bool_or(record_type IS DISTINCT FROM 'demo') AS has_user FROM health_records GROUP BY 1),
hid AS (SELECT h.patient_id, h.id FROM health_records h JOIN own ON own.patient_id = h.patient_id AND has_user WHERE record_type = 'demo'),
vis AS (SELECT cond.* FROM cond LEFT JOIN hid ON hid.patient_id = cond.patient_id AND hid.id = cond.record_id WHERE hid.id IS NULL)
"""


def _records(spark, sf):
    return bind(spark, sf, "health_records")


def has_user_records(spark, sf):
    return V.has_user_records(_records(spark, sf))


def visible_conditions(spark, sf):
    c, h = _conditions(spark, sf), _records(spark, sf)
    auto, demo = V.visible_conditions(c, h, "auto"), V.visible_conditions(c, h, "demo")
    return auto.select("patient_id", "id", F.lit("auto").alias("mode")).unionByName(demo.select("patient_id", "id", F.lit("demo").alias("mode")))


def condition_view(spark, sf):
    return V.condition_view(_conditions(spark, sf)).drop("cx", "cy")


def timeline(spark, sf):
    shown = V.condition_view(V.visible_conditions(_conditions(spark, sf), _records(spark, sf)))
    return V.timeline(shown).select("patient_id", "n", "id", "label", "system", "status", "year_frac")


def _locations(spark, sf, conditions=None):
    c = (_conditions(spark, sf) if conditions is None else conditions).where("seq % 4 > 0")
    k = F.explode(F.sequence(F.lit(0), (C("seq") % 3).cast("int")))
    return c.select("patient_id", C("id").alias("condition_id"), "cx", "cy", k.alias("k")).select(
        "patient_id", "condition_id", F.concat(C("condition_id"), F.lit("-loc-"), C("k").cast("string")).alias("id"), (C("cx") + C("k")).alias("cx"), (C("cy") - C("k")).alias("cy"), (C("k") == 1).alias("is_primary")
    )


_LOC_SQL = ", loc AS (SELECT patient_id, id AS condition_id, concat(id, '-loc-', k) AS id, cx + k AS cx, cy - k AS cy, k = 1 AS is_primary FROM (SELECT *, unnest(range(0, seq % 3 + 1)) AS k FROM cond WHERE seq % 4 > 0))"


def condition_dots(spark, sf):
    return V.condition_dots(V.visible_conditions(_conditions(spark, sf), _records(spark, sf)), _locations(spark, sf))


def filter_active_systems(spark, sf):
    c = _conditions(spark, sf)
    return V.snapshot(c, ["renal", "digestive"], 9999.0).select("id", "system")


def as_of_snapshot(spark, sf):
    at = bind(spark, sf, "patients").select("patient_id", (1993 + C("patient_id") % 5).cast("double").alias("known_by"))
    return V.snapshot(_conditions(spark, sf), ["cardiovascular", "renal", "endocrine"], at).select("patient_id", "id", "year_frac", "known_by")


def flag_unconfirmed(spark, sf):
    return V.flag_unconfirmed(_conditions(spark, sf)).select("id", "status", "inferred")


def date_overrides(spark, sf):
    c = written(_conditions(spark, sf).select("id", "seq", "year_frac"), "conditions")
    o = c.where("seq % 5 = 0").select(C("id").alias("condition_id"), F.when(C("seq") % 10 == 0, "unknown").otherwise(F.concat(F.lit("199"), (C("seq") % 9).cast("string"), F.lit(".5"))).alias("value"))
    return V.apply_overrides(c, o).select("id", "year_frac")


def rail_range(spark, sf):
    return V.rail_range(_conditions(spark, sf).where("year_frac > 0"), bind(spark, sf, "patients")).select("patient_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def snap_to_nearest(spark, sf):
    c = written(_conditions(spark, sf).where("year_frac > 0").select("patient_id", "id", "year_frac"), "conditions")
    rails = V.rail_range(c, bind(spark, sf, "patients"))
    probes = bind(spark, sf, "dated").select(C("id").alias("probe_id"), C("o_custkey").alias("patient_id"), (1992 + (C("id") % 700) / F.lit(100.0)).alias("year"))
    return V.snap_to_nearest(probes, c, rails).withColumn("snapped", F.round("snapped", 6))


_RAIL_SQL = ", rails AS (SELECT c.patient_id, greatest(min(year_frac) - 2 / 12.0::DOUBLE, any_value(birth_year + (birth_month - 1) / 12.0::DOUBLE)) AS low, max(year_frac) + 1 / 12.0::DOUBLE AS high FROM cond c JOIN patients p USING (patient_id) WHERE year_frac > 0 GROUP BY 1)"
_POS = "CASE WHEN high <= low THEN 0 ELSE (exp(2.5 * greatest(0, least(1, ({} - low) / nullif(high - low, 0)))) - 1) / (exp(2.5::DOUBLE) - 1) END"


def condition_records_images(spark, sf):
    c = bind(spark, sf, "dated")
    images = c.where("id % 4 < 2").select(C("id").alias("id"), F.when(C("id") % 2 == 0, F.concat(F.lit("thumb"), C("id").cast("string"))).alias("thumbnail_blob"), F.concat(F.lit("full"), C("id").cast("string")).alias("image_blob"))
    records = c.select(C("o_custkey").alias("condition_id"), C("id").alias("record_no"), F.when(C("id") % 3 > 0, C("id")).alias("image_id"))
    return V.condition_records(records, images).select("condition_id", "record_no", "image_id", "image")


def _linked(spark, sf):
    m = bind(spark, sf, "condition_mentions")
    return m.select(
        "record_id", F.concat_ws(":", "patient_id", "name_medical").alias("condition_id"), "seq", F.concat_ws(":", C("patient_id").cast("string"), F.lpad(C("seq").cast("string"), 6, "0")).alias("id"), "provider_name", "facility_name",
        F.when(C("status") == "documented", "diagnosed").when(C("status") == "resolved", "treated").otherwise("guessed").alias("event_type"), C("date_diagnosed").alias("date"),
    )


_LINKED_SQL = ", lk AS (SELECT record_id, concat(patient_id, ':', name_medical) AS condition_id, seq, concat(patient_id, ':', lpad(seq::VARCHAR, 6, '0')) AS id, provider_name, facility_name, CASE status WHEN 'documented' THEN 'diagnosed' WHEN 'resolved' THEN 'treated' ELSE 'guessed' END AS event_type, date_diagnosed AS date FROM condition_mentions)"


def condition_attribution(spark, sf):
    k = _linked(spark, sf)
    p = k.where("seq % 2 = 0").select("record_id", "condition_id", "id", C("provider_name").alias("name"))
    f = k.where("seq % 3 = 0").select("record_id", "condition_id", "id", C("facility_name").alias("name"))
    e = k.where("seq % 5 = 0").select("condition_id", "id", F.concat_ws(" · ", "event_type", "date").alias("line"))
    out = V.condition_attribution(k.select("record_id", "condition_id").distinct(), p, f, e)
    return out.select("record_id", "condition_id", *[F.array_join(c, "; ").alias(c) for c in ("providers", "facilities", "care_events")])


def care_event_lines(spark, sf):
    k = _linked(spark, sf)
    p = k.where("seq % 2 = 0").select("condition_id", C("provider_name").alias("name"))
    return V.care_event_lines(k, p)


def flatten_care_events(spark, sf):
    k = _linked(spark, sf)
    event = F.struct("event_type", "date", F.struct(C("provider_name").alias("name")).alias("provider"), F.struct(F.when(C("seq") % 2 == 0, C("facility_name")).alias("name")).alias("facility"))
    nested = k.groupBy("condition_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(C("id").alias("s"), event.alias("e")))), lambda x: x["e"]).alias("care_events"))
    return V.flatten_care_events(nested)


def unlinked_record_providers(spark, sf):
    k = _linked(spark, sf)
    phone = F.when(C("seq") % 3 == 0, "5").alias("phone")
    none = F.lit(None).cast("string").alias("email")
    record = k.select("record_id", "seq", C("provider_name").alias("name"), none, phone)
    return V.unlinked_record_providers(record, k.where("seq % 2 = 0").select("record_id", C("provider_name").alias("name"), none, phone)).select("record_id", "seq", "name", "phone")


def rehydrate_contacts(spark, sf):
    contacts = bind(spark, sf, "contacts")
    no = F.row_number().over(Window.partitionBy("record_id").orderBy("seq"))
    p = _linked(spark, sf).withColumn("provider_no", no.cast("int")).select(
        "record_id", "provider_no", F.when(C("seq") % 3 == 0, F.concat(F.lit(" Nurse Joy "), C("facility_name"))).when(C("seq") % 3 == 1, F.concat(F.lit("No"), (C("seq") % 25).cast("string"))).otherwise(C("provider_name")).alias("name"),
        F.when(C("seq") % 4 == 0, "own@x.org").alias("email"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("evidence"),
    )
    return V.rehydrate_contacts(p, contacts)


def join_anatomy(spark, sf):
    s = _summaries(spark, sf).select("patient_id", "index", F.concat(C("name_medical"), F.when(C("index") % 4 == 0, " of the kidney").otherwise(" joint")).alias("name_medical"), "notes")
    a = s.where("index % 3 = 1").select("patient_id", "index", F.lit("renal").alias("system"), F.lit("suspected").alias("status"), F.lit("kidney").alias("organ"))
    return V.join_anatomy(s, a).select("patient_id", C("index").alias("i"), "system", "status", "organ")


def call_outcome(spark, sf):
    return V.call_outcome(bind(spark, sf, "call_log"))


def cooldown_blocked(spark, sf):
    return V.cooldown_blocked(bind(spark, sf, "call_log"), 600.0).select("seq", "model")


def model_leaderboard(spark, sf):
    return V.model_leaderboard(bind(spark, sf, "models")).withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (
    has_user_records, visible_conditions, condition_view, timeline, condition_dots, filter_active_systems, as_of_snapshot, flag_unconfirmed, date_overrides, rail_range, snap_to_nearest,
    condition_records_images, condition_attribution, care_event_lines, flatten_care_events, unlinked_record_providers, rehydrate_contacts, join_anatomy, call_outcome, cooldown_blocked, model_leaderboard,
)}

_MENT = view_sql("condition_mentions")
_NORM = _SYSTEM
SQL = {
    "has_user_records": view_sql("health_records") + "SELECT patient_id, bool_or(record_type IS DISTINCT FROM 'demo') AS has_user FROM health_records GROUP BY 1",
    "visible_conditions": _BASE + "SELECT patient_id, id, 'auto' AS mode FROM vis UNION ALL SELECT c.patient_id, c.id, 'demo' FROM cond c JOIN health_records h ON h.patient_id = c.patient_id AND h.id = c.record_id WHERE record_type = 'demo'",
    "condition_view": _BASE + f"SELECT patient_id, id, coalesce(name_common, name_medical) AS label, name_medical, {_NORM} AS system, status, coalesce(date, '') AS date, year_frac, '' AS note, coalesce(evidence, '') AS evidence FROM cond",
    "timeline": _BASE + f"SELECT patient_id, row_number() OVER (PARTITION BY patient_id ORDER BY year_frac, id)::INT AS n, id, coalesce(name_common, name_medical) AS label, {_NORM} AS system, status, year_frac FROM vis",
    "condition_dots": _BASE + _LOC_SQL + """SELECT v.patient_id, v.id AS condition_id, loc.id AS location_id, coalesce(loc.cx, v.cx) AS cx, coalesce(loc.cy, v.cy) AS cy,
 row_number() OVER (PARTITION BY v.patient_id, v.id ORDER BY is_primary DESC NULLS LAST, loc.id)::INT AS n FROM vis v LEFT JOIN loc ON loc.patient_id = v.patient_id AND loc.condition_id = v.id""",
    "filter_active_systems": _BASE + f"SELECT id, system FROM cond WHERE {_NORM} IN ('renal', 'digestive')",
    "as_of_snapshot": _BASE + f", p AS (SELECT c_custkey AS patient_id, (1993 + c_custkey % 5)::DOUBLE AS known_by FROM customer) SELECT patient_id, id, year_frac, known_by FROM cond JOIN p USING (patient_id) WHERE {_NORM} IN ('cardiovascular', 'renal', 'endocrine') AND year_frac <= known_by",
    "flag_unconfirmed": _BASE + "SELECT id, status, status = 'inferred' AS inferred FROM cond WHERE status <> 'suspected'",
    "date_overrides": _BASE + "SELECT id, CASE WHEN seq % 5 = 0 AND seq % 10 <> 0 THEN concat('199', seq % 9, '.5')::DOUBLE ELSE year_frac END AS year_frac FROM cond",
    "rail_range": _BASE + ", patients AS (SELECT c_custkey AS patient_id, 1940 + c_custkey % 60 AS birth_year, c_custkey % 12 + 1 AS birth_month FROM customer)" + _RAIL_SQL + "SELECT patient_id, round(low, 6) AS low, round(high, 6) AS high FROM rails",
    "snap_to_nearest": _BASE + ", patients AS (SELECT c_custkey AS patient_id, 1940 + c_custkey % 60 AS birth_year, c_custkey % 12 + 1 AS birth_month FROM customer)" + _RAIL_SQL + f""",
 c AS (SELECT patient_id, year_frac, id, {_POS.format('year_frac')} AS pos FROM cond JOIN rails USING (patient_id) WHERE year_frac > 0),
 p AS (SELECT o_orderkey AS probe_id, patient_id, low, high, 1992 + (o_orderkey % 700) / 100.0::DOUBLE AS year FROM orders JOIN rails ON patient_id = o_custkey), q AS (SELECT *, {_POS.format('year')} AS pos FROM p),
 n AS (SELECT probe_id, year_frac AS near, d FROM (SELECT probe_id, year_frac, round(abs(q.pos - c.pos), 12) AS d, row_number() OVER (PARTITION BY probe_id ORDER BY round(abs(q.pos - c.pos), 12), year_frac, id) AS r FROM q JOIN c USING (patient_id)) WHERE r = 1)
 SELECT probe_id, patient_id, round(greatest(low, least(high, CASE WHEN d <= 0.01 THEN near ELSE year END)), 6) AS snapped FROM q LEFT JOIN n USING (probe_id)""",
    "condition_records_images": view_sql("dated") + "SELECT r.o_custkey AS condition_id, r.id AS record_no, CASE WHEN r.id % 3 > 0 THEN r.id END AS image_id, CASE WHEN r.id % 3 > 0 AND r.id % 4 < 2 THEN CASE WHEN r.id % 2 = 0 THEN concat('thumb', r.id) ELSE concat('full', r.id) END END AS image FROM dated r",
    "condition_attribution": _MENT + _LINKED_SQL + """, c AS (SELECT DISTINCT record_id, condition_id FROM lk), p AS (SELECT record_id, condition_id, string_agg(provider_name, '; ' ORDER BY id) AS v FROM lk WHERE seq % 2 = 0 GROUP BY 1, 2),
 f AS (SELECT record_id, condition_id, string_agg(facility_name, '; ' ORDER BY id) AS v FROM lk WHERE seq % 3 = 0 GROUP BY 1, 2), e AS (SELECT condition_id, string_agg(concat_ws(' · ', event_type, date), '; ' ORDER BY id) AS v FROM lk WHERE seq % 5 = 0 GROUP BY 1)
 SELECT c.record_id, c.condition_id, coalesce(p.v, '') AS providers, coalesce(f.v, '') AS facilities, coalesce(e.v, '') AS care_events FROM c LEFT JOIN p USING (record_id, condition_id) LEFT JOIN f USING (record_id, condition_id) LEFT JOIN e USING (condition_id)""",
    "care_event_lines": _MENT + _LINKED_SQL + """SELECT condition_id, id, concat_ws(' · ', event_type, date, CASE WHEN l.n IS NULL THEN provider_name END, facility_name) AS line FROM lk LEFT JOIN (SELECT DISTINCT condition_id AS ci, provider_name AS pn, 1 AS n FROM lk WHERE seq % 2 = 0) l ON l.ci = condition_id AND l.pn = provider_name""",
    "flatten_care_events": _MENT + _LINKED_SQL + """SELECT concat(condition_id, '-care-', row_number() OVER (PARTITION BY condition_id ORDER BY id) - 1) AS id, condition_id, event_type, date, provider_name, CASE WHEN seq % 2 = 0 THEN facility_name END AS facility_name FROM lk WHERE event_type <> 'guessed' AND date IS NOT NULL""",
    "unlinked_record_providers": _MENT + _LINKED_SQL + """, k AS (SELECT *, concat(provider_name, '|', CASE WHEN seq % 3 = 0 THEN '5' ELSE '' END) AS k FROM lk),
 n AS (SELECT *, row_number() OVER (PARTITION BY record_id, k ORDER BY seq) AS n FROM k WHERE (record_id, k) NOT IN (SELECT (record_id, k) FROM k WHERE seq % 2 = 0))
 SELECT record_id, seq, provider_name AS name, CASE WHEN seq % 3 = 0 THEN '5' END AS phone FROM n WHERE n = 1""",
    "rehydrate_contacts": view_sql("condition_mentions", "contacts") + _LINKED_SQL + """, p AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY seq)::INT AS provider_no, CASE WHEN seq % 3 = 0 THEN concat(' Nurse Joy ', facility_name) WHEN seq % 3 = 1 THEN concat('No', seq % 25) ELSE provider_name END AS name, CASE WHEN seq % 4 = 0 THEN 'own@x.org' END AS email FROM lk),
 k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS pk FROM p), c AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS ck FROM contacts),
 b AS (SELECT k.record_id, k.provider_no, min(contact_no) AS no FROM k JOIN c ON c.record_id = k.record_id AND (contains(pk, ck) OR contains(ck, pk)) GROUP BY 1, 2), o AS (SELECT record_id, min(contact_no) AS no FROM c GROUP BY 1 HAVING count(*) = 1),
 r AS (SELECT k.*, coalesce(b.no, o.no, k.provider_no) AS no FROM k LEFT JOIN b USING (record_id, provider_no) LEFT JOIN o USING (record_id))
 SELECT r.record_id, r.provider_no, trim(r.name) AS name, coalesce(r.email, c.email) AS email, c.phone, c.evidence FROM r LEFT JOIN c ON c.record_id = r.record_id AND c.contact_no = r.no""",
    "join_anatomy": _MENT + _SUMMARIES_SQL + ", t AS (SELECT patient_id, index, concat(name_medical, CASE WHEN index % 4 = 0 THEN ' of the kidney' ELSE ' joint' END) AS name, notes FROM s) SELECT patient_id, index AS i, CASE WHEN index % 3 = 1 THEN 'renal' ELSE " + _CLASS + " END AS system, CASE WHEN index % 3 = 1 THEN 'suspected' ELSE 'documented' END AS status, CASE WHEN index % 3 = 1 THEN 'kidney' END AS organ FROM t",
    "call_outcome": view_sql("call_log") + """, g AS (SELECT call_id, min(seq) FILTER (http_status = 200) AS ok, min(seq) FILTER (http_status IN (402, 429)) AS li, arg_min(model, seq) FILTER (http_status = 200) AS model, count(*)::BIGINT AS n_attempts FROM call_log GROUP BY 1)
 SELECT call_id, CASE WHEN ok IS NULL THEN 'exhausted' WHEN li < ok THEN 'degraded' ELSE 'ok' END AS outcome, model, n_attempts FROM g""",
    "cooldown_blocked": view_sql("call_log") + """, w AS (SELECT *, last_value(CASE WHEN http_status = 429 THEN epoch_us(ts) + 600000000 END IGNORE NULLS) OVER (PARTITION BY model ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM call_log)
 SELECT seq, model FROM w WHERE epoch_us(ts) < until""",
    "model_leaderboard": view_sql("models") + f"SELECT id, {_MODEL_SCORE} AS score, context_length FROM models WHERE id LIKE '%:free' ORDER BY score DESC, context_length DESC, id LIMIT 5",
}
