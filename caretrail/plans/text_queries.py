"""Queries of the text jobs, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from caretrail.functions import scalars as S
from caretrail.operators import text as X
from caretrail.plans.bindings import base, bind, view_sql

C = F.col


def _redacted(spark, sf):
    return X.redact(bind(spark, sf, "clinical_notes"))


def redact_pii(spark, sf):
    return _redacted(spark, sf).select("record_id", "text", F.size("edits").cast("long").alias("n_edits"))


def redact_documents(spark, sf):
    out = X.redact(base(spark, sf, "documents"))
    return out.select("doc_id", F.size("edits").cast("long").alias("n_edits"), F.length("text").cast("long").alias("n_chars_left"))


def remap_offsets(spark, sf):
    d = X.redact(bind(spark, sf, "clinical_notes").withColumn("n", F.length("text")))
    breaks = S.estimate_page_breaks(C("n"), F.lit(4))
    moved = X.remap_offsets(breaks, C("edits"))
    return d.select("record_id", F.array_join(breaks.cast("array<string>"), ",").alias("before"), F.array_join(moved.cast("array<string>"), ",").alias("after"))


def pii_counts(spark, sf):
    return X.pii_counts(_redacted(spark, sf))


def extract_provider_contacts(spark, sf):
    return X.provider_contacts(bind(spark, sf, "clinical_notes"), ["patient_id", "record_id"])


def _sectioned(spark, sf):
    d = base(spark, sf, "documents").select("doc_id", "text")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(x) > 0)
    section = lambda x, i: F.struct(F.substring(x, 1, 12).alias("heading"), (i * 500).alias("startOffset"), F.when(i % 4 == 0, "2020-01-01").alias("inferredDate"), F.when(i % 3 == 0, "labs").otherwise("other").alias("sectionType"), (i % 5 == 0).alias("imageWorthy"))
    every = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), section(x, i).alias("s"))), lambda x: x["i"] % 3 == 0)
    return d.select("doc_id", "text", F.transform(every, lambda x: x["s"]).cast(X.SECTION).alias("sections"), S.estimate_page_breaks(F.length("text"), F.lit(5)).alias("page_breaks"))


def chunk_sections(spark, sf):
    return X.chunk(_sectioned(spark, sf), 2000).select("doc_id", "chunk_no", "start", "end", "heading", "sectionType", "inferredDate", "imageWorthy", "page_start", "page_end", F.md5("text").alias("text_md5"))


def chunk_cover(spark, sf):
    """The chunks of a document follow each other and make up its text again. A row per row, so that ids may repeat."""
    d = X.cut_chunks(_sectioned(spark, sf), 2000)
    whole = F.array_join(F.transform("_c", lambda c: X.part_of(C("text"), c)), "")
    return d.select("doc_id", F.md5(F.when(C("text").isNotNull(), whole)).alias("text_md5"), F.forall("_c", lambda c: c["end"] - c["start"] <= 2000).alias("fits"))


def chunk_prompt_input(spark, sf):
    d = _sectioned(spark, sf)
    return X.chunk_input(X.chunk(d, 2000), d, ["doc_id"]).select("doc_id", "chunk_no", F.length("input").cast("long").alias("n"), F.md5("input").alias("input_md5"))


def _parsed(spark, sf):
    return X.parse_extraction(bind(spark, sf, "responses"), ["chunk_id"])


def parse_extraction_ndjson(spark, sf):
    p = _parsed(spark, sf)
    c = p["conditions"].select("chunk_id", F.lit("condition").alias("kind"), C("name_medical").alias("name"), C("earliest_date").alias("date"), F.lit(None).cast("double").alias("value"))
    m = p["measurements"].select("chunk_id", F.lit("measurement").alias("kind"), "name", "date", C("value_numeric").alias("value"))
    r = p["providers"].select("chunk_id", F.lit("provider").alias("kind"), "name", F.lit(None).cast("string").alias("date"), F.lit(None).cast("double").alias("value"))
    return c.unionByName(m).unionByName(r)


def usable_extraction(spark, sf):
    return X.usable_extraction(_parsed(spark, sf), ["chunk_id"])


def inherit_report_attribution(spark, sf):
    return X.inherit_report_attribution(_parsed(spark, sf), ["chunk_id"]).select("chunk_id", "name_medical", "provider", "facility")


def extraction_outcome(spark, sf):
    chunks = bind(spark, sf, "responses").select("chunk_id", (C("chunk_id") % 5000).alias("document_id"))
    return X.extraction_outcome(chunks, X.usable_extraction(_parsed(spark, sf), ["chunk_id"]), ["document_id"], ["chunk_id"])


_ANATOMY = """concat('{"index":', CAST(id % 4 AS STRING), ',"system":"', CASE WHEN id % 5 = 0 THEN 'other' ELSE 'renal' END, '","status":"', CASE WHEN id % 7 = 0 THEN 'inferred' ELSE 'resolved' END,
 '","organ":"kidney","anatomical_location":null,"laterality":', CASE WHEN id % 11 = 0 THEN '3' ELSE 'null' END, ',"name_common":"', CAST(id AS STRING), '","local_names":null,"cx":', CASE WHEN id % 3 = 0 THEN '140' ELSE CAST(id % 100 AS STRING) END, ',"cy":', CASE WHEN id % 2 = 0 THEN '"x"' ELSE '12.5' END, '}')"""
_BATCH = "SELECT o_custkey AS batch, concat('```json', chr(10), {agg}, chr(10), '```') AS content FROM {src} GROUP BY 1"


def _batched(spark, sf, line):
    d = bind(spark, sf, "dated").select("o_custkey", "id", F.expr(line).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n")
    return d.groupBy(C("o_custkey").alias("batch")).agg(F.concat(F.lit("```json\n"), lines, F.lit("\n```")).alias("content"))


def parse_anatomy_ndjson(spark, sf):
    return X.parse_anatomy(_batched(spark, sf, _ANATOMY), ["batch"]).select("batch", C("index").alias("i"), "system", "status", "organ", "name_common", "cx", "cy")


_GROUP = """CASE WHEN id % 6 = 0 THEN 'oops {' ELSE concat('{"index":', CAST(id % 5 AS STRING), ',"group":', CASE WHEN id % 7 = 0 THEN '"a"' ELSE CAST(id % 3 AS STRING) END, '}') END"""


def parse_dedupe_groups(spark, sf):
    return X.parse_dedupe_groups(_batched(spark, sf, _GROUP), ["batch"]).select("batch", C("index").alias("i"), C("group").alias("g"))


_STRUCTURE = """concat('```json', chr(10), '{"organization":"', CASE WHEN id % 6 = 0 THEN 'random' ELSE 'mixed' END, '","documentDate":', CASE WHEN id % 2 = 0 THEN '"2021-01-01"' ELSE '7' END, ',"sections":[',
 CASE WHEN id % 5 = 0 THEN '' ELSE concat('{"heading":"A","startOffset":0,"endOffset":9,"inferredDate":"2020","sectionType":"labs","imageWorthy":true},{"heading":', CASE WHEN id % 7 = 0 THEN 'null' ELSE '"B"' END, ',"startOffset":9,"endOffset":20,"inferredDate":null,"sectionType":"odd"}') END, ']}', chr(10), '```')"""


def parse_structure(spark, sf):
    d = bind(spark, sf, "dated").select("id")
    r = bind(spark, sf, "dated").where("id % 9 > 0").select("id", F.expr(_STRUCTURE).alias("content"))
    out = X.parse_structure(r, d, ["id"]).select("id", "document_date", F.posexplode("sections").alias("n", "s"))
    return out.select("id", "document_date", "n", "s.heading", "s.inferredDate", "s.sectionType", "s.imageWorthy")


_PROVIDER = '{"name":"Dr. A","specialty":null,"email":null,"phone":null,"evidence":null}'
_FACILITY = '{"name":"Clinic","address":null,"city":null,"state":null,"country":null}'
_LONG = f"""concat('{{"schema_version":', CASE WHEN id % 7 = 0 THEN '2' ELSE '1' END, ',"measurements":[],"report_context":{{"providers":[{{"name":3}}', CASE WHEN id % 2 = 0 THEN ',{_PROVIDER}' ELSE '' END, '],"facilities":[', CASE WHEN id % 3 = 0 THEN '{_FACILITY}' ELSE '' END, ']}},
 "conditions":[{{"name_medical":"N', CAST(id AS STRING), '","provider":', CASE WHEN id % 5 = 0 THEN '{{"name":"Own"}}' ELSE 'null' END, ',"date_onset":', CASE WHEN id % 4 = 0 THEN 'null' ELSE '"2020"' END, ',"care_events":[', CASE WHEN id % 9 = 0 THEN '{{"facility":{_FACILITY}}}' ELSE '' END, ']}}]}}')"""


def parse_longitudinal_json(spark, sf):
    r = bind(spark, sf, "dated").select("id", F.expr(_LONG).alias("content"))
    return X.parse_longitudinal(r, ["id"]).drop("index")


def _events(spark, sf):
    """Care events as JSON, some of them ill-formed."""
    text = F.expr(f"""concat('{{"event_type":"', CASE WHEN id % 5 = 0 THEN 'guessed' ELSE 'treated' END, '","date":', CASE WHEN id % 7 = 0 THEN 'null' ELSE '"2020"' END, ',"provider":', CASE WHEN id % 3 = 0 THEN '{{"name":"x"}}' ELSE '{_PROVIDER}' END,
 ',"facility":', CASE WHEN id % 4 = 0 THEN 'null' WHEN id % 4 = 1 THEN '{_FACILITY}' ELSE '{{"name":1}}' END, CASE WHEN id % 11 = 0 THEN '' ELSE ',"evidence":null' END, '}}')""")
    return bind(spark, sf, "dated").select("id", F.try_parse_json(text).alias("v"))


def valid_shapes(spark, sf):
    v = C("v")
    return _events(spark, sf).select(
        "id", X.is_valid_provider(v, "$.provider").alias("provider"), X.is_valid_facility(v, "$.facility").alias("facility"), X.is_valid_care_event(v).alias("care_event")
    )


def is_valid_provider(spark, sf):
    return valid_shapes(spark, sf).select("id", C("provider").alias("valid"))


def is_valid_facility(spark, sf):
    return valid_shapes(spark, sf).select("id", C("facility").alias("valid"))


def is_valid_care_event(spark, sf):
    return valid_shapes(spark, sf).select("id", C("care_event").alias("valid"))


QUERIES = {f.__name__: f for f in (
    is_valid_provider, is_valid_facility, is_valid_care_event, redact_pii, redact_documents, remap_offsets, pii_counts, extract_provider_contacts, chunk_sections, chunk_cover, chunk_prompt_input, parse_extraction_ndjson, usable_extraction,
    inherit_report_attribution, extraction_outcome, parse_anatomy_ndjson, parse_dedupe_groups, parse_structure, parse_longitudinal_json, valid_shapes,
)}

_NOTES = view_sql("clinical_notes")
# what the rules leave of a note; a phone number runs on over the white space behind it
_LINES = """, n AS (SELECT record_id, patient_id, o_orderdate, c_name, c_nationkey, text, [concat('[PATIENT NAME]'), '[DATE OF BIRTH]', '[MRN]', concat('Attending physician: Dr. No', c_nationkey, ', email [EMAIL]'), '[PHONE][PATIENT NAME] was seen; SSN [SSN].', 'Diagnosis: Hypertension'] AS l
 FROM clinical_notes JOIN orders ON o_orderkey = record_id JOIN customer ON c_custkey = o_custkey)"""
_RESP = view_sql("responses")
_FLAGS = """, f AS (SELECT chunk_id, chunk_id % 5 <> 0 AND chunk_id % 7 <> 0 AS c, chunk_id % 4 <> 0 AS m, chunk_id % 2 = 0 AS p FROM responses)"""


def _redacted_sql() -> tuple[str, str, str]:
    """Steps that replace rule by rule, the count of matches, and the last step. The same as claims by precedence where no two
    matches overlap and no labelled name occurs again, as in the documents table."""
    plain = lambda p: p.replace("(?ai:", "(?i:").replace("(?a:", "(?:").replace("'", "''")
    steps, counts = ["r0 AS (SELECT doc_id, text AS t FROM documents)"], []
    for k, (name, pattern) in enumerate(X.REDACTION_RULES):
        before = f"n{k - 1}" if k else "0"
        steps.append(f"r{k + 1} AS (SELECT doc_id, regexp_replace(t, '{plain(pattern)}', '{name}', 'g') AS t, {before} + len(regexp_extract_all(t, '{plain(pattern)}')) AS n{k} FROM r{k})")
        counts.append(f"n{k}")
    return "WITH " + ", ".join(steps), counts[-1], f"r{len(counts)}"


_STEPS, _COUNT, _LAST = _redacted_sql()
SQL = {
    "redact_documents": f"{_STEPS} SELECT doc_id, {_COUNT}::BIGINT AS n_edits, length(t)::BIGINT AS n_chars_left FROM {_LAST}",
    "remap_offsets": _NOTES + """, n AS (SELECT record_id, text, length(text) AS n, c_name, concat('dr', c_nationkey, '@clinic.example.com') AS mail FROM clinical_notes JOIN customer ON c_custkey = patient_id),
 e AS (SELECT *, [{'s': 0, 'e': 9 + length(c_name), 'r': 14}, {'s': strpos(text, 'DOB: ') - 1, 'e': strpos(text, 'DOB: ') + 14, 'r': 15}, {'s': strpos(text, 'MRN: ') - 1, 'e': strpos(text, 'MRN: ') + 4 + length(record_id::VARCHAR), 'r': 5},
  {'s': strpos(text, mail) - 1, 'e': strpos(text, mail) - 1 + length(mail), 'r': 7}, {'s': strpos(text, 'Phone: ') - 1, 'e': strpos(text, 'Phone: ') + 20, 'r': 7}, {'s': strpos(text, 'Phone: ') + 20, 'e': strpos(text, 'Phone: ') + 20 + length(c_name), 'r': 14},
  {'s': strpos(text, '123-45-') - 1, 'e': strpos(text, '123-45-') + 10, 'r': 5}] AS ed, [floor(n * i / 4.0::DOUBLE + 0.5::DOUBLE)::BIGINT FOR i IN [0, 1, 2, 3]] AS b FROM n)
 SELECT record_id, array_to_string(b, ',') AS before, array_to_string([(x + list_sum([CASE WHEN d.e <= x THEN d.r - (d.e - d.s) ELSE 0 END FOR d IN ed]))::BIGINT FOR x IN b], ',') AS after FROM e""",
    "is_valid_provider": view_sql("dated") + "SELECT id, id % 3 <> 0 AS valid FROM dated",
    "is_valid_facility": view_sql("dated") + "SELECT id, id % 4 = 1 AS valid FROM dated",
    "is_valid_care_event": view_sql("dated") + "SELECT id, id % 5 <> 0 AND id % 7 <> 0 AND id % 3 <> 0 AND id % 4 < 2 AND id % 11 <> 0 AS valid FROM dated",
    "redact_pii": _NOTES + _LINES + "SELECT record_id, array_to_string(l, chr(10)) AS text, 7::BIGINT AS n_edits FROM n",
    "pii_counts": _NOTES + "SELECT unnest(['[PATIENT NAME]', '[DATE OF BIRTH]', '[MRN]', '[EMAIL]', '[PHONE]', '[SSN]']) AS kind, unnest([2, 1, 1, 1, 1, 1]) * count(*)::BIGINT AS n FROM clinical_notes",
    "extract_provider_contacts": _NOTES + _LINES + """SELECT patient_id, record_id, 3 AS line_no, NULL::VARCHAR AS name, concat('dr', c_nationkey, '@clinic.example.com') AS email, concat('555-010-', 1000 + record_id % 9000) AS phone,
 concat('Attending physician: Dr. No', c_nationkey, ', email dr', c_nationkey, '@clinic.example.com') AS evidence FROM n""",
    "chunk_cover": "SELECT doc_id, md5(text) AS text_md5, true AS fits FROM documents",
    "parse_extraction_ndjson": _RESP + _FLAGS + """SELECT chunk_id, 'condition' AS kind, o_orderpriority AS name, CASE WHEN chunk_id % 3 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date, NULL::DOUBLE AS value FROM f JOIN orders ON o_orderkey = chunk_id WHERE c
 UNION ALL SELECT chunk_id, 'measurement', 'LDL', NULL, (100 + chunk_id % 100)::DOUBLE FROM f WHERE m UNION ALL SELECT chunk_id, 'provider', concat('Dr. No', o_custkey % 9), NULL, NULL FROM f JOIN orders ON o_orderkey = chunk_id WHERE p""",
    "usable_extraction": _RESP + _FLAGS + "SELECT chunk_id, (3 - c::INT - m::INT - p::INT)::BIGINT AS skipped, c OR m AS usable FROM f",
    "inherit_report_attribution": _RESP + _FLAGS + "SELECT chunk_id, o_orderpriority AS name_medical, CASE WHEN p THEN concat('Dr. No', o_custkey % 9) END AS provider, NULL::VARCHAR AS facility FROM f JOIN orders ON o_orderkey = chunk_id WHERE c",
    "extraction_outcome": _RESP + _FLAGS + "SELECT chunk_id % 5000 AS document_id, count(*)::BIGINT AS n_chunks, count(*) FILTER (c OR m)::BIGINT AS n_ok, NOT bool_or(c OR m) AS failed FROM f GROUP BY 1",
    "parse_anatomy_ndjson": view_sql("dated") + """SELECT o_custkey AS batch, (id % 4)::INT AS i, 'renal' AS system, 'resolved' AS status, 'kidney' AS organ, id::VARCHAR AS name_common, CASE WHEN id % 3 <> 0 THEN (id % 100)::DOUBLE END AS cx, CASE WHEN id % 2 <> 0 THEN 12.5::DOUBLE END AS cy
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, id % 4 ORDER BY id DESC) AS r FROM dated WHERE id % 5 <> 0 AND id % 7 <> 0 AND id % 11 <> 0) WHERE r = 1""",
    "parse_dedupe_groups": view_sql("dated") + "SELECT o_custkey AS batch, (id % 5)::INT AS i, (id % 3)::INT AS g FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, id % 5 ORDER BY id DESC) AS r FROM dated WHERE id % 6 <> 0 AND id % 7 <> 0) WHERE r = 1",
    "parse_structure": view_sql("dated") + """, ok AS (SELECT id, id % 9 > 0 AND id % 6 <> 0 AND id % 5 <> 0 AND id % 7 <> 0 AS ok FROM dated)
 SELECT id, CASE WHEN id % 2 = 0 THEN '2021-01-01' END AS document_date, n, CASE n WHEN 0 THEN 'A' ELSE 'B' END AS heading, CASE n WHEN 0 THEN '2020' END AS inferredDate, CASE n WHEN 0 THEN 'labs' ELSE 'other' END AS sectionType, n = 0 AS imageWorthy FROM ok, (SELECT unnest([0, 1])::INT AS n) WHERE ok
 UNION ALL SELECT id, NULL, 0, 'Full record', NULL, 'other', false FROM ok WHERE NOT ok""",
    "parse_longitudinal_json": view_sql("dated") + """, x AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'Own' WHEN id % 2 = 0 THEN 'Dr. A' END AS provider, CASE WHEN id % 4 <> 0 THEN '2020' END AS date, id % 3 = 0 AS fac FROM dated WHERE id % 7 <> 0)
 SELECT id, concat('N', id) AS name_medical, provider, date, ((id % 9 = 0)::INT + (provider IS NOT NULL AND fac AND date IS NOT NULL AND id % 9 <> 0)::INT)::BIGINT AS n_care_events,
 concat_ws(',', CASE WHEN id % 5 <> 0 AND id % 2 = 0 THEN 'provider:report_context' END, CASE WHEN provider IS NOT NULL AND fac AND date IS NOT NULL THEN 'facility:report_context' END) AS provenance FROM x""",
    "valid_shapes": view_sql("dated") + "SELECT id, id % 3 <> 0 AS provider, id % 4 = 1 AS facility, id % 5 <> 0 AND id % 7 <> 0 AND id % 3 <> 0 AND id % 4 < 2 AND id % 11 <> 0 AS care_event FROM dated",
}
