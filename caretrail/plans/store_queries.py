"""Queries of the sources, stores, backups, placement and streams, with their SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretrail.functions import scalars as S
from caretrail.operators import placement as P
from caretrail.operators import views as V
from caretrail.plans.bindings import base, bind, view_sql
from caretrail.plans.scalar_queries import _ANCHOR, _HASH, _SYSTEM
from caretrail.plans.view_queries import _BASE, _LOC_SQL, _conditions, _locations
from caretrail.plans.view_queries import SQL as VIEW_SQL
from caretrail.schemas import STORES
from caretrail.sources import backup as B
from caretrail.sources import documents as D
from caretrail.sources import store as ST
from caretrail.sources.shared import fresh_path, written
from caretrail.streaming import jobs
from caretrail.streaming import records as RS

C = F.col


def _folder(spark) -> str:
    return fresh_path(spark, "store")


def _pages(spark, sf):
    d = base(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    g = d.groupBy("doc_id", (C("line") / 4).cast("int").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return g.select("doc_id", "page_no", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def assemble_document(spark, sf):
    a = D.assemble_document(_pages(spark, sf), ["doc_id"])
    return a.select("doc_id", F.md5("text").alias("text_md5"), F.array_join(C("page_breaks").cast("array<string>"), ",").alias("breaks"), C("page_count").cast("long").alias("pages"))


def classify_scanned(spark, sf):
    a = D.classify_scanned(D.assemble_document(_pages(spark, sf), ["doc_id"]), 400)
    return a.select("doc_id", "method", F.array_join(C("image_only_pages").cast("array<string>"), ",").alias("image_only"))


_PAGES_SQL = """WITH p AS (SELECT doc_id, (i - 1) // 4 AS page_no, string_agg(l, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY 1, 2),
o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM p) """


def _stored(spark, sf):
    return bind(spark, sf, "health_records").withColumn("n", C("id") % 10)


def _changes(spark, sf):
    return bind(spark, sf, "dated").where("id % 3 = 0").select(C("o_custkey").alias("patient_id"), (C("id") - C("id") % 2 + 20000 * (C("id") % 4).cast("int")).alias("id"), F.lit("new.pdf").alias("filename"), F.lit(None).cast("string").alias("record_type"), (C("id") % 7).alias("n"), C("id").alias("seq"))


_CHANGES_SQL = ", s AS (SELECT *, id % 10 AS n FROM health_records), ch AS (SELECT o_custkey AS patient_id, o_orderkey - o_orderkey % 2 + 20000 * (o_orderkey % 4) AS id, 'new.pdf' AS filename, NULL::VARCHAR AS record_type, o_orderkey % 7 AS n, o_orderkey AS seq FROM orders WHERE o_orderkey % 3 = 0)"


def read_store(spark, sf):
    """A store written as Parquet, then the rows of some parents read back."""
    root = _folder(spark)
    c = written(_conditions(spark, sf).select("patient_id", "id", "cx", "cy", "seq"), "conditions")
    rows = _locations(spark, sf, c).select(C("patient_id").cast("string"), "id", "condition_id", "cx", "cy", "is_primary")
    none = F.lit(None).cast("string")
    ST.write_store(rows.withColumns({"anatomical_location": none, "laterality": none, "evidence": none}), root, "condition_locations")
    parents = c.where("seq % 2 = 0").select(C("id").alias("condition_id"))
    return ST.read_store(spark, root, "condition_locations", "condition_id", parents).select("patient_id", "id", "condition_id", "cx", "cy", "is_primary")


def upsert_store(spark, sf):
    return ST.upsert(_stored(spark, sf), _changes(spark, sf), ["id"])


def delete_rows(spark, sf):
    return ST.delete_rows(_stored(spark, sf), _changes(spark, sf).select("id").distinct(), ["id"])


def update_position(spark, sf):
    c, loc = _conditions(spark, sf), _locations(spark, sf)
    moves = c.where("seq % 5 = 0").select(C("id").alias("condition_id"), F.lit(1.5).alias("cx"), F.lit(2.5).alias("cy"))
    a, b = ST.update_position(c, loc, moves)
    return a.select(F.lit("condition").alias("kind"), "id", "cx", "cy").unionByName(b.select(F.lit("location").alias("kind"), "id", "cx", "cy"))


def pending_outbox(spark, sf):
    pending = bind(spark, sf, "dated").select((C("id") * 2).alias("id"), F.concat(F.lit("f"), C("id").cast("string")).alias("filename"))
    return ST.pending_retries(pending, bind(spark, sf, "health_records"), ["id"])


def persist_counts(spark, sf):
    """Mentions and measurements per record; the measurements' records are the events' users, so a record may have one kind only."""
    return ST.persist_counts(bind(spark, sf, "condition_mentions").select("record_id"), bind(spark, sf, "measurements"))


def persist_counts_all(spark, sf):
    """The same over few, large records: mentions by their record's last digits."""
    return ST.persist_counts(bind(spark, sf, "condition_mentions").select((C("record_id") % 500).alias("record_id")), bind(spark, sf, "measurements"))


def _enriched(spark, sf):
    c = _conditions(spark, sf).where("record_id IS NOT NULL")
    # up to three of each, by seq
    event = lambda k: F.struct(F.lit("treated").alias("event_type"), F.when((C("seq") + k) % 3 > 0, F.lit("2020-01-01")).alias("date"), F.concat(F.lit("P"), ((C("seq") + k) % 3).cast("string")).alias("provider_name"), C("facility_name").alias("facility_name"))
    upto = lambda make: F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda k: k < C("seq") % 4), make)
    none = F.lit(None).cast("string")
    return c.select(
        "patient_id", "record_id", C("id").alias("condition_id"), "seq", F.when(C("seq") % 9 == 0, "Nephrolithiasis").otherwise(C("name_medical")).alias("name_medical"), "system", "status", C("date").alias("date_diagnosed"), none.alias("date_onset"), "evidence", "cx", "cy",
        upto(event).alias("care_events"),
        upto(lambda k: F.struct(F.concat(F.lit("P"), (k % 3).cast("string")).alias("name"), none.alias("email"), none.alias("phone"))).alias("providers"),
        upto(lambda k: F.struct(F.when(k == 1, " ").otherwise(C("facility_name")).alias("name"))).alias("facilities"),
        upto(lambda k: F.struct(F.lit("Left").alias("anatomical_location"), none.alias("laterality"), F.when(k != 1, C("cx") + k).alias("cx"), F.when(k != 1, C("cy")).alias("cy"))).alias("locations"),
    )


def normalize_enriched(spark, sf):
    """All child rows of the enriched conditions, with their ids."""
    e = written(_enriched(spark, sf), "enriched")
    t = ST.normalize(e, e.select("condition_id", "cx", "cy"), "2024-01-01")
    out = t["conditions"].select(F.lit("conditions").alias("store"), "id", C("date").alias("a"))
    for store, value in (("condition_locations", "condition_id"), ("providers", "name"), ("facilities", "name"), ("condition_care_events", "provider_name")):
        out = out.unionByName(t[store].select(F.lit(store).alias("store"), "id", C(value).alias("a")))
    return out.unionByName(t["health_records"].select(F.lit("health_records").alias("store"), C("id").cast("string"), C("filename").alias("a")))


def _located(spark, sf):
    """Mentions with the model's anatomy, with people and places nested, as join_anatomy gives them."""
    m = written(bind(spark, sf, "condition_mentions"), "mentions")  # read twice, for what was said and for its anatomy
    n = C("seq")
    person = F.struct(C("provider_name").alias("name"), F.when(n % 2 == 0, "Cardiology").alias("specialty"), F.concat(F.lit("p"), n.cast("string"), F.lit("@x.example")).alias("email"))
    place = F.struct(C("facility_name").alias("name"), F.lit("Main St").alias("address"))
    s = m.select("patient_id", "record_id", n.alias("index"), F.when(n % 7 == 0, "Nephrolithiasis").otherwise(C("name_medical")).alias("name_medical"), F.when(n % 3 == 0, "seen twice").alias("notes"), C("date_diagnosed").alias("earliest_date"), C("date_inherited").alias("earliest_date_inherited"), F.when(n % 5 > 0, person).alias("provider"), F.when(n % 4 > 0, place).alias("facility"))
    a = m.select("patient_id", n.alias("index"), "system", "status", "organ", F.when(n % 3 > 0, "left").alias("laterality"), F.concat(F.lit("part "), (n % 9).cast("string")).alias("anatomical_location"), (n % 40).cast("double").alias("cx"), (n % 30).cast("double").alias("cy"))
    return V.join_anatomy(s, a).withColumns({"condition_id": F.concat(C("patient_id").cast("string"), F.lit(":"), C("index").cast("string")), "seq": C("index")})


def normalize_stores(spark, sf):
    """All ten stores of the located mentions, written, read back and checked: their rows, and no violation."""
    e = written(_located(spark, sf), "located")
    placed = e.select("condition_id", (C("cx") + 50).alias("cx"), C("cy"))
    m = bind(spark, sf, "measurements").withColumn("patient_id", C("record_id"))
    records = e.select("patient_id", "record_id").unionByName(m.select("patient_id", "record_id")).distinct().withColumns({"filename": F.concat(C("record_id").cast("string"), F.lit(".pdf")), "page_count": F.lit(2)})
    root = _folder(spark)
    ST.write_stores(ST.normalize(e, placed, "2024-01-01", m, records=records), root)
    stores = {name: ST.read_store(spark, root, name) for name in STORES}
    shown = {
        "health_records": ["filename", "page_count"], "conditions": ["name_common", "record_id", "system", "organ", "anatomical_location", "status", "cx", "date", "note", "inferred_fields"], "condition_locations": ["condition_id", "cx", "cy", "is_primary", "laterality"],
        "providers": ["record_id", "condition_id", "name", "specialty", "email"], "facilities": ["condition_id", "name", "address"], "condition_care_events": ["condition_id", "event_type", "date", "provider_name", "provider_specialty", "facility_name", "facility_address"],
        "measurements": ["record_id", "name", "unit", "date"],
    }

    def shot(name, rows):
        text = lambda f: C(f.name).cast("int").cast("string") if isinstance(f.dataType, T.DoubleType) else F.array_join(f.name, ",") if isinstance(f.dataType, T.ArrayType) else C(f.name).cast("string")
        said = [F.coalesce(text(rows.schema[c]), F.lit("-")) for c in shown.get(name, [])]
        return rows.select(F.lit(name).alias("store"), "patient_id", "id", F.concat_ws("|", *said).alias("said"))

    out = B.validate_backup(stores).where("rule <> 'loose'").select(F.lit("violation").alias("store"), C("store").alias("patient_id"), "id", C("rule").alias("said"))
    for name, rows in stores.items():
        out = out.unionByName(shot(name, rows))
    return out


def secondary_locations(spark, sf):
    e = _enriched(spark, sf).withColumn("_x", C("cx")).withColumn("_y", C("cy"))
    return ST.secondary_locations(e).select("id", "condition_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def secondary_locations_all(spark, sf):
    """The same without rounding."""
    e = _enriched(spark, sf).withColumn("_x", C("cx")).withColumn("_y", C("cy"))
    return ST.secondary_locations(e).select("id", "condition_id", "cx", "cy")


def _stores(spark, sf):
    text = lambda c: C(c).cast("string").alias(c)
    return {
        "health_records": bind(spark, sf, "health_records").select("patient_id", text("id"), "filename", "record_type"),
        "conditions": _conditions(spark, sf).select("patient_id", "id", text("record_id"), "name_medical", "status", "cx"),
    }


_SCHEMAS = {"health_records": "id:string,filename:string,record_type:string", "conditions": "id:string,record_id:string,name_medical:string,status:string,cx:double", "facilities": "id:string,name:string"}


def export_backup(spark, sf):
    e = B.export_backup(_stores(spark, sf), "2024-01-01T00:00:00Z")
    n = lambda s: F.size(F.from_json(F.get_json_object("envelope", f"$.stores.{s}"), "array<string>")).cast("long")
    return e.select("patient_id", F.get_json_object("envelope", "$.app").alias("app"), n("health_records").alias("n_records"), n("conditions").alias("n_conditions"))


def import_backup(spark, sf):
    """Export, then import: the rows of the stores again; the absent store is empty."""
    t = B.import_backup(B.export_backup(_stores(spark, sf), "2024-01-01T00:00:00Z"), _SCHEMAS)
    c = t["conditions"].select(F.lit("conditions").alias("store"), "patient_id", "id", C("record_id").alias("a"), C("cx"))
    r = t["health_records"].select(F.lit("health_records").alias("store"), "patient_id", "id", C("record_type").alias("a"), F.lit(None).cast("double").alias("cx"))
    f = t["facilities"].select(F.lit("facilities").alias("store"), "patient_id", "id", C("name").alias("a"), F.lit(None).cast("double").alias("cx"))
    return c.unionByName(r).unionByName(f)


def blob_round_trip(spark, sf):
    d = base(spark, sf, "documents").select("doc_id", F.when(C("doc_id") % 5 > 0, C("text").cast("binary")).alias("b"))
    e = B.encode_blobs(d, ["b"])
    broken = F.when(C("doc_id") % 7 == 0, F.struct(F.lit(True).alias("__blob"), F.lit("no base64!").alias("data"), F.lit("image/png").alias("mimeType"))).otherwise(C("b"))
    out = B.decode_blobs(e.withColumn("b", broken), ["b"])
    return out.select("doc_id", "bad_blobs", F.md5("b").alias("md5"))


def encode_blobs(spark, sf):
    e = B.encode_blobs(base(spark, sf, "documents").select("doc_id", F.when(C("doc_id") % 5 > 0, C("text").cast("binary")).alias("b")), ["b"])
    return e.select("doc_id", F.md5(C("b.data")).alias("data_md5"), C("b.__blob").alias("tagged"))


def decode_blobs(spark, sf):
    text = F.when(C("doc_id") % 7 == 0, "no base64!").otherwise(F.base64(C("text").cast("binary")))
    d = base(spark, sf, "documents").select("doc_id", F.struct(F.lit(True).alias("__blob"), text.alias("data"), F.lit("image/png").alias("mimeType")).alias("b"))
    return B.decode_blobs(d, ["b"]).select("doc_id", "bad_blobs", F.length("b").cast("long").alias("n_bytes"))


def validate_backup(spark, sf):
    s = _stores(spark, sf)
    s["conditions"] = s["conditions"].withColumn("record_id", F.when(C("cx") % 30 == 0, "gone").otherwise(C("record_id"))).withColumn("status", F.when(C("cx") % 31 == 0, "odd").otherwise(C("status")))
    s["conditions"] = written(s["conditions"], "conditions")  # every check reads them
    return B.validate_backup(s)


#: Systems that have a mask in the query, by the nation's key.
_MASKED = ("renal", "digestive", "nervous", "muscular", "skeletal", "cardiovascular", "endocrine", "lymphatic", "respiratory", "reproductive", "integumentary")


def _masks(spark, sf):
    """A mask for each system with suppliers' columns of pixels, from the nations' keys."""
    pixels = F.transform(F.sequence(F.lit(0), F.lit(12 * 9 - 1)), lambda i: F.when((i * 7 + C("k") * 5) % 23 < 2, "FF").otherwise("00"))
    systems = base(spark, sf, "nation").where("n_nationkey < 11").select(C("n_nationkey").alias("k"))
    return systems.select(F.get(F.array(*[F.lit(s) for s in _MASKED]), C("k")).alias("system"), F.lit(12).alias("width"), F.lit(9).alias("height"), F.unhex(F.array_join(F.when(C("k") == 3, F.transform(pixels, lambda x: F.lit("00"))).otherwise(pixels), "")).alias("alpha"))


def repair_coordinates(spark, sf):
    p = _conditions(spark, sf).select("id", S.normalize_system(C("system")).alias("system"), (C("cx") * 1.3 - 10).alias("cx"), (C("cy") * 1.7 - 5).alias("cy"))
    return P.repair_coordinates(p, _masks(spark, sf)).select("id", "system", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def _placed(spark, sf):
    c = _conditions(spark, sf).select("patient_id", S.normalize_system(C("system")).alias("system"), C("id").alias("condition_id"), "seq", (C("seq") % 3).cast("double").alias("cx"), F.lit(10.0).alias("cy"))
    return P.place_conditions(c, ["patient_id"]).withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


def place_conditions(spark, sf):
    return _placed(spark, sf).select("condition_id", "cx", "cy")


def _unplaced(spark, sf):
    """Conditions with and without points and locations, of systems as written."""
    c = _enriched(spark, sf)
    point = lambda c, k: F.when(C("seq") % k > 0, C(c) * 1.1)
    return c.select("patient_id", "condition_id", "seq", "name_medical", "system", point("cx", 4).alias("cx"), point("cy", 5).alias("cy"), "locations")


def place_masked(spark, sf):
    """Points from locations, defaults and masks; the plain form is in the tests."""
    out = P.place_conditions(_unplaced(spark, sf), ["patient_id"], _masks(spark, sf))
    last = F.get("locations", F.size("locations") - 1)
    return out.select("condition_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round(last["cx"], 6).alias("last_cx"), F.round(last["cy"], 6).alias("last_cy"))


def place_first(spark, sf):
    """The first conditions of each system keep their points, as nothing is there yet."""
    first = _placed(spark, sf).groupBy("patient_id", "system").agg(F.min_by(F.struct("condition_id", "cx", "cy"), "seq").alias("x"))
    return first.select("x.*")


def stream_ingest(spark, sf):
    """Orders as arriving documents, each file a batch; replays must not duplicate rows."""
    root = _folder(spark)
    source = spark.readStream.schema(base(spark, sf, "orders").schema).parquet(f"{sf}/orders.parquet*")
    job = lambda batch: batch.select(C("o_orderkey").alias("id"), C("o_custkey").alias("patient_id"), S.parse_date_frac(C("o_orderdate").cast("date").cast("string")).alias("year_frac"))
    q = jobs.stream_ingest(source, job, root, "records", ["id"], f"{root}/checkpoint")
    q.awaitTermination()
    return jobs.read_snapshot(spark, root, "records").select("id", "patient_id", F.round("year_frac", 6).alias("year_frac"))


def stream_call_health(spark, sf):
    root = _folder(spark)
    events = spark.readStream.schema(base(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    status = F.expr("CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN 500 WHEN 'signup' THEN 402 ELSE 200 END")
    calls = events.select(C("ts").cast("timestamp").alias("ts"), F.concat(F.lit("model-"), (C("user_id") % 7).cast("string")).alias("model"), status.alias("http_status"))
    q = jobs.keep_current(jobs.stream_call_health(calls, "365 days"), root, "health", ["model", "since"], f"{root}/checkpoint")
    q.awaitTermination()
    return jobs.read_snapshot(spark, root, "health").select("model", C("since").cast("date").cast("string").alias("day"), "n_attempts", "n_ok", "n_limited")


def stream_call_outcome(spark, sf):
    """The call log as a stream: the outcome of each call, kept current."""
    root = _folder(spark)
    events = spark.readStream.schema(base(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    status = F.expr("CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN 500 WHEN 'signup' THEN 402 ELSE 200 END")
    ts = C("ts").cast("timestamp")
    calls = events.select(C("event_id").alias("seq"), ts.alias("ts"), F.concat_ws(":", C("user_id").cast("string"), ts.cast("date").cast("string")).alias("call_id"), F.concat(F.lit("model-"), (C("user_id") % 7).cast("string")).alias("model"), status.alias("http_status"))
    q = jobs.keep_current(jobs.stream_call_outcome(calls, "365 days"), root, "outcomes", ["call_id"], f"{root}/checkpoint")
    q.awaitTermination()
    return jobs.read_snapshot(spark, root, "outcomes").select("call_id", "outcome", "model", "n_attempts")


def stream_records(spark, sf):
    """Notes as arriving documents through the whole batch job; a batch that comes again changes nothing."""
    root = _folder(spark)
    notes = bind(spark, sf, "clinical_notes").select("record_id", "text")
    source = spark.readStream.schema(base(spark, sf, "orders").schema).parquet(f"{sf}/orders.parquet*").select(C("o_orderkey").alias("record_id"))
    job = jobs.record_job(bind(spark, sf, "responses").select(C("chunk_id").alias("record_id"), F.lit(0).alias("chunk_no"), "content"))
    q = jobs.stream_ingest(source, lambda batch: job(batch.join(notes, "record_id")), root, "conditions", ["record_id", "condition_key"], f"{root}/checkpoint")
    q.awaitTermination()
    return jobs.read_snapshot(spark, root, "conditions").select("record_id", "name_medical", "date_diagnosed", "provider_name", "n_mentions")


def stream_stores(spark, sf):
    """Notes as arriving documents into all linked stores at once: what each store holds of each record after the last batch."""
    root = _folder(spark)
    notes = bind(spark, sf, "clinical_notes").select("record_id", "text")
    source = spark.readStream.schema(base(spark, sf, "orders").schema).parquet(f"{sf}/orders.parquet*").select(C("o_custkey").alias("patient_id"), C("o_orderkey").alias("record_id"))
    job = RS.record_stores(bind(spark, sf, "responses").select(C("chunk_id").alias("record_id"), F.lit(0).alias("chunk_no"), "content"), "2024-01-01")
    q = RS.stream_stores(source, lambda batch: job(batch.join(notes, "record_id")), root, f"{root}/checkpoint")
    q.awaitTermination()
    stores = {s: RS.read_records(spark, root, s) for s in RS.OWNED}
    condition = stores["conditions"].select(C("id").alias("condition_id"), "record_id")
    shown = {
        "health_records": stores["health_records"].select(C("id").alias("record_id"), C("filename").alias("value")),
        "pending_extraction_text": stores["pending_extraction_text"].select(C("id").alias("record_id"), C("filename").alias("value")),
        "conditions": stores["conditions"].select("record_id", F.concat_ws("|", "name_medical", "status", "date").alias("value")),
        "measurements": stores["measurements"].select("record_id", F.concat_ws("|", "name", C("value_numeric").cast("int").cast("string"), "date").alias("value")),
        "providers": stores["providers"].select("record_id", F.concat_ws("|", "name", "email").alias("value")),
        "facilities": stores["facilities"].select("record_id", C("name").alias("value")),
        "condition_locations": stores["condition_locations"].join(condition, "condition_id").select("record_id", C("is_primary").cast("string").alias("value")),
        "condition_care_events": stores["condition_care_events"].join(condition, "condition_id").select("record_id", F.concat_ws("|", "provider_name", "date").alias("value")),
    }
    return reduce(DataFrame.unionByName, [rows.select(F.lit(s).alias("store"), "record_id", "value") for s, rows in shown.items()])


def measurement_rows(spark, sf):
    """The measurements' store rows; those without a date take the day of the run."""
    return ST.measurement_rows(bind(spark, sf, "measurements"), "2024-01-01").select("id", "record_id", "name", "value_numeric", "unit", "date")


def rejected_backups(spark, sf):
    """Envelopes of which some are spoilt: another app, another version, no JSON."""
    e = B.export_backup({"health_records": _stores(spark, sf)["health_records"]}, "2024-01-01T00:00:00Z")
    spoilt = F.when(C("patient_id") % 5 == 0, F.replace("envelope", F.lit('"app":"caretrail"'), F.lit('"app":"other"'))).when(C("patient_id") % 7 == 0, F.replace("envelope", F.lit('"formatVersion":1'), F.lit('"formatVersion":2'))).when(C("patient_id") % 11 == 0, F.lit("not json"))
    return B.rejected_backups(e.withColumn("envelope", F.coalesce(spoilt, "envelope")))


QUERIES = {f.__name__: f for f in (
    assemble_document, classify_scanned, read_store, upsert_store, delete_rows, update_position, pending_outbox, persist_counts, persist_counts_all, normalize_enriched, normalize_stores, secondary_locations, secondary_locations_all, export_backup,
    import_backup, encode_blobs, decode_blobs, blob_round_trip, validate_backup, repair_coordinates, place_conditions, place_masked, place_first, stream_ingest, stream_call_health, stream_call_outcome, stream_records, stream_stores, measurement_rows, rejected_backups,
)}

_ENR = _BASE + """, e AS (SELECT *, CASE WHEN seq % 9 = 0 THEN 'Nephrolithiasis' ELSE name_medical END AS nm FROM cond WHERE record_id IS NOT NULL), k AS (SELECT *, k FROM e, (SELECT unnest([0, 1, 2]) AS k) WHERE k < seq % 4),
ev AS (SELECT *, concat('P', (seq + k) % 3) AS pn, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS n FROM k WHERE (seq + k) % 3 > 0)"""
SQL = {
    "assemble_document": _PAGES_SQL + "SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY page_no)) AS text_md5, string_agg(off::VARCHAR, ',' ORDER BY page_no) AS breaks, count(*)::BIGINT AS pages FROM o GROUP BY 1",
    "classify_scanned": _PAGES_SQL + "SELECT doc_id, CASE WHEN (sum(length(text)) + count(*) - 1) / count(*)::DOUBLE < 400 THEN 'ocr' ELSE 'text' END AS method, coalesce(string_agg((page_no + 1)::VARCHAR, ',' ORDER BY page_no) FILTER (length(trim(text, ' ')) < 400), '') AS image_only FROM o GROUP BY 1",
    "read_store": _BASE + _LOC_SQL + "SELECT loc.patient_id::VARCHAR AS patient_id, loc.id, condition_id, loc.cx, loc.cy, is_primary FROM loc WHERE split_part(condition_id, ':', 2)::BIGINT % 2 = 0",
    "upsert_store": view_sql("health_records") + _CHANGES_SQL + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM ch) WHERE r = 1)
 SELECT patient_id, id, filename, record_type, n FROM l UNION ALL SELECT patient_id, id, filename, record_type, n FROM s WHERE id NOT IN (SELECT id FROM ch)""",
    "delete_rows": view_sql("health_records") + _CHANGES_SQL + "SELECT patient_id, id, filename, record_type, n FROM s WHERE id NOT IN (SELECT id FROM ch)",
    "update_position": _BASE + _LOC_SQL + """, f AS (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY is_primary DESC, id) AS r FROM loc)
 SELECT 'condition' AS kind, id, CASE WHEN seq % 5 = 0 THEN 1.5 ELSE cx END::DOUBLE AS cx, CASE WHEN seq % 5 = 0 THEN 2.5 ELSE cy END::DOUBLE AS cy FROM cond
 UNION ALL SELECT 'location', f.id, CASE WHEN seq % 5 = 0 AND r = 1 THEN 1.5 ELSE f.cx END, CASE WHEN seq % 5 = 0 AND r = 1 THEN 2.5 ELSE f.cy END FROM f JOIN cond ON cond.id = f.condition_id
 UNION ALL SELECT 'location', concat(id, '-primary'), 1.5, 2.5 FROM cond WHERE seq % 5 = 0 AND seq % 4 = 0""",
    "pending_outbox": "SELECT o_orderkey * 2 AS id, concat('f', o_orderkey) AS filename FROM orders WHERE o_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders)",
    "persist_counts": view_sql("condition_mentions", "measurements") + ", c AS (SELECT record_id, count(*) AS n FROM condition_mentions GROUP BY 1), m AS (SELECT record_id, count(*) AS n FROM measurements GROUP BY 1) SELECT record_id, coalesce(c.n, 0)::BIGINT AS condition_count, coalesce(m.n, 0)::BIGINT AS measurement_count FROM c FULL JOIN m USING (record_id)",
    "persist_counts_all": view_sql("condition_mentions", "measurements") + ", c AS (SELECT record_id % 500 AS record_id, count(*) AS n FROM condition_mentions GROUP BY 1), m AS (SELECT record_id, count(*) AS n FROM measurements GROUP BY 1) SELECT record_id, coalesce(c.n, 0)::BIGINT AS condition_count, coalesce(m.n, 0)::BIGINT AS measurement_count FROM c FULL JOIN m USING (record_id)",
    "normalize_stores": view_sql("condition_mentions", "measurements") + """, m AS (SELECT *, concat(patient_id, ':', seq) AS cid, CASE WHEN seq % 7 = 0 THEN 'Nephrolithiasis' ELSE name_medical END AS nm, coalesce(date_diagnosed, '-') AS d,
 seq % 3 > 0 AS lat, seq % 5 > 0 AND provider_name IS NOT NULL AS pr, seq % 4 > 0 AS fa, concat('part ', seq % 9) AS part FROM condition_mentions),
 r AS (SELECT patient_id, record_id FROM m UNION SELECT record_id, record_id FROM measurements),
 k AS (SELECT record_id, concat(record_id, '-measurement-', row_number() OVER (PARTITION BY record_id ORDER BY seq) - 1) AS id, concat_ws('|', record_id, name, unit, coalesce(date, '2024-01-01')) AS said FROM measurements)
 SELECT 'health_records' AS store, patient_id::VARCHAR AS patient_id, record_id::VARCHAR AS id, concat(record_id, '.pdf|2') AS said FROM r
 UNION ALL SELECT 'conditions', patient_id::VARCHAR, cid, concat_ws('|', nm, record_id, system, coalesce(organ, '-'), part, status, seq % 40 + 50, d, CASE WHEN seq % 3 = 0 THEN 'seen twice' ELSE '-' END, CASE WHEN date_inherited THEN 'date_diagnosed' ELSE '-' END) FROM m
 UNION ALL SELECT 'condition_locations', patient_id::VARCHAR, concat(cid, '-primary'), concat_ws('|', cid, seq % 40 + 50, seq % 30, 'true', CASE WHEN lat AND seq % 7 = 0 THEN 'left' ELSE '-' END) FROM m
 UNION ALL SELECT 'condition_locations', patient_id::VARCHAR, concat(cid, '-loc-0'), concat_ws('|', cid, seq % 40, seq % 30, 'false', 'left') FROM m WHERE lat AND seq % 7 > 0
 UNION ALL SELECT 'condition_care_events', patient_id::VARCHAR, concat(cid, '-care-0'), concat_ws('|', cid, 'other', d, provider_name, CASE WHEN seq % 2 = 0 THEN 'Cardiology' ELSE '-' END, CASE WHEN fa THEN facility_name ELSE '-' END, CASE WHEN fa THEN 'Main St' ELSE '-' END) FROM m WHERE pr AND date_diagnosed IS NOT NULL
 UNION ALL SELECT 'providers', patient_id::VARCHAR, x, concat_ws('|', record_id, cid, provider_name, CASE WHEN seq % 2 = 0 THEN 'Cardiology' ELSE '-' END, concat('p', seq, '@x.example'))
  FROM (SELECT *, unnest(CASE WHEN date_diagnosed IS NOT NULL THEN [concat(cid, '-care-0-provider'), concat(cid, '-provider')] ELSE [concat(cid, '-provider')] END) AS x FROM m WHERE pr)
 UNION ALL SELECT 'facilities', patient_id::VARCHAR, concat(cid, '-facility-0'), concat_ws('|', cid, facility_name, 'Main St') FROM m WHERE fa
 UNION ALL SELECT 'measurements', record_id::VARCHAR, id, said FROM k""",
    "normalize_enriched": _ENR + """SELECT 'conditions' AS store, id, date AS a FROM e UNION ALL SELECT DISTINCT 'health_records', record_id::VARCHAR, concat('record-', record_id, '.pdf') FROM e
 UNION ALL SELECT 'condition_locations', concat(id, '-primary'), id FROM e UNION ALL SELECT 'condition_locations', concat(id, '-loc-', k), id FROM k WHERE k > 0
 UNION ALL SELECT 'condition_care_events', concat(id, '-care-', n), pn FROM ev UNION ALL SELECT 'providers', concat(id, '-care-', n, '-provider'), pn FROM ev
 UNION ALL SELECT 'providers', concat(id, '-provider-extra-', k), concat('P', k) FROM k WHERE (id, concat('P', k)) NOT IN (SELECT (id, pn) FROM ev)
 UNION ALL SELECT 'facilities', concat(id, '-facility-', k), facility_name FROM k WHERE k <> 1""",
    "secondary_locations": _ENR + f""", s AS (SELECT * EXCLUDE (name_medical), concat(nm, ':Left::', k) AS name, {_SYSTEM} AS system_id FROM k WHERE k > 0),
 q AS (SELECT id, k, cx AS px, cy AS py, CASE WHEN k = 1 THEN greatest(12, least(88, {_ANCHOR[0]} + ({_HASH.format(17)} % 900) / 100.0::DOUBLE - 4.5)) ELSE cx + k END::DOUBLE AS cx,
  CASE WHEN k = 1 THEN greatest(8, least(88, {_ANCHOR[1]} + ({_HASH.format(53)} % 900) / 100.0::DOUBLE - 4.5)) ELSE cy END::DOUBLE AS cy FROM s)
 SELECT concat(id, '-loc-', k) AS id, id AS condition_id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM q WHERE NOT (abs(cx - px) < 0.01 AND abs(cy - py) < 0.01)""",
    "export_backup": _BASE + ", h AS (SELECT patient_id, count(*)::BIGINT AS n FROM health_records GROUP BY 1), c AS (SELECT patient_id, count(*)::BIGINT AS n FROM cond GROUP BY 1) SELECT patient_id, 'caretrail' AS app, coalesce(h.n, 0) AS n_records, coalesce(c.n, 0) AS n_conditions FROM h FULL JOIN c USING (patient_id)",
    "import_backup": _BASE + "SELECT 'conditions' AS store, patient_id, id, record_id::VARCHAR AS a, cx FROM cond UNION ALL SELECT 'health_records', patient_id, id::VARCHAR, record_type, NULL FROM health_records",
    "blob_round_trip": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END::INT AS bad_blobs, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 > 0 THEN md5(text) END AS md5 FROM documents",
    "encode_blobs": "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN md5(base64(encode(text))) END AS data_md5, CASE WHEN doc_id % 5 > 0 THEN true END AS tagged FROM documents",
    "decode_blobs": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END::INT AS bad_blobs, CASE WHEN doc_id % 7 <> 0 THEN octet_length(encode(text)) END::BIGINT AS n_bytes FROM documents",
    "validate_backup": _BASE + "SELECT 'conditions' AS store, 'record_id' AS field, id, 'missing' AS rule FROM cond WHERE cx % 30 = 0 UNION ALL SELECT 'conditions', 'status', id, 'value' FROM cond WHERE cx % 31 = 0",
    "repair_coordinates": _BASE + f""", o AS (SELECT k, i % 12 AS x, i // 12 AS y FROM range(11) t(k), range(108) u(i) WHERE k <> 3 AND (i * 7 + k * 5) % 23 < 2),
 g AS (SELECT * FROM (SELECT k, px, py, x, y, row_number() OVER (PARTITION BY k, px, py ORDER BY greatest(abs(x - px), abs(y - py)), (x - px) * (x - px) + (y - py) * (y - py), y, x) AS r FROM o, range(12) a(px), range(9) b(py)) WHERE r = 1),
 p AS (SELECT *, list_position({list(_MASKED)}, system) - 1 AS k, greatest(0.0::DOUBLE, least(100.0::DOUBLE, cx)) AS ax, greatest(0.0::DOUBLE, least(100.0::DOUBLE, cy)) AS ay FROM (SELECT id, {_SYSTEM} AS system, cx * 1.3::DOUBLE - 10 AS cx, cy * 1.7::DOUBLE - 5 AS cy FROM cond)),
 q AS (SELECT *, floor(ax / 100 * 11 + 0.5::DOUBLE)::INT AS px, floor(ay / 100 * 8 + 0.5::DOUBLE)::INT AS py FROM p)
 SELECT id, system, round(CASE WHEN coalesce(q.k, -1) < 0 THEN cx WHEN x IS NULL THEN NULL WHEN x = q.px AND y = q.py THEN ax ELSE x / 11.0::DOUBLE * 100 END, 6)::DOUBLE AS cx,
  round(CASE WHEN coalesce(q.k, -1) < 0 THEN cy WHEN x IS NULL THEN NULL WHEN x = q.px AND y = q.py THEN ay ELSE y / 8.0::DOUBLE * 100 END, 6)::DOUBLE AS cy
 FROM q LEFT JOIN g ON g.k = q.k AND g.px = q.px AND g.py = q.py""",
    "place_first": _BASE + f", x AS (SELECT id AS condition_id, seq, row_number() OVER (PARTITION BY patient_id, {_SYSTEM} ORDER BY seq) AS r FROM cond) SELECT condition_id, (seq % 3)::DOUBLE AS cx, 10.0::DOUBLE AS cy FROM x WHERE r = 1",
    "stream_call_outcome": VIEW_SQL["call_outcome"],
    "stream_records": view_sql("responses") + """, f AS (SELECT chunk_id, chunk_id % 5 <> 0 AND chunk_id % 7 <> 0 AS c, chunk_id % 2 = 0 AS p FROM responses)
 SELECT chunk_id AS record_id, o_orderpriority AS name_medical, CASE WHEN chunk_id % 3 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date_diagnosed, CASE WHEN p THEN concat('Dr. No', o_custkey % 9) END AS provider_name, 1::BIGINT AS n_mentions
 FROM f JOIN orders ON o_orderkey = chunk_id WHERE c""",
    "stream_stores": view_sql("responses") + """, f AS (SELECT chunk_id AS k, CAST(chunk_id AS VARCHAR) AS record_id, chunk_id % 5 <> 0 AND chunk_id % 7 <> 0 AS c, chunk_id % 4 <> 0 AS m, chunk_id % 2 = 0 AS p,
  concat('record-', chunk_id, '.pdf') AS file, o_orderpriority AS name, CASE WHEN chunk_id % 3 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day, 100 + chunk_id % 100 AS ldl, concat('Dr. No', o_custkey % 9) AS who,
  concat('dr', c_nationkey, '@clinic.example.com') AS mail FROM responses JOIN orders ON o_orderkey = chunk_id JOIN customer ON c_custkey = o_custkey)
 SELECT 'health_records' AS store, record_id, file AS value FROM f WHERE c OR m
 UNION ALL SELECT 'pending_extraction_text', record_id, file FROM f WHERE NOT (c OR m)
 UNION ALL SELECT 'conditions', record_id, concat_ws('|', name, 'documented', day) FROM f WHERE c
 UNION ALL SELECT 'conditions', record_id, 'Hyperlipidaemia|inferred' FROM f WHERE m AND ldl >= 160
 UNION ALL SELECT 'condition_locations', record_id, 'true' FROM f WHERE c
 UNION ALL SELECT 'condition_locations', record_id, 'true' FROM f WHERE m AND ldl >= 160
 UNION ALL SELECT 'measurements', record_id, concat_ws('|', 'LDL', ldl, '2024-01-01') FROM f WHERE m
 UNION ALL SELECT 'providers', record_id, who FROM f WHERE c AND p
 UNION ALL SELECT 'providers', record_id, concat_ws('|', who, mail) FROM f WHERE (c OR m) AND p
 UNION ALL SELECT 'condition_care_events', record_id, concat_ws('|', who, day) FROM f WHERE c AND p AND day IS NOT NULL""",
    "measurement_rows": view_sql("measurements") + "SELECT concat(record_id, '-measurement-', row_number() OVER (PARTITION BY record_id ORDER BY seq) - 1) AS id, record_id, name, value_numeric, unit, coalesce(date, '2024-01-01') AS date FROM measurements",
    "rejected_backups": "SELECT DISTINCT o_custkey AS patient_id, CASE WHEN o_custkey % 5 = 0 THEN 'app' WHEN o_custkey % 7 = 0 THEN 'version' ELSE 'no backup' END AS reason FROM orders WHERE o_custkey % 5 = 0 OR o_custkey % 7 = 0 OR o_custkey % 11 = 0",
    "stream_ingest": "SELECT o_orderkey AS id, o_custkey AS patient_id, round(year(o_orderdate) + ((month(o_orderdate) - 1) * 30.44::DOUBLE + day(o_orderdate)) / 365.25::DOUBLE, 6) AS year_frac FROM orders",
    "stream_call_health": view_sql("call_log") + "SELECT model, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*)::BIGINT AS n_attempts, count(*) FILTER (http_status = 200)::BIGINT AS n_ok, count(*) FILTER (http_status = 429)::BIGINT AS n_limited FROM call_log GROUP BY 1, 2",
}
