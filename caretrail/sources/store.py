"""Stores as Parquet tables: read, upsert, delete, move, pending outbox, and the normalisation of one enriched document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretrail import reference_data as R
from caretrail.functions import scalars as S
from caretrail.schemas import STORES
from caretrail.sources.shared import written


def read_store(spark: SparkSession, root: str, name: str, parent: str | None = None, parent_ids: DataFrame | None = None) -> DataFrame:
    """A whole store, or the rows of some parents."""
    rows = spark.read.schema(STORES[name]).parquet(f"{root}/{name}")
    return rows if parent_ids is None else rows.join(parent_ids, parent, "left_semi")


def write_store(rows: DataFrame, root: str, name: str) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/{name}")


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """Insert or replace by key; the last change wins, and of changes with one order the one that is largest as JSON. current
    has no order column; rows with a null order count as earlier than others, and as what is stored does."""
    old = current.withColumn(order, F.lit(None).cast(changes.schema[order].dataType))
    latest = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last(), F.to_json(F.struct(*current.columns)).desc()))
    return old.unionByName(changes).withColumn("_n", latest).where("_n = 1").drop("_n", order)


def delete_rows(current: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    return current.join(ids, key, "left_anti")


def update_position(conditions: DataFrame, locations: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves conditions, with their primary location, else their first one, else a new one."""
    m = moves.select("condition_id", F.col("cx").alias("_x"), F.col("cy").alias("_y"))
    moved = conditions.join(m.withColumnRenamed("condition_id", "id"), "id", "left")
    moved = moved.withColumn("cx", F.coalesce("_x", "cx")).withColumn("cy", F.coalesce("_y", "cy")).select(*conditions.columns)
    n = F.row_number().over(Window.partitionBy("condition_id").orderBy(F.desc("is_primary"), "id"))
    places = locations.join(m, "condition_id", "left").withColumn("_hit", F.col("_x").isNotNull() & (n == 1))
    for c, v in (("cx", "_x"), ("cy", "_y")):
        places = places.withColumn(c, F.when(F.col("_hit"), F.col(v)).otherwise(F.col(c)))
    fresh = m.join(locations.select("condition_id").distinct(), "condition_id", "left_anti").join(conditions.select(F.col("id").alias("condition_id")), "condition_id", "left_semi")
    fresh = fresh.select(F.concat("condition_id", F.lit("-primary")).alias("id"), "condition_id", F.col("_x").alias("cx"), F.col("_y").alias("cy"), F.lit(True).alias("is_primary"))
    return moved, places.select(*locations.columns).unionByName(fresh, allowMissingColumns=True)


def pending_retries(pending: DataFrame, health_records: DataFrame, key: list[str]) -> DataFrame:
    """Staged texts whose record has not been written yet."""
    return pending.join(health_records.select(*key), key, "left_anti")


def persist_counts(conditions: DataFrame, measurements: DataFrame) -> DataFrame:
    c = conditions.groupBy("record_id").agg(F.count("*").alias("condition_count"))
    m = measurements.groupBy("record_id").agg(F.count("*").alias("measurement_count"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return c.join(m, "record_id", "full").select("record_id", zero("condition_count"), zero("measurement_count"))


def _child(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


PERSON = ["name", "specialty", "email", "phone", "evidence"]
PLACE = ["name", "address", "city", "state", "country"]


def _inside(df: DataFrame, column: str) -> dict[str, T.DataType]:
    """Fields of a struct column, or of the structs of an array column; none where there is no such column."""
    kind = df.schema[column].dataType if column in df.columns else None
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}


def _fields(x: Column, there, fields: list[str], prefix: str = "") -> Column:
    """x's fields as a struct of texts; those that it does not have are null."""
    return F.struct(*[(x[prefix + f] if prefix + f in there else F.lit(None)).cast("string").alias(f) for f in fields])


def _part(x: Column, there: dict, name: str, fields: list[str]) -> Column:
    """A nested struct of x, or its flat fields name_*."""
    if isinstance(there.get(name), T.StructType):
        return _fields(x[name], {f.name for f in there[name].fields}, fields)
    return _fields(x, there, fields, f"{name}_")


def whole_conditions(enriched: DataFrame) -> DataFrame:
    """Enriched conditions with every column that the stores take; lists are never null and hold structs of one shape, whether
    people and places came nested or as flat fields."""
    have = set(enriched.columns)
    given = lambda c, kind="string": (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)

    def listed(c: str, make) -> Column:
        there = _inside(enriched, c)
        return F.coalesce(F.transform(c, lambda x: make(x, there)), F.array()).alias(c) if there else F.transform(F.slice(F.array(F.lit(0)), 1, 0), lambda x: make(x, {})).alias(c)

    event = lambda x, there: F.struct(*[(x[f] if f in there else F.lit(None)).cast("string").alias(f) for f in ("event_type", "date", "evidence")], _part(x, there, "provider", PERSON).alias("provider"), _part(x, there, "facility", PLACE).alias("facility"))
    spot = {"anatomical_location": "string", "laterality": "string", "evidence": "string", "cx": "double", "cy": "double"}
    place = lambda x, there: F.struct(*[(x[f] if f in there else F.lit(None)).cast(kind).alias(f) for f, kind in spot.items()])
    one = _inside(enriched, "provider")
    own = F.when(F.col("provider")["name"].isNotNull(), _fields(F.col("provider"), one, PERSON)) if one else F.lit(None).cast(T.StructType([T.StructField(f, T.StringType()) for f in PERSON]))
    note = F.coalesce(*[given(c) for c in ("notes", "note")])
    inferred = given("inferred_from_structure", "array<string>")
    return enriched.select(
        "patient_id", "record_id", "condition_id", "seq", "name_medical", F.coalesce(given("name_common"), F.col("name_medical")).alias("name_common"), F.coalesce(given("system"), F.lit(R.DEFAULT_SYSTEM)).alias("system"),
        F.coalesce(given("status"), F.lit("documented")).alias("status"), *[given(c) for c in ("organ", "anatomical_location", "severity", "certainty", "date_onset", "date_diagnosed", "evidence")], note.alias("note"),
        given("source_pages", "array<int>"), given("local_names", "map<string,string>"), F.when(F.size(inferred) > 0, inferred).alias("inferred_fields"), own.alias("provider"),
        listed("providers", lambda x, there: _fields(x, there, PERSON)), listed("facilities", lambda x, there: _fields(x, there, PLACE)), listed("care_events", event), listed("locations", place),
    )


def as_store(rows: DataFrame, name: str) -> DataFrame:
    """rows in a store's columns and types; what they do not have is null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORES[name].fields])


def write_stores(stores: dict[str, DataFrame], root: str) -> None:
    for name, rows in stores.items():
        write_store(rows, root, name)


def normalize(
    enriched: DataFrame, placed: DataFrame, today: str, measurements: DataFrame | None = None, record_providers: DataFrame | None = None, record_facilities: DataFrame | None = None, records: DataFrame | None = None, **others: DataFrame
) -> dict[str, DataFrame]:
    """Enriched conditions and measurements -> all stores in their own columns, with ids that a rerun gives again.

    enriched: patient_id, record_id, condition_id, seq, name_medical and any of the other fields; provider, providers, facilities,
    care_events, locations as structs of any of their fields (join_anatomy gives these, with people and places nested; flat
    provider_* and facility_* do as well). An event counts with a known type, a date and a named provider. placed: condition_id
    with its primary point. measurements: patient_id, record_id, seq, name, value_numeric, unit, date (`today` where it has
    none) and, if known, inferred_from_structure. record_providers and record_facilities (patient_id, record_id, seq, name...):
    those of the record itself; a provider that one of its conditions is linked to is left out. records: patient_id, record_id
    and the fields of a health record (by default one a record_id). others: rows of the remaining stores, as they are.
    """
    from caretrail.operators.merge import record_facilities as named_facilities
    from caretrail.operators.views import unlinked_record_providers

    # joined once and written, as every store reads it
    c = written(whole_conditions(enriched).join(placed.select("condition_id", F.col("cx").alias("_x"), F.col("cy").alias("_y")), "condition_id"), "whole-conditions")
    date = F.coalesce("date_diagnosed", "date_onset")
    conditions = c.withColumns({"id": F.col("condition_id"), "cx": F.col("_x"), "cy": F.col("_y"), "date": date, "year_frac": F.when(date.isNull(), 0.0).otherwise(S.parse_date_frac(F.coalesce(date, F.lit(""))))})
    first = F.when(F.lower("name_medical").contains("nephrolith"), F.get("locations", F.lit(0)))
    primary = c.select("patient_id", _child(F.col("condition_id"), "-primary").alias("id"), "condition_id", F.col("_x").alias("cx"), F.col("_y").alias("cy"), F.lit(True).alias("is_primary"), *[first[f].alias(f) for f in ("anatomical_location", "laterality", "evidence")])
    locations = primary.unionByName(secondary_locations(c))
    keys = ["patient_id", "record_id", "condition_id"]
    valid = lambda e: e["event_type"].isin(R.CARE_EVENT_TYPES) & e["date"].isNotNull() & e["provider"]["name"].isNotNull()
    events = c.select(*keys, F.posexplode(F.filter("care_events", lambda e: F.coalesce(valid(e), F.lit(False)))).alias("n", "e"))
    at = _child(F.col("condition_id"), "-care-", F.col("n").cast("string"))
    care = events.select(*keys, at.alias("id"), "e.event_type", "e.date", "e.evidence", *[F.col(f"e.provider.{f}").alias(f"provider_{f}") for f in PERSON], *[F.col(f"e.facility.{f}").alias(f"facility_{f}") for f in PLACE])
    linked = events.select(*keys, _child(at, "-provider").alias("id"), "e.provider.*").unionByName(c.where("provider IS NOT NULL").select(*keys, _child(F.col("condition_id"), "-provider").alias("id"), "provider.*"))
    # a condition's further providers: the first of each key that none of its events and not its own has, found within its row
    key = lambda p: F.concat_ws("|", p["name"], F.coalesce(p["email"], F.lit("")), F.coalesce(p["phone"], F.lit("")))  # noqa: E731  (views.provider_key)
    known = F.concat(F.transform(F.filter("care_events", lambda e: F.coalesce(valid(e), F.lit(False))), lambda e: key(e["provider"])), F.when(F.col("provider").isNotNull(), F.array(key(F.col("provider")))).otherwise(F.array().cast("array<string>")))
    named = F.filter("providers", lambda p: p["name"].isNotNull())
    fresh = lambda x, i, all_: (F.array_position(all_, key(x)) == i + 1) & ~F.array_contains("_known", key(x))
    extra = c.select(*keys, known.alias("_known"), named.alias("_named"), F.transform(named, key).alias("_all"))
    extra = extra.select(*keys, F.posexplode(F.transform("_named", lambda x, i: F.when(fresh(x, i, F.col("_all")), x))).alias("n", "p")).where("p IS NOT NULL")
    extra = extra.select(*keys, _child(F.col("condition_id"), "-provider-extra-", F.col("n").cast("string")).alias("id"), "p.*")
    providers = linked.unionByName(extra.select(*linked.columns))
    facilities = c.select(*keys, F.posexplode("facilities").alias("n", "f")).where(F.trim("f.name") != "")
    facilities = facilities.select(*keys, _child(F.col("condition_id"), "-facility-", F.col("n").cast("string")).alias("id"), "f.*")
    none = F.lit(None).cast(c.schema["condition_id"].dataType)
    if record_providers is not None:
        own = unlinked_record_providers(record_providers, providers)
        n = F.row_number().over(Window.partitionBy("record_id").orderBy("seq")) - 1
        own = own.withColumn("_n", n).withColumn("id", _child(F.col("record_id").cast("string"), "-provider-", F.col("_n").cast("string")))
        providers = providers.unionByName(own.withColumn("condition_id", none).select(*[x for x in providers.columns if x in own.columns or x == "condition_id"]), allowMissingColumns=True)
    if record_facilities is not None:
        own = named_facilities(record_facilities).withColumn("condition_id", none)
        facilities = facilities.unionByName(own.select(*facilities.columns))
    if records is None:
        records = enriched.select("patient_id", "record_id").distinct().withColumn("filename", F.concat(F.lit("record-"), F.col("record_id").cast("string"), F.lit(".pdf")))
    out = {"health_records": records.withColumn("id", F.col("record_id")), "conditions": conditions, "condition_locations": locations, "providers": providers, "facilities": facilities, "condition_care_events": care, **others}
    if measurements is not None:
        out["measurements"] = measurement_rows(measurements, today)
    spark = enriched.sparkSession
    return {name: as_store(out[name], name) if name in out else spark.createDataFrame([], schema) for name, schema in STORES.items()}


def measurement_rows(measurements: DataFrame, today: str) -> DataFrame:
    """The measurements' store rows, numbered in order within their record."""
    n = F.row_number().over(Window.partitionBy("record_id").orderBy("seq")) - 1
    inferred = F.when(F.size("inferred_from_structure") > 0, F.col("inferred_from_structure")) if "inferred_from_structure" in measurements.columns else F.lit(None).cast("array<string>")
    keep = ["patient_id"] if "patient_id" in measurements.columns else []
    return measurements.withColumn("_n", n).select(
        *keep, _child(F.col("record_id").cast("string"), "-measurement-", F.col("_n").cast("string")).alias("id"), "record_id", "name", "value_numeric", "unit",
        F.coalesce("date", F.lit(today)).alias("date"), inferred.alias("inferred_fields"),
    )


def secondary_locations(c: DataFrame) -> DataFrame:
    """A condition's other locations: their own point or a default one, without those at the primary point (_x, _y)."""
    first = F.lower("name_medical").contains("nephrolith")
    e = c.select("patient_id", "condition_id", "name_medical", "system", "_x", "_y", first.alias("_first"), F.posexplode("locations").alias("n", "l")).where(~(F.col("_first") & (F.col("n") == 0)))
    seed = F.concat_ws(":", "name_medical", F.coalesce("l.anatomical_location", F.lit("")), F.coalesce("l.laterality", F.lit("")), F.col("n").cast("string"))
    spot = S.default_position(S.normalize_system(F.col("system")), seed)
    e = e.withColumn("cx", F.coalesce("l.cx", spot["cx"])).withColumn("cy", F.coalesce("l.cy", spot["cy"]))
    e = e.where(~((F.abs(F.col("cx") - F.col("_x")) < 0.01) & (F.abs(F.col("cy") - F.col("_y")) < 0.01)))
    return e.select("patient_id", _child(F.col("condition_id"), "-loc-", F.col("n").cast("string")).alias("id"), "condition_id", "cx", "cy", F.lit(False).alias("is_primary"), "l.anatomical_location", "l.laterality", *(["l.evidence"] if "evidence" in _inside(c, "locations") else []))
