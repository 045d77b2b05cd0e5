"""Merging repeated mentions. Every rule that depends on order takes an explicit `seq`; nothing relies on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caretrail.functions import scalars as S

FIRST_KNOWN = ["id", "name_common", "organ", "anatomical_location", "severity", "certainty", "notes", "local_names", "provider", "provider_name", "facility_name", "cx", "cy"]


def first_known(column: str | Column, seq: str = "seq") -> Column:
    """The value of the first row that has one."""
    c = F.col(column) if isinstance(column, str) else column
    return F.min_by(c, F.when(c.isNotNull(), F.col(seq)))


def joined(column: str, glue: str, seq: str = "seq") -> Column:
    """Non-empty values in order, joined; null if there is none."""
    pairs = F.array_sort(F.collect_list(F.when(F.length(column) > 0, F.struct(F.col(seq).alias("s"), F.col(column).alias("v")))))
    return F.nullif(F.array_join(F.transform(pairs, lambda p: p["v"]), glue), F.lit(""))


def latest_status(date: str = "date", status: str = "status", seq: str = "seq") -> Column:
    """Status of the latest dated mention, ties to the later one; of the last one if none has a date."""
    return F.max_by(status, F.struct(F.nullif(F.col(date), F.lit("")).alias("d"), F.col(seq).alias("s")))


def dedupe(df: DataFrame, scope: list[str], key: Column, seq: str = "seq") -> DataFrame:
    """First row of each key within a scope."""
    w = Window.partitionBy(*scope, "_key").orderBy(seq)
    return df.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")


def dedupe_providers(df: DataFrame, scope: list[str]) -> DataFrame:
    """First per name, email and phone, letters in either case."""
    none = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return dedupe(df, scope, F.concat_ws("|", none("name"), none("email"), none("phone")))


def dedupe_facilities(df: DataFrame, scope: list[str]) -> DataFrame:
    """First per name and place, letters in either case."""
    none = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return dedupe(df, scope, F.concat_ws("|", *[none(c) for c in ("name", "address", "city", "state", "country")]))


def merge_conditions(mentions: DataFrame, by: list[str] = ["patient_id"]) -> DataFrame:  # noqa: B006
    """One row per condition: first known values, the earliest date of the better tier, the latest status.

    Explicit dates beat inherited ones in any order; within a tier the earliest counts. A date is inherited where the array
    `inferred_from_structure` names its field, else where `date_inherited` is set. `evidence` texts are joined, arrays
    `care_events` chained in order. Arrays `providers` and `facilities` are united with those of the care events, one per
    identity; `locations` are merged per place. The lists of a condition mentioned once stay as they are.
    """
    have = set(mentions.columns)
    location = F.col("anatomical_location") if "anatomical_location" in have else F.lit(None).cast("string")
    locations = F.col("locations") if "locations" in have else None
    keyed = mentions.withColumn("condition_key", S.condition_key(F.col("name_medical"), F.col("organ"), location, locations))
    dates = [c for c in ("date_onset", "date_diagnosed") if c in have]
    listed = "inferred_from_structure" in have
    flag = F.coalesce(F.col("date_inherited"), F.lit(False)) if "date_inherited" in have else F.lit(False)
    keyed = keyed.withColumns({f"_inherited_{c}": F.coalesce(F.array_contains("inferred_from_structure", c), F.lit(False)) if listed else flag for c in dates})
    if "date_onset" in have and "date_diagnosed" in have:
        keyed = keyed.withColumn("_date", F.coalesce("date_diagnosed", "date_onset"))
    else:
        keyed = keyed.withColumn("_date", F.col(dates[0]))

    def earliest(c: str, inherited: bool):
        mine = F.col(f"_inherited_{c}")
        return F.min(F.when(mine if inherited else ~mine, F.nullif(F.col(c), F.lit(""))))

    aggs = [
        F.count("*").alias("n_mentions"),
        F.min("seq").alias("seq"),
        F.min_by("name_medical", "seq").alias("name_medical"),
        F.min_by("system", "seq").alias("system"),
        latest_status("_date").alias("status"),
        *[first_known(c).alias(c) for c in FIRST_KNOWN if c in have],
        *[F.coalesce(earliest(c, False), earliest(c, True)).alias(c) for c in dates],
    ]
    if "evidence" in have:
        aggs.append(joined("evidence", " | ").alias("evidence"))
    if "care_events" in have:
        chained = F.array_sort(F.collect_list(F.struct(F.col("seq").alias("s"), F.col("care_events").alias("e"))))
        aggs.append(F.flatten(F.transform(chained, lambda x: F.coalesce(x["e"], F.array()))).alias("care_events"))
    if listed:
        # a date is flagged by the tier it came from; without any date the last mention's flag stands
        others = F.array_distinct(F.flatten(F.collect_list(F.filter("inferred_from_structure", lambda x: ~x.isin("date_onset", "date_diagnosed")))))
        won = [F.when(earliest(c, False).isNull() & F.coalesce(earliest(c, True).isNotNull() | F.max_by(f"_inherited_{c}", "seq"), F.lit(False)), F.lit(c)) for c in dates]
        aggs.append(F.array_sort(F.concat(others, F.array_compact(F.array(*won)))).alias("inferred_from_structure"))
    out = keyed.groupBy(*by, "condition_key").agg(*aggs)
    for lists in merged_lists(keyed, [*by, "condition_key"]):
        out = out.join(lists, [*by, "condition_key"], "left")
    return out


#: What tells providers and facilities apart, letters in either case.
IDENTITY = {"providers": ["name", "email", "phone"], "facilities": ["name", "address", "city", "state", "country"]}


def merged_lists(keyed: DataFrame, keys: list[str]) -> list[DataFrame]:
    """keys and one merged array each, of those of providers, facilities and locations that the mentions have."""
    mention = Window.partitionBy(*keys)
    ranked = keyed.withColumn("_r", F.row_number().over(mention.orderBy("seq"))).withColumn("_m", F.count("*").over(mention))
    events = {f.name: f.dataType for f in keyed.schema["care_events"].dataType.elementType.fields} if "care_events" in keyed.columns else {}
    out = []
    for name, one in (("providers", "provider"), ("facilities", "facility")):
        if name not in keyed.columns:
            continue
        fields = keyed.schema[name].dataType.elementType.fields

        def parts(values, kind: int, fields=fields):
            # the lists of the first two mentions come before the events of both; from then on mention by mention
            order = F.struct(F.when(F.col("_r") <= 2, 0).otherwise(F.col("_r")).alias("g"), F.when(F.col("_r") <= 2, kind).otherwise(0).alias("k"), F.col("_r").alias("r"), F.lit(kind).alias("kind"))
            rows = ranked.select(*keys, "_m", order.alias("_o"), F.posexplode(values).alias("_i", "_v")).where("_v IS NOT NULL")
            there = set(rows.schema["_v"].dataType.names)
            v = F.struct(*[(F.col("_v")[f.name] if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
            return rows.select(*keys, "_m", F.struct("_o", "_i").alias("_o"), v.alias("v"))

        rows = parts(F.col(name), 0)
        if hasattr(events.get(one), "names"):
            rows = rows.unionByName(parts(F.when(F.col("_m") > 1, F.col(f"care_events.{one}")), 1))
        ident = F.concat_ws("|", *[F.lower(F.coalesce(F.col(f"v.{c}"), F.lit(""))) for c in IDENTITY[name] if c in [f.name for f in fields]])
        first = F.row_number().over(Window.partitionBy(*keys, "_k").orderBy("_o"))
        rows = rows.withColumn("_k", ident).withColumn("_n", first).where("_n = 1 OR _m = 1")
        out.append(rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "v"))), lambda x: x["v"]).alias(name)))
    if "locations" in keyed.columns:
        rows = ranked.select(*keys, "_m", "_r", F.posexplode("locations").alias("_i", "_v")).select(*keys, "_m", F.struct("_r", "_i").alias("seq"), "_v.*")
        for c in ("anatomical_location", "laterality", "cx", "cy", "evidence"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("double" if c in ("cx", "cy") else "string"))
        # the places of a condition mentioned once are told apart by their order alone
        places = merge_locations(rows.withColumn("_alone", F.when(F.col("_m") == 1, F.col("seq"))), [*keys, "_alone"])
        value = F.struct("anatomical_location", "laterality", "cx", "cy", "evidence")
        out.append(places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", value.alias("v")))), lambda x: x["v"]).alias("locations")))
    return out


def merge_longitudinal_located(mentions: DataFrame, by: list[str]) -> DataFrame:
    """Key name, system and location; the earliest valid date, first known values, texts joined by a space."""
    part = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    keyed = mentions.withColumn("k", F.concat_ws("|", part("name_medical"), part("system"), part("anatomical_location")))
    keyed = keyed.withColumn("_d", S.earliest_date(F.array("date_diagnosed", "date_onset"))).withColumn("_o", S.earliest_date(F.array("date_onset")))
    return keyed.groupBy(*by, "k").agg(
        F.count("*").alias("n_mentions"),
        F.min_by("name_medical", "seq").alias("name_medical"),
        first_known("organ").alias("organ"),
        F.min("_d").alias("date_diagnosed"),
        F.when(F.count("*") == 1, F.min_by("date_onset", "seq")).otherwise(F.min("_o")).alias("date_onset"),
        joined("evidence", " ").alias("evidence"),
        first_known("provider_name").alias("provider_name"),
    )


def merge_longitudinal_pages(mentions: DataFrame, by: list[str]) -> DataFrame:
    """Key name and system; the earliest valid date, the union of the source pages, the rest from the first mention."""
    part = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    keyed = mentions.withColumn("k", F.concat_ws("|", part("name_medical"), part("system")))
    return keyed.groupBy(*by, "k").agg(
        F.min_by("name_medical", "seq").alias("name_medical"),
        F.min_by("status", "seq").alias("status"),
        F.min(S.earliest_date(F.array("date_diagnosed"))).alias("date_diagnosed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_pages")))).alias("source_pages"),
    )


def merge_summaries(summaries: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Summaries (index) with the model's groups (index, group); ungrouped ones stay alone. Date tiers are kept apart."""
    s = summaries.join(groups, [*by, "index"], "left").withColumn(
        "_g", F.coalesce(F.col("group").cast("string"), F.concat(F.lit("ungrouped-"), F.col("index").cast("string")))
    )
    return s.groupBy(*by, F.col("_g").alias("group_key")).agg(
        F.min("index").alias("index"),
        F.min_by("name_medical", "index").alias("name_medical"),
        F.min(F.nullif(F.col("earliest_date"), F.lit(""))).alias("earliest_date"),
        F.min(F.nullif(F.col("section_date"), F.lit(""))).alias("section_date"),
        joined("notes", " | ", "index").alias("notes"),
        first_known("provider", "index").alias("provider"),
        first_known("facility", "index").alias("facility"),
    )


def merge_locations(locations: DataFrame, scope: list[str]) -> DataFrame:
    """One row per place and side (else per point): the first one, with missing point and evidence filled from later ones."""
    named = F.concat_ws("|", *[S.normalized_key(F.coalesce(c, F.lit(""))) for c in ("anatomical_location", "laterality")])
    point = F.concat_ws(",", F.coalesce(F.col("cx").cast("string"), F.lit("")), F.coalesce(F.col("cy").cast("string"), F.lit("")))
    keyed = locations.withColumn("k", F.when(named != "|", named).otherwise(point))
    return keyed.groupBy(*scope, "k").agg(
        F.min("seq").alias("seq"),
        F.min_by("anatomical_location", "seq").alias("anatomical_location"),
        F.min_by("laterality", "seq").alias("laterality"),
        *[first_known(c).alias(c) for c in ("cx", "cy", "evidence")],
    )


def record_facilities(facilities: DataFrame) -> DataFrame:
    """Record-level facilities with a name, one per exact identity, numbered in order from 0."""
    ident = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("name", "address", "city", "state", "country")])
    once = dedupe(facilities.where(F.trim("name") != ""), ["record_id"], ident)
    n = F.row_number().over(Window.partitionBy("record_id").orderBy("seq")) - 1
    return once.withColumn("n", n).withColumn("id", F.concat(F.col("record_id").cast("string"), F.lit("-facility-"), F.col("n").cast("string")))


def backfill_attribution(summaries: DataFrame, reports: DataFrame, by: list[str]) -> DataFrame:
    """A document's only provider (facility) goes to its conditions without one; two or more are no guess."""
    out = summaries
    for c in ("provider", "facility"):
        seen = summaries.select(*by, F.col(c).alias("v"), "index").unionByName(reports.select(*by, F.col(c).alias("v"), F.lit(-1).cast("long").alias("index"))).where("v IS NOT NULL")
        only = seen.groupBy(*by).agg(F.count_distinct(F.lower("v")).alias("_n"), F.min_by("v", "index").alias("_only")).where("_n = 1").drop("_n")
        out = out.join(only, by, "left").withColumn(c, F.coalesce(c, "_only")).drop("_only")
    return out


def resolve_date_tiers(summaries: DataFrame, documents: DataFrame, by: list[str]) -> DataFrame:
    """The condition's own date, else its section's, else the document's; `inherited` marks the last two."""
    own, section, doc = (F.nullif(F.col(c), F.lit("")) for c in ("earliest_date", "section_date", "document_date"))
    out = summaries.join(documents.select(*by, "document_date"), by, "left")
    return out.withColumn("inherited", own.isNull() & F.coalesce(section, doc).isNotNull()).withColumn("earliest_date", F.coalesce(own, section, doc)).drop("document_date")


def coalesce_image_sections(sections: DataFrame) -> DataFrame:
    """One row per page range, with the condition keys of all its sections."""
    return sections.groupBy("record_id", "page_start", "page_end").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("condition_keys")))).alias("condition_keys"))


def section_images(sections: DataFrame, image_only: DataFrame, conditions: DataFrame) -> DataFrame:
    """One row per page of the image-worthy sections with its linked conditions; image-only pages are added if absent."""
    pages = sections.where("page_start IS NOT NULL").select("*", F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("page"))
    first = pages.groupBy("record_id", "page").agg(F.min_by("heading", "seq").alias("title"), first_known("date").alias("date"))
    linked = (
        pages.select("record_id", "page", F.explode("condition_keys").alias("condition_key"))
        .join(conditions.select("record_id", "condition_key", "condition_id"), ["record_id", "condition_key"])
        .groupBy("record_id", "page")
        .agg(F.array_sort(F.collect_set("condition_id")).alias("condition_ids"))
    )
    more = image_only.join(first, ["record_id", "page"], "left_anti").select("record_id", "page", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("date"))
    return first.unionByName(more).join(linked, ["record_id", "page"], "left")


def carry_section_date(chunks: DataFrame, by: list[str]) -> DataFrame:
    """A chunk without a date takes the last one above it."""
    w = Window.partitionBy(*by).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("carried_date", F.last(F.nullif(F.col("date"), F.lit("")), ignorenulls=True).over(w))


def all_conditions(extracted: DataFrame, inferred: DataFrame) -> DataFrame:
    return extracted.unionByName(inferred, allowMissingColumns=True)
