"""Reads over the condition tables: visibility, dots, attribution, time line, as-of views, call-log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretrail.functions import scalars as S

COOLDOWN = 60.0


def has_user_records(health_records: DataFrame) -> DataFrame:
    return health_records.groupBy("patient_id").agg(F.bool_or(~F.col("record_type").eqNullSafe(F.lit("demo"))).alias("has_user"))


def visible_conditions(conditions: DataFrame, health_records: DataFrame, mode: str = "auto") -> DataFrame:
    """auto: conditions of demo records are hidden from patients with records of their own; demo: those alone."""
    demo = health_records.where("record_type = 'demo'").select("patient_id", F.col("id").alias("record_id"))
    if mode == "demo":
        return conditions.join(demo, ["patient_id", "record_id"], "left_semi")
    own = has_user_records(health_records).where("has_user").select("patient_id")
    hidden = demo.join(own, "patient_id", "left_semi")
    return conditions.join(hidden, ["patient_id", "record_id"], "left_anti")  # a null record_id stays


def condition_view(conditions: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return conditions.select(
        "patient_id", "id", F.coalesce("name_common", "name_medical").alias("label"), "name_medical", S.normalize_system(F.col("system")).alias("system"),
        "status", text("date").alias("date"), "year_frac", text("note").alias("note"), text("evidence").alias("evidence"), "cx", "cy",
    )


def timeline(conditions: DataFrame) -> DataFrame:
    """Number of each condition in its patient's order of years; ties by id."""
    return conditions.withColumn("n", F.row_number().over(Window.partitionBy("patient_id").orderBy("year_frac", "id")))


def condition_dots(visible: DataFrame, locations: DataFrame) -> DataFrame:
    """A row per location, the primary one first; a condition without any gives its own point."""
    places = locations.select("patient_id", "condition_id", F.col("id").alias("location_id"), F.col("cx").alias("_x"), F.col("cy").alias("_y"), "is_primary")
    dots = visible.withColumnRenamed("id", "condition_id").join(places, ["patient_id", "condition_id"], "left")
    n = F.row_number().over(Window.partitionBy("patient_id", "condition_id").orderBy(F.col("is_primary").desc_nulls_last(), "location_id"))
    return dots.select("patient_id", "condition_id", "location_id", F.coalesce("_x", "cx").alias("cx"), F.coalesce("_y", "cy").alias("cy"), n.alias("n"))


def condition_records(records: DataFrame, images: DataFrame) -> DataFrame:
    """Records with their image: the thumbnail, else the full one."""
    shown = images.select(F.col("id").alias("image_id"), F.coalesce("thumbnail_blob", "image_blob").alias("image"))
    return records.join(shown, "image_id", "left")


def condition_attribution(conditions: DataFrame, providers: DataFrame, facilities: DataFrame, care_events: DataFrame) -> DataFrame:
    """Every condition with its lists of providers, facilities and care events; empty lists where there are none."""
    out = conditions
    for name, rows, keys in (("providers", providers, ["record_id", "condition_id"]), ("facilities", facilities, ["record_id", "condition_id"]), ("care_events", care_events, ["condition_id"])):
        value = "name" if name != "care_events" else "line"
        listed = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))
        out = out.join(listed, keys, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def care_event_lines(care_events: DataFrame, providers: DataFrame) -> DataFrame:
    """'type · date · provider · facility'; the provider is left out where the condition lists it already."""
    listed = providers.select("condition_id", F.col("name").alias("provider_name"), F.lit(True).alias("_listed")).distinct()
    e = care_events.join(listed, ["condition_id", "provider_name"], "left")
    shown = F.when(F.col("_listed").isNull(), F.col("provider_name"))
    return e.select("condition_id", "id", F.concat_ws(" · ", "event_type", "date", shown, "facility_name").alias("line"))


def flatten_care_events(conditions: DataFrame) -> DataFrame:
    """Nested events to flat rows; invalid ones go first, numbers count the valid ones."""
    from caretrail import reference_data as R

    ok = F.filter("care_events", lambda e: e["event_type"].isin(R.CARE_EVENT_TYPES) & e["date"].isNotNull() & e["provider"]["name"].isNotNull())
    e = conditions.select("condition_id", F.posexplode(ok).alias("n", "e"))
    return e.select(
        F.concat(F.col("condition_id").cast("string"), F.lit("-care-"), F.col("n").cast("string")).alias("id"), "condition_id",
        "e.event_type", "e.date", F.col("e.provider.name").alias("provider_name"), F.col("e.facility.name").alias("facility_name"),
    )


def provider_key(name="name", email="email", phone="phone"):
    return F.concat_ws("|", F.col(name), F.coalesce(F.col(email), F.lit("")), F.coalesce(F.col(phone), F.lit("")))


def unlinked_record_providers(record_providers: DataFrame, linked: DataFrame) -> DataFrame:
    """Record-level providers that no condition of the record is linked to, one per name, email and phone."""
    mine = record_providers.withColumn("_k", provider_key())
    left = mine.join(linked.select("record_id", provider_key().alias("_k")).distinct(), ["record_id", "_k"], "left_anti")
    return left.withColumn("_n", F.row_number().over(Window.partitionBy("record_id", "_k").orderBy("seq"))).where("_n = 1").drop("_n", "_k")


def rehydrate_contacts(providers: DataFrame, contacts: DataFrame) -> DataFrame:
    """Fills a provider's email, phone and evidence from the record's first contact whose name contains or is contained in
    the provider's, else from its only contact, else from the contact at the provider's place in order."""
    c = contacts.select("record_id", "contact_no", F.struct("email", "phone", "evidence").alias("_c"), S.contact_name_key(F.coalesce("name", F.lit(""))).alias("_ck"), F.col("name").isNotNull().alias("_named"))
    p = providers.withColumn("_pk", S.contact_name_key(F.col("name")))
    met = p.select("record_id", "provider_no", "_pk").join(c.where("_named"), "record_id").where(F.col("_pk").contains(F.col("_ck")) | F.col("_ck").contains(F.col("_pk")))
    by_name = met.groupBy("record_id", "provider_no").agg(F.min_by("_c", "contact_no").alias("_by_name"))
    only = c.groupBy("record_id").agg(F.count("*").alias("_n"), F.min_by("_c", "contact_no").alias("_only")).where("_n = 1").drop("_n")
    at = c.select("record_id", F.col("contact_no").alias("provider_no"), F.col("_c").alias("_at"))
    out = p.join(by_name, ["record_id", "provider_no"], "left").join(only, "record_id", "left").join(at, ["record_id", "provider_no"], "left")
    local = F.coalesce("_by_name", "_only", "_at")
    fill = lambda f: F.coalesce(F.col(f), local[f]).alias(f)
    return out.select("record_id", "provider_no", F.trim("name").alias("name"), fill("email"), fill("phone"), fill("evidence"))


#: What the model's anatomy may give, with its type.
ANATOMY = {"name_common": "string", "system": "string", "status": "string", "organ": "string", "anatomical_location": "string", "laterality": "string", "local_names": "map<string,string>", "cx": "double", "cy": "double"}


def join_anatomy(summaries: DataFrame, anatomy: DataFrame) -> DataFrame:
    """Summaries with the model's anatomy by index, as conditions; without it the keyword classifier places them, as documented.

    The summary's provider and facility (names or structs, if it has them) become lists of one, and with its earliest_date a care
    event; a laterality becomes a location with the model's point; an inherited date is flagged.
    """
    fields = [f for f in ANATOMY if f in anatomy.columns]
    a = anatomy.select("patient_id", "index", F.struct(*fields).alias("_a"))
    out, have = summaries.join(a, ["patient_id", "index"], "left"), set(summaries.columns)
    got = lambda f: F.col(f"_a.{f}") if f in fields else F.lit(None).cast(ANATOMY[f])
    given = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)

    def person(c: str):
        """A name as a struct of that name; null stays null."""
        named = c in have and isinstance(summaries.schema[c].dataType, T.StructType)
        return F.col(c) if named else F.when(given(c).isNotNull(), F.struct(given(c).alias("name")))

    only = lambda x, there: F.when(there, F.array(x)).otherwise(F.slice(F.array(x), 1, 0))
    date = given("earliest_date")
    event = F.struct(F.lit("other").alias("event_type"), date.alias("date"), person("provider").alias("provider"), person("facility").alias("facility"), F.lit(None).cast("string").alias("evidence"))
    place = F.struct(got("anatomical_location").alias("anatomical_location"), got("laterality").alias("laterality"), got("cx").alias("cx"), got("cy").alias("cy"), F.lit(None).cast("string").alias("evidence"))
    full = {
        "system": F.coalesce(got("system"), S.classify_system(F.col("name_medical"), F.col("notes"))),
        "status": F.coalesce(got("status"), F.lit("documented")),
        **{f: got(f) for f in ("organ", "name_common", "anatomical_location", "local_names", "cx", "cy")},
        "date_diagnosed": date,
        "providers": only(person("provider"), person("provider").isNotNull()),
        "facilities": only(person("facility"), person("facility").isNotNull()),
        "care_events": only(event, person("provider").isNotNull() & date.isNotNull()),
        "locations": only(place, got("laterality").isNotNull()),
        "inferred_from_structure": only(F.lit("date_diagnosed"), F.coalesce(given("earliest_date_inherited", "boolean"), F.lit(False))),
    }
    return out.select(*[F.col(c) for c in summaries.columns if c not in full], *[v.alias(c) for c, v in full.items()])


def apply_overrides(conditions: DataFrame, overrides: DataFrame) -> DataFrame:
    """A user's year for a condition replaces year_frac where it is a number."""
    o = overrides.select(F.col("condition_id").alias("id"), F.expr("try_cast(value AS double)").alias("_y"))
    return conditions.join(o, "id", "left").withColumn("year_frac", F.coalesce("_y", "year_frac")).drop("_y")


def snapshot(dots: DataFrame, systems: list[str], at) -> DataFrame:
    """What was known by then: rows of the chosen systems up to the year `at` (a number, or a DataFrame of known_by per patient)."""
    chosen = dots.where(S.normalize_system(F.col("system")).isin(systems))
    if isinstance(at, DataFrame):
        return chosen.join(at, "patient_id").where(F.col("year_frac") <= F.col("known_by"))
    return chosen.where(F.col("year_frac") <= at)


def flag_unconfirmed(conditions: DataFrame) -> DataFrame:
    return conditions.where("status <> 'suspected'").withColumn("inferred", F.col("status") == "inferred")


def rail_range(conditions: DataFrame, patients: DataFrame) -> DataFrame:
    """Years that the time rail spans: two months before the first and one after the last, not before birth."""
    span = conditions.groupBy("patient_id").agg((F.min("year_frac") - 2 / 12).alias("low"), (F.max("year_frac") + 1 / 12).alias("high"))
    birth = F.col("birth_year") + (F.col("birth_month") - 1) / 12
    return span.join(patients, "patient_id").select("patient_id", F.greatest("low", birth).alias("low"), "high")


def snap_to_nearest(probes: DataFrame, conditions: DataFrame, rails: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Each probe's nearest condition year on the rail; beyond the threshold the probe's own year, within the rail's range.

    Conditions and probes of a patient are sorted by place once in each direction; only the neighbours are compared.
    """
    on_rail = lambda year: S.rail_pos(F.col(year), F.col("low"), F.col("high"))
    c = conditions.join(rails, "patient_id").select("patient_id", on_rail("year_frac").alias("pos"), F.struct(F.col("year_frac").alias("year"), "id").alias("c"))
    c = c.groupBy("patient_id", "pos").agg(F.min("c").alias("c")).select("patient_id", "pos", F.struct("pos", "c.year", "c.id").alias("c"))
    p = probes.join(rails, "patient_id").withColumn("pos", on_rail("year")).select("patient_id", "pos", F.struct("probe_id", "year", "low", "high").alias("p"))
    both = c.unionByName(p, allowMissingColumns=True)

    def neighbour(order):
        # conditions before the probes of the same place
        return F.last("c", ignorenulls=True).over(Window.partitionBy("patient_id").orderBy(order, F.col("p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))

    both = both.withColumn("before", neighbour(F.asc("pos"))).withColumn("after", neighbour(F.desc("pos"))).where("p IS NOT NULL")
    off = lambda x: F.when(x.isNotNull(), F.struct(F.round(F.abs(F.col("pos") - x["pos"]), 12).alias("d"), x["year"].alias("year"), x["id"].alias("id")))
    near = F.least(off(F.col("before")), off(F.col("after")))
    snapped = F.when(near["d"] <= threshold, near["year"]).otherwise(F.col("p.year"))
    return both.select("p.probe_id", "patient_id", F.greatest("p.low", F.least("p.high", snapped)).alias("snapped"))


# ---- call log ----


def call_outcome(calls: DataFrame, by: list | None = None) -> DataFrame:
    """ok, degraded (a rate limit or quota failure came first) or exhausted, and the tries of the model that answered."""
    ok = F.col("http_status") == 200
    won = F.min_by("model", F.when(ok, F.col("seq")))
    first_ok = F.min(F.when(ok, F.col("seq")))
    limited = F.min(F.when(F.col("http_status").isin(402, 429), F.col("seq")))
    g = calls.groupBy(*(by or ["call_id"])).agg(first_ok.alias("_ok"), limited.alias("_limited"), won.alias("model"), F.count("*").alias("n_attempts"))
    outcome = F.when(F.col("_ok").isNull(), "exhausted").when(F.col("_limited") < F.col("_ok"), "degraded").otherwise("ok")
    return g.select("call_id", outcome.alias("outcome"), "model", "n_attempts")


def cooldown_blocked(calls: DataFrame, cooldown: float = COOLDOWN, span: str = "1 hour") -> DataFrame:
    """Attempts that fall into the cooldown set by the model's latest earlier rate-limit failure: its retry_after seconds
    where the calls have and give them, else `cooldown`.

    Each model's calls are looked at in stretches of `span`; the last failure of the stretches before is carried in, so that
    a model with most of the calls is many tasks.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    wait = F.coalesce(F.col("retry_after").cast("double"), F.lit(float(cooldown))) if "retry_after" in calls.columns else F.lit(float(cooldown))
    until = F.when(F.col("http_status") == 429, micros("ts") + (wait * 1_000_000).cast("long"))
    calls = calls.withColumn("_until", until).withColumn("_part", F.window(F.col("ts").cast("timestamp"), span)["start"])
    ends = calls.groupBy("model", "_part").agg(F.max_by("_until", F.when(F.col("_until").isNotNull(), F.struct("ts", "seq"))).alias("_carry"))
    ends = ends.withColumn("_carry", F.last("_carry", ignorenulls=True).over(Window.partitionBy("model").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    before = Window.partitionBy("model", "_part").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    out = calls.withColumn("_own", F.last("_until", ignorenulls=True).over(before)).join(ends, ["model", "_part"])
    out = out.withColumn("until", F.coalesce("_own", "_carry")).where(micros("ts") < F.col("until"))
    return out.drop("_until", "_part", "_own", "_carry")


def model_leaderboard(models: DataFrame, n: int = 5) -> DataFrame:
    """The n best free models by score, then context length, then id."""
    scored = models.where(F.col("id").endswith(":free")).withColumn("score", S.score_model(F.col("benchmarked"), F.col("intelligence"), F.col("agentic")))
    return scored.orderBy(F.desc("score"), F.desc("context_length"), "id").limit(n).select("id", "score", "context_length")
