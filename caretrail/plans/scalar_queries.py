"""One query for each column function, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from caretrail import reference_data as R
from caretrail.functions import scalars as S
from caretrail.plans.bindings import bind, view_sql

QUERIES, SQL = {}, {}


def _add(name, view, build, sql):
    QUERIES[name] = lambda spark, sf, view=view, build=build: build(bind(spark, sf, view))
    SQL[name] = view_sql(view) + sql


def _cases(column: str, values: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {default} END"


C = F.col
_KEY = "trim(regexp_replace(lower(trim({})), '[^a-z0-9]+', ' ', 'g'))"
_CANON = _cases(_KEY.format("name"), R.CONDITION_ALIASES, _KEY.format("name"))
_SYSTEM = _cases("lower(trim(system))", {s: s for s in R.SYSTEMS} | R.SYSTEM_ALIASES, f"'{R.DEFAULT_SYSTEM}'")
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(lower(concat(name, ' ', coalesce(notes, ''))), '{p}') THEN '{s}'" for s, p in R.KEYWORDS) + f" ELSE '{R.KEYWORD_DEFAULT}' END"

_add("normalize_system", "terms", lambda d: d.select("id", S.normalize_system(C("system")).alias("system_id")), f"SELECT id, {_SYSTEM} AS system_id FROM terms")
_add("classify_system", "terms", lambda d: d.select("id", S.classify_system(C("name"), C("notes")).alias("system_id")), f"SELECT id, {_CLASS} AS system_id FROM terms")
_add("normalized_key", "terms", lambda d: d.select("id", S.normalized_key(C("name")).alias("k")), f"SELECT id, {_KEY.format('name')} AS k FROM terms")
_add("canonical_condition_name", "terms", lambda d: d.select("id", S.canonical_condition_name(C("name")).alias("k")), f"SELECT id, {_CANON} AS k FROM terms")
_add(
    "condition_key", "terms", lambda d: d.select("id", S.condition_key(C("name"), C("organ"), C("location")).alias("k")),
    f"SELECT id, concat({_CANON}, '|', {_KEY.format(chr(99) + 'oalesce(organ, chr(32))')}, '|', {_KEY.format(chr(99) + 'oalesce(location, chr(32))')}) AS k FROM terms",
)
_add("contact_name_key", "terms", lambda d: d.select("id", S.contact_name_key(C("name")).alias("k")), "SELECT id, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS k FROM terms")
_LEAD = "TRY_CAST(nullif(regexp_extract(string_split(d, '-')[{}], '^\\s*([+-]?\\d{{1,9}})', 1), '') AS INT)"
_MONTH = "coalesce(" + _LEAD.format(2) + " - 1, " + _cases("upper(string_split(d, '-')[2])", {m: i for i, m in enumerate(R.MONTHS)}, "NULL").replace("'0'", "0") + "::INT)"
_add(
    "parse_date_frac", "dated", lambda d: d.select("id", F.round(S.parse_date_frac(C("d")), 6).alias("frac")),
    f"SELECT id, round(CASE WHEN {_LEAD.format(1)} IS NULL THEN 0 WHEN {_MONTH} IS NULL OR {_LEAD.format(3)} IS NULL THEN {_LEAD.format(1)} ELSE {_LEAD.format(1)} + ({_MONTH} * 30.44::DOUBLE + {_LEAD.format(3)}) / 365.25::DOUBLE END::DOUBLE, 6) AS frac FROM dated",
)
_P = "coalesce(TRY_CAST(string_split(d, '-')[{}] AS INT), {})"
_add(
    "year_frac", "dated", lambda d: d.select("id", F.round(S.year_frac(C("d")), 6).alias("frac")),
    "SELECT id, round(CASE WHEN regexp_matches(coalesce(d, ''), '^\\d{4}(-\\d{2}(-\\d{2})?)?$') THEN "
    + f"{_P.format(1, 0)} + date_diff('day', make_date({_P.format(1, 0)}, 1, 1), CAST(make_date({_P.format(1, 0)}, 1, 1) + to_months({_P.format(2, 7)} - 1) + to_days({_P.format(3, 1)} - 1) AS DATE))"
    + f" / CAST(date_diff('day', make_date({_P.format(1, 0)}, 1, 1), make_date({_P.format(1, 0)} + 1, 1, 1)) AS DOUBLE) ELSE 0 END::DOUBLE, 6) AS frac FROM dated",
)
_HASH = "list_reduce(list_prepend({}::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(name, '')]), lambda h, c: (h * 31 + c) % 4294967296)"
_ANCHOR = ["CASE system_id " + " ".join(f"WHEN '{s}' THEN {R.ANCHORS[s][i]}" for s in R.SYSTEMS) + " END" for i in (0, 1)]
_add(
    "default_position", "terms",
    lambda d: d.select("id", S.default_position(S.normalize_system(C("system")), C("name")).alias("p")).select("id", F.round("p.cx", 6).alias("cx"), F.round("p.cy", 6).alias("cy")),
    f", t AS (SELECT *, {_SYSTEM} AS system_id FROM terms) SELECT id, round(greatest(12, least(88, {_ANCHOR[0]} + ({_HASH.format(17)} % 900) / 100.0::DOUBLE - 4.5)), 6)::DOUBLE AS cx, round(greatest(8, least(88, {_ANCHOR[1]} + ({_HASH.format(53)} % 900) / 100.0::DOUBLE - 4.5)), 6)::DOUBLE AS cy FROM t",
)
_add("sanitize_coordinate", "dated", lambda d: d.select("id", S.sanitize_coordinate(C("o_totalprice") / 1000 - 50).alias("c")), "SELECT id, CASE WHEN o_totalprice / 1000 - 50 BETWEEN 0 AND 100 THEN o_totalprice / 1000 - 50 END AS c FROM dated")
_RAIL = "CASE WHEN high <= low THEN 0 ELSE (exp(2.5 * greatest(0, least(1, (year - low) / nullif(high - low, 0)))) - 1) / (exp(2.5::DOUBLE) - 1) END::DOUBLE"
_add("rail_pos", "dated", lambda d: d.select("id", F.round(S.rail_pos(C("year"), C("low"), C("high")), 6).alias("pos")), f"SELECT id, round({_RAIL}, 6) AS pos FROM dated")
_add(
    "from_rail_pos", "dated", lambda d: d.select("id", F.round(S.from_rail_pos((C("id") % 150) / F.lit(100.0) - 0.2, C("low"), C("high")), 6).alias("year")),
    "SELECT id, round(low + ln(greatest(0, least(1, (id % 150) / 100.0::DOUBLE - 0.2)) * (exp(2.5::DOUBLE) - 1) + 1) / 2.5 * (high - low), 6)::DOUBLE AS year FROM dated",
)
_MNAME = "(['" + "','".join(R.MONTHS) + "'])[{}]"
_add(
    "format_date_display", "dated",
    lambda d: d.select("id", S.format_date_display(C("year"), "date", F.lit(1970), F.lit("MAR")).alias("by_date"), S.format_date_display(F.floor(C("year") * 4) / 4, "age", F.lit(1994), F.lit("MAR")).alias("by_age")),
    f"SELECT id, concat(floor(year)::BIGINT, '-', {_MNAME.format('1 + greatest(0, least(11, floor((year - floor(year)) * 12 + 0.5)))::INT')}) AS by_date, printf('AGE %.1f', greatest(0, floor(year * 4) / 4 - (1994 + 2 / 12.0::DOUBLE))::DOUBLE) AS by_age FROM dated",
)
_EV = "CASE id % 4 WHEN 0 THEN name WHEN 1 THEN concat(name, ' · ', organ) WHEN 2 THEN concat('Dr. ', name, ' ·  ', notes, ' · ', system) END"
_add(
    "parse_evidence", "terms", lambda d: d.select("id", S.parse_evidence(F.coalesce(F.expr(_EV), F.lit(""))).alias("e")).select("id", "e.*"),
    f", t AS (SELECT id, string_split(coalesce(CASE id % 4 WHEN 0 THEN name WHEN 1 THEN name || ' · ' || organ WHEN 2 THEN 'Dr. ' || name || ' ·  ' || notes || ' · ' || system END, ''), ' · ') AS p FROM terms) SELECT id, trim(coalesce(p[1], '')) AS doctor, trim(coalesce(p[2], '')) AS institution, trim(coalesce(p[3], '')) AS location FROM t",
)
_add(
    "local_name", "terms",
    lambda d: d.select("id", S.local_name(C("name"), F.create_map(F.lit("es"), F.concat(F.lit("es-"), C("name")), F.lit("ja"), F.concat(F.lit("ja-"), C("name"))), F.expr("CASE id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'es' WHEN 2 THEN 'ja' ELSE 'zh-TW' END")).alias("shown")),
    "SELECT id, CASE id % 4 WHEN 1 THEN concat('es-', name) WHEN 2 THEN concat('ja-', name) ELSE name END AS shown FROM terms",
)
_add("to_mg_dl", "measurements", lambda d: d.select("seq", F.round(S.to_mg_dl(C("value_numeric"), C("unit")), 6).alias("mg_dl")), "SELECT seq, round(CASE WHEN lower(unit) = 'mmol/l' THEN value_numeric * 18.018::DOUBLE ELSE value_numeric END, 6) AS mg_dl FROM measurements")
_add(
    "resolve_page", "dated", lambda d: d.select("id", S.resolve_page(C("id") % 100, F.expr("CASE WHEN id % 7 = 0 THEN NULL ELSE array(0, 20, 45, 90) END")).cast("int").alias("page")),
    "SELECT id, CASE WHEN id % 7 <> 0 THEN greatest(1, (0 <= id % 100)::INT + (20 <= id % 100)::INT + (45 <= id % 100)::INT + (90 <= id % 100)::INT) END::INT AS page FROM dated",
)
_add(
    "estimate_page_breaks", "dated", lambda d: d.select("id", F.posexplode(S.estimate_page_breaks(F.floor("o_totalprice").cast("int"), (C("id") % 6).cast("int"))).alias("i", "at")).select("id", "i", "at"),
    ", p AS (SELECT id, floor(o_totalprice)::INT AS n, (id % 6)::INT AS k, unnest(range(greatest((id % 6)::INT, 1)))::INT AS i FROM dated) SELECT id, i, CASE WHEN k > 0 THEN floor(n * i / k::DOUBLE + 0.5) ELSE 0 END::INT AS at FROM p",
)
_URI = "concat('s3://bucket/in/', CASE WHEN id % 3 = 0 THEN 'scan.PDF' ELSE filename END, CASE WHEN id % 4 = 0 THEN '?v=1.pdf' ELSE '' END, CASE WHEN id % 5 = 0 THEN '.txt' ELSE '' END)"
_add(
    "input_kind", "health_records", lambda d: d.withColumn("uri", F.expr(_URI)).select("id", S.is_pdf(C("uri")).alias("pdf"), S.filename(C("uri")).alias("file")),
    f", u AS (SELECT id, string_split({_URI}, '?')[1] AS uri FROM health_records) SELECT id, lower(uri) LIKE '%.pdf' AS pdf, string_split(uri, '/')[-1] AS file FROM u",
)
_BODY = "CASE seq % 3 WHEN 0 THEN 'Insufficient_Quota today' WHEN 1 THEN 'context_length_exceeded' END"
_STATUS = "CASE WHEN seq % 5 = 0 THEN 418 WHEN seq % 11 = 0 THEN 401 WHEN seq % 13 = 0 THEN 400 ELSE http_status END"
_add(
    "classify_http_failure", "call_log", lambda d: d.select("seq", S.classify_http_failure(F.expr(_STATUS), F.expr(_BODY)).alias("kind")),
    f", c AS (SELECT seq, {_STATUS} AS s, {_BODY} AS b FROM call_log) SELECT seq, CASE WHEN s IN (401, 403) THEN 'auth' WHEN s = 429 THEN 'rate_limit' WHEN s = 402 THEN 'quota_billing' WHEN s = 400 THEN 'invalid_request' WHEN s >= 500 THEN 'server' WHEN lower(b) LIKE '%insufficient_quota%' THEN 'quota_billing' WHEN lower(b) LIKE '%context_length_exceeded%' THEN 'invalid_request' ELSE 'server' END AS kind FROM c",
)
_MSG = "concat('Failed with bearer ', call_id, ' and sk-or-', model, ' AIza', model, ' key ', call_id)"
_add(
    "redact_secrets", "call_log", lambda d: d.select("seq", S.redact_secrets(F.expr(_MSG), C("call_id")).alias("message")),
    f"SELECT seq, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MSG}, '(?i)Bearer\\s+\\S+', '[REDACTED]', 'g'), 'sk-or-[a-zA-Z0-9-_]+', '[REDACTED]', 'g'), 'sk-[a-zA-Z0-9-_]+', '[REDACTED]', 'g'), 'AIza[a-zA-Z0-9-_]+', '[REDACTED]', 'g'), call_id, '[REDACTED]') AS message FROM call_log",
)
_add(
    "normalise_elo", "dated", lambda d: d.select("id", F.round(S.normalise_elo(C("year"), C("low"), C("high")), 6).alias("score")),
    "SELECT id, round(CASE WHEN high = low THEN 50 ELSE greatest(0, least(100, (year - low) / nullif(high - low, 0) * 100)) END::DOUBLE, 6) AS score FROM dated",
)
_DOC = "CASE WHEN id LIKE '%:free' THEN intelligence / 2 END"
_add(
    "composite_score", "models", lambda d: d.select("id", F.round(S.composite_score(C("intelligence"), C("agentic"), F.expr(_DOC), C("agentic") / 3), 6).alias("score")),
    f"SELECT id, round(CASE WHEN {_DOC} IS NOT NULL THEN intelligence * 0.35 + agentic * 0.25 + ({_DOC}) * 0.25 + agentic / 3 * 0.15 ELSE (intelligence * 0.35 + agentic * 0.25) / 0.6 END::DOUBLE, 6) AS score FROM models",
)
_MODEL_SCORE = "round(CASE WHEN benchmarked THEN (intelligence * 0.35 + agentic * 0.25) / 0.6 ELSE -1 END::DOUBLE, 6)"
_add("score_model", "models", lambda d: d.select("id", F.round(S.score_model(C("benchmarked"), C("intelligence"), C("agentic")), 6).alias("score")), f"SELECT id, {_MODEL_SCORE} AS score FROM models")
_D2 = "CASE WHEN id % 3 = 0 THEN '1995-05-05' WHEN id % 3 = 1 THEN '' ELSE '1996-13' END"
_add(
    "earliest_date", "dated", lambda d: d.select("id", S.earliest_date(F.array(C("d"), F.expr(_D2))).alias("first")),
    f"SELECT id, least(CASE WHEN regexp_matches(d, '^\\d{{4}}(-\\d{{2}}-\\d{{2}})?$') THEN d END, CASE WHEN regexp_matches({_D2}, '^\\d{{4}}(-\\d{{2}}-\\d{{2}})?$') THEN {_D2} END) AS first FROM dated",
)
_add("earlier_date", "dated", lambda d: d.select("id", S.earlier_date(C("d"), F.expr(_D2)).alias("first")), f"SELECT id, least(nullif(d, ''), nullif({_D2}, '')) AS first FROM dated")
_add(
    "js_number", "measurements", lambda d: d.select("seq", S.js_number(C("value_numeric")).alias("shown")),
    "SELECT seq, regexp_replace(regexp_replace(value_numeric::DECIMAL(30,10)::VARCHAR, '0+$', ''), '\\.$', '') AS shown FROM measurements",
)
