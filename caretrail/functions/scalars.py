"""Column functions of the health-record jobs: all built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caretrail import reference_data as R


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def normalize_system(system: Column) -> Column:
    """Known ids pass, aliases map, anything else is the default system."""
    key = F.lower(F.trim(F.coalesce(system, F.lit(""))))
    return F.when(key.isin(R.SYSTEMS), key).otherwise(F.coalesce(F.try_element_at(_map(R.SYSTEM_ALIASES), key), F.lit(R.DEFAULT_SYSTEM)))


def classify_system(name: Column, notes: Column) -> Column:
    """The system of the first keyword rule that the name and notes match."""
    text = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(notes, F.lit(""))))
    out = None
    for system, pattern in R.KEYWORDS:
        out = F.when(text.rlike(pattern), system) if out is None else out.when(text.rlike(pattern), system)
    return out.otherwise(R.KEYWORD_DEFAULT)


def normalized_key(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", " "))


def canonical_condition_name(name: Column) -> Column:
    key = normalized_key(name)
    return F.coalesce(F.try_element_at(_map(R.CONDITION_ALIASES), key), key)


def condition_key(name: Column, organ: Column, location: Column, locations: Column | None = None) -> Column:
    """Mentions with equal keys are one condition; explicit locations do not split it."""
    place = normalized_key(F.coalesce(location, F.lit("")))
    if locations is not None:
        place = F.when(F.coalesce(F.size(locations), F.lit(0)) > 0, "").otherwise(place)
    return F.concat_ws("|", canonical_condition_name(name), normalized_key(F.coalesce(organ, F.lit(""))), place)


def contact_name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def _leading_int(text: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(text, "^\\s*([+-]?\\d{1,9})", 1), F.lit("")), F.lit("S999999999")).cast("int")


def parse_date_frac(date: Column) -> Column:
    """Year and fraction (months of 30.44 days) from Y-M-D or Y-MMM-D; the year alone without month or day; 0 without year."""
    part = lambda i: F.get(F.split(date, "-"), F.lit(i))
    year, day = _leading_int(part(0)), _leading_int(part(2))
    named = F.array_position(F.array(*[F.lit(m) for m in R.MONTHS]), F.upper(part(1)))
    month = F.coalesce(_leading_int(part(1)) - 1, F.when(named > 0, (named - 1).cast("int")))
    frac = year + (month * F.lit(30.44) + day) / F.lit(365.25)
    return F.when(year.isNull(), 0.0).when(month.isNull() | day.isNull(), year.cast("double")).otherwise(frac)


def year_frac(date: Column) -> Column:
    """Strict YYYY[-MM[-DD]]: year and elapsed share of the real year; the month is 7 and the day 1 if absent; else 0."""
    ok = F.coalesce(date, F.lit("")).rlike("^\\d{4}(-\\d{2}(-\\d{2})?)?$")
    part = lambda i, default: F.coalesce(F.try_to_number(F.get(F.split(date, "-"), F.lit(i)), F.lit("9999")).cast("int"), F.lit(default))
    year, month, day = part(0, 0), part(1, 7), part(2, 1)
    start = F.make_date(year, F.lit(1), F.lit(1))
    at = F.date_add(F.add_months(start, month - 1), day - 1)
    length = F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), start)
    return F.when(ok, year + F.datediff(at, start) / length).otherwise(0.0)


def _offset(seed: Column, salt: int) -> Column:
    chars = F.when(F.length(seed) > 0, F.split(seed, "")).otherwise(F.array().cast("array<string>"))
    folded = F.aggregate(chars, F.lit(salt).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % 4294967296)
    return (folded % 900) / 100 - 4.5


def default_position(system: Column, seed: Column) -> Column:
    """The system's anchor with an offset that depends on the seed alone; struct<cx,cy>."""
    anchor = lambda i: F.element_at(F.create_map(*[F.lit(v) for s in R.SYSTEMS for v in (s, float(R.ANCHORS[s][i]))]), system)
    within = lambda v, b: F.greatest(F.lit(float(b[0])), F.least(F.lit(float(b[1])), v))
    seed = F.coalesce(seed, F.lit(""))
    return F.struct(
        within(anchor(0) + _offset(seed, R.SALT_X), R.PLACE_X).alias("cx"), within(anchor(1) + _offset(seed, R.SALT_Y), R.PLACE_Y).alias("cy")
    )


def sanitize_coordinate(value: Column) -> Column:
    return F.when(value.between(0, 100) & ~F.isnan(value), value)


def rail_pos(year: Column, low: Column, high: Column, k: float = R.RAIL_K) -> Column:
    """Place of a year on the exponential scale from low (0) to high (1); 0 on an empty range."""
    import math

    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (year - low) / F.nullif(high - low, F.lit(0.0))))
    return F.when(high <= low, 0.0).otherwise((F.exp(t * k) - 1) / (math.exp(k) - 1))


def from_rail_pos(pos: Column, low: Column, high: Column, k: float = R.RAIL_K) -> Column:
    import math

    t = F.log(F.greatest(F.lit(0.0), F.least(F.lit(1.0), pos)) * (math.exp(k) - 1) + 1) / k
    return low + t * (high - low)


def format_date_display(year: Column, mode: str, birth_year: Column, birth_month: Column) -> Column:
    """'YYYY-MMM', or in mode 'age' 'AGE n.n', never below 0."""
    months = F.array(*[F.lit(m) for m in R.MONTHS])
    if mode == "age":
        month = F.greatest(F.array_position(months, birth_month) - 1, F.lit(0))
        return F.concat(F.lit("AGE "), F.format_string("%.1f", F.greatest(F.lit(0.0), year - (birth_year + month / 12))))
    whole = F.floor(year)
    month = F.greatest(F.lit(0), F.least(F.lit(11), F.floor((year - whole) * 12 + 0.5)))
    return F.concat(whole.cast("string"), F.lit("-"), F.get(months, month.cast("int")))


def parse_evidence(evidence: Column) -> Column:
    part = lambda i: F.trim(F.coalesce(F.get(F.split(evidence, " · "), F.lit(i)), F.lit("")))
    return F.struct(part(0).alias("doctor"), part(1).alias("institution"), part(2).alias("location"))


def local_name(label: Column, names: Column, lang: Column) -> Column:
    return F.when(lang == "en", label).otherwise(F.coalesce(F.try_element_at(names, lang), label))


def to_mg_dl(value: Column, unit: Column) -> Column:
    return F.when(F.lower(unit) == "mmol/l", value * R.GLUCOSE_FACTOR).otherwise(value)


def resolve_page(offset: Column, page_breaks: Column) -> Column:
    """1-based page of an offset; null without page starts."""
    return F.when(F.size(page_breaks) > 0, F.greatest(F.lit(1), F.size(F.filter(page_breaks, lambda b: b <= offset))))


def estimate_page_breaks(length: Column, pages: Column) -> Column:
    even = F.transform(F.sequence(F.lit(0), F.greatest(pages, F.lit(1)) - 1), lambda i: F.floor(length * i / F.greatest(pages, F.lit(1)) + 0.5).cast("int"))
    return F.when(pages > 0, even).otherwise(F.array(F.lit(0)))


def is_pdf(uri: Column) -> Column:
    return F.lower(F.substring_index(uri, "?", 1)).endswith(".pdf")


def filename(uri: Column) -> Column:
    return F.element_at(F.split(F.substring_index(uri, "?", 1), "/"), -1)


def classify_http_failure(status: Column, body: Column) -> Column:
    low = F.lower(F.coalesce(body, F.lit("")))
    return (
        F.when(status.isin(401, 403), "auth")
        .when(status == 429, "rate_limit")
        .when(status == 402, "quota_billing")
        .when(status == 400, "invalid_request")
        .when(status >= 500, "server")
        .when(low.contains("insufficient_quota"), "quota_billing")
        .when(low.contains("context_length_exceeded"), "invalid_request")
        .otherwise("server")
    )


def redact_secrets(message: Column, key: Column) -> Column:
    for pattern in R.SECRET_PATTERNS:
        message = F.regexp_replace(message, pattern, "[REDACTED]")
    return F.when(F.length(key) > 0, F.replace(message, key, F.lit("[REDACTED]"))).otherwise(message)


def normalise_elo(elo: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (elo - low) / F.nullif(high - low, F.lit(0.0)) * 100)))


def composite_score(intelligence: Column, agentic: Column, document: Column, instruction: Column) -> Column:
    """Weighted score; without the two arena scores the other weights are scaled up to 1."""
    w = R.SCORE_WEIGHTS
    two = intelligence * w["intelligence"] + agentic * w["agentic"]
    four = two + document * w["document"] + instruction * w["instruction"]
    return F.when(document.isNotNull() & instruction.isNotNull(), four).otherwise(two / (w["intelligence"] + w["agentic"]))


def score_model(benchmarked: Column, intelligence: Column, agentic: Column) -> Column:
    none = F.lit(None).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.when(benchmarked, composite_score(zero(intelligence), zero(agentic), none, none)).otherwise(-1.0)


def earliest_date(dates: Column) -> Column:
    """Smallest of the values that are YYYY or YYYY-MM-DD."""
    return F.array_min(F.filter(dates, lambda d: d.rlike("^\\d{4}(-\\d{2}-\\d{2})?$")))


def earlier_date(a: Column, b: Column) -> Column:
    return F.least(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def js_number(value: Column) -> Column:
    """A number as the records write it: no exponent, no trailing zeros."""
    text = F.regexp_replace(value.cast("decimal(30,10)").cast("string"), "0+$", "")
    return F.regexp_replace(text, "\\.$", "")


def running_sums(numbers: Column) -> Column:
    """Sums up to each element, in seven passes: the first adds the 15 elements before, the next the 15 sums before, and so on."""
    one = F.array(F.transform(numbers, lambda n: n.cast("long")))

    def add(k: int):
        before = lambda a, i: [F.coalesce(F.get(a, i - m * k), F.lit(0)) for m in range(1, 16)]
        return lambda a: F.when(F.size(a) > k, F.transform(a, lambda x, i: sum(before(a, i), x))).otherwise(a)

    for step in range(7):
        one = F.transform(one, add(16**step))
    return F.get(one, F.lit(0))
