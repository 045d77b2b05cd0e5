"""Text jobs: redaction, contacts, chunking, model responses. Two small helpers work document by document; the rest is built in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretrail import reference_data as R

# What is redacted, in order of precedence, and how. Word characters are ASCII.
CJK = "一-鿿぀-ゟ゠-ヿ0-9A-Za-z_"
REDACTION_RULES = [
    ("[PATIENT NAME]", r"(?ai:\b(?:Patient|Patient Name|Name)\s*[:#]\s*[^\n\r]{1,60})"),
    ("[PATIENT NAME]", rf"姓名\s*[：:]\s*[{CJK}]{{1,20}}"),
    ("[PATIENT NAME]", rf"氏名\s*[：:]\s*[{CJK}]{{1,20}}"),
    ("[DATE OF BIRTH]", r"(?ai:\b(?:DOB|Date of Birth|Birth Date)\s*[:#]\s*[\d/\-]+)"),
    ("[DATE OF BIRTH]", r"出生日期\s*[：:]\s*[0-9年月日/\-\s]{1,20}"),
    ("[DATE OF BIRTH]", r"生年月日\s*[：:]\s*[0-9年月日/\-\s]{1,20}"),
    ("[MRN]", r"(?ai:\b(?:MRN|Medical Record Number|Medical Record No|Chart #|Chart No)\s*[:#]?\s*[\w\-]{1,20})"),
    ("[PHONE]", r"(?ai:\b(?:Phone|Tel|Telephone|Mobile|Cell|Fax)\s*[:#]\s*[\d\s()\-+.]{7,20})"),
    ("[PHONE]", r"電話\s*[：:]\s*[0-9\-\s()]{7,20}"),
    ("[PHONE]", r"電話番号\s*[：:]\s*[0-9\-\s]{7,20}"),
    ("[INSURANCE ID]", r"(?ai:\b(?:Insurance ID|Insurance No|Policy No|Policy Number|Member ID)\s*[:#]\s*[\w\-]{1,20})"),
    ("[EMAIL]", r"(?a:\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b)"),
    ("[SSN]", r"(?a:\b\d{3}[-\s]\d{2}[-\s]\d{4}\b)"),
    ("[NATIONAL ID]", r"身份證(?:字號|號碼)?\s*[：:]\s*[A-Z][0-9]{9}"),
    ("[NATIONAL ID]", r"マイナンバー\s*[：:]\s*[0-9]{12}"),
]
# Fixed values as well: where a patient's name stands, what a clinician's line says, and how an address or number looks.
NAME_FIELDS = [
    r"(?ai:\b(?:Patient|Patient Name|Name)\s*[:#]\s*([^\n\r]{1,60}))",
    rf"姓名\s*[：:]\s*([{CJK}]{{1,20}})",
    rf"氏名\s*[：:]\s*([{CJK}]{{1,20}})",
]
CLINICIAN = "doctor|physician|provider|attending|ordering|referring|author"
EMAIL = "[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}"
PHONE = "\\+?[0-9][0-9\\s().\\-]{6,}[0-9]"
CONTACT = f"(?i)(?:{CLINICIAN})\\s*[:\\-]?\\s*(?:Dr\\.\\s*)?([^,;|]+?)(?:\\s+(?:email|phone|tel|fax)(?![0-9A-Za-z_])|$)"

EDIT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("replacement", T.StringType())]))
REDACTED = T.StructType([T.StructField("edits", EDIT), T.StructField("text", T.StringType())])


_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def ascii_lower(text: str) -> str:
    """A-Z in lower case, all else as it is, so that places stay."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def name_spans(text: str, folded: str, name: str) -> Iterator[tuple[int, int]]:
    """Where else a labelled name occurs: Latin names of 3 letters or more as whole words in either case, others of 2 or more
    anywhere. folded is ascii_lower(text). No pattern is compiled, as most names occur in one text only."""
    latin = bool(re.search("[A-Za-z]", name))
    if len(name) < (3 if latin else 2):
        return
    within, wanted = (folded, ascii_lower(name)) if latin else (text, name)
    first, last = name[0] in _WORD, name[-1] in _WORD
    at = within.find(wanted)
    while at >= 0:
        end = at + len(wanted)
        if not latin or ((at > 0 and text[at - 1] in _WORD) != first and (end < len(text) and text[end] in _WORD) != last):
            yield at, end
            at = within.find(wanted, end)
        else:
            at = within.find(wanted, at + 1)


def find_edits(text: str, rules) -> list[tuple[int, int, str]]:
    """Spans to replace, in order. A span that overlaps an earlier claim goes whole; the claims are kept sorted."""
    from bisect import bisect_right

    starts, spans = [], []

    def claim(a: int, b: int, replacement: str) -> None:
        i = bisect_right(starts, a)
        if a < b and not (i and spans[i - 1][1] > a) and not (i < len(starts) and starts[i] < b):
            starts.insert(i, a)
            spans.insert(i, (a, b, replacement))

    for replacement, pattern in rules:
        for m in pattern.finditer(text):
            claim(*m.span(), replacement)
    names = [m[1].strip() for p in NAME_FIELDS for m in re.finditer(p, text)]
    folded = ascii_lower(text) if names else ""
    for name in dict.fromkeys(filter(None, names)):
        for a, b in name_spans(text, folded, name):
            claim(a, b, "[PATIENT NAME]")
    return spans


def redact(docs: DataFrame, rules=None, text_col: str = "text") -> DataFrame:
    """Replaces personal data; adds `edits` (code-point spans of the original text). Matches come from the original text.

    rules: (replacement, pattern) in order of precedence, or a table (rank, replacement, pattern) of rule_tables.PATTERNS at most.
    """
    rules = REDACTION_RULES if rules is None else rules
    if isinstance(rules, DataFrame):
        from caretrail.operators.rule_tables import rows_of

        rules = [(r.replacement, r.pattern) for r in rows_of(rules, ["rank", "replacement", "pattern"])]

    @F.pandas_udf(REDACTED)
    def redacted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = [(r, re.compile(p)) for r, p in rules]
        for part in texts:
            edits = [find_edits(t, compiled) for t in part]
            named = [[{"start": a, "end": b, "replacement": r} for a, b, r in e] for e in edits]
            yield pd.DataFrame({"edits": named, "text": [apply_edits(t, e) for t, e in zip(part, edits, strict=True)]})

    out = docs.withColumn("_redacted", redacted(F.coalesce(F.col(text_col), F.lit(""))))
    text = F.when(F.col(text_col).isNotNull(), F.col("_redacted.text"))
    return out.withColumn("edits", F.col("_redacted.edits")).withColumn(text_col, text).drop("_redacted")


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with its spans replaced; the edits follow each other."""
    at, out = 0, []
    for start, end, replacement in edits:
        out += [text[at:start], replacement]
        at = end
    return "".join([*out, text[at:]])


def remap_offsets(offsets: Column, edits: Column) -> Column:
    """Offsets of the original text as offsets of the redacted one, in their order: offsets and ends of edits are sorted
    together, and each offset moves by what the edits before it have grown. Null edits are none; a null offset stays null."""
    from caretrail.functions.scalars import running_sums

    points = "array<struct<at:int,kind:int,grown:bigint,place:int>>"
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  (value is worked out once)
    ends = F.transform(edits, lambda e: F.struct(e["end"].alias("at"), F.lit(0).alias("kind"), (F.length(e["replacement"]) - (e["end"] - e["start"])).alias("grown"), F.lit(-1).alias("place")))
    asked = F.transform(offsets, lambda off, i: F.struct(off.alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("grown"), i.alias("place")))

    def moved(p: Column, sums: Column) -> Column:
        at = F.transform(p, lambda x, i: F.struct(x["place"].alias("place"), x["kind"].alias("kind"), (x["at"] + F.get(sums, i)).cast("int").alias("off")))
        return F.transform(F.array_sort(F.filter(at, lambda x: x["kind"] == 1)), lambda x: x["off"])

    together = F.array_sort(F.concat(F.coalesce(ends.cast(points), F.array().cast(points)), asked.cast(points)))
    return bound(together, lambda p: bound(running_sums(F.transform(p, lambda x: x["grown"])), lambda sums: moved(p, sums)))


def pii_counts(redacted: DataFrame) -> DataFrame:
    return redacted.select(F.explode("edits").alias("e")).groupBy(F.col("e.replacement").alias("kind")).count().withColumnRenamed("count", "n")


def provider_contacts(docs: DataFrame, by: list[str]) -> DataFrame:
    """Clinician lines with an email or phone number in them or in the next two lines; each text is read within its row."""
    clinician = f"(?i)(?<![0-9A-Za-z_])(?:{CLINICIAN})(?![0-9A-Za-z_])"
    near = lambda lines, line, i: F.concat_ws(" ", line, F.get(lines, i + 1), F.get(lines, i + 2))
    named = lambda lines: F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(clinician), F.struct(i.alias("line_no"), line.alias("line"), near(lines, line, i).alias("near")))), lambda x: x.isNotNull())
    lines = docs.select(*by, F.inline(F.flatten(F.transform(F.array(F.split("text", "\\r?\\n")), named))))
    found = lambda c, p, g=0: F.nullif(F.trim(F.regexp_extract(c, p, g)), F.lit(""))
    out = lines.select(*by, "line_no", found("line", CONTACT, 1).alias("name"), found("near", EMAIL).alias("email"), found("near", PHONE).alias("phone"), F.trim("line").alias("evidence"))
    return out.where("email IS NOT NULL OR phone IS NOT NULL")


# ---- chunks ----

SECTION = "array<struct<heading:string,startOffset:int,inferredDate:string,sectionType:string,imageWorthy:boolean>>"
CHUNK = "array<struct<start:int,end:int,heading:string,sectionType:string,inferredDate:string,imageWorthy:boolean>>"


def cut(text: str, sections: list, longest: int, shortest: int) -> list[tuple]:
    """(start, end, heading, type, date, image) of the chunks; they follow each other and cover the text."""
    marks, cursor = [], 0
    for s in sections or []:
        heading = s["heading"] or ""
        at = text.find(heading, cursor) if heading else -1
        start = at if at >= 0 else min(max(s["startOffset"] or 0, cursor), len(text))
        cursor = min(len(text), start + (max(1, len(heading)) if at >= 0 else 1))
        marks.append([start, heading, s["sectionType"] or "other", s["inferredDate"], bool(s["imageWorthy"])])
    if not marks:
        marks = [[0, "", "other", None, False]]
    marks[0][0] = 0
    ends = [m[0] for m in marks[1:]] + [len(text)]
    parts = [[m[0], e, *m[1:]] for m, e in zip(marks, ends, strict=True) if e > m[0]] or [[0, len(text), *marks[0][1:]]]

    def melt(a, b):  # a's text runs on into b
        names = [h for h in dict.fromkeys([a[2], b[2]]) if h]
        return [a[0], b[1], " / ".join(names), a[3] if a[3] != "other" else b[3], b[4] if a[4] is None else a[4], a[5] or b[5]]

    whole: list = []
    for i, p in enumerate(parts):
        if p[1] - p[0] < shortest and i + 1 < len(parts):
            parts[i + 1] = melt(p, parts[i + 1])
        elif p[1] - p[0] < shortest and whole:
            whole[-1] = melt(whole[-1], p)
        else:
            whole.append(p)
    out = []
    for a, e, *rest in whole:
        stops = [a, *(a + m.end() for m in re.finditer(r"\n{2,}", text[a:e])), e] if e - a > longest else [a, e]
        pieces, begin, end = [], a, a
        for lo, hi in zip(stops, stops[1:], strict=False):
            if hi - begin > longest and end > begin:
                pieces.append((begin, end))
                begin = lo
            end = hi
        pieces.append((begin, end))
        for lo, hi in pieces:
            out += [(k, min(hi, k + longest), *rest) for k in range(lo, hi, longest)]
    return out


def cut_chunks(docs: DataFrame, max_chars: int = 6000, min_chars: int = 200) -> DataFrame:
    """docs (text, sections) with `_c`, a list of each text's chunks as CHUNK, in order; a null text is cut as an empty one."""

    @F.pandas_udf(CHUNK)
    def cut_all(texts: pd.Series, sections: pd.Series) -> pd.Series:
        names = ("start", "end", "heading", "sectionType", "inferredDate", "imageWorthy")
        return pd.Series([[dict(zip(names, c, strict=True)) for c in cut(t, list(s) if s is not None else [], max_chars, min_chars)] for t, s in zip(texts, sections, strict=True)])

    # else Spark would filter by the lists' sizes before it explodes them, and cut (and redact) every text once more for that
    once = cut_all.asNondeterministic()
    return docs.withColumn("_c", once(F.coalesce("text", F.lit("")), F.col("sections").cast(SECTION)))


def part_of(text: Column, c: Column) -> Column:
    """A chunk's part of its text."""
    return F.substring(text, c["start"] + 1, c["end"] - c["start"])


def chunk(docs: DataFrame, max_chars: int = 6000, min_chars: int = 200) -> DataFrame:
    """docs (text, sections[, page_breaks]) -> a row per chunk with chunk_no; every chunk is an exact part of the text."""
    from caretrail.functions.scalars import resolve_page

    keep = [c for c in docs.columns if c not in ("text", "sections", "page_breaks")]
    out = cut_chunks(docs, max_chars, min_chars).select("*", F.posexplode("_c").alias("chunk_no", "c"))
    pages = [resolve_page(F.col("c.start"), F.col("page_breaks")).alias("page_start"), resolve_page(F.greatest(F.col("c.start"), F.col("c.end") - 1), F.col("page_breaks")).alias("page_end")] if "page_breaks" in docs.columns else []
    return out.select(*keep, "chunk_no", "c.*", part_of(F.coalesce("text", F.lit("")), F.col("c")).alias("text"), *pages)


def chunk_input(chunks: DataFrame, docs: DataFrame, by: list[str], header: int = 1500) -> DataFrame:
    """What a model service reads: the document's head, the section line and the chunk."""
    heads = docs.select(*by, F.substring("text", 1, header).alias("_head"))
    line = F.concat(F.lit("Section: "), F.col("heading"), F.lit(" ("), F.col("sectionType"), F.lit(")"), F.when(F.col("inferredDate").isNotNull(), F.concat(F.lit(" "), F.col("inferredDate"))).otherwise(""))
    return chunks.join(heads, by).select(*by, "chunk_no", F.concat(F.lit("Document header:\n"), F.col("_head"), F.lit("\n\n"), line, F.lit("\n\n"), F.col("text")).alias("input"))


# ---- model responses ----

FENCES = "```(?:json|ndjson)?\\n?|\\n?```"


def _is(v: Column, path: str, kinds: tuple[str, ...]) -> Column:
    """Whether a field is there with one of the JSON kinds; a null field is VOID, an absent one has no schema."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).isin(*kinds), F.lit(False))


STRING, NUMBER, VOID = ("STRING",), ("BIGINT", "DOUBLE", "FLOAT"), ("VOID",)


def _number(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.coalesce(kind.isin(*NUMBER) | kind.startswith("DECIMAL"), F.lit(False))


def _text(path: str, v: str = "v") -> Column:
    return F.when(_is(F.col(v), path, STRING), F.try_variant_get(F.col(v), path, "string"))


def is_valid_provider(v: Column, at: str = "$") -> Column:
    ok = _is(v, f"{at}.name", STRING)
    for f in ("specialty", "email", "phone", "evidence"):
        ok = ok & _is(v, f"{at}.{f}", STRING + VOID)
    return ok


def is_valid_facility(v: Column, at: str = "$") -> Column:
    ok = _is(v, f"{at}.name", STRING)
    for f in ("address", "city", "state", "country"):
        ok = ok & _is(v, f"{at}.{f}", STRING + VOID)
    return ok


def is_valid_care_event(v: Column, at: str = "$") -> Column:
    kind = F.coalesce(F.try_variant_get(v, f"{at}.event_type", "string").isin(R.CARE_EVENT_TYPES), F.lit(False))
    facility = _is(v, f"{at}.facility", VOID) | is_valid_facility(v, f"{at}.facility")
    return _is(v, f"{at}.event_type", STRING) & kind & _is(v, f"{at}.date", STRING) & is_valid_provider(v, f"{at}.provider") & facility & _is(v, f"{at}.evidence", STRING + VOID)


def response_lines(responses: DataFrame, by: list[str]) -> DataFrame:
    """(by, line_no, v, type): a row per non-empty line, v null where it is no JSON."""
    lines = responses.select(*by, F.posexplode(F.split(F.regexp_replace("content", FENCES, ""), "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    v = lines.select(*by, "line_no", F.try_parse_json(F.trim("line")).alias("v"))
    return v.withColumn("type", _text("$.type"))


def parse_extraction(responses: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    """conditions, measurements, providers and facilities of the responses; lines that are none of them are skipped."""
    lines = response_lines(responses, by)
    v, of = F.col("v"), lambda kind: F.col("type") == kind
    condition = of("condition") & _is(v, "$.name_medical", STRING) & _is(v, "$.earliest_date", STRING + VOID) & _is(v, "$.notes", STRING + VOID)
    measurement = of("measurement") & _is(v, "$.name", STRING) & _number(v, "$.value_numeric") & _is(v, "$.unit", STRING) & _is(v, "$.date", STRING + VOID)
    own = lambda what, valid: F.when(valid(v, f"$.{what}"), F.try_variant_get(v, f"$.{what}.name", "string"))
    pick = lambda ok, *cols: lines.where(ok).select(*by, "line_no", *cols)
    return {
        "conditions": pick(
            condition, _text("$.name_medical").alias("name_medical"), _text("$.earliest_date").alias("earliest_date"), _text("$.notes").alias("notes"),
            own("provider", is_valid_provider).alias("provider"), own("facility", is_valid_facility).alias("facility"),
        ),
        "measurements": pick(measurement, _text("$.name").alias("name"), F.try_variant_get(v, "$.value_numeric", "double").alias("value_numeric"), _text("$.unit").alias("unit"), _text("$.date").alias("date")),
        "providers": pick(of("report_provider") & is_valid_provider(v), *[_text(f"$.{f}").alias(f) for f in ("name", "specialty", "email", "phone", "evidence")]),
        "facilities": pick(of("report_facility") & is_valid_facility(v), *[_text(f"$.{f}").alias(f) for f in ("name", "address", "city", "state", "country")]),
        "lines": lines.select(*by, "line_no", (condition | measurement | (of("report_provider") & is_valid_provider(v)) | (of("report_facility") & is_valid_facility(v))).alias("usable"), F.coalesce(condition | measurement, F.lit(False)).alias("counts")),
    }


def usable_extraction(parsed: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Per response: lines skipped, and whether it has any condition or measurement."""
    return parsed["lines"].groupBy(*by).agg(F.count_if(~F.coalesce("usable", F.lit(False))).alias("skipped"), F.bool_or("counts").alias("usable"))


def inherit_report_attribution(parsed: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Conditions take the first report provider and facility of their response where they have none of their own."""
    out = parsed["conditions"]
    for one, many in (("provider", "providers"), ("facility", "facilities")):
        first = parsed[many].groupBy(*by).agg(F.min_by("name", "line_no").alias("_first"))
        out = out.join(first, by, "left").withColumn(one, F.coalesce(one, "_first")).drop("_first")
    return out


def extraction_outcome(chunks: DataFrame, usable: DataFrame, doc: list[str], by: list[str]) -> DataFrame:
    """Per document: chunks in all and chunks that succeeded; failed only where none did."""
    joined = chunks.join(usable.select(*by, "usable"), by, "left")
    return joined.groupBy(*doc).agg(F.count("*").alias("n_chunks"), F.count_if(F.coalesce("usable", F.lit(False))).alias("n_ok")).withColumn("failed", F.col("n_ok") == 0)


def parse_anatomy(responses: DataFrame, by: list[str]) -> DataFrame:
    """A row per condition index, the last valid line counting; a bad coordinate only empties itself."""
    from caretrail.functions.scalars import sanitize_coordinate

    lines = response_lines(responses, by)
    v = F.col("v")
    ok = _number(v, "$.index") & F.coalesce(_text("$.system").isin(R.SYSTEMS), F.lit(False)) & F.coalesce(_text("$.status").isin([s for s in R.STATUSES if s != "inferred"]), F.lit(False))
    for f in ("organ", "anatomical_location", "laterality", "name_common"):
        ok = ok & _is(v, f"$.{f}", STRING + VOID)
    xy = lambda f: F.when(_number(v, f"$.{f}"), sanitize_coordinate(F.try_variant_get(v, f"$.{f}", "double"))).alias(f)
    rows = lines.where(ok).select(*by, "line_no", F.try_variant_get(v, "$.index", "int").alias("index"), F.struct(*[_text(f"$.{f}").alias(f) for f in ("system", "status", "organ", "anatomical_location", "laterality", "name_common")], xy("cx"), xy("cy")).alias("a"))
    return rows.groupBy(*by, "index").agg(F.max_by("a", "line_no").alias("a")).select(*by, "index", "a.*")


def parse_dedupe_groups(responses: DataFrame, by: list[str]) -> DataFrame:
    """(index, group) lines; the last one per index counts."""
    v = F.col("v")
    rows = response_lines(responses, by).where(_number(v, "$.index") & _number(v, "$.group"))
    rows = rows.select(*by, "line_no", F.try_variant_get(v, "$.index", "int").alias("index"), F.try_variant_get(v, "$.group", "int").alias("group"))
    return rows.groupBy(*by, "index").agg(F.max_by("group", "line_no").alias("group"))


def parse_structure(responses: DataFrame, docs: DataFrame, by: list[str]) -> DataFrame:
    """Sections of each document; where the response is unusable or has none, one section 'Full record'."""
    v = F.try_parse_json(F.regexp_replace("content", "```(?:json)?\\n?|\\n?```", ""))
    r = responses.select(*by, v.alias("v"))
    items = F.try_variant_get(F.col("v"), "$.sections", "array<variant>")
    # strict on headings and offsets, lenient on the rest
    strict = F.forall(items, lambda s: _is(s, "$.heading", STRING) & _number(s, "$.startOffset") & _number(s, "$.endOffset"))
    ok = F.coalesce(_text("$.organization").isin(R.ORGANIZATIONS), F.lit(False)) & F.coalesce(strict, F.lit(False)) & (F.size(items) > 0)
    section = lambda s: F.struct(
        F.try_variant_get(s, "$.heading", "string").alias("heading"),
        F.try_variant_get(s, "$.startOffset", "int").alias("startOffset"),
        F.when(_is(s, "$.inferredDate", STRING), F.try_variant_get(s, "$.inferredDate", "string")).alias("inferredDate"),
        F.coalesce(F.when(F.try_variant_get(s, "$.sectionType", "string").isin(R.SECTION_TYPES), F.try_variant_get(s, "$.sectionType", "string")), F.lit("other")).alias("sectionType"),
        F.coalesce(F.try_variant_get(s, "$.imageWorthy", "boolean"), F.lit(False)).alias("imageWorthy"),
    )
    parsed = r.where(ok).select(*by, F.transform(items, section).cast(SECTION).alias("_s"), _text("$.documentDate").alias("document_date"))
    full = F.array(F.struct(F.lit("Full record").alias("heading"), F.lit(0).alias("startOffset"), F.lit(None).cast("string").alias("inferredDate"), F.lit("other").alias("sectionType"), F.lit(False).alias("imageWorthy"))).cast(SECTION)
    return docs.join(parsed, by, "left").withColumn("sections", F.coalesce("_s", full)).drop("_s")


def parse_longitudinal(responses: DataFrame, by: list[str]) -> DataFrame:
    """Whole-document JSON, version 1: a row per condition with its provider (own or the report's), the number of care
    events (one more for the report's facility where provider and date are known and no event names it), and provenance."""
    v = F.col("v")
    r = responses.select(*by, F.try_parse_json("content").alias("v")).where(F.coalesce(F.try_variant_get(v, "$.schema_version", "int") == 1, F.lit(False)))
    first = lambda what, valid: F.get(F.filter(F.try_variant_get(v, f"$.report_context.{what}", "array<variant>"), lambda x: valid(x)), F.lit(0))
    r = r.select(*by, F.try_variant_get(v, "$.conditions", "array<variant>").alias("cs"), F.try_variant_get(v, "$.measurements", "array<variant>").alias("ms"), first("providers", is_valid_provider).alias("rp"), first("facilities", is_valid_facility).alias("rf"))
    r = r.where("cs IS NOT NULL AND ms IS NOT NULL").select(*by, "rp", "rf", F.posexplode("cs").alias("index", "c"))
    c = F.col("c")
    text = lambda x, path: F.when(_is(x, path, STRING), F.try_variant_get(x, path, "string"))
    own, rp, rf = text(c, "$.provider.name"), text(F.col("rp"), "$.name"), text(F.col("rf"), "$.name")
    provider, date = F.coalesce(own, rp), F.coalesce(text(c, "$.date_diagnosed"), text(c, "$.date_onset"))
    events = F.coalesce(F.try_variant_get(c, "$.care_events", "array<variant>"), F.array().cast("array<variant>"))
    named = F.exists(events, lambda e: F.coalesce(text(e, "$.facility.name") == rf, F.lit(False)))
    attributed = provider.isNotNull() & rf.isNotNull() & date.isNotNull()
    notes = F.array_compact(F.array(F.when(own.isNull() & rp.isNotNull(), "provider:report_context"), F.when(attributed, "facility:report_context")))
    return r.select(*by, "index", text(c, "$.name_medical").alias("name_medical"), provider.alias("provider"), date.alias("date"), (F.size(events) + F.when(attributed & ~named, 1).otherwise(0)).cast("long").alias("n_care_events"), F.array_join(notes, ",").alias("provenance"))


PERSON = {"name": "string", "specialty": "string", "email": "string", "phone": "string", "evidence": "string"}
PLACE = {"name": "string", "address": "string", "city": "string", "state": "string", "country": "string"}
_struct = lambda fields: "struct<" + ",".join(f"{n}:{t}" for n, t in fields.items()) + ">"
LOCATION = {"anatomical_location": "string", "laterality": "string", "cx": "double", "cy": "double", "evidence": "string"}
EVENT = {"event_type": "string", "date": "string", "provider": _struct(PERSON), "facility": _struct(PLACE), "evidence": "string"}
#: The fields of a condition in a whole-document answer, with their types; a field of another type counts as absent.
CONDITION = {
    **{f: "string" for f in ("id", "name_medical", "name_common", "system", "organ", "anatomical_location", "status", "severity", "certainty", "date_onset", "date_diagnosed", "evidence", "notes")},
    "local_names": "map<string,string>", "cx": "double", "cy": "double", "providers": f"array<{_struct(PERSON)}>", "facilities": f"array<{_struct(PLACE)}>",
    "locations": f"array<{_struct(LOCATION)}>", "source_pages": "array<int>", "inferred_from_structure": "array<string>",
}
MEASUREMENT = {"name": "string", "value_numeric": "double", "unit": "string", "date": "string", "reference_low": "double", "reference_high": "double", "flag": "string"}


def parse_longitudinal_full(responses: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    """Whole-document JSON, version 1, with every field: conditions (with `provider`, `care_events` and `provenance` as
    parse_longitudinal counts them), measurements, and the report's own providers and facilities. `by` names no field of theirs."""
    v = F.col("v")
    r = responses.select(*by, F.try_parse_json("content").alias("v")).where(F.coalesce(F.try_variant_get(v, "$.schema_version", "int") == 1, F.lit(False)))
    items = lambda path: F.try_variant_get(v, path, "array<variant>")
    r = r.where(items("$.conditions").isNotNull() & items("$.measurements").isNotNull())
    value = lambda x, f, kind: F.try_variant_get(x, f"$.{f}", kind).alias(f)
    whole = lambda x, fields: F.when(x.isNotNull(), F.struct(*[value(x, f, t) for f, t in fields.items()])).cast(_struct(fields))
    own = {"providers": (is_valid_provider, PERSON), "facilities": (is_valid_facility, PLACE)}
    valid = {what: _valid(items(f"$.report_context.{what}"), ok, fields, whole) for what, (ok, fields) in own.items()}
    x = F.col("x")
    rows = r.select(*by, F.get(valid["providers"], F.lit(0)).alias("_rp"), F.get(valid["facilities"], F.lit(0)).alias("_rf"), F.posexplode(items("$.conditions")).alias("index", "x"))
    mine = whole(F.when(~F.coalesce(F.is_variant_null(F.try_variant_get(x, "$.provider", "variant")), F.lit(True)), F.try_variant_get(x, "$.provider", "variant")), PERSON)
    rows = rows.select(*by, "index", *[value(x, f, t) for f, t in CONDITION.items()], mine.alias("_own"), F.coalesce(F.try_variant_get(x, "$.care_events", f"array<{_struct(EVENT)}>"), F.array().cast(f"array<{_struct(EVENT)}>")).alias("_events"), F.try_variant_get(x, "$.provenance", "array<string>").alias("_said"), "_rp", "_rf")
    provider, date = F.coalesce("_own", "_rp"), F.coalesce("date_diagnosed", "date_onset")
    attributed = provider.isNotNull() & F.col("_rf").isNotNull() & date.isNotNull()
    named = F.exists("_events", lambda e: F.coalesce(e["facility"]["name"] == F.col("_rf.name"), F.lit(False)))
    added = F.struct(F.lit("other").alias("event_type"), date.alias("date"), provider.alias("provider"), F.col("_rf").alias("facility"), F.lit(None).cast("string").alias("evidence"))
    notes = F.array_compact(F.array(F.when(F.col("_own").isNull() & F.col("_rp").isNotNull(), "provider:report_context"), F.when(attributed, "facility:report_context")))
    conditions = rows.select(
        *by, "index", *CONDITION, provider.alias("provider"), F.when(attributed & ~named, F.array_append("_events", added)).otherwise(F.col("_events")).alias("care_events"),
        F.when(F.size(notes) > 0, F.array_distinct(F.concat(F.coalesce("_said", F.array().cast("array<string>")), notes))).otherwise(F.col("_said")).alias("provenance"),
    )
    measured = r.select(*by, F.posexplode(items("$.measurements")).alias("index", "x")).select(*by, "index", *[value(x, f, t) for f, t in MEASUREMENT.items()])
    listed = {what: r.select(*by, F.posexplode(valid[what]).alias("index", "x")).select(*by, "index", "x.*") for what in own}
    return {"conditions": conditions, "measurements": measured, **listed}


def _valid(items: Column, ok, fields: dict[str, str], whole) -> Column:
    """Those of a list of variants that are valid, as structs."""
    return F.transform(F.filter(items, lambda x: ok(x)), lambda x: whole(x, fields))
