"""Chat formatting by schema fingerprints.

A record is a JSON text or a struct. The nested paths of its fields, with the kind of each (text, list or object), are hashed;
the hash selects a declarative mapping that turns the record's layout into canonical turns. A JSON text is fingerprinted with
its long strings cut short and is read with no limit on the length of a string; the paths of a struct come from its type, a
null field being absent, so a table with the fields of many layouts side by side is read row by row. The turns are written in
a template whose control strings cannot occur in a text.

A layout matches by the hash of the paths that it names: below the top, fields of other names do not count (a turn may have a
name, a part an image). Where a text is in some turns a list of parts, its kind is VARIANT, and layouts with `mixed` read both.

Defined cases: a record that is null, no JSON object (one that repeats a key is none), or of an unknown layout has layout null
and no turns, and unmatched() counts it; where two layouts fit, the earlier one of the list is taken; fields named in IGNORED
do not count at the top of a record, any other field there does; numbers and truth values count as text; a null role, name or text counts as
empty; turns keep their order; conversations of no turns give the empty formatted text; further columns of the input are kept
in `row`. In from_turns() rows of one conversation are ordered by turn, then role, then text, and a null conv_id is a
conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretrail.llm.common import hex_digest, table, text_of

TURN = "struct<role:string,text:string>"

#: Names that some layouts use for the canonical roles.
ROLE_ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant"}
#: Fields that a record of any layout may have besides.
IGNORED = ["id", "conv_id", "source", "lang", "meta", "metadata", "created", "score"]

#: Known layouts. `list` is the path of an array of turns, with the paths of its role and text (`text` may name an array of
#: parts; `mixed` names the text of a part where text and parts are mixed); `fields` has a text field's path per turn, "+" going on in the turn before. Paths go down by dots, [] means a list.
LAYOUTS = [
    {"name": "messages", "list": "messages", "role": "role", "text": "content", "mixed": "text"},
    {"name": "message-parts", "list": "messages", "role": "role", "text": "content[].text"},
    {"name": "turns", "list": "turns", "role": "role", "text": "text"},
    {"name": "conversations", "list": "conversations", "role": "from", "text": "value", "aliases": ROLE_ALIASES},
    {"name": "data-messages", "list": "data.messages", "role": "role", "text": "content", "mixed": "text"},
    {"name": "prompt", "fields": [("prompt", "user"), ("completion", "assistant")]},
    {"name": "prompt-response", "fields": [("prompt", "user"), ("response", "assistant")]},
    {"name": "prompt-object", "fields": [("prompt.text", "user"), ("response.text", "assistant")]},
    {"name": "data-prompt", "fields": [("data.prompt", "user"), ("data.completion", "assistant")]},
    {"name": "question", "fields": [("question", "user"), ("answer", "assistant")]},
    {"name": "instruction", "fields": [("instruction", "user"), ("output", "assistant")]},
    {"name": "instruction-input", "fields": [("instruction", "user"), ("input", "+"), ("output", "assistant")]},
    {"name": "system-prompt", "fields": [("system", "system"), ("prompt", "user"), ("response", "assistant")]},
]
#: Control strings of the template.
START, MIDDLE, END = "<|start|>", "<|text|>", "<|end|>"
#: Characters of a string that a fingerprint looks at: none beyond so many are needed to tell a text from a list or object.
SHORT = 64


# ---- layouts and fingerprints ----


def paths_of(layout: dict) -> list[str]:
    """The leaves of a layout, as paths from the top."""
    if "list" in layout:
        return [f"{layout['list']}[].{x}" for x in (layout["role"], layout["text"])]
    return [name for name, _ in layout["fields"]]


def _tree(paths: list[str]) -> dict:
    """Nested names -> sub-tree; a name ends in [] where it is a list; {} is a text."""
    top: dict = {}
    for path in paths:
        at = top
        for name in path.split("."):
            at = at.setdefault(name, {})
    return top


def _ddl(tree: dict) -> str:
    kind = lambda name, sub: (f"array<{_ddl(sub) if sub else 'string'}>" if name.endswith("[]") else _ddl(sub)) if sub or name.endswith("[]") else "string"
    return "struct<" + ",".join(f"`{name.removesuffix('[]')}`:{kind(name, sub)}" for name, sub in tree.items()) + ">"


def _kind(t: T.DataType) -> str:
    """The nested paths below a field of that type, in the words of schema_of_variant()."""
    if isinstance(t, T.VariantType):
        return "VARIANT"
    if isinstance(t, T.ArrayType):
        return f"ARRAY<{_kind(t.elementType)}>"
    if isinstance(t, T.StructType):
        return "OBJECT<" + ", ".join(f"{f.name}: {_kind(f.dataType)}" for f in sorted(t.fields, key=lambda f: f.name)) + ">"
    return "STRING"


def layout_type(layout: dict, mixed: bool = False) -> T.StructType:
    ddl = _ddl(_tree(paths_of(layout)))
    return T._parse_datatype_string(ddl.replace(f"`{layout['text']}`:string", f"`{layout['text']}`:variant") if mixed else ddl)


def _names(layout: dict) -> list[str]:
    """The names that a layout has below the top."""
    return sorted({n.removesuffix("[]") for path in paths_of(layout) for n in path.split(".")[1:]})


def _fields_text(kind: T.StructType) -> str:
    return "\n".join(sorted(f"{f.name} {_kind(f.dataType)}" for f in kind.fields))


def fingerprint_of(layout: dict) -> Column:
    return F.sha2(F.lit(_fields_text(layout_type(layout))), 256)


def _mixed_fingerprints(layout: dict) -> list[Column]:
    """Hashes of the layout where texts and lists of parts, or parts and texts in one list, are mixed."""
    text, plain = layout["text"], _fields_text(layout_type(layout))
    return [F.sha2(F.lit(plain.replace(f"{text}: STRING", f"{text}: {kind}")), 256) for kind in ("VARIANT", "ARRAY<VARIANT>")]


def _only(fields: Column, names: list[str]) -> Column:
    """The fields with those names below the top; kinds are nested to eight levels at most."""
    if not names:
        return fields
    body = "[^<>]"
    for _ in range(8):
        body = f"(?:[^<>]|<{body}*+>)"
    kind = body.replace("[^<>]", "[^<>,]", 1)
    other = f"(?<=<|, )(?!(?:{'|'.join(names)}): )[^:<>,]++: {kind}++(?:, |(?=>))"
    return F.transform(fields, lambda f: F.replace(F.regexp_replace(f, other, ""), F.lit(", >"), F.lit(">")))


def _json_fields(record: Column) -> Column:
    """Sorted "field kind" texts of a JSON object, down to its leaves; null if it is none."""
    atom = "(?:\\\\u[0-9a-fA-F]{4}|\\\\.|[^\"\\\\])"
    short = F.regexp_replace(record, f'("{atom}{{0,{SHORT}}}+){atom}*+"', '$1"')
    fields = F.map_entries(F.try_parse_json(short).try_cast("map<string,variant>"))
    plain = "(?<=^|: |ARRAY<)(?:VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\\([0-9]+,[0-9]+\\))"
    kind = lambda v: F.coalesce(F.regexp_replace(F.schema_of_variant(v), plain, "STRING"), F.lit("STRING"))
    return F.array_sort(F.transform(F.filter(fields, lambda e: ~e["key"].isin(IGNORED)), lambda e: F.concat(e["key"], F.lit(" "), kind(e["value"]))))


def _struct_fields(record: Column, kind: T.StructType) -> Column:
    """The same for a struct: its type's paths, but for null fields."""
    fields = [f for f in sorted(kind.fields, key=lambda f: f.name) if f.name not in IGNORED]
    return F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(record.getField(f.name).isNotNull(), f"{f.name} {_kind(f.dataType)}") for f in fields]))


# ---- turns ----


def _at(value: Column, path: str) -> Column:
    """The text at a path below a struct; the texts of a list are put together."""
    name, _, rest = path.partition(".")
    if name.endswith("[]"):
        items = value.getField(name[:-2])
        return F.array_join(F.transform(items, lambda x: _at(x, rest)) if rest else items, "")
    return _at(value.getField(name), rest) if rest else value.getField(name).cast("string")


def _role(role: Column, aliases: dict[str, str]) -> Column:
    out = F.coalesce(role, F.lit(""))
    for name, canonical in aliases.items():
        out = F.when(role == name, canonical).otherwise(out)
    return out


def _mixed_text(value: Column, name: str) -> Column:
    """A text, or the texts of a list of parts put together; a part may be a text itself."""
    is_a = lambda v, kind: F.schema_of_variant(v).startswith(kind)
    part = lambda p: F.when(is_a(p, "OBJECT"), F.try_variant_get(p, f"$.{name}", "string")).otherwise(p.try_cast("string"))
    parts = F.array_join(F.transform(value.try_cast("array<variant>"), part), "")
    return F.when(is_a(value, "ARRAY"), parts).when(is_a(value, "OBJECT"), part(value)).otherwise(value.try_cast("string"))


def _mapped(layout: dict, record: Column, mixed: bool = False) -> Column:
    """The turns of a struct of that layout."""
    if "list" in layout:
        items = record
        for name in layout["list"].split("."):
            items = items.getField(name)
        said = lambda x: _mixed_text(x.getField(layout["text"]), layout["mixed"]) if mixed else _at(x, layout["text"])
        turn = lambda x: F.struct(_role(_at(x, layout["role"]), layout.get("aliases", {})).alias("role"), F.coalesce(said(x), F.lit("")).alias("text"))
        return F.coalesce(F.transform(items, turn), F.array().cast(f"array<{TURN}>"))
    turns: list[list[Column]] = []
    roles: list[str] = []
    for path, role in layout["fields"]:
        if role == "+":  # goes on in the turn before
            turns[-1].append(F.nullif(_at(record, path), F.lit("")))
        else:
            roles.append(role)
            turns.append([F.coalesce(_at(record, path), F.lit(""))])
    return F.array(*[F.struct(F.lit(r).alias("role"), F.concat_ws("\n\n", *t).alias("text")) for r, t in zip(roles, turns, strict=True)])


def canonical_turns(records: DataFrame, record_col: str = "record", layouts=None) -> DataFrame:
    """(row, fingerprint, layout, turns, paths) for records that are JSON texts or structs; the fingerprint is that of all
    paths, a null for what is no object."""
    layouts = LAYOUTS if layouts is None else layouts
    kind = records.schema[record_col].dataType
    rows = records.select(F.struct("*").alias("row"), F.col(f"`{record_col}`").alias("_record"))
    record = F.col("_record")
    nested = isinstance(kind, T.StructType)
    rows = rows.withColumn("_fields", F.when(record.isNotNull(), _struct_fields(record, kind)) if nested else _json_fields(record))
    fields = F.col("_fields")
    hash_of = lambda f: F.sha2(F.array_join(f, "\n"), 256)
    kinds = ["|".join(_names(x)) for x in layouts]
    rows = rows.withColumns({f"_hash{kinds.index(k)}": hash_of(_only(fields, [n for n in k.split("|") if n])) for k in set(kinds)})
    layout, turns = F.lit(None).cast("string"), F.array().cast(f"array<{TURN}>")
    for x, k in reversed(list(zip(layouts, kinds, strict=True))):
        if nested and not all(f.name in kind.names for f in layout_type(x).fields):
            continue  # no row of this table can have the layout
        hashed = F.col(f"_hash{kinds.index(k)}")
        cases = [(hashed == fingerprint_of(x), False)] if not nested or _fits(kind, layout_type(x)) else []
        if "mixed" in x and not nested:
            cases.append((hashed.isin(_mixed_fingerprints(x)), True))
        for hit, mixed in cases:
            value = record if nested else F.from_json(record, layout_type(x, mixed), {"maxStringLen": str((1 << 31) - 1)})
            layout = F.when(hit, x["name"]).otherwise(layout)
            turns = F.when(hit, _mapped(x, value, mixed)).otherwise(turns)
    return rows.select("row", hash_of(fields).alias("fingerprint"), layout.alias("layout"), turns.alias("turns"), F.array_join(fields, "\n").alias("paths"))


def _fits(kind: T.DataType, want: T.DataType) -> bool:
    """A column of that type has the paths wanted: further fields do not matter, any other atom counts as text."""
    if isinstance(want, T.ArrayType):
        return isinstance(kind, T.ArrayType) and _fits(kind.elementType, want.elementType)
    if isinstance(want, T.StructType):
        return isinstance(kind, T.StructType) and all(f.name in kind.names and _fits(kind[f.name].dataType, f.dataType) for f in want.fields)
    return not isinstance(kind, (T.ArrayType, T.StructType, T.VariantType))


def unmatched(done: DataFrame) -> DataFrame:
    """(fingerprint, paths, n_records) of the records whose layout is unknown; both are null for what is no object."""
    return done.where("layout IS NULL").groupBy("fingerprint", "paths").agg(F.count("*").alias("n_records"))


def from_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> (conv_id, record), a struct of the layout `turns` for each conversation."""
    turn = F.struct(F.col("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    slim = F.transform("_turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return grouped.select("conv_id", F.struct(slim.alias("turns")).alias("record"))


# ---- the template ----


def escape(text: Column) -> Column:
    """No '<' and no '[' is left, so that no control string of this template or of the usual others can occur."""
    for plain, escaped in (("\\", "\\0"), ("<", "\\1"), ("[", "\\2")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in (("<", "\\1"), ("[", "\\2"), ("\\", "\\0")):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def running_sums(lengths: Column) -> Column:
    """Sums up to each element, by doubling steps: each pass adds the element 1, 2, 4... places before; 30 passes at most."""
    one = F.array(F.transform(lengths, lambda n: n.cast("long")))

    def add(k: int):
        return lambda a: F.when(F.size(a) > k, F.transform(a, lambda x, i: x + F.coalesce(F.get(a, i - k), F.lit(0)))).otherwise(a)

    for step in range(30):
        one = F.transform(one, add(1 << step))
    return F.get(one, F.lit(0))


def format_chat(turns: DataFrame) -> DataFrame:
    """Adds `formatted` and `loss_spans`: for each assistant turn (by number) the code points [start, end) of its text."""
    piece = lambda x: F.concat(F.lit(START), escape(x["role"]), F.lit(MIDDLE), escape(x["text"]), F.lit(END))
    out = turns.withColumn("_pieces", F.transform("turns", piece))
    out = out.withColumn("_ends", running_sums(F.transform("_pieces", lambda p: F.length(p))))
    end = lambda i: F.get("_ends", i) - len(END)
    span = lambda x, i: F.struct((end(i) - F.length(escape(x["text"]))).alias("start"), end(i).alias("end"), i.alias("turn"))
    spans = F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", span(x, i))), lambda s: s.isNotNull())
    return out.withColumn("loss_spans", spans).withColumn("formatted", F.array_join("_pieces", "")).drop("_pieces", "_ends")


def _pieces(formatted: Column) -> Column:
    """The formatted turns, without their start marks."""
    return F.filter(F.split(formatted, F.lit("<\\|start\\|>"), -1), lambda p: p != "")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    return F.transform(
        _pieces(formatted),
        lambda p: F.struct(
            unescape(F.substring_index(p, MIDDLE, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, MIDDLE, -1), END, 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the spans, each cut from its own turn's piece, so that long conversations are read once."""
    one = F.array(F.struct(_pieces(formatted).alias("p"), running_sums(F.transform(_pieces(formatted), lambda p: F.length(p) + len(START))).alias("e")))

    def cut(x: Column, s: Column) -> Column:
        piece = F.get(x["p"], s["turn"])
        begin = F.get(x["e"], s["turn"]) - F.length(piece)
        return unescape(F.substring(piece, (s["start"] - begin + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    return F.get(F.transform(one, lambda x: F.array_join(F.transform(spans, lambda s: cut(x, s)), "")), F.lit(0))


def op5_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    done = format_chat(canonical_turns(from_turns(rows.unionByName(added))))
    back = done.select(F.col("row.conv_id").alias("conv_id"), "formatted", read_back(F.col("formatted")).alias("back"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "layout")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        hex_digest(F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        hex_digest(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


#: The layouts that op5_layouts writes, by conv_id; "mixed" are messages with texts and parts.
WRITTEN = [x["name"] for x in LAYOUTS] + ["mixed"]


def _as_json(layout: str) -> Column:
    """The conversation's turns `t` as a record of that layout. Layouts of two texts hold the first turn and all others."""
    first, rest = F.coalesce(F.get("t", F.lit(0))["text"], F.lit("")), F.array_join(F.transform(F.slice("t", F.lit(2), F.size("t")), lambda x: x["text"]), "\n")
    if layout == "mixed":
        part = lambda x: F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text")))
        one = lambda x, i: F.when(i % 2 == 0, F.to_json(F.struct(x["role"].alias("role"), x["text"].alias("content")))).otherwise(F.to_json(F.struct(x["role"].alias("role"), part(x).alias("content"))))
        return F.concat(F.lit('{"messages":['), F.array_join(F.transform("t", one), ","), F.lit("]}"))
    x = next(y for y in LAYOUTS if y["name"] == layout)
    if "list" in x:
        name, _, below = x["text"].partition("[].")
        said = lambda v: F.array(F.struct(v.alias(below), F.lit("text").alias("type"))) if below else v
        out = F.transform("t", lambda v: F.struct(v["role"].alias(x["role"]), said(v["text"]).alias(name), F.struct(v["role"].alias("name")).alias("author")))
        for name in reversed(x["list"].split(".")):
            out = F.struct(out.alias(name))
        return F.to_json(out)
    texts = iter([F.lit("s"), first, rest] if x["name"] == "system-prompt" else [first, rest, rest] if len(x["fields"]) == 3 else [first, rest])
    tops: dict[str, list[Column]] = {}
    for path, _ in x["fields"]:
        top, _, below = path.partition(".")
        tops.setdefault(top, []).append(next(texts).alias(below or top))
    nested = {path.partition(".")[0] for path, _ in x["fields"] if "." in path}
    return F.to_json(F.struct(*[(F.struct(*c) if top in nested else c[0]).alias(top) for top, c in tops.items()]))


def op5_layouts(spark, sf_dir: str) -> DataFrame:
    """All conversations, each written as JSON in one of all layouts (with further fields in the turns), read back."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    t = from_turns(rows).select("conv_id", F.col("record.turns").alias("t"))
    record = F.lit(None).cast("string")
    for k, name in enumerate(WRITTEN):
        record = F.when(F.pmod("conv_id", F.lit(len(WRITTEN))) == k, _as_json(name)).otherwise(record)
    done = canonical_turns(t.select("conv_id", record.alias("record")))
    digest = hex_digest(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""))
    return done.select(F.col("row.conv_id").alias("conv_id"), "layout", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"))


_AT = {name: k for k, name in enumerate(WRITTEN)}
_LISTS = [_AT[x["name"]] for x in LAYOUTS if "list" in x] + [_AT["mixed"]]
OP5_LAYOUTS_SQL = f"""
WITH r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
g AS (
  SELECT conv_id, conv_id % {len(WRITTEN)} AS m, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
    max(text) FILTER (k = 1) AS a, coalesce(string_agg(text, chr(10) ORDER BY k) FILTER (k > 1), '') AS b FROM r GROUP BY conv_id)
SELECT conv_id, ({WRITTEN[:-1] + ["messages"]})[m + 1] AS layout,
  CASE WHEN m IN ({", ".join(map(str, _LISTS))}) THEN n WHEN m = {_AT["system-prompt"]} THEN 3 ELSE 2 END::BIGINT AS n_turns,
  sha256(CASE WHEN m IN ({", ".join(map(str, _LISTS))}) THEN turns
    ELSE (CASE WHEN m = {_AT["system-prompt"]} THEN 'system' || chr(10) || 's' || chr(10) ELSE '' END) || 'user' || chr(10) || a
      || (CASE WHEN m = {_AT["instruction-input"]} AND b <> '' THEN CASE WHEN a = '' THEN b ELSE chr(10) || chr(10) || b END ELSE '' END)
      || chr(10) || 'assistant' || chr(10) || b || chr(10) END) AS turns_sha256
FROM g
"""

OP5_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')))::BIGINT AS formatted_chars,
  'turns' AS layout
FROM r GROUP BY conv_id
"""
