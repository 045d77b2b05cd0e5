"""Queries of the rule tables, read from the given tables, and of the extraction stage."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from caretrail.operators import extraction as X
from caretrail.operators import rule_tables as T
from caretrail.operators import rules, text
from caretrail.operators import views as V
from caretrail.plans.bindings import base, bind, view_sql
from caretrail.plans.merge_queries import _JS, _sexed
from caretrail.sources.shared import written

C = F.col


def _part_rules(spark, sf):
    """A keyword rule a part: a piece of its name, in order of the parts."""
    at = 1 + C("p_partkey") % 4
    return base(spark, sf, "part").select(C("p_partkey").alias("rank"), F.substring("p_name", at, 3 + C("p_partkey") % 3).alias("term"), C("p_type").alias("system"))


def _nation_rules(spark, sf):
    return base(spark, sf, "nation").select(C("n_nationkey").alias("rank"), F.concat(F.chr(97 + (C("n_nationkey") * 7) % 26), F.chr(97 + (C("n_nationkey") * 3) % 26)).alias("term"), C("n_name").alias("system"))


def classify_by_rules(spark, sf):
    """Terms under as many rules as there are parts, joined."""
    return T.classify(bind(spark, sf, "terms"), _part_rules(spark, sf), "name", "notes", "found", compiled=0).select("id", "found")


def classify_by_few_rules(spark, sf):
    """Terms under the nations' rules, compiled."""
    return T.classify(bind(spark, sf, "terms"), _nation_rules(spark, sf), "name", "notes", "found").select("id", "found")


def _part_thresholds(spark, sf):
    names = F.array(*[F.lit(n) for n in ("ldl cholesterol", "total cholesterol", "hgb", "egfr", "hba1c")])
    return base(spark, sf, "part").select(
        C("p_partkey").cast("int").alias("rank"), C("p_partkey").cast("int").alias("family"), F.lit(False).alias("exclusive"), F.get(names, (C("p_partkey") % 5).cast("int")).alias("pattern"), F.lit(None).cast("string").alias("but_not"),
        F.when(C("p_partkey") % 3 == 0, "male").alias("sex"), F.lit(False).alias("in_mg"), F.when(C("p_partkey") % 2 == 0, "<").otherwise(">=").alias("op"), (C("p_size") * 4).cast("double").alias("bound"),
        F.concat(F.lit("part-"), (C("p_partkey") % 20).cast("string")).alias("code"), F.lit("Value").alias("label"), F.lit(" ").alias("gap"), F.concat(F.lit("(part "), C("p_partkey").cast("string"), F.lit(")")).alias("note"),
    )


def infer_by_rules(spark, sf):
    """Conditions inferred by a rule a part, whose names come from a table too; known ones by a table of terms."""
    results = base(spark, sf, "part").where("p_partkey < 15").select(F.concat(F.lit("part-"), C("p_partkey").cast("string")).alias("code"), C("p_name").alias("name_medical"), C("p_brand").alias("name_common"), C("p_type").alias("system"), F.lit(None).cast("string").alias("organ"))
    known = base(spark, sf, "nation").where("n_nationkey < 20").select(F.concat(F.lit("part-"), C("n_nationkey").cast("string")).alias("code"), F.when(C("n_nationkey") % 2 == 0, "Asthma").otherwise("CKD").alias("term"))
    out = rules.infer_conditions(bind(spark, sf, "measurements"), bind(spark, sf, "known_conditions"), _sexed(spark, sf), rules=_part_thresholds(spark, sf), results=results, documented=known, compiled=0)
    return out.select("record_id", "seq", "code", "evidence", "name_medical", "name_common", "system")


def _read_diagnosis(inputs, attempt):
    """A stand-in for a model: the diagnosis and the date of birth of each input, with answers that a check has to reject."""
    out = []
    for x in inputs:
        found, date = re.search("Diagnosis: (.*)", x), re.search("DOB: ([0-9-]+)", x)
        broken = len(x) % 11 == 0 or attempt <= len(x) % 3
        out.append("no answer" if broken else '{"type":"condition","name_medical":"%s","earliest_date":"%s","notes":null}' % (found[1], date[1]))  # noqa: UP031
    return out


def extract_chunks(spark, sf):
    """Notes to chunks to prompts to answers to conditions, with what the calls came to."""
    by = ["record_id", "chunk_no"]
    notes = bind(spark, sf, "clinical_notes").select("record_id", "text", F.lit(None).cast(text.SECTION).alias("sections"))
    prompts = text.chunk_input(text.chunk(notes), notes, ["record_id"])
    log = written(X.extract(prompts, by, _read_diagnosis, lambda a: a.startswith("{")), "attempts")
    said = text.parse_extraction(X.answers(log, by), by)["conditions"]
    calls = V.call_outcome(X.call_log(log, by)).select("call_id", "outcome", "n_attempts")
    keyed = said.select(F.concat_ws(":", *[C(c).cast("string") for c in by]).alias("call_id"), "name_medical", "earliest_date")
    return calls.join(keyed, "call_id", "left").select("call_id", "outcome", "n_attempts", "name_medical", "earliest_date")


QUERIES = {f.__name__: f for f in (classify_by_rules, classify_by_few_rules, infer_by_rules, extract_chunks)}

_TEXTS = view_sql("terms") + ", t AS (SELECT id, lower(concat(coalesce(name, ''), ' ', coalesce(notes, ''))) AS text FROM terms)"
SQL = {
    "classify_by_rules": _TEXTS + """, r AS (SELECT p_partkey AS rank, lower(substr(p_name, (1 + p_partkey % 4)::INT, (3 + p_partkey % 3)::INT)) AS term, p_type AS system FROM part)
 SELECT id, coalesce(arg_min(system, rank), 'skeletal') AS found FROM t LEFT JOIN r ON term <> '' AND contains(text, term) GROUP BY id""",
    "classify_by_few_rules": _TEXTS + """, r AS (SELECT n_nationkey AS rank, concat(chr((97 + n_nationkey * 7 % 26)::INT), chr((97 + n_nationkey * 3 % 26)::INT)) AS term, n_name AS system FROM nation)
 SELECT id, coalesce(arg_min(system, rank), 'skeletal') AS found FROM t LEFT JOIN r ON contains(text, term) GROUP BY id""",
    "infer_by_rules": view_sql("measurements", "known_conditions") + f""", m AS (SELECT *, lower(trim(name)) AS n, {_JS} AS j, CASE WHEN record_id % 2 = 0 THEN 'male' ELSE 'female' END AS sex FROM measurements),
r AS (SELECT p_partkey AS rank, ['ldl cholesterol', 'total cholesterol', 'hgb', 'egfr', 'hba1c'][(p_partkey % 5 + 1)::INT] AS term, p_partkey % 3 = 0 AS male, p_partkey % 2 = 0 AS below, p_size * 4 AS bound, concat('part-', p_partkey % 20) AS code FROM part),
h AS (SELECT m.record_id, m.seq, arg_min(r.code, rank) AS code, concat('Value ', any_value(j), ' ', any_value(unit), ' (part ', min(rank), ')') AS evidence FROM m JOIN r ON n = term AND (NOT male OR sex = 'male') AND CASE WHEN below THEN value_numeric < bound ELSE value_numeric >= bound END GROUP BY ALL),
k AS (SELECT DISTINCT record_id, concat('part-', n_nationkey) AS code FROM known_conditions JOIN nation ON n_nationkey < 20 AND contains(lower(name_medical), CASE WHEN n_nationkey % 2 = 0 THEN 'asthma' ELSE 'ckd' END))
SELECT record_id, seq, h.code, evidence, coalesce(p_name, h.code) AS name_medical, coalesce(p_brand, h.code) AS name_common, p_type AS system
FROM h LEFT JOIN part ON h.code = concat('part-', p_partkey) AND p_partkey < 15 WHERE (record_id, h.code) NOT IN (SELECT (record_id, code) FROM k)""",
    "extract_chunks": view_sql("clinical_notes") + """, i AS (SELECT record_id, text, length(text) * 2 + length('Document header:') + length('Section:  (other)') + 5 AS n FROM clinical_notes)
SELECT concat(record_id, ':0') AS call_id, CASE WHEN n % 11 = 0 THEN 'exhausted' ELSE 'ok' END AS outcome, (CASE WHEN n % 11 = 0 THEN 3 ELSE 1 + n % 3 END)::BIGINT AS n_attempts,
 CASE WHEN n % 11 > 0 THEN 'Hypertension' END AS name_medical, CASE WHEN n % 11 > 0 THEN regexp_extract(text, 'DOB: ([0-9-]+)', 1) END AS earliest_date FROM i""",
}
