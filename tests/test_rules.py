"""Rule tables against the fixed rules, compiled and joined; the extraction stage under failures."""

import pytest
from pyspark.sql import functions as F

from caretrail.operators import extraction as X
from caretrail.operators import rule_tables as T
from caretrail.operators import rules, text
from caretrail.operators import views as V


def test_fixed_rules_as_a_table(spark):
    names = ["Type 2 diabetes", "a mole (left arm)", "Stroke and skin rash", "EBV", "nothing", "", None, "Ovarian cyst"]
    df = spark.createDataFrame([(i, n, "skin" if i % 2 else None) for i, n in enumerate(names)], "id int, name_medical string, notes string")
    want = {r.id: r.system for r in T.classify(df).collect()}
    for compiled in (0, 200):
        assert {r.id: r.system for r in T.classify(df, T.keyword_rules(spark), compiled=compiled).collect()} == want


@pytest.mark.parametrize("compiled", [0, 200])
def test_terms_and_patterns_by_rank(spark, compiled):
    rows = [(3, "kid", None, "late"), (1, "Kidney", None, "first"), (2, None, "^gut|colon$", "pattern"), (0, "", None, "never"), (0, None, None, "never"), (2, "colon", None, "b"), (9, "é", None, "accent")]
    table = spark.createDataFrame(rows, "rank int, term string, pattern string, system string")
    df = spark.createDataFrame([("a KIDNEY",), ("kids",), ("the colon",), ("gut",), ("",), (None,), ("CAFÉ",), ("kids",)], "t string").withColumn("extra", F.lit(1))
    got = sorted((r.t or "", r.found, r.extra) for r in T.first_match(df, F.col("t"), table, "system", "none", "found", compiled).collect())
    assert got == sorted([("a KIDNEY", "first", 1), ("kids", "late", 1), ("the colon", "b", 1), ("gut", "pattern", 1), ("", "none", 1), ("", "none", 1), ("CAFÉ", "accent", 1), ("kids", "late", 1)])
    none = T.first_match(df, F.col("t"), table.limit(0), "system", "none", "found", compiled)
    assert {r.found for r in none.collect()} == {"none"}


def test_too_many_patterns_are_refused(spark):
    table = spark.range(T.PATTERNS + 1).select(F.col("id").alias("rank"), F.col("id").cast("string").alias("pattern"), F.lit("x").alias("system"))
    with pytest.raises(ValueError, match="rules"):
        T.first_match(spark.createDataFrame([("1",)], "t string"), F.col("t"), table, "system", "none", "found")


def test_threshold_tables(spark):
    m = spark.createDataFrame([(1, 1, "HbA1c", 6.0, "%", None), (1, 2, "LDL", 170.0, "mg/dL", None), (2, 1, "Ferritin ", 5.0, "ng", None), (2, 2, "ferritin", 500.0, "ng", None), (2, 3, "ferritin", None, "ng", None)], "record_id int, seq int, name string, value_numeric double, unit string, date string")
    known = spark.createDataFrame([(1, "x")], "record_id int, name_medical string")
    by_default = rules.infer_conditions(m, known).select("record_id", "seq", "code").collect()
    assert sorted(tuple(r) for r in by_default) == [(1, 1, "prediabetes"), (1, 2, "hyperlipid")]
    assert sorted(tuple(r) for r in rules.infer_conditions(m, known, rules=rules.threshold_rules(spark)).select("record_id", "seq", "code").collect()) == [(1, 1, "prediabetes"), (1, 2, "hyperlipid")]
    own = spark.createDataFrame([(1, 1, True, "ferritin", None, None, False, "<", 15.0, "iron", "Ferritin", " ", "(low)"), (2, 1, True, "ferritin", None, None, False, ">", 300.0, "load", "Ferritin", " ", "(high)")], T.THRESHOLD)
    for compiled in (0, 200):
        out = rules.infer_conditions(m, known, rules=own, compiled=compiled).collect()
        assert sorted((r.seq, r.code, r.name_medical, r.evidence) for r in out) == [(1, "iron", "iron", "Ferritin 5 ng (low)"), (2, "load", "load", "Ferritin 500 ng (high)")]


def test_redaction_rules_from_a_table(spark):
    table = spark.createDataFrame([(2, "[B]", "bc"), (1, "[A]", "ab"), (3, "[C]", "c")], "rank int, replacement string, pattern string")
    docs = spark.createDataFrame([("abc",), (None,)], "text string")
    assert {r.text for r in text.redact(docs, table).collect()} == {"[A][C]", None}


def test_extraction_tries_again(spark):
    class Busy(Exception):
        status = 429

    def model(inputs, attempt):
        if inputs.iloc[0] == "busy" and attempt == 1:
            raise Busy("later")
        if inputs.iloc[0] == "short":
            return []
        return [None if x == "null" else x.upper() if attempt > 1 or x != "slow" else "bad" for x in inputs]

    prompts = spark.createDataFrame([(i, t) for i, t in enumerate(["fine", "slow", "busy", "null", "short", None])], "id int, input string").withColumn("attempt", F.lit("clash"))
    log = X.extract(prompts, ["id"], model, lambda a: a != "bad", attempts=2, batch=1, model="m")
    got = {}
    for r in sorted(log.collect(), key=lambda r: r.attempt):
        got.setdefault(r.id, []).append((r.http_status, r.content))
    assert got == {0: [(200, "FINE")], 1: [(422, "bad"), (200, "SLOW")], 2: [(429, None), (200, "BUSY")], 3: [(422, None)] * 2, 4: [(500, None)] * 2, 5: [(200, "")]}
    assert {r.content for r in X.answers(log, ["id"]).collect()} == {"FINE", "SLOW", "BUSY", ""}
    outcomes = {r.call_id: (r.outcome, r.n_attempts) for r in V.call_outcome(X.call_log(log, ["id"])).collect()}
    assert outcomes == {"0": ("ok", 1), "1": ("ok", 2), "2": ("degraded", 2), "3": ("exhausted", 2), "4": ("exhausted", 2), "5": ("ok", 1)}
    assert X.extract(prompts.limit(0), ["id"], model).count() == 0


def test_extraction_batches(spark):
    sizes = X.extract(spark.range(10).coalesce(1).select("id", F.lit("x").alias("input")), ["id"], lambda inputs, attempt: [str(len(inputs))] * len(inputs), batch=4)
    assert sorted(r.content for r in sizes.collect()) == ["2"] * 2 + ["4"] * 8
