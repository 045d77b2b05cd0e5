"""Queries on odd and grown tables: repeated and missing documents, plans that must not put a large side into the driver."""

import random
import re

import duckdb
import pandas as pd
from compare import same
from pyspark.sql import functions as F

from caretrail.llm import near_text, simhash
from caretrail.operators import rule_tables as T
from caretrail.operators import text
from caretrail.plans import catalog
from caretrail.sources import backup_files, store
from caretrail.streaming import jobs


def test_chunk_cover_of_repeated_and_null_documents(spark, tmp_path):
    long = "\n\n".join(f"line {i} " + "x" * (i * 37 % 400) for i in range(60))
    rows = [(1, long), (1, long), (1, "another text\nof the same id"), (2, None), (3, ""), (4, "王\n😀\n" * 900), (None, "no id"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.QUERIES["chunk_cover"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same(out, con, catalog.SQL["chunk_cover"])


def test_replicated_fingerprints_are_not_broadcast(spark):
    prints = spark.range(500).select(F.xxhash64("id").alias("fp"), (F.col("id") % 7).alias("group"))
    for rows in (prints, prints.drop("group")):
        plan = simhash.near_links(rows)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
    pairs = spark.range(500).select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 300)).alias("b"))
    texts = spark.range(900).select(F.col("id").alias("text_key"), F.lit(b"x" * 312).alias("minima"))
    plan = near_text.likely(pairs, texts)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan[plan.rindex("BroadcastExchange") :] if "BroadcastExchange" in plan else True


def test_thresholds_join_a_step_a_value(spark):
    rng = random.Random(11)
    bounds = [0.0, 1.0, 2.0, 3.5, 5.0, float("nan"), None]
    make = lambda i: (rng.choice([None, *range(12)]), i, False, rng.choice(["a", "b"]), None, rng.choice([None, None, "male", "female"]), rng.random() < 0.3, rng.choice([">=", ">", "<", "<=", "?"]), rng.choice(bounds), rng.choice("xyz"), rng.choice(["L", "M", None]), " ", f"({i % 5})")
    table = spark.createDataFrame([make(i) for i in range(150)], T.THRESHOLD)
    values = [None, float("nan"), -1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 3.5, 4.0, 5.0, 9.0]
    m = spark.createDataFrame([(i, rng.choice(["A ", "b", "c"]), rng.choice(values), rng.choice(["mg/dL", "mmol/L", None]), rng.choice(["male", "female", ""])) for i in range(400)], "seq int, name string, value_numeric double, unit string, sex string")
    got = sorted(map(str, T.threshold_hits(m.withColumn("k", F.lit(1)), table, ["k"], F.col("sex"), 0).collect()))
    r, v = table.alias("r"), F.when(F.col("r.in_mg"), T.S.to_mg_dl(F.col("value_numeric"), F.col("unit"))).otherwise(F.col("value_numeric"))
    b, op = F.col("r.bound"), F.col("r.op")
    holds = F.when(op == ">=", v >= b).when(op == ">", v > b).when(op == "<", v < b).when(op == "<=", v <= b) & (F.col("r.sex").isNull() | (F.col("r.sex") == F.col("m.sex")))
    said = F.concat("label", F.lit(" "), T.S.js_number(F.col("value_numeric")), "gap", "unit", F.lit(" "), "note")
    every = m.alias("m").join(r, (F.lower(F.trim("m.name")) == F.col("r.pattern")) & holds).groupBy("seq").agg(F.min(F.struct("rank", "code", said.alias("evidence"))).alias("h"))
    assert got == sorted(map(str, every.select(F.lit(1).alias("k"), "seq", "h.code", "h.evidence").collect()))
    many = spark.range(20_000).select(*[(F.lit(x) if not isinstance(x, str) else F.expr(x)).alias(c) for c, x in {"rank": "int(20000 - id)", "pattern": "'a'", "sex": "cast(null as string)", "in_mg": "false", "op": "'>='", "bound": "double(id % 50)", "code": "'x'", "label": "'L'", "gap": "' '", "note": "string(id)"}.items()])
    assert T.threshold_steps(many).count() <= 50


def test_names_are_found_as_their_patterns_would(spark):
    rng = random.Random(7)
    for _ in range(4000):
        pick = lambda n: "".join(rng.choice("aAbB.-_ 王é1ſK") for _ in range(n))
        name, body = pick(rng.randint(1, 4)), pick(rng.randint(0, 30))
        latin = bool(re.search("[A-Za-z]", name))
        pattern = rf"(?ai:\b{re.escape(name)}\b)" if latin else re.escape(name)
        want = [m.span() for m in re.finditer(pattern, body)] if len(name) >= (3 if latin else 2) else []
        assert list(text.name_spans(body, text.ascii_lower(body), name)) == want


def test_a_batch_reads_its_documents_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(x: pd.Series) -> pd.Series:
        read.add(len(x))
        return x

    docs = spark.range(30).select(F.col("id").alias("record_id"), F.concat(F.lit("note "), F.col("id").cast("string")).alias("text")).repartition(3).withColumn("text", counted("text"))
    said = '{"type":"condition","name_medical":"Asthma","earliest_date":null,"notes":null}\n{"type":"report_provider","name":"Dr. A","specialty":null,"email":null,"phone":null,"evidence":null}'
    answers = spark.range(30).select(F.col("id").alias("record_id"), F.lit(0).alias("chunk_no"), F.lit(said).alias("content"))
    jobs.upsert_batch(jobs.record_job(answers)(docs), 0, str(tmp_path), "conditions", ["record_id", "condition_key"])
    assert jobs.read_snapshot(spark, str(tmp_path), "conditions").where("provider_name = 'Dr. A'").count() == 30
    assert read.value == 30


def test_conditions_come_from_one_pass_over_the_lines(spark):
    """Each line of the orders is joined and numbered once, however often a query reads its conditions."""
    scans = lambda df: len(re.findall(r"Relation \[[^]]*l_linenumber", df._jdf.queryExecution().optimizedPlan().toString()))
    for name, most in (("condition_view", 1), ("place_conditions", 1), ("place_first", 1), ("place_masked", 1), ("timeline", 1), ("read_store", 0), ("validate_backup", 0), ("date_overrides", 0), ("snap_to_nearest", 0)):
        assert scans(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")) <= most, name


def test_further_providers_need_no_shuffle(spark, tmp_path):
    people = [{"name": n, "email": e} for n, e in (("A", None), ("A", ""), (None, "x"), ("B", "b"), ("C", None), ("B", "b"), ("D", None))]
    events = [{"event_type": "treated", "date": "2020-01-01", "provider": {"name": "C"}}, {"event_type": "treated", "date": None, "provider": {"name": "B", "email": "b"}}]
    rows = [(1, 1, "c1", 1, "Asthma", {"name": "D"}, people, events), (1, 1, "c2", 2, "Gout", None, people, None), (1, 1, "c3", 3, "Rash", None, None, None)]
    kind = "patient_id long, record_id long, condition_id string, seq long, name_medical string, provider struct<name:string,email:string>, providers array<struct<name:string,email:string>>, care_events array<struct<event_type:string,date:string,provider:struct<name:string,email:string>>>"
    e = spark.createDataFrame(rows, kind)
    providers = store.normalize(e, e.select("condition_id", F.lit(1.0).alias("cx"), F.lit(2.0).alias("cy")), "2024-01-01")["providers"]
    plan = providers._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    got = sorted(r.id for r in providers.collect())
    assert got == sorted(["c1-care-0-provider", "c1-provider", "c1-provider-extra-0", "c1-provider-extra-2", "c2-provider-extra-0", "c2-provider-extra-2", "c2-provider-extra-3", "c2-provider-extra-5"])


def test_backups_are_packed(spark, tmp_path):
    envelope = '{"app": "x", "stores": {"conditions": [' + ",".join(['{"name": "Asthma", "note": null}'] * 2000) + "]}}"
    backup_files.write_backup(spark.createDataFrame([(envelope,)], "envelope string"), f"{tmp_path}/b")
    assert sum(f.stat().st_size for f in tmp_path.glob("b/part*")) < len(envelope) / 10
    assert [r.envelope for r in backup_files.read_backup(spark, f"{tmp_path}/b").collect()] == [envelope]
