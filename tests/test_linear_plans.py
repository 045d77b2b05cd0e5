"""Offsets, contact lines and names that contain one another, against plain forms."""

import random

from pyspark.sql import functions as F

from caretrail.operators import text, views


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_offsets_at_random(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        cuts = sorted(rng.sample(range(200), 2 * rng.randint(0, 12)))
        edits = [(a, b, "x" * rng.randint(0, 9)) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        rows.append((i, [rng.choice([None, *range(210)]) for _ in range(rng.randint(0, 15))], edits))
    df = spark.createDataFrame(rows, "i int, offsets array<int>, edits array<struct<start:int,end:int,replacement:string>>")
    want = {i: [o if o is None else o + sum(len(r) - (b - a) for a, b, r in edits if b <= o) for o in offsets] for i, offsets, edits in rows}
    assert {r.i: r.m for r in df.select("i", text.remap_offsets(F.col("offsets"), F.col("edits")).alias("m")).collect()} == want
    bare = spark.createDataFrame([([3, 1], None), (None, [])], df.select("offsets", "edits").schema)
    assert [r.m for r in bare.select(text.remap_offsets(F.col("offsets"), F.col("edits")).alias("m")).collect()] == [[3, 1], None]


def test_many_offsets(spark):
    n = 20_000
    df = spark.range(1).select(F.expr(f"sequence(0, {2 * n})").alias("o"), F.expr(f"transform(sequence(0, {n - 1}), i -> struct(2 * i AS start, 2 * i + 1 AS end, 'abc' AS replacement))").alias("e"))
    moved = df.select(text.remap_offsets(F.col("o"), F.col("e")).alias("m")).first().m
    assert moved == [o + 2 * ((o + 1) // 2) for o in range(2 * n + 1)]


def test_contact_lines_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "Attending: Dr. Ann Lee\r\nfloor 2\nann@x.example\nPhysician: Bob Ray\n\n\nbob@x.example"), (2, None), (3, ""), (4, "\n" * 3000 + "Provider Cy Fox, 555-010-1234")], "id int, text string")
    out = text.provider_contacts(docs, ["id"])
    assert "Exchange" not in plan(out) and "Window" not in plan(out)
    assert [(r.id, r.line_no, r.email, r.phone is not None) for r in sorted(out.collect())] == [(1, 0, "ann@x.example", False), (4, 3000, None, True)]


def test_names_within_names(spark):
    rng = random.Random(3)
    name = lambda: rng.choice([None, "王", "", " ".join(rng.choice(["Ann", "Bo", "Cy", "Lee", "An"]) for _ in range(rng.randint(1, 3)))])
    providers = [(r, n, name(), None, None, None) for r in range(40) for n in range(rng.randint(0, 6))]
    contacts = [(r, n, name(), f"{r}-{n}", None, None) for r in range(40) for n in range(rng.randint(0, 5))]
    p = spark.createDataFrame(providers, "record_id int, provider_no int, name string, email string, phone string, evidence string")
    c = spark.createDataFrame(contacts, "record_id int, contact_no int, name string, email string, phone string, evidence string")
    key = lambda df: {r.name: r.k for r in df.select("name", views.S.contact_name_key(F.col("name")).alias("k")).distinct().collect()}
    pk, ck = key(p), key(c)
    want = {}
    for r, n, who, *_ in providers:
        own = [x for x in contacts if x[0] == r]
        met = [x for x in own if x[2] is not None and pk[who] is not None and (ck[x[2]] in pk[who] or pk[who] in ck[x[2]])]
        at = [x for x in own if x[1] == n]
        want[r, n] = (met[0] if met else own[0] if len(own) == 1 else at[0] if at else [None] * 4)[3]
    out = views.rehydrate_contacts(p, c)
    assert {(r.record_id, r.provider_no): r.email for r in out.collect()} == want
