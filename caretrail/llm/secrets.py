"""Secret scans: credentials in texts, and multipart credentials whose parts confirm each other.

Strong finds stand alone (assigned secrets, access keys, long hex runs). Weak candidates (an assigned account name or a
short access key, a random-looking token, an endpoint) are reported only where a complementary part lies within `scope` code
points before or after: an account needs a secret, a token needs an account or an endpoint, an endpoint needs both an account
and a secret. A part confirms only what it does not overlap, and text that is an account's is no secret besides.
The scopes are joined to the parts as intervals: parts are summed up per cell of `scope` code points (least and greatest start
and end of each kind of part). A candidate meets the two cells before it and the two after it; as a cell is as wide as the
scope, the figures decide exactly whether a part ends there in reach before it or starts there in reach after it. No pairs are
made, however many parts a cell holds.

Defined cases: a null text is empty; an empty or clean text has a row with no spans; each input row is scanned for itself,
also if its doc_id is null or repeated; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caretrail.llm.common import hex_digest, materialize, table, text_of

#: How far complementary parts may be apart, in code points.
SCOPE = 200

ASSIGN = "(?i:(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?)([A-Za-z0-9+/_.=-]+)"
#: kind, part, strong, pattern, what a match must hold. The first three are the base; their order is the order of kinds.
KINDS = [
    ("assign", "secret", True, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    ("access", "access", True, "AKIA[A-Z0-9]{16,}", None),
    ("hex", "secret", True, "(?<![0-9a-f])[0-9a-f]{24,}", None),
    ("weak_access", "access", False, "(?i:(?:user(?:name)?|login|client_?id|account)[\"']?\\x20*[:=]\\x20*[\"']?)[A-Za-z0-9@._-]{3,}|AKIA[A-Z0-9]{8,15}(?![A-Z0-9])", None),
    ("weak_secret", "secret", False, "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")),
    ("endpoint", "endpoint", False, "(?i:https?://)[^\\x20\\x09-\\x0D\"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?![0-9.])", None),
]


def _part(rank: int, gaps: Column, holds):
    return lambda m, i: F.struct(
        F.lit(rank).alias("rank"),
        i.alias("idx"),
        F.get(gaps, i).alias("gap"),
        F.length(m).alias("len"),
        (F.lit(True) if holds is None else holds(m)).alias("holds"),
    )


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, parts): every match of every kind, with the gap before it; one pass over the texts."""
    out = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    out = out.select("rid", "doc_id", "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, _, _, p, _ in KINDS])
    found = []
    for rank, (kind, _, _, pattern, holds) in enumerate(KINDS):
        gaps = F.transform(F.split("text", F.lit(pattern), -1), lambda g: F.length(g))
        out = out.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, gaps))
        found.append(F.transform(f"m_{kind}", _part(rank, F.col(f"g_{kind}"), holds)))
    return out.select("rid", "doc_id", F.concat(*found).alias("parts"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, spans): spans are structs start, rank, kind, end, in order; one row per input row."""
    slim = materialize(find_parts(docs, id_col, text_col), "secret-parts")
    rows = slim.select("rid", F.explode("parts").alias("p")).select("rid", "p.*")
    run = Window.partitionBy("rid", "rank").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    kinds = F.array(*[F.lit(k[1]) for k in KINDS])
    strong = F.array(*[F.lit(k[2]) for k in KINDS])
    rows = (
        rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run))
        .where("holds")
        .select(
            "rid", "rank", (F.col("end") - F.col("len")).alias("start"), "end", F.get(names, "rank").alias("kind"), F.get(kinds, "rank").alias("part"), F.get(strong, "rank").alias("strong")
        )
    )
    # a secret's characters that are an account's as well: an account that starts no later ends inside, or one starts inside
    by_start = Window.partitionBy("rid").orderBy("start")
    access = F.col("part") == "access"
    reached = F.max(F.when(access, F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    begun = F.min(F.when(access, F.col("start"))).over(by_start.rangeBetween(0, Window.unboundedFollowing))
    shared = (F.col("part") == "secret") & (F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(begun < F.col("end"), F.lit(False)))
    rows = materialize(rows.withColumn("shared", shared), "secret-rows")
    parts, cell = ("access", "secret", "endpoint"), lambda c: F.floor(F.col(c) / scope)
    evidence, weak = rows.where("NOT shared"), rows.where("NOT strong AND NOT shared")

    def figures(at: str, out: str) -> DataFrame:
        """Least and greatest `at` of each kind of part, per cell."""
        sums = [f(F.when(F.col("part") == p, F.col(at))).alias(f"{name}_{p}") for p in parts for f, name in ((F.min, "least"), (F.max, "most"))]
        return evidence.groupBy("rid", cell(at).alias("cell")).agg(*sums).withColumn("side", F.lit(out))

    sides = figures("end", "before").unionByName(figures("start", "after"))
    reach = weak.withColumn(
        "at",
        F.explode(
            F.array(
                *[F.struct(F.lit("before").alias("side"), (cell("start") - k).alias("cell"), F.lit(k).alias("step")) for k in (0, 1)],
                *[F.struct(F.lit("after").alias("side"), (cell("end") + k).alias("cell"), F.lit(k).alias("step")) for k in (0, 1)],
            )
        ),
    ).select("rid", "rank", "kind", "part", "start", "end", "at.side", "at.cell", "at.step")

    def near(p: str):
        own = F.when(F.col("side") == "before", F.col(f"least_{p}") <= F.col("start")).otherwise(F.col(f"most_{p}") >= F.col("end"))
        next_ = F.when(F.col("side") == "before", F.col(f"most_{p}") > F.col("start") - scope).otherwise(F.col(f"least_{p}") < F.col("end") + scope)
        return F.coalesce(F.when(F.col("step") == 0, own).otherwise(next_), F.lit(False))

    met = (
        reach.join(sides, ["rid", "side", "cell"])
        .groupBy("rid", "rank", "kind", "part", "start", "end")
        .agg(*[F.max(near(p)).alias(f"has_{p}") for p in parts])
        .where(
            ((F.col("part") == "access") & F.col("has_secret"))
            | ((F.col("part") == "secret") & (F.col("has_access") | F.col("has_endpoint")))
            | ((F.col("part") == "endpoint") & F.col("has_access") & F.col("has_secret"))
        )
    )
    every = rows.where("strong").select("rid", "rank", "kind", "start", "end").unionByName(met.select("rid", "rank", "kind", "start", "end"))
    spans = every.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return slim.select("rid", "doc_id").join(spans, "rid", "left").withColumn("spans", F.coalesce(F.col("spans"), none))


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        hex_digest(written(F.filter("spans", lambda s: s["rank"] < 3))).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
