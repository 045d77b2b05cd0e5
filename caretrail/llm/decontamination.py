"""Benchmark decontamination by a prefix-filtered containment join.

A benchmark item's windows (ten consecutive words, or the whole item if shorter) are sets of three-word shingles. A text that
contains a window contains its rarest shingle, so that one is the window's necessary prefix. The texts are cut into words once.
That pass asks a bit filter, which has no misses and a bounded size, for the shingles that are some item's; it keeps their
hashes, and with their words the stretches of them that are long enough for a window. The kept hashes' corpus counts give the
order of rarity; the stretches' places join the windows' prefixes; the window's offset and length bound the place, and the
words are compared. The plan is the same at every size of the benchmark, and Spark picks each join's kind.

Defined cases: null texts and texts without words have n_words 0 and no hits; items without words have no windows; an empty
benchmark or an empty table gives no hits or no rows; equal windows of several items count for each of the items; repeated
rows are judged each for itself; further columns are ignored. item_ids are compared and joined as strings; a null one counts
as the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import bit_filter, hex_digest, lower_ascii, materialize, table, text_of

WINDOW = 10
SHINGLE = 3
GAP_RE = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def item_words(text: Column) -> Column:
    """Lower-cases A-Z, then cuts at every ASCII character that is no letter or digit."""
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(lower_ascii(text))
    return F.array_remove(F.split(plain, GAP_RE, -1), "")


def benchmark_windows(benchmark: DataFrame, id_col="item_id", text_col="text") -> DataFrame:
    """(words, len, items): each distinct window with the items that hold it."""
    w = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), item_words(text_of(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    w = w.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, WINDOW))).alias("words"))
    return w.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("words"))


def shingle_hashes(words: Column | str, q: int) -> Column:
    """The hash of the q words at each place that has so many."""
    words = F.col(words) if isinstance(words, str) else words
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - q), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(q)]))
    return F.when(F.size(words) >= q, hashes).otherwise(F.array().cast("array<bigint>"))


def shingles_of(windows: DataFrame) -> DataFrame:
    """Adds (q, least, off, token) for every shingle of a window: its size, SHINGLE or the whole of a shorter window, and how
    many in a row the windows of the kind (whole ones, shorter ones) have at least."""
    kinds = windows.withColumn("q", F.least("len", F.lit(SHINGLE))).withColumn("full", F.col("len") == WINDOW)
    least = kinds.groupBy("q", "full").agg((F.min("len") - F.first("q") + 1).alias("least"))
    kinds = kinds.join(least, ["q", "full"]).drop("full")
    hashes = F.coalesce(*[F.when(F.col("q") == q, shingle_hashes("words", q)) for q in range(SHINGLE, 0, -1)])
    return kinds.select("*", F.posexplode(hashes).alias("off", "token"))


def with_stretches(rows: DataFrame, shingles: DataFrame) -> DataFrame:
    """rows with words w -> adds `tokens`, the hashes that pass the filters as (q, least, token), and `stretches`, the words
    (at, words) of those at least `least` places long."""
    kinds = shingles.groupBy("q", "least").agg(F.count_distinct("token").alias("n")).orderBy("q", "least").collect()  # four kinds at most
    tokens, stretches = [], []
    for j, k in enumerate(kinds):
        passes = bit_filter(shingles.where((F.col("q") == k.q) & (F.col("least") == k.least)).select("token").distinct(), k.n)
        places = F.transform(shingle_hashes("w", k.q), lambda t, i: F.struct(i.alias("i"), t.alias("token")))
        rows = rows.withColumn(f"_h{j}", F.filter(places, lambda x: passes(x["token"])))  # noqa: B023
        hits = F.col(f"_h{j}")
        # a hit is inside a long enough stretch if one of the `least` stretches around it is without a gap
        whole = lambda a: F.coalesce(F.get(hits, a + (k.least - 1))["i"] - F.get(hits, a)["i"] == k.least - 1, F.lit(False))  # noqa: B023, E731
        begins = F.transform(hits, lambda x, a: whole(a))  # noqa: B023
        rows = rows.withColumn(f"_b{j}", begins)
        inside = lambda a: F.exists(F.slice(F.col(f"_b{j}"), F.greatest(a - (k.least - 2), F.lit(1)), F.least(a + 1, F.lit(k.least))), lambda b: b)  # noqa: B023, E731
        rows = rows.withColumn(f"_k{j}", F.transform(F.filter(hits, lambda x, a: inside(a)), lambda x: x["i"]))  # noqa: B023
        kept = F.col(f"_k{j}")
        edge = lambda step: F.filter(kept, lambda x, a: ~F.coalesce((a + step >= 0) & (F.get(kept, a + step) == x + step), F.lit(False)))  # noqa: B023, E731
        rows = rows.withColumn(f"_s{j}", F.arrays_zip(edge(-1).alias("a"), edge(1).alias("b")))
        words = lambda x: F.struct(F.lit(k.q).alias("q"), F.lit(k.least).alias("least"), x["a"].alias("at"), F.slice("w", x["a"] + 1, x["b"] - x["a"] + k.q).alias("words"))  # noqa: B023, E731
        stretches.append(F.transform(f"_s{j}", words))
        tokens.append(F.transform(hits, lambda x: F.struct(F.lit(k.q).alias("q"), F.lit(k.least).alias("least"), x["token"].alias("token"))))  # noqa: B023
    return rows.withColumns({"tokens": F.concat(*tokens), "stretches": F.concat(*stretches)})


def find_items(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items), one row per input row; text_key is the text's xxhash64."""
    text = text_of(text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), item_words(text).alias("w"))
    shingles = materialize(shingles_of(benchmark_windows(benchmark)), "benchmark-shingles")
    if shingles.isEmpty():
        return rows.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    slim = with_stretches(rows, shingles).select("rid", "doc_id", "text_key", F.size("w").cast("long").alias("n_words"), "tokens", "stretches")
    slim = materialize(slim, "benchmark-stretches")
    # order of rarity: the corpus counts of the items' shingles
    kind = ["q", "least", "token"]
    counts = slim.select(F.explode("tokens").alias("t")).groupBy(*[f"t.{c}" for c in kind]).agg(F.count("*").alias("n"))
    ranked = shingles.join(counts, kind, "left").groupBy("words", "len", "items", "q", "least")
    prefixes = materialize(ranked.agg(F.min_by(F.struct("off", "token"), F.struct(F.coalesce("n", F.lit(0)), "off")).alias("p")).select("words", "len", "items", "q", "least", "p.off", "p.token"), "benchmark-prefixes")
    runs = slim.where(F.size("stretches") > 0).select("rid", F.explode("stretches").alias("s")).select("rid", "s.q", "s.least", "s.at", F.col("s.words").alias("ctx"))
    hashes = F.coalesce(*[F.when(F.col("q") == q, shingle_hashes("ctx", q)) for q in range(SHINGLE, 0, -1)])
    places = runs.select("*", F.posexplode(hashes).alias("i", "token"))
    start = F.col("i") - F.col("off")
    met = (
        places.join(prefixes, kind)
        .where((start >= 0) & (start + F.col("len") <= F.size("ctx")))
        .where(F.slice("ctx", start + 1, F.col("len")) == F.col("words"))
        .select("rid", F.struct((F.col("at") + start).alias("s"), (F.col("at") + start + F.col("len")).alias("e")).alias("span"), "items")
    )
    by_row = met.groupBy("rid").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    state = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    hit = F.aggregate(
        "spans",
        state,
        lambda a, x: F.struct(F.greatest(a["to"], x["e"]).alias("to"), (a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["to"]), F.lit(0))).cast("long").alias("n")),
        lambda a: a["n"],
    )
    by_row = by_row.select("rid", hit.alias("n_hit"), "items")
    return slim.join(by_row, "rid", "left").select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        hex_digest(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM v),
p AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM d, n WHERE len(w) >= n)),
m AS (SELECT doc_id, s, p.n, item FROM p JOIN v ON p.n = v.n AND p.g = v.g),
h AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
