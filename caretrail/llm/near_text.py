"""Near-duplicates by the Jaccard similarity of word shingles, from SimHash anchors and bands of minima.

Candidates come in three steps; each candidate is decided by the exact similarity of the two texts' shingles.

1. Texts that share a bucket: one of BANDS bands of ROWS minima of the shingles' hashes, so that a pair of similarity s shares
   none with probability (1 - s ** ROWS) ** BANDS (2e-8 at 0.8). Each text is compared with the heaviest of its buckets' hubs (a
   bucket's hub is the text whose buckets hold most others), so a group of thousands costs a comparison a text.
2. Texts of different components whose fingerprints are equal or differ in two bits at most, which meet at their anchors (see
   simhash). Similarity 0.8 means about ten differing bits, so these are only some of the links.
3. Where a bucket's texts are in different components, they are open. Open texts of different components that agree in two
   neighbouring minima are compared, unless more than COMMON open texts agree in those two: such keys come from what a template
   gives to all its pages. Texts of which more than DOMINATED keys are that common have little of their own; they are compared
   with each other within their buckets, in blocks of BLOCK texts, where the shingles that others of them have too are enough for
   the similarity (exact: what a text has alone cannot count). Either way pairs whose minima agree in fewer than LEAST_AGREE
   places are left out (one of similarity 0.8 is lost with probability 2e-6). The rule is the same at every size and no bucket
   is capped. A pair of similarity 0.8 of which a template is two thirds shares no other key with probability 3e-6; one that is
   similar by the template alone is lost with probability 1e-3 at most, if it is not linked by step 1, which compares such texts
   with their hub. Comparisons are COMMON times the keys of the open texts at most, but for texts of which a template is more
   than about four fifths.

Defined cases: null and wordless texts are one text without words; fewer words than a shingle make one shingle; A-Z count as
lower case; equal texts share a group; shingles and texts are compared by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretrail.llm import simhash
from caretrail.llm.common import materialize, shuffled, text_of, with_passes
from caretrail.llm.components import connected_components

SHINGLE = 5
BANDS, ROWS = 26, 3
BLOCK = 1024
#: Keys that more open texts have are common; texts with more common keys, of BANDS * ROWS / 2, are compared within their buckets.
COMMON, DOMINATED = 64, 24
#: Of BANDS * ROWS minima, so many agree at least at similarity 0.8, but for 2 pairs in a million (binomial tail).
LEAST_AGREE = 45
SEED = 42
PRINTS = T.StructType().add("fp", T.LongType()).add("buckets", T.ArrayType(T.LongType())).add("minima", T.BinaryType())


def minima(hashes: np.ndarray) -> np.ndarray:
    """For each of BANDS * ROWS multiply-and-add hashes its least value over the shingles."""
    rng = np.random.default_rng(SEED)
    a, b = (rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, False) | np.uint64(1) for _ in range(2))
    out = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        out = np.minimum(out, (a * (part ^ part >> np.uint64(31)) + b).min(axis=1))
    return out


@F.pandas_udf(PRINTS)
def prints(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Fingerprint, buckets and the minima's upper halves of each text."""
    from xxhash import xxh64_intdigest as digest

    for part in texts:
        fp, buckets, packed = [], [], []
        for t in part:
            every = simhash.shingle_hashes(t.encode("utf-8", "surrogatepass"), SHINGLE)
            m = minima(np.unique(every))
            fp.append(simhash.fingerprint(every))
            buckets.append(np.array([digest(x.tobytes(), k) for k, x in enumerate(m.reshape(BANDS, ROWS))], np.uint64).view(np.int64))
            packed.append((m >> np.uint64(32)).astype("<u4").tobytes())
        yield pd.DataFrame({"fp": np.array(fp, np.int64), "buckets": buckets, "minima": packed})


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingles(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The distinct shingle hashes of each text."""
    for part in texts:
        yield pd.Series([np.unique(simhash.shingle_hashes(t.encode("utf-8", "surrogatepass"), SHINGLE)).view(np.int64) for t in part])


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def fingerprint_pairs(placed: DataFrame) -> DataFrame:
    """(text_key, fp, component) -> pairs of texts of different components with fingerprints two bits apart at most: one for
    each two components that a fingerprint, or two near ones, are in."""
    heads = materialize(placed.groupBy("fp", F.col("component").alias("group")).agg(F.min("text_key").alias("head")), "near-fingerprints")
    first = heads.groupBy("fp").agg(F.min("head").alias("first"))
    same = heads.join(first, "fp").where("head <> first").select(*_pair("head", "first"))
    links = simhash.near_links(heads.select("fp", "group"))
    of = lambda c: heads.select(F.col("fp").alias(c), F.col("group").alias(f"{c}_group"), F.col("head").alias(f"{c}_key"))
    return same.unionByName(links.join(of("a"), ["a", "a_group"]).join(of("b"), ["b", "b_group"]).select(*_pair("a_key", "b_key")))


def hub_pairs(shared: DataFrame) -> DataFrame:
    """(text_key, bucket, n) -> each text with the heaviest of its buckets' hubs."""
    weight = shared.groupBy("text_key").agg(F.sum("n").alias("weight"))
    hubs = shared.join(weight, "text_key").groupBy("bucket").agg(F.max(F.struct("weight", "text_key")).alias("hub"))
    best = shared.join(hubs, "bucket").where(F.col("text_key") != F.col("hub.text_key")).groupBy("text_key").agg(F.max("hub").alias("best"))
    return best.select(*_pair("text_key", "best.text_key"))


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links).withColumnRenamed("node", "text_key")


def _agreeing(queries: pd.DataFrame, members: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of a block of queries and one of members that are in different components, whose minima agree often enough, and
    whose shingles that other texts have are enough for the similarity."""
    found = {"a": [], "b": []}
    if len(queries) and len(members):
        m = np.frombuffer(b"".join(members["minima"]), "<u4").reshape(len(members), -1)
        keys, comps, sizes, often, seldom = (members[c].to_numpy() for c in ("text_key", "component", "size", "often", "seldom"))
        for k, c, x, size, most, few in queries[["text_key", "component", "minima", "size", "often", "seldom"]].itertuples(index=False):
            common = np.minimum(often, most) + np.minimum(seldom, few)
            at = np.flatnonzero((comps != c) & ((100 + percent) * common >= percent * (sizes + size)))
            same = m[at] == np.frombuffer(x, "<u4")
            # a pair counts in the first of its buckets only
            at = at[(same.sum(axis=1) >= LEAST_AGREE) & (same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == queries["band"].iat[0])]
            found["a"] += np.minimum(keys[at], k).tolist()
            found["b"] += np.maximum(keys[at], k).tolist()
    return pd.DataFrame(found, dtype="int64")


@F.pandas_udf(T.IntegerType())
def agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    """In how many places the minima of two texts agree."""
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(c), "<u4").reshape(len(c), -1) for c in (a, b))
    return pd.Series((x == y).sum(axis=1).astype("int32"))


def likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose minima agree often enough; texts: text_key, minima."""
    of = lambda c: texts.select(F.col("text_key").alias(c), F.col("minima").alias(f"{c}_minima"))
    return shuffled(pairs).join(of("a"), "a").join(of("b"), "b").where(agreeing("a_minima", "b_minima") >= LEAST_AGREE).select("a", "b")


def pair_keys(open_: DataFrame) -> DataFrame:
    """(text_key, component, key, c): the hashes of each text's minima taken two by two that another open text has too."""
    at = F.sequence(F.lit(0), F.lit(BANDS * ROWS // 2 - 1))
    keys = open_.select("text_key", "component", F.explode(F.transform(at, lambda i: F.xxhash64(i, F.substr("minima", i * 8 + 1, F.lit(8))))).alias("key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    return materialize(keys.join(shuffled(counts), "key"), "near-keys")


def rare_pairs(keyed: DataFrame, open_: DataFrame) -> DataFrame:
    """Pairs of different components that have a key in common which COMMON texts have at most, if their minima agree enough."""
    few = keyed.where(F.col("c") <= COMMON).groupBy("key").agg(F.collect_list(F.struct("text_key", "component")).alias("k"))
    few = few.where(F.size(F.array_distinct("k.component")) > 1).select(F.explode("k").alias("x"), "k")
    few = few.select(F.col("x.text_key").alias("a"), F.explode(F.filter("k", lambda y: (y["text_key"] > F.col("x.text_key")) & (y["component"] != F.col("x.component")))["text_key"]).alias("b")).distinct()
    return likely(few, open_)


def shared_sizes(docs: DataFrame, keys: DataFrame, percent: int, text_col: str = "text") -> DataFrame:
    """(text_key, size, often, seldom): a text's shingles, and how many of them more than COMMON texts of `keys` have, or others
    of them but fewer; texts that therefore cannot be similar to any of them are left out."""
    needed = materialize(keys.select(F.col("text_key").alias("key")).distinct(), "near-plain")
    sets = shingle_sets(docs, needed, text_col)
    each = sets.select("key", F.explode("s").alias("shingle"))
    met = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle", (F.col("n") > COMMON).cast("int").alias("often"))
    held = each.join(shuffled(met), "shingle").groupBy("key").agg(F.sum("often").cast("int").alias("often"), F.sum(1 - F.col("often")).cast("int").alias("seldom"))
    out = sets.select("key", "size").join(held, "key").where(100 * (F.col("often") + F.col("seldom")) >= percent * F.col("size"))
    return materialize(out.withColumnRenamed("key", "text_key"), "near-held")


def common_pairs(docs: DataFrame, keyed: DataFrame, rest: DataFrame, open_: DataFrame, percent: int, text_col: str = "text") -> DataFrame:
    """Pairs of different components in a bucket whose texts have little but what many texts have, by blocks."""
    plain = keyed.where(F.col("c") > COMMON).groupBy("text_key").agg(F.count("*").alias("k")).where(F.col("k") > DOMINATED)
    held = shared_sizes(docs, plain, percent, text_col)
    left = rest.select("bucket", "band", "text_key", "component").join(held, "text_key")
    of = left.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    sizes = of.groupBy("bucket").agg(F.max(F.struct("m", "component"))["component"].alias("main"), F.count("*").alias("k"), F.sum("m").alias("n"), (F.sum("m") - F.max("m")).alias("outside")).where("k > 1")
    many = left.join(sizes, "bucket").join(open_.select("text_key", "minima"), "text_key")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("text_key"), blocks(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    side = ["bucket", "query_block", "member_block"]
    fields = [F.col(c).alias(c) for c in (*side, "band", "text_key", "component", "minima", "size", "often", "seldom")]  # new columns, as both sides come from one table
    queries = many.where("component <> main").withColumn("query_block", mine("outside")).withColumn("member_block", each("n")).select(*fields)
    members = many.withColumn("member_block", mine("n")).withColumn("query_block", each("outside")).select(*fields)

    def compare(key, q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        return _agreeing(q, m, percent)

    return queries.groupBy(*side).cogroup(members.groupBy(*side)).applyInPandas(compare, "a long, b long")


def other_pairs(docs: DataFrame, shared: DataFrame, texts: DataFrame, met: DataFrame, percent: int, text_col: str = "text") -> DataFrame:
    """The pairs that are left in buckets whose texts are in several components."""
    placed = shared.join(texts.select("text_key", "component"), "text_key")
    several = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    rest = materialize(placed.select("bucket", "band", "text_key", "component").join(several, "bucket"), "near-rest")
    open_ = materialize(met.join(rest.select("text_key", "component").distinct(), "text_key"), "near-open")
    keyed = pair_keys(open_)
    return rare_pairs(keyed, open_).unionByName(common_pairs(docs, keyed, rest, open_, percent, text_col))


def shingle_sets(docs: DataFrame, needed: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, s, size): the distinct shingles of the texts whose keys are needed (key, written already)."""
    keyed = docs.select(F.xxhash64(text_of(text_col)).alias("key"), text_of(text_col).alias("text"))
    texts = with_passes(keyed, "key", needed).where("_passes").drop("_passes").join(needed, "key", "left_semi").dropDuplicates(["key"])
    return materialize(texts.select("key", shingles("text").alias("s")).withColumn("size", F.size("s")), "near-shingles")


def similar(docs: DataFrame, pairs: DataFrame, percent: int, text_col: str = "text") -> DataFrame:
    """Of pairs (a, b) of text_keys those whose shingles' similarity is percent / 100 or more."""
    pairs = materialize(pairs.distinct(), "near-pairs")
    sets = shingle_sets(docs, materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "near-needed"), text_col)
    # the sizes alone bound the similarity: the sets are joined only where it can be reached
    size = lambda c, n: sets.select(F.col("key").alias(c), F.col("size").alias(n))
    fit = shuffled(pairs).join(size("a", "m"), "a").join(size("b", "n"), "b").where(100 * F.least("m", "n") >= percent * F.greatest("m", "n"))
    both = fit.join(sets.select(F.col("key").alias("a"), "s"), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("t")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("s", "t")).alias("c"), (F.col("m") + F.col("n")).alias("n"))
    return materialize(common.where(100 * F.col("c") >= percent * (F.col("n") - F.col("c"))).select("a", "b"), "near-links")


def near_links(docs: DataFrame, rows: DataFrame, percent: int, text_col: str = "text") -> DataFrame:
    """Links (a, b) between text_keys: every two similar texts are in one component of them."""
    texts = materialize(rows.select("text_key", "fp", "buckets", "minima").dropDuplicates(["text_key"]), "near-texts")
    bands = texts.select("text_key", F.posexplode("buckets").alias("band", "bucket"))
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(bands.join(shuffled(sizes), "bucket"), "near-buckets")
    # only texts that share a bucket are compared by their minima
    met = materialize(texts.select("text_key", "minima").join(shared.select("text_key").distinct(), "text_key"), "near-met")
    first = similar(docs, likely(hub_pairs(shared).distinct(), met), percent, text_col)
    component = _components(first)
    placed = texts.join(component, "text_key", "left").select("text_key", "fp", F.coalesce("component", "text_key").alias("component"))
    placed = materialize(placed, "near-placed")
    rest = similar(docs, fingerprint_pairs(placed).unionByName(other_pairs(docs, shared, placed, met, percent, text_col)), percent, text_col)
    return first.unionByName(rest)


def near_groups(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, component), one row per input row; component is a text_key that stands for the group."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), prints(text).alias("p")).select("doc_id", "text_key", "p.*")
    rows = materialize(rows, "near-prints")
    stars = connected_components(near_links(docs, rows, percent, text_col))
    member = rows.select("doc_id", "text_key").join(stars.withColumnRenamed("node", "text_key"), "text_key", "left")
    return member.select("doc_id", "text_key", F.coalesce("component", "text_key").alias("component"))
