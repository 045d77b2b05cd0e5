"""Line dedup by distinct-site spread.

HyperLogLog sketches of the sites of each line hash merge by aggregation, from the lines themselves: partial sketches per task
take a line in a third of all documents apart. Lines whose estimate is clearly above or below the threshold are decided by it;
only the lines near it get exact distinct counts. A line on MIN_SITES sites or more is boilerplate: it stays in the document
with the smallest id and goes from all others. Lines that occur fewer times than that cannot spread so far and need no sketch.
Documents without any such line pass by a filter; only the others are joined with what they lose.

Defined cases: lines are compared without white space at their ends, as 64-bit hashes, and count from min_words words (by
default every line that holds a word); null texts are empty and keep their null; a null site is a site of its own; ids may be
of any type that has an order; rows with the same doc_id keep or lose a line together; a null doc_id counts as larger than all
others; an empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import SPACE, WORD_RE, hex_digest, materialize, table, text_of, with_passes

MIN_SITES = 10
MIN_WORDS = 1
LG_K = 10
NEAR = 0.15  # of the threshold; over four times the sketch's standard error


def _counts(line: Column, min_words: int) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]") if min_words <= 1 else F.regexp_count(line, F.lit(WORD_RE)) >= min_words


def _hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACE)))


def line_rows(docs: DataFrame, id_col="doc_id", text_col="text", site_col="source", min_words: int = MIN_WORDS) -> DataFrame:
    """(ord, text_key, site, i, hash) of the lines that count."""
    lines = docs.select(
        F.col(id_col).alias("ord"),
        F.xxhash64(text_of(text_col)).alias("text_key"),
        F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("")).alias("site"),
        F.posexplode(F.split(text_of(text_col), "\n", -1)).alias("i", "line"),
    )
    return lines.where(_counts(F.col("line"), min_words)).select("ord", "text_key", "site", "i", _hash(F.col("line")).alias("hash"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(hash, first): lines on at least min_sites sites, with the smallest document that has them."""
    seen = lines.groupBy("hash").agg(F.count("*").alias("n"), F.min("ord").alias("first")).where(F.col("n") >= min_sites).select("hash", "first")
    seen = materialize(seen, "line-candidates")
    sites = lines.join(seen.select("hash"), "hash", "left_semi").select("hash", "site")
    spread = materialize(sites.groupBy("hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("spread")), "line-spread")
    near = spread.where(F.abs(F.col("spread") - min_sites) <= max(1.0, NEAR * min_sites)).select("hash")
    exact = lines.join(near, "hash", "left_semi").select("hash", "site").distinct().groupBy("hash").agg(F.count("*").alias("exact"))
    wide = spread.join(exact, "hash", "left").where(F.coalesce("exact", "spread") >= min_sites)
    return materialize(seen.join(wide.select("hash"), "hash"), "line-wide")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col="doc_id", text_col="text", site_col="source", min_words: int = MIN_WORDS) -> DataFrame:
    """(row, text, n_lines, n_removed): every input row as a struct, with what is left of its text."""
    lines = materialize(line_rows(docs, id_col, text_col, site_col, min_words), "lines")
    wide = spread_lines(lines, min_sites)
    # `first` is the smallest id that has the line, so any other id is larger
    gone = lines.join(wide, "hash").where(~F.col("ord").eqNullSafe(F.col("first"))).groupBy("ord", "text_key").agg(F.collect_set("i").alias("gone"))
    gone = materialize(gone.select(F.struct("ord", "text_key").alias("_of"), "gone"), "line-removals")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(text_of(text_col)).alias("_key"))
    rows = with_passes(rows, "_key", gone.select("_of.text_key").distinct())
    text = F.col(f"row.`{text_col}`")
    whole = rows.where("NOT _passes").select("row", text.alias("text"), F.size(F.split(text_of(f"row.`{text_col}`"), "\n", -1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    joined = rows.where("_passes").join(gone, F.col(f"row.`{id_col}`").eqNullSafe(F.col("_of.ord")) & (F.col("_key") == F.col("_of.text_key")), "left")
    joined = joined.withColumn("_lines", F.split(text_of(f"row.`{text_col}`"), "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "gone")
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(places, lambda i: F.get("_lines", i)), "\n"))
    cut = joined.select("row", left.alias("text"), F.size("_lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))
    return whole.unionByName(cut)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_removed",
        hex_digest(F.coalesce("text", F.lit(""))).alias("kept_sha256"),
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, site, i, trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
k AS (SELECT * FROM l WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 1),
w AS (SELECT line, min(doc_id) AS first FROM k GROUP BY line HAVING count(DISTINCT site) >= 10),
g AS (SELECT k.doc_id, list(i) AS gone FROM k JOIN w USING (line) WHERE k.doc_id > w.first GROUP BY k.doc_id)
SELECT d.doc_id, len(lines)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(coalesce(gone, []), i)], chr(10))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
