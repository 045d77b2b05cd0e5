"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code over the 64 bits: three perfect codes, the binary Golay code (covering radius 3)
over bits 0-22 and 23-45 and a Hamming code (covering radius 1) over bits 46-60; the last three bits are left open. Each
distinct fingerprint is at home at its one anchor within the covering radius, and is replicated to every anchor within that
radius plus the threshold (about 150); two fingerprints within the threshold then meet at the home of the smaller one, where
they are compared. There are 2 ** 35 anchors. Distinct fingerprints stand for all their copies, so a fingerprint has at most
2,080 links, however large its group.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other; fewer words than a shingle make
one shingle; equal fingerprints share a component; repeated rows keep their rows; a null doc_id has a row, is never the
smallest of a component unless nothing else is in it (then component_id is null); an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretrail.llm.common import materialize, shuffled, table, text_of, without
from caretrail.llm.components import connected_components

SHINGLE = 3
THRESHOLD = 2
SEED = 42
#: Fingerprints in a task that replicates them.
FEW = 50_000
#: The covering codes, from bit 0 on: length, check bits, generator polynomial, covering radius (fixed values).
CODES = [(23, 11, 0b110001110101, 3), (23, 11, 0b110001110101, 3), (15, 4, 0b10011, 1)]


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included; fewer words make one shingle, none make none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, "<u8")
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, SEED) for g in grams), dtype="<u8", count=max(1, len(words) - shingle + 1))


def fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes, as a signed number."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([fingerprint(shingle_hashes(t.encode("utf-8", "surrogatepass"))) for t in part], dtype="int64")


class Code:
    """A perfect cyclic code. For each syndrome: the differences from a word to the code word within the covering radius
    (home), and to those first reached with 0, 1 and 2 changed bits (rings)."""

    def __init__(self, length: int, checks: int, generator: int, radius: int):
        self.length, self.checks, self.generator = length, checks, generator
        self.syndrome_of_bit = np.array([self._remainder(1 << i) for i in range(length)], np.int64)
        errors = {w: self._patterns(w) for w in range(max(radius, THRESHOLD) + 1)}
        leaders = np.zeros(1 << checks, np.int64)
        for w in range(radius, -1, -1):
            leaders[self.syndrome(errors[w])] = errors[w]
        every = np.arange(1 << checks)
        self.home = leaders
        self.rings = []  # padded with -1
        seen: list[set[int]] = [set() for _ in every]
        for w in range(THRESHOLD + 1):
            e = errors[w]
            found = e[None, :] ^ leaders[every[:, None] ^ self.syndrome(e)[None, :]]
            fresh = [sorted(set(row) - seen[s]) for s, row in enumerate(found.tolist())]
            for s, row in enumerate(fresh):
                seen[s].update(row)
            ring = np.full((len(fresh), max(map(len, fresh))), -1, np.int64)
            for s, row in enumerate(fresh):
                ring[s, : len(row)] = row
            self.rings.append(ring)

    def _remainder(self, x: int) -> int:
        while x.bit_length() > self.checks:
            x ^= self.generator << (x.bit_length() - self.checks - 1)
        return x

    def _patterns(self, weight: int) -> np.ndarray:
        from itertools import combinations

        return np.array([sum(1 << b for b in bits) for bits in combinations(range(self.length), weight)], np.int64)

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for i in range(self.length):
            out ^= np.where(words >> i & 1, self.syndrome_of_bit[i], 0)
        return out


def _blocks(fp: np.ndarray) -> Iterator[tuple[Code, int, np.ndarray]]:
    """Each code with the place of its bits and the fingerprints' words there."""
    at, made = 0, {}
    for spec in CODES:
        code = made.setdefault(spec, Code(*spec) if spec not in made else None)
        yield code, at, fp >> at & ((1 << code.length) - 1)
        at += code.length


def anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """fp, group -> (b, anchor, b_group): every anchor within the covering radius plus the threshold."""
    from itertools import product

    for frame in frames:
        every, groups = frame["fp"].to_numpy(np.int64), frame["group"].to_numpy(np.int64)
        parts = [(code, at, word, code.syndrome(word)) for code, at, word in _blocks(every)]
        for lo in range(0, len(every), 5_000):
            here = slice(lo, lo + 5_000)
            fp, rows, where = every[here], [], []
            for steps in product(range(THRESHOLD + 1), repeat=len(parts)):
                if sum(steps) > THRESHOLD:
                    continue
                keep, anchor = np.ones((len(fp), 1), bool), np.zeros((len(fp), 1), np.int64)
                for (code, at, word, syndrome), w in zip(parts, steps, strict=True):
                    d = code.rings[w][syndrome[here]]
                    keep = (keep[:, :, None] & (d >= 0)[:, None, :]).reshape(len(fp), -1)
                    anchor = (anchor[:, :, None] | ((word[here][:, None] ^ d) << at)[:, None, :]).reshape(len(fp), -1)
                rows.append(np.repeat(np.arange(len(fp)), keep.sum(axis=1))), where.append(anchor[keep])
            row = np.concatenate(rows)
            yield pd.DataFrame({"b": fp[row], "anchor": np.concatenate(where), "b_group": groups[here][row]})


def home_anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        fp = frame["fp"].to_numpy(np.int64)
        anchor = np.zeros(len(fp), np.int64)
        for code, at, word in _blocks(fp):
            anchor |= (word ^ code.home[code.syndrome(word)]) << at
        yield pd.DataFrame({"a": fp, "anchor": anchor, "a_group": frame["group"]})


def near_links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b), a < b, with at most `threshold` (2 or less) differing bits.

    Where prints have a column `group` (long; a fingerprint may be in several), only links between different groups count, and
    come with them (a_group, b_group).
    """
    if threshold > THRESHOLD:
        raise ValueError(f"the anchors cover {THRESHOLD} differing bits")
    grouped = "group" in prints.columns
    rows = prints.select("fp", F.col("group") if grouped else F.lit(0).cast("long").alias("group"))
    # tasks by number of fingerprints, as each becomes some 150 rows
    spread = rows.repartition(max(prints.sparkSession.sparkContext.defaultParallelism, rows.count() // FEW + 1))
    homes = spread.mapInPandas(home_anchors, "a long, anchor long, a_group long")
    visits = shuffled(spread.mapInPandas(anchors, "b long, anchor long, b_group long"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    if grouped:
        return homes.join(visits, "anchor").where(near & (F.col("a_group") != F.col("b_group"))).select("a", "b", "a_group", "b_group")
    return homes.join(visits, "anchor").drop("a_group", "b_group").where(near).select("a", "b")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp, component, component_id), one row per input row; text_key is the text's xxhash64.

    component is a fingerprint that stands for the component, component_id its smallest doc_id.
    """
    text = text_of(text_col)
    prints = materialize(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), fingerprints(text).alias("fp")), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    stars = connected_components(near_links(classes.select("fp")))
    member = classes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    member = materialize(member, "fingerprint-members")
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = member.join(least, "component").select("fp", "component", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "text_key", "fp", "component", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null last), then of the smallest text_key."""
    return keep_first(docs, simhash_groups(docs, id_col, text_col), id_col, text_col)


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of groups (doc_id, text_key, component)."""
    groups = materialize(groups, "near-groups")
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("text_key"))
    chosen = groups.groupBy("component").agg(F.min(order).alias("first"))
    placed = groups.join(chosen, "component").select("doc_id", "text_key", (order == F.col("first")).alias("stays"))
    placed = placed.groupBy("doc_id", "text_key", "stays").count().where("NOT stays OR count > 1")
    placed = materialize(placed, "near-places")
    left = without(docs, placed.where(~F.col("stays")), id_col, text_col)
    twice = placed.where("stays")  # rows that repeat a kept one go as well
    if twice.isEmpty():
        return left
    rows = left.select(F.struct("*").alias("row"))
    k = twice.select(F.struct("doc_id", "text_key").alias("_twice"))
    same = F.col(f"row.`{id_col}`").eqNullSafe(F.col("_twice.doc_id")) & (F.xxhash64(text_of(f"row.`{text_col}`")) == F.col("_twice.text_key"))
    again = rows.join(k, same, "left_semi").select("row.*")
    return without(left, twice, id_col, text_col).unionByName(again.dropDuplicates([id_col, text_col]))


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
