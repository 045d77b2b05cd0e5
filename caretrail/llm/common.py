"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caretrail.sources.shared import written as materialize

SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"
WORD_RE = "[^\\x20\\x09-\\x0D]+"

#: Filters of tables of keys: KEY_SHIFTS choose a key's bits in one word; of words there are as many as a power of two makes from one
#: to KEYS_A_WORD keys a word, up to MOST_WORDS. Those are 4 million rows of two numbers, the most that is ever broadcast, some 200 MB.
KEY_SHIFTS, KEYS_A_WORD, LEAST_WORDS, MOST_WORDS = (40, 46, 52, 58), 4, 64, 1 << 22

#: Bits of a filter in an expression: FILTER_BITS for each hash, as a power of two between these; beyond the last it lets more through.
FILTER_BITS, LEAST_BITS, MOST_BITS = 64, 1 << 12, 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """array<string> of the maximal runs without ASCII white space."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RE, -1))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hex_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, from one pruned pass; sizes the batches of the operators that work on batches."""
    return docs.select(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def shuffled(rows: DataFrame) -> DataFrame:
    """rows, never broadcast in their next join. Spark takes a table that was exploded, or that Python makes many rows of, for as
    small as what it was made of, and would put it into the driver before it is worked out."""
    return rows.hint("merge")


def bit_filter(hashes: DataFrame, n: int | None = None) -> Callable[[Column], Column]:
    """A test that holds for all the hashes (one long column), and seldom for others: one bit for each, in an array that is
    part of the plan. What it lets through has to be joined still; what it stops needs no join."""
    held = hashes.select(F.col(hashes.columns[0]).alias("h"))
    n = held.count() if n is None else n
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (FILTER_BITS * n).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(size - 1))
    held = held.select(F.shiftright(place, 6).alias("id"), F.expr("shiftleft(1L, int(h & 63))").alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    every = hashes.sparkSession.range(size // 64).join(held, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    text = every.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]), ",")).first()[0]  # MOST_BITS / 64 numbers at most
    bits = F.split(F.lit(text), ",").cast("array<bigint>")  # folded to one literal
    return lambda h: F.bit_get(F.get(bits, F.shiftright(h.bitwiseAND(F.lit(size - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def _word_bits(h: Column) -> Column:
    """The bits of a hash within its word."""
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int"))
    return reduce(Column.bitwiseOR, [one(k) for k in KEY_SHIFTS])


def key_words(keys: DataFrame) -> tuple[DataFrame, int]:
    """(id, bits) of the words that any key (one column of 64-bit hashes) has bits in, written, and how many words there are."""
    h = F.col(keys.columns[0])
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << (keys.count() // KEYS_A_WORD).bit_length()))
    held = keys.select(h.bitwiseAND(F.lit(words - 1)).alias("id"), _word_bits(h).alias("bits")).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    return materialize(held, "key-words"), words


def with_passes(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows with `_passes`: true for all whose key (a 64-bit hash) is among keys, and for few others, by a table of words that is
    broadcast. Of strangers less than 1 % pass with up to 16 million keys (MOST_WORDS * KEYS_A_WORD), about a sixth with 64 million;
    what passes has to be joined still, what does not needs no join and no shuffle."""
    held, words = key_words(keys)
    held = held.select(F.col("id").alias("_word"), F.col("bits").alias("_bits"))
    mine = _word_bits(F.col(key))
    out = rows.join(F.broadcast(held), F.col(key).bitwiseAND(F.lit(words - 1)) == F.col("_word"), "left")
    return out.withColumn("_passes", F.coalesce(F.col("_bits").bitwiseAND(mine) == mine, F.lit(False))).drop("_word", "_bits")


def without(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs whose (doc_id, xxhash64 of the text) is not among keys (doc_id, text_key, both written already).

    Only the rows that a filter of the keys lets through are joined, so that other texts are not shuffled.
    """
    text_key = F.xxhash64(text_of(f"`{text_col}`")).alias("_key")
    rows = with_passes(docs.select(F.struct("*").alias("row"), text_key), "_key", keys.select("text_key"))
    k = keys.select(F.struct("doc_id", "text_key").alias("_gone"))
    same = F.col(f"row.`{id_col}`").eqNullSafe(F.col("_gone.doc_id")) & (F.col("_key") == F.col("_gone.text_key"))
    return rows.where("NOT _passes").unionByName(rows.where("_passes").join(k, same, "left_anti")).select("row.*")
