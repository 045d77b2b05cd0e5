"""Prefix trie of conversations from padded matrices of turn ids.

A conversation is a sequence of turn ids (hashes of role and text). Conversations are dealt to shards by ranges of their first
HEAD ids, then conv_id, so that a node's conversations are neighbours. In a shard the ids of WIDTH turns at a time form a padded
matrix of the conversations that are as long; numpy sorts its rows by columns, the columns' change masks, OR-accumulated from
left to right, mark where each depth's nodes start, and reduceat adds up every depth. So a shard holds WIDTH ids a conversation
at once, however long a few of them are.

A node whose first HEAD ids are those of a shard's first or last row may go on in other shards: such boundary nodes are partial.
They are recombined by their keys (a hash of the node's ids): counts are added up, and what lies below is passed up the
boundary nodes by doubling the distance to their ancestors. Every other node is whole in its shard. The ids that end at a
boundary node are hashed as they stream by in order, never gathered.

Defined cases: turns go by turn, nulls first, then by role and by the hash of the text; a null role or text is empty; rows with a
null conv_id are one conversation, which is rebuilt from itself alone, comes before all others in order and counts as the
smallest member only where it is alone; its decimal is empty; repeated rows are repeated turns; an empty table gives no rows;
further columns are ignored. Turns are compared by 64-bit hashes, boundary nodes by 64-bit hashes of their ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretrail.llm.common import materialize, table, text_of

FAMILY, HEADS = 100, 6
HEAD, WIDTH = 8, 32
#: Turns and conversations in a shard, about.
SHARD_TURNS = 400_000
ROOT_KEY = 0x243F6A8885A308D3
LEAST = -(1 << 63)

SHARD = (
    T.StructType()
    .add("shard", T.IntegerType()).add("key", T.LongType()).add("parent_key", T.LongType()).add("open", T.BooleanType()).add("parent_open", T.BooleanType())
    .add("conv_id", T.LongType()).add("depth", T.LongType()).add("parent_conv_id", T.LongType()).add("n_convs", T.LongType()).add("n_children", T.LongType())
    .add("n_leaves", T.LongType()).add("saved_tokens", T.LongType()).add("last_chars", T.LongType()).add("ends", T.StringType()).add("ends_from", T.LongType())
)


def turn_sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, own): each conversation's turns in order as {turn, role, id, chars}."""
    role, text = text_of(role_col), text_of(text_col)
    one = F.struct(F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("id"), F.length(text).cast("long").alias("chars"))
    return turns.select(F.col(conv_col).cast("long").alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))


def rebuild(sequences: DataFrame) -> DataFrame:
    """(conv_id, ids, chars): conversations with their first turns taken from their family's first conversation."""
    own = sequences.select("conv_id", F.transform("own", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("own"))
    own = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    base = own.where("conv_id = family").select("family", F.slice("own", 1, HEADS - 1).alias("base"))
    h = (F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % HEADS).cast("int")
    met = own.join(base, "family", "left").withColumn("h", h)
    base_part = F.slice(F.when(F.col("conv_id").isNull(), F.col("own")).otherwise(F.coalesce("base", F.array().cast("array<struct<id:bigint,chars:bigint>>"))), F.lit(1), F.col("h"))
    built = met.select("conv_id", F.concat(base_part, F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))).alias("all"))
    return built.select("conv_id", F.col("all.id").alias("ids"), F.col("all.chars").alias("chars"))


def _mix(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Key of a child from its parent's key and its own turn id."""
    x = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ids.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _padded(flat: np.ndarray, start: np.ndarray, live: np.ndarray, at: int) -> np.ndarray:
    """A row of WIDTH values a conversation, from depth `at` on; LEAST where there is no turn."""
    place = np.where(live, start[:, None] + at + np.arange(WIDTH), 0)
    return np.where(live, flat[place], LEAST) if len(flat) else np.full(live.shape, LEAST)


def shard_levels(convs: np.ndarray, null: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray, chars: np.ndarray) -> tuple[list[dict], list[tuple]]:
    """The nodes of a shard by depth, each level a dict of arrays (key, parent, open, conv_id, alone, n_convs, last), and
    (depth, nodes, conversations) of the conversations that end there, in order."""
    known = np.where(null, np.iinfo(np.int64).max, convs)
    level = {"key": np.array([ROOT_KEY]), "parent": np.array([-1]), "open": np.array([True]), "conv_id": known.min(keepdims=True), "alone": null.all(keepdims=True), "n_convs": np.array([len(convs)]), "last": np.array([0])}
    levels, ends = [level], []
    rows, group, at, edges, on_edge = np.arange(len(convs)), np.zeros(len(convs), np.int64), 0, None, np.ones((2, 1), bool)
    while len(rows):
        live = at + np.arange(WIDTH) < size[rows][:, None]
        matrix = _padded(ids, start[rows], live, at)
        columns = [c for j in range(WIDTH - 1, -1, -1) for c in (matrix[:, j], live[:, j])]
        by = np.lexsort([convs[rows], ~null[rows], *columns, group])
        rows, live, matrix, group = rows[by], live[by], matrix[by], group[by]
        texts = _padded(chars, start[rows], live, at)
        change = np.ones((len(rows), WIDTH + 1), bool)
        change[1:, 0] = group[1:] != group[:-1]
        change[1:, 1:] = (matrix[1:] != matrix[:-1]) | (live[1:] != live[:-1])
        change = np.logical_or.accumulate(change, axis=1)
        if edges is None:
            edges = [ids[start[r] : start[r] + min(size[r], HEAD)] for r in (rows[0], rows[-1])]
        here = np.ones(len(rows), bool)
        for j in range(WIDTH):
            depth = at + j + 1
            done = here & ~live[:, j]
            if done.any():
                ends.append((depth - 1, group[done], rows[done]))
            here = live[:, j]
            starts = np.flatnonzero(change[:, j + 1])  # of the nodes, and of the conversations that have no turn here
            lives = here[starts]
            if not lives.any():
                break
            segment = np.cumsum(change[:, j + 1]) - 1
            first = starts[lives]
            parent, own = group[first], matrix[first, j]
            if depth <= HEAD:
                on_edge = np.array([on_edge[e][parent] & (len(edges[e]) >= depth) & (own == (edges[e][depth - 1] if len(edges[e]) >= depth else 0)) for e in (0, 1)])
            else:
                on_edge = on_edge[:, parent]
            level = {
                "key": _mix(levels[-1]["key"][parent], own),
                "parent": parent,
                "open": on_edge.any(axis=0),
                "conv_id": np.minimum.reduceat(known[rows], starts)[lives],
                "alone": np.logical_and.reduceat(null[rows], starts)[lives],
                "n_convs": np.diff(np.append(starts, len(rows)))[lives],
                "last": texts[first, j],
            }
            levels.append(level)
            group = (np.cumsum(lives) - 1)[segment]
        rows, group, at = rows[here], group[here], at + WIDTH
    return levels, ends


def sum_up(levels: list[dict]) -> None:
    """Adds children, leaves and saved to every level, from below: whole for closed nodes, of their closed children for open ones."""
    for level in levels:
        level |= {c: np.zeros(len(level["key"]), np.int64) for c in ("children", "leaves", "saved")}
    for d in range(len(levels) - 1, -1, -1):
        level, closed = levels[d], ~levels[d]["open"]
        level["leaves"] += closed & (level["children"] == 0)
        level["saved"] += np.where(closed, (level["n_convs"] - 1) * level["last"], 0)
        if d:
            above = levels[d - 1]
            for c, values in (("children", np.ones(len(closed), np.int64)), ("leaves", level["leaves"]), ("saved", level["saved"])):
                np.add.at(above[c], level["parent"][closed], values[closed])


def _names(convs: np.ndarray, null: np.ndarray, rows: np.ndarray) -> list[str]:
    return ["" if gone else str(c) for c, gone in zip(convs[rows].tolist(), null[rows].tolist(), strict=True)]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shard_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A shard (conv_id, ids, chars, shard) -> its nodes, a depth at a time."""
    parts = [p for p in parts if len(p)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    null = rows["conv_id"].isna().to_numpy(bool)
    convs = rows["conv_id"].fillna(0).to_numpy(np.int64)
    size = np.array([len(x) for x in rows["ids"]], np.int64)
    flat = lambda c: np.concatenate([np.empty(0, np.int64), *[np.asarray(x, np.int64) for x in rows[c]]])
    levels, ends = shard_levels(convs, null, np.cumsum(size) - size, size, flat("ids"), flat("chars"))
    sum_up(levels)
    ended = {}
    for depth, nodes, members in ends:
        cuts = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(nodes)), strict=True):
            ended[depth, int(nodes[lo])] = members[lo:hi]
    nothing = _sha("")
    for depth, level in enumerate(levels):
        above = levels[depth - 1] if depth else None
        n = len(level["key"])
        names = [_names(convs, null, m) if (m := ended.get((depth, k))) is not None else None for k in range(n)]
        heads = [ended[depth, k][0] if names[k] is not None else None for k in range(n)]
        shut = ~level["open"]
        conv = pd.array(np.where(level["alone"], 0, level["conv_id"]), "Int64")
        conv[level["alone"]] = pd.NA
        parent = pd.array(above["conv_id"][level["parent"]] if depth else np.zeros(n, np.int64), "Int64")
        parent[(above["open"] | above["alone"])[level["parent"]] if depth else np.ones(n, bool)] = pd.NA
        yield pd.DataFrame({
            "shard": np.full(n, rows["shard"].iat[0], np.int32), "key": level["key"], "parent_key": pd.array(above["key"][level["parent"]], "Int64") if depth else pd.array([pd.NA] * n, "Int64"),
            "open": level["open"], "parent_open": above["open"][level["parent"]] if depth else np.zeros(n, bool), "conv_id": conv, "depth": np.full(n, depth, np.int64), "parent_conv_id": parent,
            "n_convs": level["n_convs"], "n_children": level["children"], "n_leaves": level["leaves"], "saved_tokens": level["saved"], "last_chars": level["last"],
            "ends": [(_sha(",".join(x)) if shut[k] else ",".join(x)) if x is not None else (nothing if shut[k] else None) for k, x in enumerate(names)],
            "ends_from": pd.array([pd.NA if h is None or null[h] else int(convs[h]) for h in heads], "Int64"),
        })


def _stream_sha(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, ends) in order -> (key, sha256 of a key's ends, comma-joined); holds one digest at a time."""
    key, state = None, None
    for part in parts:
        out = []
        for k, text in zip(part["key"].tolist(), part["ends"], strict=True):
            if k == key:
                state.update(b",")
            else:
                if state:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(text.encode())
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if state:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends_sha256"])


def recombine(parts: DataFrame) -> DataFrame:
    """Boundary nodes of all shards -> (key, parent_key and the node's columns), each whole."""
    nodes = parts.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("closed"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("last_chars").alias("chars"),
    )
    nodes = materialize(nodes, "trie-boundary")
    below = nodes.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("opened"))
    nodes = nodes.join(below, "key", "left").withColumn("n_children", F.col("closed") + F.coalesce("opened", F.lit(0)))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    sums = materialize(nodes.select("key", F.col("parent_key").alias("up"), (F.col("leaves") + leaf).alias("leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "trie-sums")
    while sums.where("up IS NOT NULL").limit(1).count():
        more = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = sums.select(F.col("key").alias("up"), F.col("up").alias("further"))
        grown = sums.join(more, "key", "left").join(further, "up", "left")
        sums = materialize(grown.select("key", F.col("further").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "trie-sums")
    chunks = parts.where("ends IS NOT NULL").select("key", "ends_from", "ends").repartition("key").sortWithinPartitions("key", F.col("ends_from").asc_nulls_first())
    shas = chunks.select("key", "ends").mapInPandas(_stream_sha, "key long, ends_sha256 string")
    parent = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("leaves", "saved").join(sums.select("key", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), "key").join(shas, "key", "left").join(parent, "parent_key", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_sha(""))))


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """(conv_id, ids, chars) -> a row per distinct prefix: OUT."""
    sequences = materialize(sequences, "trie-sequences")
    total = sequences.agg(F.sum(F.size("ids") + 4).alias("n")).first()["n"] or 0
    shards = sequences.repartitionByRange(max(1, -(-total // SHARD_TURNS)), F.slice("ids", 1, HEAD), "conv_id").select("conv_id", "ids", "chars", F.spark_partition_id().alias("shard"))
    nodes = materialize(shards.mapInPandas(shard_rows, SHARD), "trie-nodes")
    parts, closed = nodes.where("open"), nodes.where("NOT open").withColumnRenamed("ends", "ends_sha256")
    whole = materialize(recombine(parts), "trie-whole")
    above = parts.select("shard", "key").join(whole.select("key", "conv_id"), "key").select("shard", F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    hung = closed.where("parent_open").drop("parent_conv_id").join(above, ["shard", "parent_key"]).withColumnRenamed("above", "parent_conv_id")
    return closed.where("NOT parent_open").select(*OUT).unionByName(hung.select(*OUT)).unionByName(whole.select(*OUT))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuild(turn_sequences(table(spark, sf_dir, "conversations"))))


OP13_SQL = r"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t),
o AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own FROM conversations GROUP BY conv_id),
h AS (SELECT conv_id, own, (xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, v: xor(c >> 8, t.t[(xor(c, v) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 6)::INT AS h FROM o, t),
b AS MATERIALIZED (SELECT h.conv_id, list_concat(coalesce(o.own, [])[1:h], h.own[h + 1:]) AS turns FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100),
p AS MATERIALIZED (SELECT conv_id AS member, d, turns[1:d] AS prefix, len(turns) AS size FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM b)),
n AS MATERIALIZED (SELECT d, prefix, min(member) AS conv_id, count(*) AS n_convs, coalesce(string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (WHERE size = d), '') AS ends FROM p GROUP BY d, prefix),
k AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
v AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.prefix[n.d].text) END AS saved FROM n LEFT JOIN k USING (d, prefix)),
u AS (SELECT a AS d, prefix[1:a] AS prefix, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(d + 1)) AS a FROM v) GROUP BY ALL)
SELECT v.conv_id, v.d::BIGINT AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN u USING (d, prefix) LEFT JOIN n q ON q.d = v.d - 1 AND q.prefix = v.prefix[1:v.d - 1]
"""
