"""Spelling variants of a corpus' words by a relational trie frontier.

The words' prefixes are the nodes of a trie, kept as a distributed table of edges by depth: a row per child of a node, with its
character and which characters and how many of them may follow. Level by level the
frontier, states (word, rest of the word, node, edits), is joined with the edges of that depth: a state without an edit takes a
replaced, an inserted or a deleted character, a state with one goes on along equal characters only. A state that has read its
word, has one edit and is where a word ends makes the two words neighbours.

An edit in a word's second half leaves its first half as it is, and an edit in the first half the second. So every word walks two
tries, one of the words and one of the words written backwards, and may be edited in the second half only: where an edit may
happen few words are left, which keeps the frontier in proportion to the words. On the edited half's way a state without an
edit is at the node of its own prefix, so those states are made from the words at each depth.

Words of more than LONGEST code points would make a level a code point. They, with those of LONGEST, meet by hashes of their
forms with one code point left out instead (rows in proportion to their lengths); the words found so are compared exactly.

Defined cases: a null text has no words; a null id counts as the empty text in the sum that decides on deletions; rows with the
same id and text count each; ties in n go to the smallest word in code-point order; an empty table gives no rows; further
columns are ignored. Nodes are 64-bit hashes of prefixes; neighbours are held to their edit distance besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretrail.llm.common import lower_ascii, materialize, table, text_of
from caretrail.sources.shared import fresh_path

RUN_RE = "[A-Za-z\\u00C0-\\u00FF]"
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One run in so many loses a code point.
TYPO_MOD = 97
LONGEST = 40
#: Copies of the edges of the upper levels, over which the states of a node are dealt: (levels up to, copies).
SALTS = [(3, 16), (5, 4)]


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): the runs of every text, one in TYPO_MOD with a code point deleted; shorter runs than a word's are left out."""
    found = F.regexp_extract_all(text_of(text_col), F.lit(f"{RUN_RE}{{{LEAST_LETTERS},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    plain = F.octet_length("run") == F.length("run")  # of A-Z and a-z alone, where lower() knows no other capitals
    each = each.select("id", F.when(plain, F.lower("run")).otherwise(lower_ascii(F.col("run"))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.expr("substr(run, 1, int(h % length(run)))"), F.col("run").substr(at + 2, F.length("run")))
    return each.withColumn("h", h).select(F.when(F.col("h") % TYPO_MOD == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    counted = runs(docs, id_col, text_col).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LETTERS))


def _walkers(words: DataFrame) -> DataFrame:
    """(id, back, w, size): each word as the two tries have it."""
    short = words.where(F.length("word") <= LONGEST)
    both = F.explode(F.array(F.struct(F.lit(0).alias("back"), F.col("word").alias("w")), F.struct(F.lit(1).alias("back"), F.reverse("word").alias("w")))).alias("x")
    return short.select("id", both).select("id", "x.back", "x.w", F.length("x.w").alias("size"))


def _node(w: Column, back: Column) -> Column:
    return F.xxhash64(w, back)


def _free_from(size: Column, back: Column) -> Column:
    """The depth from which a word may be edited: its half, rounded up backwards, so that every place is in one of the two."""
    return F.floor((size + back) / 2).cast("int")


def _salts(depth: Column) -> Column:
    """Copies of a node's edges at a depth."""
    out = F.lit(1)
    for upto, n in reversed(SALTS):
        out = F.when(depth <= upto, n).otherwise(out)
    return out


def _salt(depth: Column) -> Column:
    return F.pmod(F.col("id"), _salts(depth)).cast("int").alias("salt")


def trie_edges(walkers: DataFrame) -> DataFrame:
    """(depth, node, salt, salts, ch, child, follow, lefts), a row per child: follow has a bit for each character that may follow it,
    which some share, and bit k of lefts says that a word ends k code points below; salts is what its own states are dealt over."""
    steps = walkers.select("back", "w", "size", F.explode(F.sequence(F.floor(F.col("size") / 2).cast("int"), F.col("size"))).alias("d"))
    child = steps.where("d > 0").select(
        (F.col("d") - 1).alias("depth"),
        _node(F.expr("substr(w, 1, d - 1)"), F.col("back")).alias("node"),
        F.expr("substr(w, d, 1)").alias("ch"),
        _node(F.expr("substr(w, 1, d)"), F.col("back")).alias("child"),
        F.expr("if(d < size, shiftleft(1L, ascii(substr(w, d + 1, 1)) & 63), 0L)").alias("next"),
        F.expr("shiftleft(1L, size - d)").alias("left"),
    )
    child = child.groupBy("depth", "node", "ch", "child").agg(F.bit_or("next").alias("follow"), F.bit_or("left").alias("lefts"))
    copies = F.explode(F.sequence(F.lit(0), _salts(F.col("depth")) - 1)).alias("salt")
    return child.select("depth", "node", copies, _salts(F.col("depth") + 1).alias("salts"), "ch", "child", "follow", "lefts")


def own_states(walkers: DataFrame) -> DataFrame:
    """(depth, id, rest, node, edits, salt): each word without an edit at every depth from which it may be edited."""
    at = walkers.select("id", "back", "w", F.explode(F.sequence(_free_from(F.col("size"), F.col("back")), F.col("size"))).alias("depth"))
    return at.select("depth", "id", F.expr("substr(w, depth + 1)").alias("rest"), _node(F.expr("substr(w, 1, depth)"), F.col("back")).alias("node"), F.lit(0).alias("edits"), _salt(F.col("depth")))


def _alive(skip: int) -> str:
    """Whether the rest without `skip` code points may still be read below the child."""
    end = f"(length(rest) = {skip} OR (follow & shiftleft(1L, ascii(substr(rest, {skip + 1}, 1)) & 63)) <> 0)"
    return f"(lefts & shiftleft(1L, length(rest) - {skip})) <> 0 AND {end}"


def _level(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States (id, rest, node, edits, salt) -> those a code point deeper from which an end may still be reached."""
    met = states.join(edges.select("node", "salt", "salts", "ch", "child", "follow", "lefts"), ["node", "salt"])
    equal = "ch = substr(rest, 1, 1)"
    read = f"if(edits = 1, {equal}, rest <> '' AND NOT {equal}) AND {_alive(1)}"  # as it is, or replaced
    inserted = f"edits = 0 AND NOT {equal} AND {_alive(0)}"
    deleted = f"edits = 0 AND length(rest) > 1 AND NOT {equal} AND ch = substr(rest, 2, 1) AND {_alive(2)}"
    rests = F.expr(f"array(if({read}, substr(rest, 2), NULL), if({inserted}, rest, NULL), if({deleted}, substr(rest, 3), NULL))")
    after = met.select("id", "salts", F.col("child").alias("node"), F.explode(rests).alias("rest")).where("rest IS NOT NULL")
    return after.select("id", "rest", "node", F.lit(1).alias("edits"), F.pmod("id", "salts").cast("int").alias("salt"))


def _by_depth(df: DataFrame, tag: str) -> DataFrame:
    """df written in a folder per depth, so that a level reads its own rows only."""
    path = fresh_path(df.sparkSession, tag)
    df.write.partitionBy("depth").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trie_pairs(words: DataFrame) -> DataFrame:
    """(id, node): words of LONGEST code points at most, with the nodes where one edit has read them; some are a whole word's."""
    walkers = materialize(_walkers(words), "spelling-walkers")
    edges, own = _by_depth(trie_edges(walkers), "spelling-edges"), _by_depth(own_states(walkers), "spelling-states")
    # a word without its last code point is read where its own prefix is
    found = walkers.select("id", _node(F.expr("substr(w, 1, size - 1)"), F.col("back")).alias("node"))
    deepest = walkers.agg(F.max("size")).first()[0] or 0
    frontier = None
    for depth in range(LEAST_LETTERS // 2, deepest + 1):
        states = own.where(F.col("depth") == depth).drop("depth")
        states = states if frontier is None else states.unionByName(frontier.where("rest <> ''"))
        frontier = materialize(_level(states, edges.where(F.col("depth") == depth)), "spelling-frontier")
        found = found.unionByName(frontier.where("rest = ''").select("id", "node"))
    return found


@F.pandas_udf(T.ArrayType(T.StructType().add("key", T.LongType()).add("at", T.IntegerType())))
def _left_out(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """For each word the hashes of its forms with one code point left out, with the place, and of the whole (place -1)."""
    for part in words:
        out = []
        for w in part:
            c = np.frombuffer(w.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
            base = np.uint64(0x9E3779B97F4A7C15)
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(c), base)]), dtype=np.uint64)
            head = np.concatenate([[np.uint64(0)], np.cumsum(c * power[:-1], dtype=np.uint64)])
            back = np.uint64(pow(int(base), -1, 1 << 64))
            keys = np.concatenate([head[:-1] + (head[-1] - head[1:]) * back, head[-1:]]).view(np.int64)
            at = np.append(np.arange(len(c)), -1)
            out.append([{"key": int(k), "at": int(a)} for k, a in zip(keys, at, strict=True)])
        yield pd.Series(out)


def long_pairs(words: DataFrame) -> DataFrame:
    """(a, b): words of LONGEST code points or more that one edit takes to each other, both ways."""
    long = words.where(F.length("word") >= LONGEST)
    forms = long.select("id", F.explode(_left_out("word")).alias("x")).select("id", "x.key", "x.at").distinct()
    forms = materialize(forms, "spelling-forms")
    whole = forms.where("at = -1").select(F.col("id").alias("b"), "key")
    cut = forms.where("at >= 0").select(F.col("id").alias("a"), "key", "at")
    shorter = cut.select("a", "key").distinct().join(whole, "key").select("a", "b")
    replaced = cut.join(cut.withColumnRenamed("a", "b"), ["key", "at"]).where("a <> b").select("a", "b")
    return shorter.unionByName(shorter.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(replaced)


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n) -> (word, n, near, near_n), a row per ordered pair of words one edit apart."""
    words = materialize(words.select(F.xxhash64("word").alias("id"), "word", "n"), "spelling-words")
    ends = _walkers(words).select(F.col("id").alias("b"), _node(F.col("w"), F.col("back")).alias("node"))
    pairs = trie_pairs(words).join(ends, "node").select(F.col("id").alias("a"), "b").unionByName(long_pairs(words))
    pairs = pairs.where("a <> b").distinct()
    of = lambda c, *names: words.select(F.col("id").alias(c), F.col("word").alias(names[0]), F.col("n").alias(names[1]))
    met = pairs.join(of("b", "near", "near_n"), "b").join(of("a", "word", "n"), "a")
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to their end, twice as far at each step (n doubles along a way, so few)."""
    at = materialize(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = materialize(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.drop("moved")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word with the near word that it seems to be a variant of."""
    words = materialize(vocabulary(docs, id_col, text_col), "spelling-vocabulary")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("form"))).alias("best"))
    out = words.join(best, "word", "left").withColumn("form_n", -F.col("best.k")).withColumn("is_form", F.coalesce(F.col("form_n") >= 2 * F.col("n"), F.lit(False)))
    held = lambda c: F.when(F.col("is_form"), F.col(c))
    out = materialize(out.select("word", held("best.form").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), held("form_n").alias("form_n")), "spelling-forms")
    ways = roots(out.where("form IS NOT NULL"))
    return out.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{5,}') AS runs FROM documents),
r AS (SELECT id, run, count(*) AS k FROM (SELECT id, unnest(runs) AS run FROM d) GROUP BY ALL),
b AS (SELECT *, hex(encode(id || ':' || run)) AS x FROM r),
h AS (SELECT run, k, xor(list_reduce(list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT), lambda c, v: xor(c >> 8, t.t[(xor(c, v) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM h GROUP BY 1 HAVING sum(k) >= 3),
v AS MATERIALIZED (SELECT word, n FROM w WHERE length(word) >= 5),
c AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM c a JOIN c b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM c a JOIN v b ON a.cut = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM c a JOIN v b ON a.cut = b.word),
q AS (SELECT word, n, count(*) AS n_near, min({'k': -near_n, 'form': near}) AS best FROM p GROUP BY word, n),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.k >= 2 * v.n THEN best.form END AS form, CASE WHEN -best.k >= 2 * v.n THEN -best.k END AS form_n FROM v LEFT JOIN q USING (word)),
z AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT z.word, f.form, step + 1 FROM z JOIN f ON z.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM z GROUP BY word) e USING (word)
"""
