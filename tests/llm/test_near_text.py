"""Near-duplicates among pages of one template: recall against brute force, and comparisons in proportion to the pages."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute

from pyspark.sql import functions as F

from caretrail.llm import near_text


def pages(n, shared, own, seed=1):
    """Texts that share a template; every tenth is a copy of the one before it with one word changed."""
    r = random.Random(seed)
    template, out = [f"t{i}" for i in range(shared)], {}
    for i in range(n):
        words = [f"w{r.randrange(10**9)}" for _ in range(own)]
        if i % 10 == 9:
            words = out[i - 1].split()[shared:]
            words[r.randrange(own)] = "changed"
        out[i] = " ".join(template + words)
    return out


def groups(spark, texts, monkeypatch):
    compared, similar = [0], near_text.similar

    def counting(docs, pairs, *rest):
        compared[0] += pairs.count()
        return similar(docs, pairs, *rest)

    monkeypatch.setattr(near_text, "similar", counting)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found = {}
    for r in near_text.near_groups(docs).collect():
        found.setdefault(r.component, []).append(r.doc_id)
    monkeypatch.setattr(near_text, "similar", similar)
    return {i: min(g) for g in found.values() for i in g}, compared[0]


def test_templated_pages(spark, monkeypatch):
    small, large = pages(300, 200, 100), pages(1200, 200, 100)
    got, few = groups(spark, small, monkeypatch)
    assert got == brute.jaccard_groups(small)
    assert got[9] == 8 and got[19] == 18 and len(set(got.values())) == 270
    got, many = groups(spark, large, monkeypatch)
    assert all(got[i] == (i - 1 if i % 10 == 9 else i) for i in large)
    assert many < 6 * few, (few, many)


def test_pages_that_are_nearly_all_template(spark, monkeypatch):
    texts = pages(150, 170, 30, 2) | {1000 + i: t for i, t in pages(60, 190, 14, 3).items()}
    got, _ = groups(spark, texts, monkeypatch)
    assert got == brute.jaccard_groups(texts)


def test_few_strangers_pass_a_filter_of_many_keys(spark):
    """More keys than a filter in an expression takes: all keys pass, and less than one of a hundred others."""
    from caretrail.llm.common import MOST_BITS, with_passes

    n = MOST_BITS + 800_000
    hashed = lambda a, b: spark.range(a, b).select(F.xxhash64("id").alias("h"))
    keys = hashed(0, n)
    count = lambda rows: with_passes(rows, "h", keys).where("_passes").count()
    assert count(hashed(0, 100_000)) == 100_000
    assert count(hashed(n, n + 200_000)) < 2_000
    assert with_passes(hashed(0, 9), "h", keys.limit(0)).where("_passes").count() == 0


def test_rows_taken_out_reach_no_shuffle(spark):
    """Only the rows that pass are joined; the others keep their columns, clashing names too."""
    from caretrail.llm.common import without

    docs = spark.createDataFrame([(1, "a", True), (2, "b", None), (None, "a", None), (1, None, None), (1, "a", False)], "doc_id long, text string, _passes boolean")
    gone = spark.createDataFrame([(1, "a"), (None, "a")], "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("text_key"))
    assert sorted(without(docs, gone).collect(), key=str) == sorted([(1, None, None), (2, "b", None)], key=str)
