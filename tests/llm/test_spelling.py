"""Spelling variants against a plain form of the contract."""

import random
import re
import zlib
from collections import Counter

from caretrail.llm import spelling

CLASH = ["id", "word", "n", "back", "rest", "node", "run", "h"]


def plain(rows):
    n = Counter()
    for i, t in rows:
        low = "".join(c.lower() if c < "\x80" else c for c in t or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {w: min((v for v in vs), key=lambda v: (-n[v], v)) if vs else None for w, vs in near.items()}
    form = {w: v if v and n[v] >= 2 * n[w] else None for w, v in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k:] == b[k + 1 :] or len(a) == len(b) and a[k + 1 :] == b[k + 1 :]


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASH:
        df = df.withColumn(c, df.doc_id * 0)
    return Counter(tuple(r) for r in spelling.spelling_groups(df.repartition(3)).select("word", "form", "root", "n", "n_near", "form_n").collect())


def edited(r, w):
    k, c = r.randrange(len(w) + 1), r.choice("abñé")
    return r.choice([w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :]])


def test_against_plain_form(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abc") for _ in range(r.randint(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÀÉàéñ", "Straße", "x" * 40, "x" * 41, "y" * 38 + "zz", "ab" * 300, "q" * 39]
    words = [w for b in base for w in (b, edited(r, b), edited(r, edited(r, b)))]
    rows = [(i, " ".join(r.choices(words, k=120)) + r.choice(["", " A1b two\nlines", " " + "w" * 500])) for i in range(25)]
    rows += [(None, "nulla nulla nulla"), (None, None), (100, ""), (101, " \x00 "), (102, "Words WORDS words word"), (102, "Words WORDS words word")]
    want = plain(rows)
    assert sum(1 for x in want if x[1]) > 20 and any(len(x[0]) > 41 and x[4] for x in want)
    assert got(spark, rows) == want


def test_chains_lead_to_their_end(spark):
    names = ["kabcde", "kabcdf", "kabcef", "kabxef"]
    text = " ".join(" ".join([w] * (3 * 3**k)) for k, w in enumerate(names))
    rows = [(i, text) for i in (1,)]
    found = {x[0]: x for x in got(spark, rows)}
    assert {w: found[w][2] for w in names} == dict.fromkeys(names, "kabxef")
    assert got(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert not got(spark, [])


def test_capitals_beyond_a_to_z_stay(spark):
    rows = [(i, "WORTE Worte worte ÀWORTE àworte Éworte éWORTE") for i in range(4)]
    assert got(spark, rows) == plain(rows)


def test_edges_are_added_up_in_place(spark):
    """A row per child and numbers alone in the aggregation: sets of strings fall back to sorts of whole tasks."""
    words = spark.createDataFrame([(1, "abcde"), (2, "abcdf"), (3, "abcef")], "id long, word string")
    edges = spelling.trie_edges(spelling._walkers(words))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    top = edges.where("depth = 2 AND ch = 'c' AND salt = 0").collect()
    # ab-c before d and e; backwards ed-c, fd-c and fe-c before b; two code points are left to each word's end
    assert sorted((r.lefts, bin(r.follow).count("1")) for r in top) == [(4, 1), (4, 1), (4, 1), (4, 2)]
