"""The prefix trie against a plain form of the contract, in one shard and in many."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from caretrail.llm import prefix_trie

CLASH = ["key", "shard", "ids", "chars", "own", "family", "depth", "open"]


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(("" if c is None else str(c)).encode()) % 6
        base = ts if c is None else own.get(c - int(c / 100) * 100 if c < 0 else c - c % 100, [])
        if c is not None and c < 0:
            base = own.get(c + (-c) % 100, [])
        built[c] = tuple(base[:h]) + tuple(ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    order = lambda c: (c is not None, c or 0)
    small = {p: min((c for c in cs if c is not None), default=None) for p, cs in members.items()}
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    return Counter(
        (small[p], len(p), small[p[:-1]] if p else None, len(cs), kids[p], leaves[p], saved[p], hashlib.sha256(",".join("" if c is None else str(c) for c in sorted((c for c in cs if built[c] == p), key=order)).encode()).hexdigest())
        for p, cs in members.items()
    )


def awkward():
    r = random.Random(4)
    rows = [(c, k, r.choice(["user", "assistant"]), r.choice(["a", "bb", "", "ünï"])) for c in range(240) for k in range(r.randint(1, 9))]
    rows += [(c, k, "user", "same") for c in range(300, 420) for k in range(12)]  # copies, deeper than the shards' ranges tell
    rows += [(c, k, "user", f"long {k}" if k < 70 or c % 2 else f"other {c}") for c in range(500, 508) for k in range(75 + c % 3)]
    rows += [(None, 1, "user", "x"), (None, None, None, None), (-7, 0, "user", "minus"), (-107, 0, None, "minus"), (-100, 0, "user", "base")]
    rows += [(600, 0, "user", "t"), (600, 0, "assistant", "t"), (600, None, "user", "first"), (600, 0, "user", "t"), (703, 0, "user", "alone")]
    return rows


@pytest.mark.parametrize("turns", [10**6, 300, 40])
def test_against_plain_form(spark, monkeypatch, turns):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    rows = awkward()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in CLASH:
        df = df.withColumn(c, df.conv_id * 0)
    out = prefix_trie.prefix_trie(prefix_trie.rebuild(prefix_trie.turn_sequences(df.repartition(3))))
    assert Counter(tuple(r) for r in out.select(*prefix_trie.OUT).collect()) == plain(rows)


def test_whole_text_of_the_hash_streams_by(spark):
    import pandas as pd

    parts = [pd.DataFrame({"key": [1, 1], "ends": ["1,2", "3"]}), pd.DataFrame({"key": [1, 2], "ends": ["4", "9"]})]
    got = [tuple(r) for p in prefix_trie._stream_sha(iter(parts)) for r in p.itertuples(index=False)]
    assert got == [(1, hashlib.sha256(b"1,2,3,4").hexdigest()), (2, hashlib.sha256(b"9").hexdigest())]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.rebuild(prefix_trie.turn_sequences(df))).count() == 0
