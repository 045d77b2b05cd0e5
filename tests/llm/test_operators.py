"""The operators against plain forms of their contracts, on a table with every awkward case, and on the smallest tables."""

import math
import random
import sys
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[1]))
import brute
from compare import duck, same

from caretrail.llm import chat, components, decontamination, language_model, line_dedup, mixing, near_text, quality_classifier, quality_rules, queries, secrets, simhash, suffix_dedup

SF = "/root/testdata/sf0.001"
#: Extra columns with names that the operators use themselves.
CLASH = ["rid", "ord", "batch", "text_key", "row", "size", "target", "hash", "w", "words", "fp", "score", "lines", "n", "copies", "kept", "spans", "first"]


def sentences(seed, n):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "mo", "ri", "tel", "sun", "é") for b in ("la", "ne", "dor", "mi", "st")]
    return " ".join(r.choice(words) for _ in range(n))


SHARED = sentences(99, 40)
TEXTS = [
    (1, sentences(1, 120)),
    (2, sentences(1, 120)),  # exact copy
    (3, sentences(1, 119) + " changed"),  # near copy
    (4, None),
    (5, ""),
    (6, " \t\n \x0b"),
    (7, sentences(7, 30) + "\n" + SHARED),
    (8, SHARED + "\n" + sentences(8, 30)),
    (9, "a" * 300),
    (10, "b" + "a" * 200 + "b"),
    (11, "one two three four"),
    (12, ("same line of some words here\n" * 20) + "end"),
    (13, sentences(13, 6000)),  # very long
    (14, "ABC! " * 40),
    (15, "password = hunter2hunter2 AKIA" + "A" * 16 + " token=ab secret:token = abcdefgh\n" + "deadbeef" * 5 + " ünï"),
    (16, "user: admin key Zx9yQw8eRt7uYi6oPa5sDf4g https://a.example/x " + "filler " * 80 + " user: nobody"),
    (None, sentences(1, 120)),
    (17, "\x00 control \x1c words 　wide \U0001f600 smile"),
    (18, "ties ties ties"),
    (18, "ties ties ties"),  # a repeated row
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}" if i != 5 else None) for i, t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def by_id(df, *cols):
    return Counter((r["doc_id"], *[r[c] for c in cols]) for r in df.collect())


def want(f):
    return Counter((i, *f(t)) for i, t in TEXTS)


def test_secrets(docs, empty):
    found = secrets.scan_secrets(docs)
    written = {}
    for r in found.collect():
        base = [s for s in r.spans if s["rank"] < 3]
        n = Counter(s["kind"] for s in base)
        written.setdefault(r.doc_id, []).append((n["assign"], n["access"], n["hex"], brute.sha(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base))))
    assert Counter((i, *x) for i, xs in written.items() for x in xs) == want(brute.secrets)
    near = {r.doc_id: [s["kind"] for s in r.spans] for r in found.collect()}
    assert near[16] == ["weak_access", "weak_secret", "endpoint"]  # the lone account far behind is not reported
    assert secrets.scan_secrets(empty).count() == 0


def test_scopes_against_brute_force(spark):
    r = random.Random(5)
    texts = []
    for i in range(40):
        t = ""
        for _ in range(12):
            t += " " + "x " * r.choice([3, 40, 150]) + r.choice(["user: bob", "Zx9yQw8eRt7uYi6oPa5sDf4g", "10.1.2.3", "AKIA" + "B" * 16, "AKIA" + "C" * 10, "deadbeef" * 4, "login: aZx9yQw8eRt7uYi6oPa5sDf4g", "https://a.example/Zx9yQw8eRt7uYi6oPa5sDf4g/x"])
        texts.append((i, t))
    got = secrets.scan_secrets(spark.createDataFrame(texts, "doc_id long, text string"))
    import re

    for row in got.collect():
        t, parts = dict(texts)[row.doc_id], []
        for rank, (kind, part, strong, pattern, holds) in enumerate(secrets.KINDS):
            for m in re.finditer(pattern.replace("\\x20", " "), t):
                s = m[0]
                if kind == "assign" and len(m[2]) < 6 or kind == "weak_secret" and not (re.search("[a-z]", s) and re.search("[A-Z]", s) and re.search("[0-9]", s)):
                    continue
                parts.append((m.start(), rank, kind, m.end(), part, strong))
        def shared(p):
            return p[4] == "secret" and any(q[4] == "access" and q[0] < p[3] and q[3] > p[0] for q in parts)  # noqa: B023

        def near(p, what):
            found = [q for q in parts if q[4] == what and not shared(q)]  # noqa: B023
            return any(p[0] - secrets.SCOPE < q[3] <= p[0] or p[3] <= q[0] < p[3] + secrets.SCOPE for q in found)

        need = {"access": lambda p: near(p, "secret"), "secret": lambda p: not shared(p) and (near(p, "access") or near(p, "endpoint")), "endpoint": lambda p: near(p, "access") and near(p, "secret")}
        assert [tuple(s) for s in row.spans] == sorted(p[:4] for p in parts if p[5] or need[p[4]](p))


def test_no_candidate_confirms_itself(spark):
    token = "Zx9yQw8eRt7uYi6oPa5sDf4g"
    texts = {1: f"login: {token}", 2: f"see https://a.example/{token}/page", 3: f"login: {token} https://a.example/x", 4: f"login: bob {token}", 5: f"https://a.example/{token} and user: bob", 6: f"login: {token} other {token[::-1]}"}
    got = {r.doc_id: [(s["kind"], s["start"]) for s in r.spans] for r in secrets.scan_secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [], 3: [], 4: [("weak_access", 0), ("weak_secret", 11)], 5: [("weak_secret", 10), ("weak_access", 47)], 6: [("weak_access", 0), ("weak_secret", 38)]}


def test_quality_rules(docs, empty):
    out = quality_rules.quality_rules(docs)
    assert by_id(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want(brute.rules)
    assert all(not r.kept for r in out.collect() if r.base_failed)
    assert quality_rules.quality_rules(empty).count() == 0


def test_fences_keep_the_ordinary(spark):
    rows = [(i, sentences(i, 60), "en", "s") for i in range(200)] + [(999, " ".join(w + "#$%" for w in sentences(999, 60).split()), "en", "s")]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept.pop(999) and all(kept.values())


def test_fences_against_plain_quartiles(spark):
    """`kept` from the figures, with exact quartiles (the sketches are exact for groups of this size)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string")))
    junk = docs.where("doc_id % 40 = 0").select((F.col("doc_id") + 100000).alias("doc_id"), F.concat("text", F.lit("\n#|#|# * $$ % | "), F.repeat(F.lit("|# "), 60)).alias("text"), "lang", "source", "n_chars")
    rows = quality_rules.quality_rules(docs.unionByName(junk)).toPandas()
    good = rows[~rows.base_failed]

    def quantile(values, rank):
        v = sorted(values)
        return v[min(len(v) - 1, max(0, math.ceil(rank * len(v)) - 1))]

    groups, langs = dict(list(good.groupby(["lang", "source"]))), dict(list(good.groupby("lang")))
    wrong = []
    for r in rows.itertuples():
        kept, near = not r.base_failed, False
        g = groups.get((r.lang, r.source))
        for name, size, event, low in quality_rules.FIGURES if kept and g is not None else []:
            q1, q3, n = quantile(g[name], 0.25), quantile(g[name], 0.75), max(getattr(r, size), 1)
            all_ = langs[r.lang][name]
            spread = max(q3 - q1, quantile(all_, 0.75) - quantile(all_, 0.25)) * math.sqrt(max(quantile(g[size], 0.5) / n, 1)) + event / n
            x, edge = getattr(r, name), quality_rules.FENCE * spread
            kept &= x <= q3 + edge and not (low and x < q1 - edge)
            near |= abs(x - q3 - edge) < 1e-9
        if kept != r.kept and not near:
            wrong.append(r.doc_id)
    assert not wrong and not rows[rows.doc_id >= 100000].kept.any() and rows[rows.doc_id < 100000].kept.mean() > 0.8


def test_substrings(docs, empty):
    plain = brute.substring_dedup({math.inf if i is None else i: t for i, t in TEXTS})
    out = suffix_dedup.suffix_dedup(docs)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), brute.sha(bytes(r.kept))) for r in out.collect())
    assert got == Counter((i, *plain[math.inf if i is None else i]) for i, _ in TEXTS)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"ab", b"ba", b"abc" * 9, b"\x00", b"\xff"]), min_size=1, max_size=60))
def test_suffix_array(parts):
    text = np.frombuffer(b"".join(parts), np.uint8)
    order, raw = suffix_dedup.suffix_array(text), text.tobytes()
    assert sorted(order.tolist()) == list(range(len(raw)))
    w = suffix_dedup.WIDTH
    heads = [raw[i : i + w] for i in order]
    assert heads == sorted(heads)
    shared = suffix_dedup.common_prefixes(text, order).tolist()
    for k in range(1, len(heads)):
        a, b = raw[order[k - 1] :][:w].ljust(w, b"\x00"), raw[order[k] :][:w].ljust(w, b"\x00")
        assert shared[k] == next((i for i in range(w) if a[i] != b[i]), w)


def test_substrings_at_random(spark):
    r = random.Random(3)
    pool = [sentences(i, 30) for i in range(6)] + ["x" * 90, "ab" * 60]
    texts = {i: "".join(r.choice(pool)[r.randrange(20) :] for _ in range(r.randrange(6))) for i in range(60)}
    plain = brute.substring_dedup(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for row in suffix_dedup.suffix_dedup(df).collect() + suffix_dedup.suffix_dedup(df, crowded=1).collect():
        assert (row.n_bytes, row.n_removed, len(row.spans), brute.sha(bytes(row.kept))) == plain[row.doc_id]


def test_simhash(docs, empty):
    groups = simhash.simhash_groups(docs)
    prints = {k: brute.simhash(t) for k, (_, t) in enumerate(TEXTS)}
    top = brute.components(prints)
    ids = {}
    for k, c in top.items():
        ids.setdefault(c, []).append(TEXTS[k][0])
    least = {c: min([i for i in v if i is not None], default=None) for c, v in ids.items()}
    expected = Counter((TEXTS[k][0], prints[k], least[top[k]]) for k in prints)
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in groups.collect()) == expected
    assert simhash.simhash_groups(empty).count() == 0
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(x for x in least.values())
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_anchor_links_lose_none(spark):
    r = random.Random(8)
    prints = {r.getrandbits(64) for _ in range(60)}
    prints |= {p ^ 1 << r.randrange(64) for p in list(prints)} | {p ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for p in list(prints)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = sorted((x.a % (1 << 64), x.b % (1 << 64)) for x in simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)).collect())
    pairs = [(a, b) for a in signed for b in signed if a < b and (a ^ b).bit_count() <= 2 or a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2]
    assert got == sorted((a % (1 << 64), b % (1 << 64)) for a, b in set(pairs))


def test_near_texts_against_brute_force(spark):
    """Copies with some words changed, a crowd around one original, short and empty texts."""
    import corpus_pipeline as pipeline

    r = random.Random(11)
    texts = {1000: None, 1001: "", 1002: " \t", 1003: "One two three", 1004: "one two  THREE", 1005: "one two four"}
    for i in range(30):
        w = sentences(500 + i, r.choice([8, 60, 200])).split()
        for k in range(4):
            texts[i * 10 + k] = " ".join(x if r.random() > 0.01 * k else "changed" for x in w)
    w = sentences(900, 150).split()
    texts |= {2000 + k: " ".join([*w[: 4 * k % 150], f"new{k}", *w[4 * k % 150 :]]) for k in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    top = brute.jaccard_groups(texts)
    assert {x.doc_id for x in pipeline.drop_near_duplicates(spark, docs, "").collect()} == set(top.values())
    bits = brute.components({i: brute.simhash(t) for i, t in texts.items()})
    assert len(set(top.values())) < len(set(bits.values()))  # more than two bits apart, and near all the same
    assert near_text.near_groups(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    top = list(range(1100))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for pair in links for i in pair if find(i) != i}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, docs, empty):
    items = {"1": sentences(13, 6000)[500:700], "2": "three", "10": "", "3": SHARED, "4": "two, THREE four"}
    bench = spark.createDataFrame([*items.items(), ("5", None)], "item_id string, text string")
    out = decontamination.find_items(docs, bench)
    got = Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.n_hit > 0) for r in out.collect())
    assert got == want(lambda t: brute.decontamination(t, items))
    assert all(r.n_hit == 0 for r in decontamination.find_items(docs, bench.limit(0)).collect())
    assert decontamination.find_items(empty, bench).count() == 0


def test_decontamination_with_a_large_benchmark(spark):
    """Over 100,000 shingles: the filter lets some others through, the result is the same, and no texts are written."""
    r = random.Random(17)
    words = [f"w{k:04}" for k in range(5000)]
    items = {f"i{k}": [r.choice(words) for _ in range(45)] for k in range(2600)}
    docs, want = [], {}
    for d in range(60):
        text, found = [r.choice(words) for _ in range(r.randrange(5, 300))], {}
        for _ in range(d % 3):
            item = f"i{r.randrange(2600)}"
            at, n = r.randrange(0, 45 - 14), r.randrange(9, 15)
            text += [r.choice(words), *items[item][at : at + n], "stop"]
            if n >= 10:
                found[item] = max(found.get(item, 0), n)
        docs.append((d, " ".join(text)))
        want[d] = set(found)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id string, text string")
    shingles = decontamination.shingles_of(decontamination.benchmark_windows(bench))
    n = shingles.select("token").distinct().count()
    assert n > 100_000
    got = {x.doc_id: set(x["items"]) for x in decontamination.find_items(df, bench).collect()}
    assert got == want
    rows = df.select(decontamination.item_words(F.col("text")).alias("w"))
    kept = decontamination.with_stretches(rows, shingles).select(F.size("w").alias("w"), F.size("tokens").alias("t"), F.aggregate("stretches", F.lit(0), lambda a, x: a + F.size(x["words"])).alias("s")).agg(F.sum("w"), F.sum("t"), F.sum("s")).first()
    assert kept[2] < 0.1 * kept[0] and kept[1] < 0.2 * kept[0]


def test_line_dedup(spark, empty):
    line, other = "a boilerplate line that many sites have", "another line on nearly as many sites"
    rows = [(i, f"own text of document number {i}\n {line}\t\n" + (other if i < 9 else "tail"), f"site{i}") for i in range(30)]
    rows += [(100, None, None), (None, line, "site0"), (101, "", "s"), (102, "short\nshort", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lines", F.lit(1))
    got = {r.row.doc_id: r for r in line_dedup.dedup_lines(docs, min_words=5).collect()}
    assert got[0].n_removed == 0 and line in got[0].text
    assert all(got[i].n_removed == 1 and line not in got[i].text for i in range(1, 30))
    assert all(other in got[i].text for i in range(9))
    assert got[None].text == "" and got[100].text is None and got[102].text == "short\nshort"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_pipeline_removes_short_boilerplate(spark):
    import corpus_pipeline as pipeline

    rows = [(i, f"Home.\n \nown text of document {i}\n" + ("And so.\n" if i < 9 else "") + " Home.", f"site{i % 12}") for i in range(30)] + [(40, "Home.", "site0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert got == {i: t if i == 0 else t.replace(" Home.", "").replace("Home.\n", "", 1).removesuffix("\n") for i, t, _ in rows if i != 40}
    every = line_dedup.dedup_lines(docs).collect()
    assert {r.row.doc_id: r.n_removed for r in every} == {i: 0 if i == 0 else 1 if i == 40 else 2 for i, _, _ in rows}  # every line that holds a word counts
    assert all(r.n_removed == 0 for r in line_dedup.dedup_lines(docs, min_words=5).collect())


def test_line_dedup_by_names(spark):
    """Ids that are no numbers, and columns named like the operator's own."""
    rows = [(f"d{i:02}", f"Home.\ntext {i}", f"site{i % 12}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string").withColumns({c: F.lit("clash") for c in ("_key", "_of", "_lines", "gone", "ord", "n_lines")})
    got = {r.row.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {i: t if i == "d00" else t.removeprefix("Home.\n") for i, t, _ in rows}


def test_mixing(docs, empty):
    plan = mixing.mix_plan(docs)
    out = mixing.mix(docs, plan)
    sizes, source = Counter(), {}
    for i, t in TEXTS:
        source[i] = f"s{(i or 0) % 3}" if i != 5 else None
        sizes[source[i]] += len(brute.WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, sum(sizes.values())
    target, open_, left = {}, set(names), total
    while True:  # reshare until none is above its cap
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s], left = 3 * sizes[s], left - 3 * sizes[s]
            open_.remove(s)
    target |= share
    for r in out.collect():
        assert r.source_size == sizes[r.row.source] and math.isclose(r.target, target[r.row.source], rel_tol=1e-9)
        assert 0 <= r.copies <= 3
    again = mixing.mix(docs.repartition(5), mixing.mix_plan(docs))
    assert Counter((r.row.doc_id, r.copies) for r in again.collect()) == Counter((r.row.doc_id, r.copies) for r in out.collect())
    assert mixing.emit(out).columns == docs.columns
    assert mixing.mix(empty, mixing.mix_plan(empty)).count() == 0


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\0 \\1 back\\slash", "<|end|><|start|>", "", "a\nb", "\U0001f600 ü"]
    rows = [(c, t, ("user", "assistant", "system", "human")[(c + t) % 4], odd[(c * 3 + t) % 6]) for c in range(9) for t in range(c % 5)]
    rows += [(50, 0, None, None), (None, 0, "assistant", "x"), (60, 1, "assistant", "twice"), (60, 1, "assistant", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_chat(chat.canonical_turns(chat.from_turns(df)))
    for r in done.select("row.conv_id", "formatted", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        mine = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(x.role, x.text) for x in r.back] == [m[1:] for m in mine]
        assert r.loss == "".join(text for _, role, text in mine if role == "assistant")
        assert "[INST]" not in r.formatted and "</s>" not in r.formatted
    assert chat.format_chat(chat.canonical_turns(chat.from_turns(df.limit(0)))).count() == 0


def test_chat_layouts(spark):
    records = {
        '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}': ("messages", ["hi", "yo"]),
        '{"messages":[{"content":null,"role":"user"}]}': ("messages", [""]),
        '{"prompt":"p","completion":"c"}': ("prompt", ["p", "c"]),
        '{"output":"o","instruction":"i","input":"x"}': ("instruction-input", ["i\n\nx", "o"]),
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}': ("conversations", ["q", "a"]),
        '{"other":1}': (None, []),
        "no json": (None, []),
        None: (None, []),
    }
    df = spark.createDataFrame([(k,) for k in records], "record string").withColumn("turns", F.lit("clash"))
    for r in chat.canonical_turns(df).collect():
        assert (r.layout, [t.text for t in r.turns]) == records[r.row.record]


def test_language_model(docs, empty, spark):
    out, n = language_model.score_texts(docs, F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False)))
    cut = lambda t: [*(t or "").encode().lower().split(), b""]
    held = [(i or 0) % 4 == 1 if i is not None else False for i, _ in TEXTS]
    count = Counter(w for (_, t), h in zip(TEXTS, held, strict=True) if not h for w in cut(t))
    total, distinct = sum(count.values()), len(count)
    assert n == total
    base = lambda t: round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in cut(t)), 6)
    expected = Counter((i, h, len(cut(t)), sum(count[w] > 0 for w in cut(t)), base(t)) for (i, t), h in zip(TEXTS, held, strict=True))
    got = out.collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert language_model.score_texts(empty, F.lit(False))[0].count() == 0


def plain_logs(p, x, y, h):
    """ln P(y) step by step for one lane, and the state after it, from the parameters alone."""
    lm, out = language_model, []
    n = lm.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    soft = lambda v: v - np.log(np.exp(v).sum())
    for a, b in zip(x, y, strict=True):
        g, u = p["e"][a // lm.BUCKETS] + p["w"][a], h @ p["u"]
        z, r = sig(g[:n] + u[:n]), sig(g[n : 2 * n] + u[n : 2 * n])
        h = (1 - z) * np.tanh(g[2 * n :] + r * u[2 * n :]) + z * h
        c = b // lm.BUCKETS
        inner = 0.0 if c == 0 else soft(h @ p["v"][c] + p["c"][c])[b % lm.BUCKETS]
        out.append(soft(h @ p["o"] + p["b"])[c] + inner)
    return out, h


def random_buckets(r, size):
    """Buckets with the end token among them, which is alone in its class."""
    b = r.integers(0, language_model.CLASSES, size) * language_model.BUCKETS + r.integers(0, language_model.BUCKETS, size)
    return np.where(b < language_model.BUCKETS, language_model.END, b)


def test_network_gradient():
    """The window's backpropagation against finite differences."""
    r = np.random.default_rng(0)
    p = {k: r.standard_normal(s) * 0.3 for k, s in language_model.SHAPES.items()}
    x, y = random_buckets(r, (2, 5, 3))
    on = r.random((5, 3)) < 0.8
    h = r.standard_normal((3, language_model.HIDDEN))

    def loss(q):
        return -sum(sum(v * o for v, o in zip(plain_logs(q, x[:, k], y[:, k], h[k])[0], on[:, k], strict=True)) for k in range(3)) / on.sum()

    trainer = language_model.Trainer(p)
    grads = {}
    trainer._update = grads.update
    trainer.window(x, y, on, h)
    assert set(grads) == set(p)
    for k in p:
        places = np.argwhere(np.abs(grads[k]) > 1e-4)
        assert len(places)
        for at in [tuple(places[r.integers(len(places))]) for _ in range(4)] + [tuple(r.integers(0, n) for n in p[k].shape) for _ in range(2)]:
            if k == "e" and at[0] == 0 or k == "w" and 0 < at[0] < language_model.BUCKETS:
                continue
            up = {**p, k: p[k].copy()}
            down = {**p, k: p[k].copy()}
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert math.isclose((loss(up) - loss(down)) / 2e-5, grads[k][at], rel_tol=2e-2, abs_tol=2e-5)


def test_state_is_carried_across_windows():
    """A text's likelihood is that of one unbroken pass, however many windows it takes."""
    r = np.random.default_rng(2)
    p = {k: (r.standard_normal(s) * 0.3).astype(np.float32) for k, s in language_model.SHAPES.items()}
    sizes = np.array([70, 0, 5, 33])
    buckets = random_buckets(r, sizes.sum())
    buckets[buckets == 0] = language_model.BUCKETS
    got, at = language_model.log_likelihoods(p, buckets, sizes), 0
    for n, value in zip(sizes, got, strict=True):
        line = [*buckets[at : at + n], language_model.END]
        logs, _ = plain_logs(p, [language_model.END, *line[:-1]], line, np.zeros(language_model.HIDDEN))
        at += n
        assert math.isclose(sum(logs), value, rel_tol=1e-4)


def test_words_are_cut_as_bytes_are():
    texts = ["", " \t\n", "A b\x0bA", "\x0c Été\u3000x\x1cy\x85z \r\nA", "a\x00B", "word"]
    ids, sizes, words = language_model.tokens_of([t.encode() for t in texts])
    plain = [t.encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in plain]
    assert [words[i] for i in ids] == [w for t in plain for w in t]
    assert len(set(words)) == len(words) == len({w for t in plain for w in t})
    ids, sizes, words = language_model.tokens_of([b"", b" "])
    assert not len(ids) and not len(words) and sizes.tolist() == [0, 0]


def test_scoring_stays_in_small_blocks():
    """Outputs of many states are worked out in blocks: what one thread holds at once does not leave the processor's cache far behind."""
    r = np.random.default_rng(4)
    sizes = np.full(256, 250)
    buckets = random_buckets(r, sizes.sum())
    buckets[buckets == 0] = language_model.BUCKETS
    p = language_model.start_parameters()
    language_model.log_likelihoods(p, buckets, sizes)
    tracemalloc.start()
    try:
        language_model.log_likelihoods(p, buckets, sizes)
        assert tracemalloc.get_traced_memory()[1] < 12 << 20
    finally:
        tracemalloc.stop()


def test_scores_against_a_plain_pass(docs, spark):
    """`score` of every text from the trained parameters, word by word, with shares counted over the whole table."""
    lm = language_model
    held = lambda i: i is not None and i % 4 == 1
    rows = spark.createDataFrame([(i, t) for i, t in TEXTS], "doc_id long, text string")
    out, _ = lm.score_texts(rows, F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False)))
    train = rows.where(~F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False)))
    p = lm.unpack(lm.train_network(train.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("ord"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))))
    cut = lambda t: (t or "").encode().lower().split()
    count = Counter(w for i, t in TEXTS if not held(i) for w in cut(t))
    bucket = lambda w: int(lm.buckets_of([w])[0])
    tokens, distinct = Counter(), Counter()
    for w, n in count.items():
        tokens[bucket(w)] += n
        distinct[bucket(w)] += 1
    plain = Counter()
    for i, t in TEXTS:
        w = cut(t)[:400]  # the plain pass is slow; the long text is checked by its n_tokens alone
        if len(cut(t)) > 400:
            continue
        line = [*map(bucket, w), lm.END]
        logs, _ = plain_logs(p, [lm.END, *line[:-1]], line, np.zeros(lm.HIDDEN))
        share = sum(math.log10((count[x] + 0.5) / (tokens[bucket(x)] + 0.5 * (distinct[bucket(x)] + 1))) for x in w)
        plain[i, round(sum(logs) / math.log(10) + share, 2)] += 1
    got = Counter((r.doc_id, round(r.score, 2)) for r in out.collect() if r.n_tokens <= 401)
    assert sum(got.values()) == sum(plain.values())
    assert all(any(abs(v - u) <= 0.011 + 1e-4 * abs(v) for j, u in plain if j == i) for i, v in got)


def test_one_model_however_the_table_is_split(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    scores = []
    for n in (1, 4, 16):
        out, _ = language_model.score_texts(docs.repartition(n), F.col("doc_id") % 5 == 1)
        scores.append({r.doc_id: (r.score, r.base_score) for r in out.collect()})
    for other in scores[1:]:
        assert set(other) == set(scores[0])
        assert all(math.isclose(a, b, rel_tol=1e-6) for i in other for a, b in zip(other[i], scores[0][i], strict=True))


def test_network_tells_words_apart(spark):
    """A word's score depends on the words before it, beyond its class: after training on two fixed orders, the learnt one is likelier."""
    rows = [(i, " ".join(("red apple blue stone " if i % 2 else "blue stone red apple ") * 60)) for i in range(60)]
    test = [(1000, "red apple " * 40), (1001, "red stone " * 40), (1002, "blue stone " * 40), (1003, "blue apple " * 40)]
    out, _ = language_model.score_texts(spark.createDataFrame(rows + test, "doc_id long, text string"), F.col("doc_id") >= 1000)
    got = {r.doc_id: r.score for r in out.where("doc_id >= 1000").collect()}
    assert got[1000] > got[1001] and got[1002] > got[1003]


def test_quality_classifier(spark, docs, empty):
    good, bad = [(i, sentences(i, 80)) for i in range(120)], [(1000 + i, sentences(i, 40).upper().replace(" ", "!! ")) for i in range(60)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (5, None, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.row.doc_id: r.score for r in quality_classifier.score_quality(d, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all((got[i] >= 0.5) == (i < 1000) for i in held)
    assert len(quality_classifier.score_quality(docs, labels).collect()) == len(TEXTS)
    assert all(r.score == 0.5 for r in quality_classifier.score_quality(docs, labels.limit(0)).collect())
    assert quality_classifier.score_quality(empty, labels).count() == 0


def plain_statistics(t):
    import re

    t = t or ""
    w, n = brute.WORD.findall(t), max(len(brute.WORD.findall(t)), 1)
    chars = len(re.sub(r"[ \t\n\x0b\x0c\r]", "", t))
    spread = lambda v: (math.sqrt(max(sum(x * x for x in v) / max(len(v), 1) - (sum(v) / max(len(v), 1)) ** 2, 0)) / (sum(v) / len(v)) if sum(v) else 0.0)
    return [
        len(w), chars / n, spread([len(x) for x in w]), math.log(len(set(w)) + 1) / math.log(n + 1), sum(x.lower() in quality_classifier.FUNCTION_WORDS for x in w) / n,
        len(re.findall(r"[#$%&*<>|~^=+@_{}\[\]\\/]", t)) / max(chars, 1), len(re.findall("[A-Z]", t)) / max(chars, 1), len(re.findall("[0-9]", t)) / max(chars, 1),
        len(re.findall(r"[.,;:?!()'\"-]", t)) / n, t.count("\n") / n, spread([len(x) for x in t.split("\n")]), len(re.findall(r"(?<!\S)(\S+)(?: \1){2}(?!\S)", t)) / n,
    ]


def test_statistics_and_compiled_rules_against_numpy(spark):
    """The columns of statistics, and the compiled score, against plain forms for every document of the smallest table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n "), (-4, "a a a a b b b")], "doc_id long, text string"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bias, rules = quality_classifier.learn(docs, labels)
    assert rules
    texts, scores = {r.doc_id: r.text for r in docs.collect()}, {r.row.doc_id: r.score for r in quality_classifier.score_quality(docs, labels).collect()}
    plain = {i: plain_statistics(t) for i, t in texts.items()}
    got = quality_classifier.text_statistics(docs, [F.col("doc_id")], F.coalesce("text", F.lit(""))).collect()
    for r in got:
        assert np.allclose(r[1:], plain[r.doc_id], rtol=1e-9, atol=1e-7), (r, plain[r.doc_id])
    at = {r.doc_id: r[1:] for r in got}
    for i, x in at.items():
        z = bias + sum(weight for weight, path in rules if all((x[f] <= edge) == low for f, edge, low in path))
        assert math.isclose(scores[i], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_no_more_rows_are_learnt_from_than_the_sample(spark):
    docs = spark.createDataFrame([(1, sentences(1, 50))] * 500 + [(i, sentences(i, 50)) for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    import unittest.mock as mock

    with mock.patch.object(quality_classifier, "fit_rules", side_effect=quality_classifier.fit_rules) as fit:
        quality_classifier.learn(docs, labels, sample=10)
    assert len(fit.call_args[0][1]) == 10


def test_classifier_on_held_out(spark):
    out = queries.QUERIES["op8_quality_classifier"](spark, SF)
    right = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.9


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), duck(SF), queries.SQL[name])


def test_pipeline(spark):
    """Stage by stage against plain forms of what each must keep."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    made, frame = {}, docs
    for name, stage in pipeline.STAGES:
        from caretrail.llm.common import materialize

        frame = materialize(stage(spark, frame, SF), "test")
        assert frame.columns == docs.columns
        made[name] = {r.doc_id: r for r in frame.collect()}
    quality = made["quality classifier"]
    scores = {r.row.doc_id: r.score for r in quality_classifier.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(quality) == {i for i, s in scores.items() if s >= 0.5}
    lines = made["line dedup"]
    left = brute.lines({i: (r.text, r.source) for i, r in quality.items()})
    assert {i: r.text for i, r in lines.items()} == {i: t for i, (t, n) in left.items() if not n or t.strip(" \t\n\x0b\x0c\r")}
    assert all(r.n_chars == len(r.text) for i, r in lines.items() if left[i][1])
    near = made["simhash near-dedup"]
    top = brute.jaccard_groups({i: r.text for i, r in lines.items()})
    assert set(near) == set(top.values()) and all(near[i].text == lines[i].text for i in near)
    items = {str(r.item_id): r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    clean = made["benchmark decontamination"]
    assert set(clean) == {i for i, r in near.items() if not brute.decontamination(r.text, items)[4]}
    assert all(clean[i].text == near[i].text for i in clean)
    # each document at most three times, each source near its target
    size = {i: len(brute.WORD.findall(r.text)) for i, r in clean.items()}
    taken, target = Counter(), {r.source: (r.target, r.source_size) for r in mixing.mix_plan(spark.createDataFrame(list(clean.values()))).collect()}
    times = Counter(r.doc_id for r in frame.collect())
    for i, n in times.items():
        assert n <= 3 and made["mixing sources"][i].text == clean[i].text
        taken[clean[i].source] += n * size[i]
    largest = {s: max(size[i] for i in clean if clean[i].source == s) for s in target}
    assert all(abs(taken[s] - want) <= max(largest[s], 0.25 * want) for s, (want, _) in target.items())
    assert Counter(r.doc_id for r in pipeline.run(spark, SF).collect()) == times


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0


def test_pipeline_with_clashing_columns(spark):
    """Columns named like the stages' own, null ids and repeated rows."""
    import corpus_pipeline as pipeline

    rows = [(i, sentences(i % 7, 80), "en", f"s{i % 3}", 1) for i in range(14)] + [(None, sentences(50, 60), None, None, None), (3, sentences(3, 80), "en", "s0", 1), (20, None, "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ["_id", "_key", "_of", "_gone", "_twice", "_plan", *CLASH]:
        docs = docs.withColumn(c, F.lit("clash"))
    for name, stage in pipeline.STAGES[1:]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.collect()]
        if name == "simhash near-dedup":
            assert sorted(ids, key=str) == sorted([*range(7), 20, None], key=str)


def test_pipeline_from_near_stage_on(spark):
    """The stages from the near-duplicates on, against groups by shingles."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    near = pipeline.drop_near_duplicates(spark, docs, SF).cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in near.collect()}
    assert set(kept) == set(brute.jaccard_groups(texts).values()) and near.columns == docs.columns
    items = {str(r.item_id): r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    clean = pipeline.drop_leaks(spark, near, SF).cache()
    assert {r.doc_id for r in clean.collect()} == {i for i, t in kept.items() if not brute.decontamination(t, items)[4]}
    assert {r.doc_id for r in pipeline.mix_sources(spark, clean, SF).collect()} <= {r.doc_id for r in clean.collect()}
    near.unpersist(), clean.unpersist()


def test_rest_imports_without_this_subpackage():
    import subprocess

    code = "import sys; sys.modules['caretrail.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2])
