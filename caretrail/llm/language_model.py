"""Scoring with a gated recurrent language model.

The output softmax is factored: P(word | before) is P(class | state) times P(bucket | class, state) times the word's share of
its bucket in the training counts of the whole corpus. A word's class comes from its last bytes, its bucket within the class
from a hash of all of them, so that no table has to be learnt or sent around; only the words of one of the CLASSES * BUCKETS
buckets are told apart by counts alone. What goes in is the embedding of the last word's class plus that of its bucket.

The network (one layer of gated units) is trained in numpy by backpropagation truncated to WINDOW tokens. The training
documents are dealt to shards by a hash of their ids and texts, about SHARD_BYTES each, and are in order within a shard; so
neither the shards nor their models depend on how the table is partitioned. The shards' parameters are averaged by tokens, as
fixed-point numbers, whose sums have no order, in two rounds that together pass every training document once. As shards do not
shrink, more input means more models of the same training in the average. A document is scored whole, with the state carried
from window to window.

Word counts travel as packed messages between batches of documents and ranges of word hashes (64 bits), so that a word in
every document is one entry per batch. Documents of like length share a batch, as they step through their words together.

Defined cases: a null text is empty and has the end token alone; a null doc_id counts as the empty text in the split, hence is
learnt from; without training documents the counts are zero and the network is untrained; repeated rows have a row each (and
share a shard and a batch); words match by their bytes with A-Z lower-cased; an empty table gives no rows; further columns are
ignored; ids are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import crc_mod, materialize, table, text_of

HIDDEN, CLASSES, BUCKETS, SUFFIX = 16, 64, 32, 2
WINDOW, LANES, STRETCH, RATE = 16, 256, 256, 0.02
SHARD_BYTES, BATCH_BYTES, RANGE_BYTES, LEAST_PARTS = 8 << 20, 8 << 20, 16 << 20, 16
#: Embeddings of classes and buckets, recurrent weights, weights and bias of the classes and of the buckets of each class.
SHAPES = {
    "e": (CLASSES, 3 * HIDDEN), "w": (CLASSES * BUCKETS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN),
    "o": (HIDDEN, CLASSES), "b": (CLASSES,), "v": (CLASSES, HIDDEN, BUCKETS), "c": (CLASSES, BUCKETS),
}
POINT, STEP = float(1 << 20), 4096  # fixed point of averaged parameters; tokens for each unit of weight
MANY, BLOCK = 1 << 13, 1 << 10  # states whose outputs are worked out at once, and of these their logits of the classes
MOST_LOGIT = np.float32(60)
SOME = 1 << 14  # parameters that are updated at once
END = 0  # bucket and class of the end token, and its key; the class has no words


def buckets_of(words) -> np.ndarray:
    """class * BUCKETS + bucket of each word."""
    from xxhash import xxh32_intdigest

    hashes = lambda of: np.fromiter(of, np.int64, len(words))
    ends = hashes(xxh32_intdigest(w[-SUFFIX:]) for w in words)
    return (1 + ends % (CLASSES - 1)) * BUCKETS + hashes(map(xxh32_intdigest, words, repeat(1))) % BUCKETS


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts one after the other, the number of words of each, and the distinct words; Arrow cuts and numbers
    them, as an object for each token costs several times as much."""
    import pyarrow as pa
    import pyarrow.compute as pc

    bare = pc.ascii_lower(pc.ascii_trim_whitespace(pa.array(texts, pa.binary()).cast(pa.string())))
    cut = pc.ascii_split_whitespace(bare)
    blank = pc.equal(bare, "").to_numpy(zero_copy_only=False)  # cut to one empty word
    words = cut.flatten()
    if blank.any():
        words = words.filter(pc.not_equal(words, ""))
    words = words.dictionary_encode()
    sizes = np.where(blank, 0, np.diff(cut.offsets.to_numpy())).astype(np.int64)
    return words.indices.to_numpy(), sizes, words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)


# ---- the network ----


def start_parameters() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    out = {k: (rng.standard_normal(s) * 0.2).astype(np.float32) for k, s in SHAPES.items()}
    for k in "wbvc":
        out[k][:] = 0
    return out


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES]).astype(np.float64)


def unpack(flat) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = np.asarray(flat[at : at + n], np.float32).reshape(s)
        at += n
    return out


def inputs(p: dict[str, np.ndarray]) -> np.ndarray:
    """The embedding of each bucket, its class's included."""
    return (p["w"].reshape(CLASSES, BUCKETS, -1) + p["e"][:, None]).reshape(CLASSES * BUCKETS, -1)


def by_gate(a: np.ndarray) -> np.ndarray:
    """The three gates' columns as three arrays, so that what is done to one gate runs through adjoining memory."""
    return np.ascontiguousarray(a.reshape(len(a), 3, HIDDEN).swapaxes(0, 1))


def _gates(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and recurrent weights by gate; those of the gates z and r are halved, as 2 sigmoid(a) = 1 + tanh(a / 2)."""
    table, weights = by_gate(inputs(p)), by_gate(p["u"])
    table[:2] *= 0.5
    weights[:2] *= 0.5
    return table, weights


def _step(g: np.ndarray, weights: np.ndarray, h: np.ndarray, un: np.ndarray, out: np.ndarray) -> None:
    """The state after words of embeddings g, which become the gates z, r and the candidate; fills the recurrent part un and the state out."""
    u = np.matmul(h, weights)
    gates, n = g[:2], g[2]
    gates += u[:2]
    np.tanh(gates, out=gates)
    gates += 1
    gates *= 0.5
    np.multiply(g[1], u[2], out=un)
    n += un
    un[:] = u[2]
    np.tanh(n, out=n)
    np.subtract(h, n, out=out)
    out *= g[0]
    out += n


def _odds(logits: np.ndarray) -> np.ndarray:
    """Makes of the logits their exp, and gives the sums."""
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype)


class Outputs:
    """The two factors of the softmax for states and the buckets that follow them. That of the classes goes by blocks of BLOCK states,
    which stay in the cache; that of the buckets has the states grouped by class."""

    def __init__(self, p: dict[str, np.ndarray], top: np.ndarray, y: np.ndarray):
        self.p, self.top, self.of = p, top, y // BUCKETS
        self.reach = max(top.max(), -top.min()) if len(top) else 0.0
        self.order = np.argsort(self.of.astype(np.int16), kind="stable")
        of = self.of[self.order]
        edges = np.searchsorted(of, np.arange(CLASSES + 1)).tolist()
        self.ends = edges[1]  # states that the end token follows, which is alone in its class
        self.classes = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if c and a < b]
        self.grouped, self.inner = top.take(self.order, axis=0), np.zeros((len(y), BUCKETS), top.dtype)
        for c, at in self.classes:
            np.matmul(self.grouped[at], p["v"][c], out=self.inner[at])
        self.inner += p["c"].take(of, axis=0)
        self._cut(self.inner, "v", "c")
        self.at = np.arange(0, self.inner.size, BUCKETS) + (y - self.of * BUCKETS)[self.order]

    def blocks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """The states' slices, their logits of the classes, and where in those the logits of the classes that follow are."""
        logits = np.empty((min(BLOCK, len(self.top)), CLASSES), self.top.dtype)
        for a in range(0, len(self.top), BLOCK):
            at = slice(a, min(a + BLOCK, len(self.top)))
            block = np.matmul(self.top[at], self.p["o"], out=logits[: at.stop - a])
            block += self.p["b"]
            self._cut(block, "o", "b")
            yield at, block, np.arange(0, block.size, CLASSES) + self.of[at]

    def _cut(self, logits: np.ndarray, weights: str, bias: str) -> None:
        """Cuts the logits off far above what training gives; a pass that the weights seldom leave room for."""
        if self.reach * np.abs(self.p[weights]).sum(axis=-2).max() + self.p[bias].max() > MOST_LOGIT:
            np.minimum(logits, MOST_LOGIT, out=logits)

    def logs(self) -> np.ndarray:
        """Natural log of P(bucket | state)."""
        out = np.empty(len(self.top), self.top.dtype)
        for at, block, of in self.blocks():
            mine = block.take(of)
            out[at] = mine - np.log(_odds(block))
        mine = self.inner.take(self.at)
        mine -= np.log(_odds(self.inner))
        mine[: self.ends] = 0
        out[self.order] += mine
        return out

    def gradients(self, share: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the loss, each state weighing its share: by parameter, and by state."""
        p, kind = self.p, self.top.dtype
        grad, out, one = {k: np.zeros_like(p[k]) for k in "obvc"}, np.empty_like(self.top), np.ones(len(self.top), kind)
        for at, d, of in self.blocks():
            d *= (share[at] / _odds(d))[:, None]
            d.reshape(-1)[of] -= share[at]
            grad["o"] += self.top[at].T @ d
            grad["b"] += one[at] @ d
            np.matmul(d, p["o"].T, out=out[at])
        share, d = share[self.order], self.inner
        d *= (share / _odds(d))[:, None]
        d.reshape(-1)[self.at] -= share
        back = np.zeros_like(self.grouped)
        for c, at in self.classes:
            mine = d[at]
            np.matmul(self.grouped[at].T, mine, out=grad["v"][c])
            np.matmul(one[at], mine, out=grad["c"][c])
            np.matmul(mine, p["v"][c].T, out=back[at])
        out[self.order] += back
        return grad, out


class Trainer:
    """Adam on windows of WINDOW steps."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = {k: v.copy() for k, v in p.items()}
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.t = 0

    def window(self, x: np.ndarray, y: np.ndarray, on: np.ndarray, h: np.ndarray) -> np.ndarray:
        """x, y: buckets, on: steps x lanes. Learns from one window and gives the state after it."""
        p, (steps, lanes) = self.p, x.shape
        kind, (table, w) = p["u"].dtype, _gates(p)
        g = table.take(x, axis=1)
        states, un = np.empty((steps + 1, lanes, HIDDEN), kind), np.empty((steps, lanes, HIDDEN), kind)
        states[0] = h
        for t in range(steps):
            _step(g[:, t], w, states[t], un[t], states[t + 1])
        top, flat_on = states[1:].reshape(-1, HIDDEN), on.ravel()
        grad, d_top = Outputs(p, top, y.ravel()).gradients((flat_on / max(1, flat_on.sum())).astype(kind))
        d_top = d_top.reshape(steps, lanes, HIDDEN)
        z, r, n = g
        rest = 1 - z
        by_n, by_z, by_r = rest * (1 - n * n), (states[:-1] - n) * z * rest, un * r * (1 - r)
        # what reaches the gates' sums of inputs; of the candidate's, du has the recurrent part's, dn the word's
        du, dn, back = np.empty_like(g), np.empty_like(un), by_gate(p["u"]).swapaxes(1, 2)
        dh = np.zeros_like(states[0])
        for t in reversed(range(steps)):
            dh += d_top[t]
            np.multiply(dh, by_n[t], out=dn[t])
            np.multiply(dh, by_z[t], out=du[0, t])
            np.multiply(dn[t], by_r[t], out=du[1, t])
            np.multiply(dn[t], r[t], out=du[2, t])
            dh *= z[t]
            for part in np.matmul(du[:, t], back):
                dh += part
        of_u = np.matmul(states[:-1].reshape(-1, HIDDEN).T, du.reshape(3, -1, HIDDEN))
        grad["u"] = of_u.swapaxes(0, 1).reshape(p["u"].shape)
        du[2] = dn
        of_w, at = np.zeros((3, CLASSES * BUCKETS * HIDDEN), kind), (x.reshape(-1, 1) * HIDDEN + np.arange(HIDDEN)).ravel()
        for k in range(3):
            np.add.at(of_w[k], at, du[k].ravel())
        grad["w"] = of_w.reshape(3, -1, HIDDEN).swapaxes(0, 1).reshape(p["w"].shape)
        grad["e"] = grad["w"].reshape(CLASSES, BUCKETS, -1).sum(axis=1)
        self._update(grad)
        return states[-1]

    def _update(self, grad) -> None:
        self.t += 1
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        rate, ease = RATE / (1 - 0.9**self.t), 1 / math.sqrt(1 - 0.98**self.t)
        for k, grads in grad.items():
            flat = [a.reshape(-1) for a in (grads, self.m[k], self.v[k], self.p[k])]
            for at in range(0, grads.size, SOME):  # what fits the cache
                g, m, v, p = (a[at : at + SOME] for a in flat)
                g *= scale
                m *= 0.9
                m += 0.1 * g
                v *= 0.98
                g *= g
                g *= 0.02
                v += g
                root = np.sqrt(v)
                root *= ease
                root += 1e-8
                np.divide(m, root, out=root)
                root *= rate
                p -= root


def train_on(trainer: Trainer, buckets: np.ndarray, sizes: np.ndarray) -> None:
    """One pass over texts given by the buckets of their words, in stretches of STRETCH tokens in LANES lanes."""
    ends = np.cumsum(sizes + 1)
    line = np.full(int(ends[-1]), END, np.int64)  # words and end of each text
    word = np.ones(len(line), bool)
    word[ends - 1] = False
    line[word] = buckets
    before = np.concatenate([[END], line[:-1]])
    begin = np.concatenate([np.arange(a, e, STRETCH) for a, e in zip(ends - sizes - 1, ends, strict=True)])
    length = np.minimum(STRETCH, np.repeat(ends, -(-(sizes + 1) // STRETCH)) - begin)
    by = np.argsort(-length, kind="stable")
    groups = [by[i : i + LANES] for i in range(0, len(by), LANES)]
    for g in np.random.default_rng(len(line)).permutation(len(groups)):
        lanes = groups[g]
        at, n = begin[lanes], length[lanes]
        h = np.zeros((len(lanes), HIDDEN), np.float32)
        for t in range(0, int(n[0]), WINDOW):
            alive = int((n > t).sum())
            place = np.arange(t, min(t + WINDOW, int(n[0])))[:, None]
            on = place < n[None, :alive]
            where = np.where(on, at[None, :alive] + place, at[None, :alive])
            h = trainer.window(before[where], line[where], on, h[:alive])


def _logs(count: np.ndarray) -> np.ndarray:
    return np.log(count / count.sum(axis=-1, keepdims=True)).astype(np.float32)


def train_shard(flat: np.ndarray, fresh: bool):
    """Parameters, in fixed point times the weight, and weight of a model trained on one shard from `flat` on."""

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ord", "text"], kind="stable")
        trainer = Trainer(unpack(flat))
        ids, sizes, words = tokens_of(list(frame["text"]))
        buckets = buckets_of(words)[ids] if len(ids) else np.empty(0, np.int64)
        if fresh:  # the outputs start from the shard's own frequencies
            count = np.bincount(buckets, minlength=CLASSES * BUCKETS).reshape(CLASSES, BUCKETS)
            trainer.p["b"][:] = _logs(count.sum(axis=1) + np.where(np.arange(CLASSES) == END, len(sizes), 0) + 1.0)
            trainer.p["c"][:] = _logs(count + 1.0)
        train_on(trainer, buckets, sizes)
        weight = -(-(len(ids) + len(sizes)) // STEP)
        return pd.DataFrame({"p": [np.rint(pack(trainer.p) * POINT).astype(np.int64) * weight], "weight": [weight]})

    return train


def add_models(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of a task's models, which are exact."""
    total, weight = None, 0
    for frame in frames:
        for p, w in zip(frame["p"], frame["weight"], strict=True):
            total, weight = (p.copy() if total is None else total + p), weight + int(w)
    if total is not None:
        yield pd.DataFrame({"p": [total], "weight": [weight]})


def train_network(docs: DataFrame) -> np.ndarray:
    """docs (ord, text binary) -> averaged parameters: a first round over an eighth of the texts, a second over the others."""
    flat, part = pack(start_parameters()), F.pmod(F.xxhash64("ord", "text"), F.lit(8))
    sizes = docs.groupBy((part == 0).alias("first")).agg(F.sum(F.octet_length("text")).alias("n")).collect()  # two rows
    sizes = {r["first"]: r["n"] or 0 for r in sizes}
    fresh = True
    for first in (True, False):
        if first not in sizes:
            continue
        shards = sizes[first] // SHARD_BYTES + 1
        dealt = docs.where((part == 0) if first else (part != 0)).withColumn("shard", F.pmod(F.xxhash64("text", "ord"), F.lit(shards)))
        models = dealt.groupBy("shard").applyInPandas(train_shard(flat, fresh), "p array<long>, weight long").mapInPandas(add_models, "p array<long>, weight long")
        mean = models.select(F.posexplode("p").alias("i", "x"), "weight").groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("weight").alias("weight"))
        rows = mean.select("i", (F.col("x").cast("double") / F.col("weight") / POINT).alias("x")).toPandas()  # as many as the network has parameters
        flat[rows["i"].to_numpy()] = rows["x"].to_numpy()
        fresh = False
    return flat


def log_likelihoods(p: dict[str, np.ndarray], buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log of the network's P(buckets and end) for each text; all texts step together, the longest first."""
    out = np.zeros(len(sizes))
    if not len(sizes):
        return out
    by = np.argsort(-sizes, kind="stable")
    n = sizes[by] + 1
    alive = np.searchsorted(-n, -np.arange(n[0]), side="left")  # texts of more than t tokens
    edges = np.append(0, np.cumsum(alive))
    # tokens by step, then by text, and the tokens before them
    row = np.concatenate([np.arange(len(n), dtype=np.int32)[:k] for k in alive])
    place = edges[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] + np.repeat(np.arange(len(n)), n)
    line = np.full(len(place), END, np.int64)
    begin = np.cumsum(sizes) - sizes
    word = np.ones(len(place), bool)
    word[np.cumsum(n) - 1] = False
    line[place[word]] = buckets[np.repeat(begin[by], sizes[by]) + np.arange(len(buckets)) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1)]
    before = np.full(len(place), END, np.int64)
    before[place[np.append(False, word[:-1])]] = line[place[word]]
    (table, weights), h, t = _gates(p), np.zeros((len(n), HIDDEN), np.float32), 0
    edges = edges.tolist()
    while t < len(alive):
        first, start = t, edges[t]
        while t < len(alive) and (t == first or edges[t + 1] - start <= MANY):
            t += 1
        part = slice(start, edges[t])
        g, top = table.take(before[part], axis=1), np.empty((edges[t] - start, HIDDEN), np.float32)
        un = np.empty((edges[first + 1] - start, HIDDEN), np.float32)
        for k in range(first, t):
            a, b = edges[k] - start, edges[k + 1] - start
            _step(g[:, a:b], weights, h[: b - a], un[: b - a], top[a:b])
            h = top[a:b]
        out += np.bincount(row[part], Outputs(p, top, line[part]).logs(), len(out))
    back = np.empty(len(out))
    back[by] = out
    return back


# ---- counts and scores ----


class Words:
    """A batch's texts as word numbers, and its distinct words by hash."""

    def __init__(self, frame: pd.DataFrame):
        from xxhash import xxh64_intdigest

        self.ids, self.sizes, words = tokens_of(list(frame["text"]))
        self.train = ~frame["held_out"].to_numpy(bool)
        hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        hashes[hashes == END] = 1
        self.buckets = buckets_of(words)
        # entries: the end token (key 0), then the words by hash
        self.order = np.argsort(hashes, kind="stable")
        self.keys = np.append(np.uint64(END), hashes[self.order])

    def counts(self) -> np.ndarray:
        """Training count of each entry."""
        mine = np.bincount(self.ids[np.repeat(self.train, self.sizes)], minlength=len(self.order))
        return np.append(int(self.train.sum()), mine[self.order])

    def ranges(self, n: int):
        of = ((self.keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        at = np.flatnonzero(np.append(True, np.diff(of) > 0))
        for a, b in zip(at, [*at[1:], len(of)], strict=True):
            yield int(of[a]), slice(int(a), int(b))


def send_counts(n_ranges: int):
    def send(key, frame: pd.DataFrame) -> pd.DataFrame:
        w = Words(frame)
        counts, buckets = w.counts().astype(np.int64), np.append(END, w.buckets[w.order]).astype(np.uint16)
        rows = [(r, int(key[0]), w.keys[at].tobytes(), counts[at].tobytes(), buckets[at].tobytes()) for r, at in w.ranges(n_ranges)]
        return pd.DataFrame(rows, columns=["rng", "batch", "keys", "counts", "buckets"])

    return send


def answer_counts(key, frame: pd.DataFrame) -> pd.DataFrame:
    """To each batch the corpus counts of its entries; besides one row (batch -1) with tokens and distinct words by bucket."""
    sizes = np.array([len(x) // 2 for x in frame["buckets"]])
    k = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["keys"]])
    c = np.concatenate([np.frombuffer(x, np.int64) for x in frame["counts"]])
    every = np.concatenate([np.frombuffer(x, np.uint16) for x in frame["buckets"]])
    by = np.argsort(k, kind="stable")
    first = np.flatnonzero(np.append(True, k[by][1:] != k[by][:-1]))
    total = np.add.reduceat(c[by], first)
    back = np.empty(len(k), np.int64)
    back[by] = np.repeat(total, np.diff(np.append(first, len(k))))
    of, n = every[by][first], CLASSES * BUCKETS
    ends = np.cumsum(sizes)
    rows = [(int(b), int(key[0]), back[e - n : e].tobytes(), None, None) for b, n, e in zip(frame["batch"], sizes, ends, strict=True)]
    rows.append((-1, int(key[0]), None, np.bincount(of, total, n).astype(np.int64).tolist(), np.bincount(of[total > 0], minlength=n).tolist()))
    return pd.DataFrame(rows, columns=["batch", "rng", "counts", "tokens", "distinct"])


def score_batch(n_ranges: int, flat: np.ndarray, tokens: np.ndarray, distinct: np.ndarray):
    def score(key, frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"ord": [], "no_id": [], "held_out": [], "n_tokens": [], "n_known": [], "base": [], "score": []})
        w = Words(frame)
        by_range = dict(zip(answers["rng"], answers["counts"], strict=True))
        count = np.empty(len(w.keys), np.int64)
        for r, at in w.ranges(n_ranges):
            count[at] = np.frombuffer(by_range[r], np.int64)
        of_word = np.empty(len(w.order), np.int64)
        of_word[w.order] = count[1:]
        text = np.repeat(np.arange(len(w.sizes)), w.sizes)
        per_text = lambda x: np.bincount(text, x[w.ids], len(w.sizes))
        n, v = tokens.sum(), distinct.sum()
        base = np.log10((of_word + 0.5) / (n + 0.5 * (v + 1)))
        in_bucket = np.log10((of_word + 0.5) / (tokens[w.buckets] + 0.5 * (distinct[w.buckets] + 1)))
        network = log_likelihoods(unpack(flat), w.buckets[w.ids] if len(w.ids) else np.empty(0, np.int64), w.sizes) / np.log(10)
        return pd.DataFrame(
            {
                "ord": frame["ord"],
                "no_id": frame["no_id"],
                "held_out": frame["held_out"],
                "n_tokens": w.sizes + 1,
                "n_known": per_text((of_word > 0).astype(np.float64)).astype(np.int64) + int(count[0] > 0),
                "base": per_text(base) + np.log10((count[0] + 0.5) / (n + 0.5 * (v + 1))),
                "score": per_text(in_bucket) + network,
            }
        )

    return score


def _batches(docs: DataFrame) -> tuple[DataFrame, int]:
    """Adds `batch`: by size class (powers of two), about BATCH_BYTES each; gives the bytes of all texts too."""
    level = F.floor(F.log2(F.octet_length("text") + F.lit(1))).cast("int")
    sizes = {r["level"]: r["n"] for r in docs.groupBy(level.alias("level")).agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # at most 32 rows
    first, batch = 0, F.lit(0)
    for k in sorted(sizes):
        n = sizes[k] // BATCH_BYTES + 1
        batch = F.when(level == k, F.pmod(F.xxhash64("ord", "text"), F.lit(n)) + first).otherwise(batch)
        first += n
    return docs.withColumn("batch", batch.cast("int")), sum(sizes.values())


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) for each input row, and the number of training tokens.

    held_out: a boolean column; those rows are scored but not learnt from.
    """
    doc_id, text = F.col(id_col).cast("long"), text_of(text_col)
    rows = docs.select(
        F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("ord"), doc_id.isNull().alias("no_id"), held_out.alias("held_out"), F.encode(text, "UTF-8").alias("text")
    )
    flat = train_network(rows.where(~F.col("held_out")).select("ord", "text"))
    rows, total = _batches(rows)
    n_ranges = max(LEAST_PARTS, total // RANGE_BYTES + 1)
    texts = rows.groupBy("batch")
    asked = texts.applyInPandas(send_counts(n_ranges), "rng int, batch int, keys binary, counts binary, buckets binary")
    answers = materialize(
        asked.groupBy("rng").applyInPandas(answer_counts, "batch int, rng int, counts binary, tokens array<long>, distinct array<long>"), "word-counts"
    )
    sums = answers.where("batch = -1").select(F.posexplode(F.arrays_zip("tokens", "distinct")).alias("i", "x")).groupBy("i").agg(F.sum("x.tokens").alias("tokens"), F.sum("x.distinct").alias("distinct"))
    tokens, distinct = np.zeros(CLASSES * BUCKETS, np.int64), np.zeros(CLASSES * BUCKETS, np.int64)
    for r in sums.collect():  # one row per bucket
        tokens[r["i"]], distinct[r["i"]] = r["tokens"], r["distinct"]
    replies = answers.where("batch >= 0").select("batch", "rng", "counts")
    out = texts.cogroup(replies.groupBy("batch")).applyInPandas(
        score_batch(n_ranges, flat, tokens, distinct), "ord long, no_id boolean, held_out boolean, n_tokens long, n_known long, base double, score double"
    )
    out = out.select(F.when(~F.col("no_id"), F.col("ord")).alias("doc_id"), "held_out", "n_tokens", "n_known", F.col("base").alias("base_score"), "score")
    return out, int(tokens.sum())


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    out, train_tokens = score_texts(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) == 1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
