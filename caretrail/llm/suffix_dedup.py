"""Removal of repeated substrings with suffix arrays.

A byte goes if a window of WIDTH bytes around it also starts in a document with a smaller id. Windows are dealt out by their
smallest gram (a content-defined key: equal windows have equal keys wherever they are), as runs of neighbouring windows with
the same key. Documents are grouped into batches by a hash; keys into ranges. Batches and ranges exchange packed messages:

1. a batch sends the keys of its distinct runs; a range answers which keys occur in more than one text, and which are crowded;
2. a batch sends the runs of repeated keys with their bytes and their smallest document. A range takes runs with equal bytes
   together. Where a key has several different runs, it sorts the suffixes of their bytes in two stages (direct sort of the
   suffixes smaller than their successors, bucket scans for the others) and takes the common prefixes of neighbours. It answers
   each run with the smallest document of each window;
3. a batch marks the windows that a smaller document has, and removes their bytes.

Hashes only choose what is compared, and bytes decide, but within a batch: there two runs of one key are taken for equal by a
48-bit hash (wrongly with probability 4e-15 a pair). A batch sends each distinct run once, so a passage in a third of all documents is one run of each batch. A key with
more than CROWDED different runs (a frequent phrase in ever new surroundings) is given up: its windows are dealt out one by
one, by the hash of all their bytes. So no range sorts more than that for one key, and nothing passes the driver but the size
of the texts. Batches and ranges that have nothing in common send nothing, so messages are never more than runs (one in 16
bytes or so); up to some 100 GB they are far fewer, as a message packs many.

Defined cases: null texts are empty; texts shorter than a window keep all; rows with the same doc_id do not count against each
other; a null doc_id counts as larger than all others; repeated rows have a row each (and share a batch); an empty table gives
no rows; further columns are ignored; ids are whole numbers. What is left of a text is binary, as a removal may cut a UTF-8
character.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import table, text_bytes, text_of

WIDTH = 50
GRAM = 20
BLOCK = 1 << 20
LONGEST_RUN = 64
BATCH_BYTES = 8 << 20
RANGE_BYTES = 16 << 20
LEAST_PARTS = 64
SORT_BYTES = 1 << 21
CROWDED = 1 << 14
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(base))]), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _C3
    return h ^ (h >> np.uint64(32))


def gram_hashes(buf: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the GRAM bytes at each of the first n places of buf."""
    at = lambda k, kind: np.ndarray((n,), kind, buffer=buf, offset=k, strides=(1,)).astype(np.uint64)
    h = at(0, "<u8") * _C1
    h ^= h >> np.uint64(31)
    h += at(8, "<u8") * _C2
    h ^= h >> np.uint64(30)
    h += at(16, "<u4") * _C3
    return mix(h)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, have = h, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if width > have else m


class Blocks:
    """The runs of the texts: maximal stretches of 50-byte windows with the same smallest gram, at most LONGEST_RUN long."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts

    def __iter__(self):
        pieces, size = [], 0
        for d, t in enumerate(self.texts):
            for at in range(0, len(t) - WIDTH + 1, BLOCK):
                piece = t[at : at + BLOCK + WIDTH - 1]
                pieces.append((d, at, piece))
                size += len(piece)
                if size >= BLOCK:
                    yield self._runs(pieces, size)
                    pieces, size = [], 0
        if pieces:
            yield self._runs(pieces, size)

    @staticmethod
    def _runs(pieces, size):
        """(buf, hashes, doc, place in doc, place in buf, windows, key) of each run in a block of pieces."""
        buf = np.frombuffer(b"".join(p for _, _, p in pieces) + bytes(32), np.uint8)
        h = gram_hashes(buf, size)
        key = mix(sliding_min(h, WIDTH - GRAM + 1)) >> np.uint64(16)
        lengths = np.array([len(p) for _, _, p in pieces])
        first = np.cumsum(lengths) - lengths
        windows = lengths - WIDTH + 1
        cut = np.zeros(size + 1, bool)
        cut[1 : len(key)] = key[1:] != key[:-1]
        cut[first] = True
        cut[first + windows] = True
        inside = np.zeros(size + 1, np.int8)
        inside[first] += 1
        inside[first + windows] -= 1
        inside = np.cumsum(inside, dtype=np.int8).astype(bool)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], size)
        keep = inside[starts]
        starts, n = starts[keep], (ends - starts)[keep]
        parts = (n + LONGEST_RUN - 1) // LONGEST_RUN
        if (parts > 1).any():
            which = np.repeat(np.arange(len(n)), parts)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
            starts, n = starts[which] + nth * LONGEST_RUN, np.minimum(n[which] - nth * LONGEST_RUN, LONGEST_RUN)
        piece = np.searchsorted(first, starts, side="right") - 1
        doc = np.array([d for d, _, _ in pieces])[piece]
        place = np.array([at for _, at, _ in pieces])[piece] + starts - first[piece]
        return buf, h, doc, place, starts, n, key[starts]


_UP, _DOWN = _powers(_BASE, 2 * BLOCK + 2 * WIDTH), _powers(_INVERSE, 2 * BLOCK + 2 * WIDTH)


def run_hashes(h: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's text, from the hashes of all its grams."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * _UP[: len(h)], dtype=np.uint64)])
    return mix((total[starts + n + WIDTH - GRAM] - total[starts]) * _DOWN[starts] + n.astype(np.uint64) * _C1)


# ---- suffix arrays ----


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one is not (the empty suffix is the smallest)."""
    n = len(text)
    rises = np.zeros(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    at = np.where(differs, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # the first place from here where neighbours differ
    return rises[nearest]


def direct_sort(padded: np.ndarray, places: np.ndarray) -> np.ndarray:
    """places, sorted by the WIDTH bytes (and up to seven more) that start there."""
    places = places.copy()
    word = lambda p, k: np.ndarray((len(padded) - 7 - k,), ">u8", buffer=padded, offset=k, strides=(1,))[p].astype(np.uint64)
    w = word(places, 0)
    order = np.argsort(w, kind="stable")
    places, w = places[order], w[order]
    fresh = np.concatenate([[True], w[1:] != w[:-1]])
    for k in range(8, WIDTH, 8):
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(fresh)[at]
        w = word(places[at], k)
        order = np.lexsort((w, group))
        places[at] = places[at][order]
        w = w[order]
        fresh[at[1:]] |= (w[1:] != w[:-1]) & (group[1:] == group[:-1])
    return places


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, as far as their first WIDTH bytes decide it."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(WIDTH + 16, np.uint8)])
    small = suffix_types(text)
    counts = np.bincount(text, minlength=256)
    first = np.cumsum(counts) - counts
    n_small = np.bincount(text[small], minlength=256)
    out = np.empty(n, np.int64)
    direct = direct_sort(padded, np.flatnonzero(small))
    to = np.cumsum(n_small)
    for c in np.flatnonzero(n_small):
        out[first[c] + counts[c] - n_small[c] : first[c] + counts[c]] = direct[to[c] - n_small[c] : to[c]]
    head = first.copy()

    def induce(found: np.ndarray) -> None:
        """Puts the predecessors of sorted suffixes, where they are larger ones, at the heads of their buckets."""
        found = found[found > 0] - 1
        found = found[~small[found]]
        if not len(found):
            return
        chars = text[found]
        order = np.argsort(chars, kind="stable")
        found, chars = found[order], chars[order]
        n_of = np.bincount(chars, minlength=256)
        out[np.arange(len(found)) + np.repeat((head - (np.cumsum(n_of) - n_of))[n_of > 0], n_of[n_of > 0])] = found
        head[:] += n_of

    induce(np.array([n], np.int64))
    for c in np.flatnonzero(counts):
        done = first[c]
        while done < head[c]:  # a scan of the bucket may add to the same bucket
            done, at = head[c], done
            induce(out[at:done])
        induce(out[first[c] + counts[c] - n_small[c] : first[c] + counts[c]])
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes (up to WIDTH) that each place of order shares with the one before; 0 for the first."""
    padded = np.concatenate([text, np.zeros(WIDTH + 16, np.uint8)])
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for k in range(0, WIDTH, 8):
        view = np.ndarray((len(padded) - 7 - k,), ">u8", buffer=padded, offset=k, strides=(1,))
        x = view[order[open_]].astype(np.uint64) ^ view[order[open_ - 1]].astype(np.uint64)
        same = np.zeros(len(x), np.int64)
        for b in range(8):
            same += x < np.uint64(1 << (8 * b)) if b else x == 0
        out[open_] += same
        open_ = open_[x == 0]
    return np.minimum(out, WIDTH)


def least_of_windows(bodies: np.ndarray, n: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For every window of the runs (bodies: their bytes one after the other), the smallest document that has it."""
    size = n + WIDTH - 1
    offset = np.cumsum(size) - size
    order = suffix_array(bodies)
    run = np.repeat(np.arange(len(n)), size)
    place = np.arange(len(bodies)) - offset[run]
    window = place < n[run]
    order = order[window[order]]
    fresh = np.flatnonzero(common_prefixes(bodies, order) < WIDTH)
    smallest = np.minimum.reduceat(least[run[order]], fresh)
    out = np.empty(len(bodies), np.int64)
    out[order] = np.repeat(smallest, np.diff(np.append(fresh, len(order))))
    return out[window]


# ---- messages ----


def _pack6(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack6(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel().astype(np.uint64)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = False
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return fresh


class Entries:
    """Distinct runs, ordered by key and hash, and where they occur. The order depends on the texts alone."""

    def __init__(self, texts: list[bytes], ord_: np.ndarray, key, seg, doc, place, n):
        self.texts, self.ord = texts, ord_
        by = np.lexsort((ord_[doc], seg, key))
        self.key, self.seg, self.doc, self.place, self.n = key[by], seg[by], doc[by], place[by], n[by]
        fresh = _firsts(self.key, self.seg)
        self.entry = np.cumsum(fresh) - 1  # of each occurrence
        self.first = np.flatnonzero(fresh)  # of each entry; there the document is the entry's smallest
        last = np.append(self.first[1:], len(self.key))[: len(self.first)] - 1
        self.least = ord_[self.doc[self.first]]
        self.many = self.least != ord_[self.doc[last]]

    def ranges(self, n_ranges: int):
        """(range, slice of entries) of each range with entries."""
        of = ((self.key[self.first] >> np.uint64(16)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
        if not len(of):
            return
        at = np.flatnonzero(_firsts(of))
        for a, b in zip(at, [*at[1:], len(of)], strict=True):
            yield int(of[a]), slice(int(a), int(b))

    def bytes_of(self, entries: np.ndarray) -> bytes:
        at = self.first[entries]
        return b"".join([self.texts[d][p : p + k + WIDTH - 1] for d, p, k in zip(self.doc[at].tolist(), self.place[at].tolist(), self.n[at].tolist(), strict=True)])

    def windows(self, chosen: np.ndarray) -> Entries:
        """The windows of the chosen entries, each an entry of its own."""
        at = np.flatnonzero(chosen[self.entry])
        n = self.n[at]
        doc = np.repeat(self.doc[at], n)
        place = np.repeat(self.place[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        buf = np.frombuffer(b"".join(self.texts), np.uint8)
        begin = (np.cumsum(sizes) - sizes)[doc] + place
        key, seg = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.uint64)
        for i in range(WIDTH):
            byte = buf[begin + i].astype(np.uint64)
            key, seg = mix(key + byte * _C1 + _C2), mix(seg ^ (byte * _C2 + _C1))
        return Entries(self.texts, self.ord, key >> np.uint64(16), seg >> np.uint64(16), doc, place, np.ones(len(doc), np.int64))


def runs_of(frame: pd.DataFrame) -> Entries:
    """The runs of a batch."""
    texts, ord_ = list(frame["text"]), frame["ord"].to_numpy(np.int64)
    parts = [(key, run_hashes(h, starts, n) >> np.uint64(16), doc, place, n) for _, h, doc, place, starts, n, key in Blocks(texts)]
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
    return Entries(texts, ord_, *[np.concatenate([p[i] for p in parts]).astype(k) if parts else np.empty(0, k) for i, k in enumerate(kinds)])


def send_keys(n_ranges: int):
    def send(key, frame: pd.DataFrame) -> pd.DataFrame:
        batch = runs_of(frame)
        rows = []
        for r, at in batch.ranges(n_ranges):
            rows.append((r, int(key[0]), _pack6(batch.key[batch.first[at]]), _pack6(batch.seg[batch.first[at]]), np.packbits(batch.many[at]).tobytes()))
        return pd.DataFrame(rows, columns=["rng", "batch", "keys", "segs", "many"])

    return send


def answer_keys(crowded: int):
    def answer(key, frame: pd.DataFrame) -> pd.DataFrame:
        keys, segs = [_unpack6(x) for x in frame["keys"]], [_unpack6(x) for x in frame["segs"]]
        sizes = np.array([len(x) for x in keys])
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(frame["many"], sizes, strict=True)]).astype(bool)
        k, s = np.concatenate(keys), np.concatenate(segs)
        by = np.lexsort((s, k))
        fresh = _firsts(k[by])
        group, at = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        entries = np.add.reduceat(np.ones(len(k), np.int64), at)
        again = (entries > 1) | np.logical_or.reduceat(many[by], at)
        runs = np.add.reduceat(_firsts(k[by], s[by]).astype(np.int64), at)
        planes = np.empty((2, len(k)), bool)
        planes[:, by] = np.stack([again, again & (runs > crowded)])[:, group]
        ends = np.cumsum(sizes)
        rows = [(b, int(key[0]), *[np.packbits(p[e - n : e]).tobytes() for p in planes]) for b, n, e in zip(frame["batch"], sizes, ends, strict=True)]
        return pd.DataFrame(rows, columns=["batch", "rng", "repeated", "crowded"])

    return answer


def _flags(batch: Entries, answers: pd.DataFrame, n_ranges: int) -> np.ndarray:
    """Of each entry: whether its key is repeated, and whether it is crowded."""
    by_range = {r: planes for r, *planes in zip(answers["rng"], answers["repeated"], answers["crowded"], strict=True) if planes[0] is not None}
    out = np.zeros((2, len(batch.first)), bool)
    for r, at in batch.ranges(n_ranges):
        for i in range(2):
            out[i, at] = np.unpackbits(np.frombuffer(by_range[r][i], np.uint8), count=at.stop - at.start)
    return out


def send_runs(n_ranges: int):
    def send(key, frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(frame):
            batch = runs_of(frame)
            repeated, crowded = _flags(batch, answers, n_ranges)
            number = int(frame["batch"].iloc[0])
            windows = batch.windows(crowded)
            for level, part, chosen in ((0, batch, repeated & ~crowded), (1, windows, np.ones(len(windows.first), bool))):
                for r, at in part.ranges(n_ranges):
                    e = np.arange(at.start, at.stop)[chosen[at]]
                    if len(e):
                        n = part.n[part.first[e]].astype(np.uint8)
                        rows.append((r, number, level, _pack6(part.key[part.first[e]]), n.tobytes(), part.least[e].tobytes(), part.bytes_of(e)))
        return pd.DataFrame(rows, columns=["rng", "batch", "level", "keys", "n", "least", "body"])

    return send


def answer_runs(key, frame: pd.DataFrame) -> pd.DataFrame:
    """For each run that a batch has sent, the smallest document of each of its windows, as stretches of equal documents."""
    k = np.concatenate([_unpack6(x) for x in frame["keys"]])
    n = np.concatenate([np.frombuffer(x, np.uint8) for x in frame["n"]]).astype(np.int64)
    least = np.concatenate([np.frombuffer(x, np.int64) for x in frame["least"]])
    body = b"".join(frame["body"])
    size = n + WIDTH - 1
    end = np.cumsum(size)
    number: dict[bytes, int] = {}  # of each different run, in order of appearance
    run = np.fromiter((number.setdefault(body[a:b], len(number)) for a, b in zip((end - size).tolist(), end.tolist(), strict=True)), np.int64, len(k))
    one = np.zeros(len(number), np.int64)
    one[run[::-1]] = np.arange(len(run))[::-1]  # an entry of each run; equal bytes have equal keys
    by = np.argsort(k[one], kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    run, one = place[run], one[by]  # runs by key
    r_least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(r_least, run, least)
    r_n, r_key, bodies = n[one], k[one], list(number)
    edges = np.flatnonzero(_firsts(r_key)) if len(one) else np.empty(0, np.int64)
    of_key = np.diff(np.append(edges, len(one)))
    several = np.repeat(of_key > 1, of_key)
    piece_run, piece_len, piece_doc = [], [], []
    alone = np.flatnonzero(~several)
    piece_run.append(alone), piece_len.append(np.zeros(len(alone), np.int64)), piece_doc.append(r_least[alone])
    many = np.flatnonzero(several)
    edges = np.flatnonzero(_firsts(r_key[many])) if len(many) else np.empty(0, np.int64)
    total = np.cumsum(np.append(0, r_n[many] + WIDTH - 1))
    a = 0
    while a < len(many):  # whole keys, about SORT_BYTES at a time
        b = int(np.searchsorted(total, total[a] + SORT_BYTES))
        i = int(np.searchsorted(edges, min(b, len(many)), side="left"))
        b = int(edges[i]) if i < len(edges) and edges[i] > a else len(many)
        part = many[a:b]
        text = np.frombuffer(b"".join([bodies[j] for j in by[part].tolist()]), np.uint8)
        docs = least_of_windows(text, r_n[part], r_least[part])
        of = np.repeat(part, r_n[part])
        at = np.flatnonzero(_firsts(of, docs))
        piece_run.append(of[at]), piece_len.append(np.diff(np.append(at, len(of)))), piece_doc.append(docs[at])
        a = b
    p_run, p_len, p_doc = np.concatenate(piece_run), np.concatenate(piece_len), np.concatenate(piece_doc)
    by = np.argsort(p_run, kind="stable")
    p_run, p_len, p_doc = p_run[by], p_len[by], p_doc[by]
    stretch = np.bincount(p_run, minlength=len(one))
    begin = np.cumsum(stretch) - stretch
    rows, at = [], 0
    for batch, level, x in zip(frame["batch"], frame["level"], frame["n"], strict=True):
        mine = run[at : at + len(x)]
        count = stretch[mine]
        pick = np.repeat(begin[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        rows.append((batch, int(key[0]), level, count.astype(np.uint8).tobytes(), p_len[pick].astype(np.uint8).tobytes(), p_doc[pick].tobytes()))
        at += len(x)
    return pd.DataFrame(rows, columns=["batch", "rng", "level", "count", "len", "doc"])


def remove(n_ranges: int):
    def apply(key, frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(t) for t in frame["text"]], np.int64)
        base = np.cumsum(sizes) - sizes
        gone = np.zeros(int(sizes.sum()), bool)
        if len(answers):
            batch = runs_of(frame)
            repeated, crowded = _flags(batch, answers, n_ranges)
            windows = batch.windows(crowded)
            found = answers[answers["count"].notna()]
            gone = _gone(batch, repeated & ~crowded, found[found["level"] == 0], n_ranges, base, len(gone))
            gone |= _gone(windows, np.ones(len(windows.first), bool), found[found["level"] == 1], n_ranges, base, len(gone))
        rows = []
        for ord_, null, text, at, size in zip(frame["ord"], frame["no_id"], frame["text"], base, sizes, strict=True):
            mask = gone[at : at + size]
            edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            left = np.frombuffer(text, np.uint8)[~mask].tobytes() if len(a) else text
            rows.append((ord_, null, size, int(mask.sum()), a.tolist(), b.tolist(), left))
        return pd.DataFrame(rows, columns=["ord", "no_id", "n_bytes", "n_removed", "starts", "ends", "kept"])

    return apply


def _gone(batch: Entries, sent: np.ndarray, answers: pd.DataFrame, n_ranges: int, base: np.ndarray, size: int) -> np.ndarray:
    """Marks every byte of a window that a smaller document has; sent: the entries that were asked about."""
    pieces = {r: (c, n, d) for r, c, n, d in zip(answers["rng"], answers["count"], answers["len"], answers["doc"], strict=True)}
    count = np.zeros(len(batch.first), np.int64)
    lens, docs = [], []
    for r, at in batch.ranges(n_ranges):
        if r in pieces:
            count[np.arange(at.start, at.stop)[sent[at]]] = np.frombuffer(pieces[r][0], np.uint8)
            lens.append(np.frombuffer(pieces[r][1], np.uint8)), docs.append(np.frombuffer(pieces[r][2], np.int64))
    if not lens:
        return np.zeros(size, bool)
    lens, docs = np.concatenate(lens).astype(np.int64), np.concatenate(docs)
    begin = np.cumsum(count) - count
    c = count[batch.entry]
    occ = np.repeat(np.arange(len(c)), c)
    piece = np.repeat(begin[batch.entry] - (np.cumsum(c) - c), c) + np.arange(c.sum())
    n = np.where(lens[piece] == 0, batch.n[occ], lens[piece])
    before, some = np.cumsum(n) - n, c > 0
    offset = before - np.repeat(before[(np.cumsum(c) - c)[some]], c[some])
    hit = docs[piece] < batch.ord[batch.doc[occ]]
    start = (base[batch.doc[occ]] + batch.place[occ] + offset)[hit]
    edges = np.bincount(start, minlength=size + 1) - np.bincount(start + n[hit] + WIDTH - 1, minlength=size + 1)
    return np.cumsum(edges[:size]) > 0


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): one row per input row; spans are the removed byte ranges [start, end)."""
    spark = docs.sparkSession
    total = text_bytes(docs, text_col)
    n_batches, n_ranges = max(LEAST_PARTS, total // BATCH_BYTES + 1), max(LEAST_PARTS, total // RANGE_BYTES + 1)
    doc_id, text = F.col(id_col).cast("long"), text_of(text_col)
    rows = docs.select(
        F.pmod(F.xxhash64(doc_id, text), F.lit(n_batches)).cast("int").alias("batch"),
        F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("ord"),
        doc_id.isNull().alias("no_id"),
        F.encode(text, "UTF-8").alias("text"),
    ).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (16 * BATCH_BYTES)), "batch")
    texts = rows.groupBy("batch")
    asked = texts.applyInPandas(send_keys(n_ranges), "rng int, batch int, keys binary, segs binary, many binary")
    known = asked.groupBy("rng").applyInPandas(answer_keys(crowded), "batch int, rng int, repeated binary, crowded binary")
    known = known.repartition("batch")
    sent = texts.cogroup(known.groupBy("batch")).applyInPandas(
        send_runs(n_ranges), "rng int, batch int, level int, keys binary, n binary, least binary, body binary"
    )
    found = sent.groupBy("rng").applyInPandas(answer_runs, "batch int, rng int, level int, count binary, len binary, doc binary")
    answers = known.unionByName(found, allowMissingColumns=True)
    out = texts.cogroup(answers.groupBy("batch")).applyInPandas(
        remove(n_ranges), "ord long, no_id boolean, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary"
    )
    return out.select(
        F.when(~F.col("no_id"), F.col("ord")).alias("doc_id"), "n_bytes", "n_removed", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"), "kept"
    )


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
