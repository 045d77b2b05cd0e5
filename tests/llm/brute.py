"""Plain forms of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def secrets(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            spans.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            spans.append((m.start(), 2, "hex", m.end()))
    n = Counter(s[2] for s in spans)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)))


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit.update(range(i, i + 5))
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def substring_dedup(docs: dict[int, str], width: int = 50):
    """docs by id -> id: (n_bytes, n_removed, n_spans, sha of the rest)."""
    first, out = {}, {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        for p in range(len(b) - width + 1):
            first.setdefault(b[p : p + width], i)
    for i, t in docs.items():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def simhash(text) -> int:
    import xxhash

    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: dict[int, int], bits: int = 2) -> dict[int, int]:
    ids = sorted(prints)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in ids}


def decontamination(text, items: dict[str, str]):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())
    w, hit, found = cut(text), set(), set()
    for item, t in items.items():
        v = cut(t)
        n = min(10, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(item)
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def jaccard_groups(texts: dict[int, str], percent: int = 80) -> dict[int, int]:
    """id -> the smallest id of its group by five-word shingles."""
    cut = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        cut[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    top = {i: i for i in texts}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and 100 * len(cut[a] & cut[b]) >= percent * len(cut[a] | cut[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in texts}


def lines(docs: dict[int, tuple], min_sites: int = 10) -> dict[int, tuple]:
    """id: (text, source) -> id: (text without the lines that go, number of those)."""
    sites, first = {}, {}
    for i in sorted(docs):
        for x in (docs[i][0] or "").split("\n"):
            if WORD.search(x):
                k = x.strip(" \t\n\x0b\x0c\r")
                sites.setdefault(k, set()).add(docs[i][1])
                first.setdefault(k, i)
    out = {}
    for i, (t, _) in docs.items():
        every = (t or "").split("\n")
        keep = [x for x in every if not ((k := x.strip(" \t\n\x0b\x0c\r")) in sites and len(sites[k]) >= min_sites and first[k] < i)]
        out[i] = (t if len(keep) == len(every) else "\n".join(keep), len(every) - len(keep))
    return out
