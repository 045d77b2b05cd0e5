"""Queries that SQL cannot express, against plain forms of the same rules, over the whole smallest tables."""

import hashlib
import re

from pyspark.sql import functions as F

from caretrail import reference_data as R
from caretrail.functions import scalars as S
from caretrail.plans import store_queries, text_queries

SF = "/root/testdata/sf0.001"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain_placement(rows):
    """(group, seq, id, x, y) -> id: point; every point is compared with all points taken before it."""
    taken, out = {}, {}
    for group, _, name, x, y in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        mine, k = taken.setdefault(group, []), 0
        while k < 8 and any(abs(a - x) < 0.5 and abs(b - y) < 0.5 for a, b in mine):
            k += 1
            spot = []
            for salt, anchor, (low, high) in ((R.SALT_X, R.ANCHORS[group[1]][0], R.PLACE_X), (R.SALT_Y, R.ANCHORS[group[1]][1], R.PLACE_Y)):
                h = salt
                for c in f"{name}:collision{k}":
                    h = (h * 31 + ord(c)) & 0xFFFFFFFF
                spot.append(min(max(anchor + h % 900 / 100 - 4.5, low), high))
            x, y = spot
        mine.append((x, y))
        out[name] = (round(x, 6), round(y, 6))
    return out


def test_place_conditions(spark):
    c = store_queries._conditions(spark, SF).select("patient_id", S.normalize_system(F.col("system")).alias("system"), "id", "seq").collect()
    want = plain_placement([((r.patient_id, r.system), r.seq, r.id, float(r.seq % 3), 10.0) for r in c])
    got = {r.condition_id: (r.cx, r.cy) for r in store_queries.place_conditions(spark, SF).collect()}
    assert got == want and len(got) == len(c)


def test_place_with_masks_and_without_points(spark):
    """Nearest pixels by trying rings one after the other; points compared with all points before them."""
    masks = {}
    for r in store_queries._masks(spark, SF).collect():
        masks[r.system] = (r.width, r.height, [[r.alpha[y * r.width + x] > 0 for x in range(r.width)] for y in range(r.height)])

    def repair(system, x, y):
        w, h, opaque = masks[system]
        x, y = min(max(x, 0), 100), min(max(y, 0), 100)
        i, j = int(x / 100 * (w - 1) + 0.5), int(y / 100 * (h - 1) + 0.5)
        for ring in range(max(w, h)):
            found = [((p - i) ** 2 + (q - j) ** 2, q, p) for q in range(h) for p in range(w) if max(abs(p - i), abs(q - j)) == ring and opaque[q][p]]
            if found:
                _, q, p = min(found)
                return (x, y) if ring == 0 else (p / (w - 1) * 100, q / (h - 1) * 100)
        return None

    def spot(system, seed):
        out = []
        for salt, anchor, (low, high) in ((R.SALT_X, R.ANCHORS[system][0], R.PLACE_X), (R.SALT_Y, R.ANCHORS[system][1], R.PLACE_Y)):
            h = salt
            for c in seed:
                h = (h * 31 + ord(c)) & 0xFFFFFFFF
            out.append(min(max(anchor + h % 900 / 100 - 4.5, low), high))
        return tuple(out)

    rows = store_queries._unplaced(spark, SF).withColumn("norm", S.normalize_system(F.col("system"))).collect()
    taken, want, moved = {}, {}, 0
    for r in sorted(rows, key=lambda r: (r.patient_id, r.seq)):
        masked = r.system in masks
        x, y, spots = r.cx, r.cy, [[p.cx, p.cy] for p in r.locations]
        if masked:
            x, y = (None, None) if x is None or y is None else repair(r.system, x, y) or (None, None)
            spots = [list(repair(r.system, *p) or (None, None)) if None not in p else p for p in spots]
        head = spots[0] if spots and "nephrolith" in r.name_medical.lower() else (None, None)
        base = spot(r.norm, f"{r.name_medical}:{r.system}")
        p = tuple(next(v for v in options if v is not None) for options in zip(head, (x, y), base, strict=True))
        mine, k = taken.setdefault((r.patient_id, r.norm), []), 0
        while k < 8 and any(abs(a - p[0]) < 0.5 and abs(b - p[1]) < 0.5 for a, b in mine):
            k, moved = k + 1, moved + 1
            p = spot(r.norm, f"{r.condition_id}:collision{k}")
            p = masked and repair(r.system, *p) or p
        mine.append(p)
        p = masked and repair(r.system, *p) or p
        want[r.condition_id] = tuple(None if v is None else round(v, 6) for v in (*p, *(spots[-1] if spots else (None, None))))
    got = {r.condition_id: tuple(r)[1:] for r in store_queries.place_masked(spark, SF).collect()}
    assert got == want and moved > 10 and any(r.system in masks for r in rows) and any(r.cx is None for r in rows)


def plain_chunks(text, sections, longest, shortest=200):
    """Chunks by the rules' wording: where sections start, short ones run on, long ones break at blank lines, then by length."""
    starts, at = [], 0
    for s in sections:
        found = text.find(s["heading"], at) if s["heading"] else -1
        begin = found if found >= 0 else max(at, min(len(text), s["startOffset"]))
        at = min(len(text), begin + (max(1, len(s["heading"])) if found >= 0 else 1))
        starts.append((begin, s))
    blocks = []
    for i, (begin, s) in enumerate(starts):
        a, b = (0 if i == 0 else begin), (starts[i + 1][0] if i + 1 < len(starts) else len(text))
        if b > a:
            blocks.append({"a": a, "b": b, "names": [s["heading"]] if s["heading"] else [], "type": s["sectionType"] or "other", "date": s["inferredDate"], "image": s["imageWorthy"]})
    if not blocks:
        first = starts[0][1] if starts else {"heading": "", "sectionType": "other", "inferredDate": None, "imageWorthy": False}
        blocks = [{"a": 0, "b": len(text), "names": [first["heading"]] if first["heading"] else [], "type": first["sectionType"], "date": first["inferredDate"], "image": first["imageWorthy"]}]

    def join(p, q):
        return {"a": p["a"], "b": q["b"], "names": list(dict.fromkeys([" / ".join(p["names"]), " / ".join(q["names"])])), "type": q["type"] if p["type"] == "other" else p["type"], "date": p["date"] or q["date"], "image": p["image"] or q["image"]}

    merged, carry = [], None
    for i, block in enumerate(blocks):
        block = join(carry, block) if carry else block
        block["names"] = [n for n in block["names"] if n]
        carry = None
        if block["b"] - block["a"] >= shortest:
            merged.append(block)
        elif i + 1 < len(blocks):
            carry = block
        elif merged:
            merged[-1] = join(merged[-1], block)
        else:
            merged.append(block)
    out = []
    for m in merged:
        body, pieces = text[m["a"] : m["b"]], [""]
        if len(body) > longest:
            for part in re.findall(r"(?s).+?(?:\n{2,}|\Z)", body):
                if len(pieces[-1]) + len(part) > longest and pieces[-1]:
                    pieces.append("")
                pieces[-1] += part
        else:
            pieces = [body]
        for piece in pieces:
            for k in range(0, max(len(piece), 1), longest):
                out.append((" / ".join(n for n in m["names"] if n), m["type"], m["date"], m["image"], piece[k : k + longest]))
    return [c for c in out if c[4]]


def test_chunk_sections_and_prompts(spark):
    docs = {r.doc_id: r for r in text_queries._sectioned(spark, SF).collect()}
    chunks, prompts = {}, {}
    for r in text_queries.chunk_sections(spark, SF).collect():
        chunks.setdefault(r.doc_id, {})[r.chunk_no] = r
    for r in text_queries.chunk_prompt_input(spark, SF).collect():
        prompts.setdefault(r.doc_id, {})[r.chunk_no] = (r.n, r.input_md5)
    assert set(chunks) == {i for i, d in docs.items() if d.text} == set(prompts)
    for i, mine in chunks.items():
        d = docs[i]
        want = plain_chunks(d.text, [s.asDict() for s in d.sections], 2000)
        assert [(mine[k].heading, mine[k].sectionType, mine[k].inferredDate, mine[k].imageWorthy, mine[k].text_md5) for k in sorted(mine)] == [(*w[:4], md5(w[4])) for w in want]
        at = 0
        for k, w in enumerate(want):
            last = at + len(w[4]) - 1
            page = lambda off: max(p for p, b in enumerate(d.page_breaks, 1) if b <= off)  # noqa: B023, E731
            assert (mine[k].start, mine[k].end, mine[k].page_start, mine[k].page_end) == (at, last + 1, page(at), page(last))
            at = last + 1
            text = f"Document header:\n{d.text[:1500]}\n\nSection: {w[0]} ({w[1]})" + (f" {w[2]}" if w[2] else "") + f"\n\n{w[4]}"
            assert prompts[i][k] == (len(text), md5(text))
        assert at == len(d.text)
