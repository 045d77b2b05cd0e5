"""Pages as streams of block tags and text blocks, and union-free expressions over them.

A page's markup is read into nested blocks; markup within a block (links, emphasis) belongs to its text. An expression is a list
of items: a text slot, an element with an expression inside, or a group of items, each optional and repeated or not. Aligning
two expressions resolves mismatches: neighbours that repeat become one repeated item or group, items that one side lacks become
optional, and texts that differ become a slot without a fixed text.
"""

from __future__ import annotations

import bisect
import html as markup
import json
import re

#: How HTML reads these elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
ENDS_BEFORE = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
ENDS_BEFORE = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS_BEFORE.items()}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
ATTR = re.compile(r"""([A-Za-z][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements nested deeper are read as their ancestor's at this depth.
DEEPEST = 120
#: Items in a repeated group at most; longer periods stay apart.
PERIOD = 4


class Block:
    """A text block of a page: its text, its code points within links, and its place."""

    __slots__ = ("at", "links", "text")

    def __init__(self, text: str, links: int, at: int):
        self.text, self.links, self.at = text, links, at


def signature(name: str, attributes: str) -> str:
    """An element's name with its classes, id and role; numbers in them are left out of account."""
    if not attributes.strip(" /\n\t"):
        return name
    found = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(attributes)}
    out = name
    out += "".join(f".{re.sub('[0-9]+', 'N', c)}" for c in sorted(set(found.get("class", "").split())))
    out += f"#{re.sub('[0-9]+', 'N', found['id'])}" if found.get("id") else ""
    out += f"@{found['role'].lower()}" if found.get("role") else ""
    style = re.sub(r"\s", "", found.get("style", "").lower())
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    return out + "!hidden" * hidden


def read_page(page: str) -> list:
    """A page -> nested [signature, children] and Blocks; script, style, title and comments are left out."""
    root, at, pos = [], 0, 0
    stack, text, links, in_link = [("", root)], [], 0, 0

    def flush():
        nonlocal text, links, at
        if text:
            words = " ".join("".join(text).split())
            if words:
                stack[-1][1].append(Block(words, min(links, len(words)), at))
                at += 1
        text, links = [], 0

    def say(raw):
        nonlocal links
        part = markup.unescape(raw)
        text.append(part)
        links += len(part.strip()) if in_link else 0

    while m := TOKEN.search(page, pos):
        if m.start() > pos:
            say(page[pos : m.start()])
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if name in RAW:
            if not closing:
                end = re.compile(f"</{name}(?![^\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, pos)
                pos = end.end() if end else len(page)
        elif name in INLINE:
            in_link = 0 if name == "a" and closing else 1 if name == "a" else in_link
        elif name in VOID:
            if name == "br":
                text.append(" ")
            elif name == "hr":
                flush()
        elif name in ("html", "head", "body"):
            flush()
        elif closing:
            flush()
            in_link = 0
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if k:
                del stack[k:]
        else:
            flush()
            if stack[-1][0] == "p":
                stack.pop()
            if name in ENDS_BEFORE:
                ended, within = ENDS_BEFORE[name]
                k = len(stack) - 1
                while k > 0 and stack[k][0] not in ended and stack[k][0] not in within:
                    k -= 1
                while k > 0 and stack[k][0] in ended:
                    del stack[k:]
                    k -= 1
            if len(stack) < DEEPEST:
                node = [signature(name, m[3] or m[6] or ""), []]
                stack[-1][1].append(node)
                stack.append((name, node[1]))
            else:
                stack.append((name, stack[-1][1]))
    if pos < len(page):
        say(page[pos:])
    flush()
    return root


class Item:
    """A text slot (kids is None), an element or a group. Slots count pages, blocks, code points, code points in links; `fixed` is
    the hash of their text while all pages agree on it; `blocks_at` holds one page's own blocks."""

    __slots__ = ("blocks", "blocks_at", "chars", "fixed", "kids", "links", "opt", "pages", "rep", "sig")

    def __init__(self, sig, kids=None, opt=False, rep=False):
        self.sig, self.kids, self.opt, self.rep = sig, kids, opt, rep
        self.pages = self.blocks = self.chars = self.links = 0
        self.fixed, self.blocks_at = None, []


def _slot(block: Block) -> Item:
    from xxhash import xxh64_intdigest

    item = Item("#")
    item.pages, item.blocks, item.chars, item.links, item.blocks_at = 1, 1, len(block.text), block.links, [block]
    item.fixed = xxh64_intdigest(block.text.encode("utf-8", "surrogatepass")) >> 1
    return item


def merged(a: Item, b: Item, same_page: bool) -> Item:
    """One item for two of the same signature."""
    out = Item(a.sig, None if a.kids is None else aligned(a.kids, b.kids, same_page), a.opt or b.opt, a.rep or b.rep)
    out.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    out.blocks, out.chars, out.links = a.blocks + b.blocks, a.chars + b.chars, a.links + b.links
    out.fixed = a.fixed if a.fixed == b.fixed else None
    out.blocks_at = a.blocks_at + b.blocks_at
    return out


def repeats(items: list[Item], same_page: bool) -> list[Item]:
    """Neighbours that repeat as one repeated item; then runs of two items or more that repeat as one repeated group."""
    for period in range(1, PERIOD + 1):
        out, i = [], 0
        while i < len(items):
            sigs = [x.sig for x in items[i : i + period]]
            j = i + period
            while len(sigs) == period and [x.sig for x in items[j : j + period]] == sigs:
                j += period
            if j == i + period or len(sigs) < period:
                out.append(items[i])
                i += 1
                continue
            kids = items[i : i + period]
            for k in range(i + period, j, period):
                kids = [merged(a, b, same_page) for a, b in zip(kids, items[k : k + period], strict=True)]
            if period == 1:
                kids[0].rep = True
                out.append(kids[0])
            else:
                out.append(Item(f"({'|'.join(sigs)})", kids, False, True))
            i = j
        items = out
    return items


def _grouped(items: list[Item], groups: dict[str, int]) -> list[Item]:
    """Runs of items that the other side has as a group, as that group."""
    for sig, n in groups.items():
        out, i = [], 0
        while i < len(items):
            part = items[i : i + n]
            if f"({'|'.join(x.sig for x in part)})" == sig:
                out.append(Item(sig, part))
                i += n
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _as_groups(a: list[Item], b: list[Item]) -> tuple[list[Item], list[Item]]:
    of = lambda xs: {x.sig: len(x.kids) for x in xs if x.sig[0] == "("}
    in_a, in_b = of(a), of(b)
    return (_grouped(a, in_b) if in_b else a), (_grouped(b, in_a) if in_a else b)


def pairs(a: list[Item], b: list[Item]) -> list[tuple[int | None, int | None]]:
    """Places of a and b side by side; at a mismatch the nearest place where they agree again is taken."""
    where = {}
    for j, x in enumerate(b):
        where.setdefault(x.sig, []).append(j)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        best = None
        for di in range(len(a) - i):
            if best and di >= best[0] + best[1]:
                break
            places = where.get(a[i + di].sig, ())
            k = bisect.bisect_left(places, j)
            if k < len(places) and (best is None or di + places[k] - j < best[0] + best[1]):
                best = (di, places[k] - j)
        if best is None:
            break
        out += [(i + k, None) for k in range(best[0])] + [(None, j + k) for k in range(best[1])]
        i, j = i + best[0], j + best[1]
        out.append((i, j))
        i, j = i + 1, j + 1
    return out + [(k, None) for k in range(i, len(a))] + [(None, k) for k in range(j, len(b))]


def aligned(a: list[Item], b: list[Item], same_page: bool = False) -> list[Item]:
    """One expression for both."""
    a, b = _as_groups(a, b)
    out = []
    for i, j in pairs(a, b):
        if i is not None and j is not None:
            out.append(merged(a[i], b[j], same_page))
        else:
            out.append(a[i] if j is None else b[j])
            out[-1].opt = True
    return repeats(out, same_page)


def folded(nodes: list) -> list[Item]:
    """A page's own expression; elements without text are left out."""
    items = []
    for x in nodes:
        if isinstance(x, Block):
            items.append(_slot(x))
        elif kids := folded(x[1]):
            items.append(Item(x[0], kids))
    return repeats(items, True)


def slots(items: list[Item]) -> list[Item]:
    """The text slots from left to right."""
    return [s for x in items for s in ([x] if x.kids is None else slots(x.kids))]


def shape(items: list[Item]) -> list:
    """Signatures, optional and repeated marks, without counts."""
    return [[x.sig, int(x.opt), int(x.rep), *([] if x.kids is None else [shape(x.kids)])] for x in items]


def from_shape(form: list) -> list[Item]:
    return [Item(x[0], from_shape(x[3]) if len(x) > 3 else None, bool(x[1]), bool(x[2])) for x in form]


def dumps(items: list[Item]) -> str:
    """An expression with its slots' counts."""
    return json.dumps([shape(items), [[s.pages, s.blocks, s.chars, s.links, s.fixed] for s in slots(items)]], ensure_ascii=False, separators=(",", ":"))


def loads(text: str) -> list[Item]:
    form, counts = json.loads(text)
    items = from_shape(form)
    for s, (pages, blocks, chars, links, fixed) in zip(slots(items), counts, strict=True):
        s.pages, s.blocks, s.chars, s.links, s.fixed = pages, blocks, chars, links, fixed
    return items


def counterparts(wrapper: list[Item], items: list[Item]) -> dict[int, Item]:
    """id() of the items' slots -> the wrapper's slots at their places."""
    wrapper, items = _as_groups(wrapper, items)
    out = {}
    for i, j in pairs(wrapper, items):
        if i is not None and j is not None:
            out |= {id(items[j]): wrapper[i]} if items[j].kids is None else counterparts(wrapper[i].kids, items[j].kids)
    return out
