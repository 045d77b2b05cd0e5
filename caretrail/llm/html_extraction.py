"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

1. Each page becomes its own expression (html_pages): repeats folded, texts as slots. Pages of a host with the same shape are
   counted together, slot by slot, by sums and by the least and greatest hash of the slot's texts.
2. A host's shapes are aligned, FAN of them in a task, then the results of those, and so on, to one wrapper a host.
3. Each shape is laid beside its host's wrapper: the slots of its main part stay, without menus and the like and without texts
   that are the same on all the host's pages. That choice goes to the host's pages of that shape, whose blocks it selects.

The main part is what the markup marks as such (article, then main or a container named for it), else the element that holds
most of the host's changing text outside links. Within it go elements that by name, role, class or id are menus, headers, footers,
sidebars, notices, adverts, forms or comments, and a slot other than a heading whose text is the same on SEEN pages or more,
while other slots of the part change.

Defined cases: null html is empty and gives an empty text; pages whose url is null or has no host share the host ''; repeated rows
and null ids keep their rows; characters outside tags are text, unclosed elements end with their parent; white space is what
Unicode says it is; an empty table gives no rows; further columns are ignored by the query and kept by extract_main_text. A host
with a third of all pages is counted before the shuffle, its shapes are dealt over tasks and its pages over salts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretrail.llm import html_pages as hp
from caretrail.llm.common import materialize, table

FAN = 32
SEEN = 5
#: Shapes with more than one in so many pages are dealt over salts: fewer than HOT of them, whatever the table.
HOT = 100
#: The main part by descent is left when no child holds so much of the text.
MOST = 0.8

#: Elements, roles and words of class or id that mark what is not the main text, and that mark it.
DROPPED_NAMES = frozenset("nav footer aside form button select dialog menu noscript template svg canvas object audio video fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing shoutbox sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
MAIN_WORDS = frozenset("article articlebody content entry main maincontent post postbody story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

PAGE = T.StructType().add("key", T.LongType()).add("shape", T.StringType()).add(
    "slots", T.ArrayType(T.StructType().add("blocks", T.LongType()).add("chars", T.LongType()).add("links", T.LongType()).add("fixed", T.LongType()))
)


def _expression(page: str | None) -> list[hp.Item]:
    return hp.folded(hp.read_page(page or ""))


def _shape_of(items: list[hp.Item]) -> tuple[int, str]:
    from xxhash import xxh64_intdigest

    text = json.dumps(hp.shape(items), ensure_ascii=False, separators=(",", ":"))
    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63), text


@F.pandas_udf(PAGE)
def page_shapes(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Each page's shape, its hash, and its slots' counts."""
    for part in pages:
        out = []
        for page in part:
            items = _expression(page)
            out.append((*_shape_of(items), [{"blocks": s.blocks, "chars": s.chars, "links": s.links, "fixed": s.fixed} for s in hp.slots(items)]))
        yield pd.DataFrame(out, columns=["key", "shape", "slots"])


@F.pandas_udf(T.LongType())
def page_keys(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in pages:
        yield pd.Series([_shape_of(_expression(page))[0] for page in part], dtype="int64")


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_shapes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, key, shape, pages, slots): the shapes of each host's pages with their slots' counts over all those pages."""
    seen = pages.select(host_of(F.col(url_col)).alias("host"), page_shapes(F.col(html_col).cast("string")).alias("p")).select("host", "p.*")
    one = seen.select("host", "key", "shape", F.posexplode_outer("slots").alias("slot", "s"))
    slot = one.groupBy("host", "key", "slot").agg(
        F.count("*").alias("pages"), F.min("shape").alias("shape"), F.sum("s.blocks").alias("blocks"), F.sum("s.chars").alias("chars"), F.sum("s.links").alias("links"),
        F.when((F.count("s.fixed") == F.count("*")) & (F.min("s.fixed") == F.max("s.fixed")), F.min("s.fixed")).alias("fixed"),
    )
    counts = F.transform(F.array_sort(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "pages", "blocks", "chars", "links", "fixed")))), lambda s: s.dropFields("slot"))
    return slot.groupBy("host", "key").agg(F.min("shape").alias("shape"), F.max("pages").alias("pages"), counts.alias("slots"))


@F.pandas_udf(T.StringType())
def _as_wrapper(shapes: pd.Series, counts: pd.Series) -> pd.Series:
    out = []
    for form, slots in zip(shapes, counts, strict=True):
        items = hp.from_shape(json.loads(form))
        for s, c in zip(hp.slots(items), slots, strict=True):
            s.pages, s.blocks, s.chars, s.links, s.fixed = c["pages"], c["blocks"], c["chars"], c["links"], c["fixed"]
        out.append(hp.dumps(items))
    return pd.Series(out)


def _align_all(group: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of a group's, in the order of their keys."""
    group = group.sort_values("key", kind="stable")
    items = hp.loads(group["wrapper"].iat[0])
    for other in group["wrapper"].iloc[1:]:
        items = hp.aligned(items, hp.loads(other))
    return pd.DataFrame({"host": [group["host"].iat[0]], "key": [group["key"].iat[0]], "wrapper": [hp.dumps(items)]})


def infer_wrappers(shapes: DataFrame) -> DataFrame:
    """(host, wrapper), one row a host, of its shapes (host, key, wrapper)."""
    rows, turn = shapes.select("host", "key", "wrapper"), 0
    while True:
        counted = rows.join(rows.groupBy("host").agg(F.count("*").alias("_n")), "host")
        if not counted.where("_n > 1").limit(1).count():
            return rows.select("host", "wrapper")
        several = counted.where("_n > 1").withColumn("_bucket", F.pmod(F.xxhash64("key", F.lit(turn)), F.ceil(F.col("_n") / FAN)))
        joined = several.groupBy("host", "_bucket").applyInPandas(lambda g: _align_all(g), "host string, key long, wrapper string")
        rows, turn = materialize(counted.where("_n = 1").select("host", "key", "wrapper").unionByName(joined), "html-wrappers"), turn + 1


def _name(sig: str) -> str:
    return re.split("[.#@!]", sig, maxsplit=1)[0]


def _marks(sig: str) -> set[str]:
    """The words of an element's classes and id; what it says to be beside or without does not count."""
    rest = re.sub("([a-z])([A-Z])", r"\1 \2", sig[len(_name(sig)) :].split("@")[0])
    return set(re.split("[^a-z0-9]+", re.sub("\\b(with|without|no|has)[-_ ][a-z]+", "", rest.lower()))) - {""}


def _is_main(sig: str) -> bool:
    return _name(sig) == "main" or "@main" in sig or _name(sig) in ("div", "section", "td") and bool(_marks(sig) & MAIN_WORDS)


def _holds_main(items: list[hp.Item]) -> bool:
    return any(x.kids is not None and (_name(x.sig) in ("article", "main") or _holds_main(x.kids)) for x in items)


def _is_dropped(x: hp.Item) -> bool:
    """Whether an element is not main text, by its name, role, class or id."""
    name = _name(x.sig)
    if name in DROPPED_NAMES or x.sig.endswith("!hidden") or any(f"@{r}" in x.sig for r in DROPPED_ROLES if x.sig.split("@")[-1].split("!")[0] == r):
        return True
    return bool(_marks(x.sig) & DROPPED_WORDS) and not (name in ("main",) or _holds_main([x]) and not _comment(x.sig))


def _comment(sig: str) -> bool:
    return bool(_marks(sig) & {"comment", "comments", "reply", "replies", "respond"})


def _parts(items: list[hp.Item], is_part) -> list[hp.Item]:
    """The outermost elements that are a part, outside dropped ones."""
    out = []
    for x in items:
        if x.kids is not None and not (x.sig[0] != "(" and _is_dropped(x)):
            out += [x] if x.sig[0] != "(" and is_part(x.sig) else _parts(x.kids, is_part)
    return out


def _kept(items: list[hp.Item], within: tuple[str, ...] = ()) -> list[tuple[hp.Item, bool]]:
    """Slots outside dropped elements, with whether they are headings; of a header only headings stay."""
    out = []
    for x in items:
        if x.kids is None:
            heading = any(w in HEADINGS for w in within)
            if heading or "header" not in within:
                out.append((x, heading))
        elif x.sig[0] == "(":
            out += _kept(x.kids, within)
        elif not _is_dropped(x) or _name(x.sig) in HEADINGS:
            out += _kept(x.kids, (*within, _name(x.sig)))
    return out


def choose(wrapper: list[hp.Item], items: list[hp.Item]) -> list[bool]:
    """For each slot of a shape whether it is main text, by its host's wrapper."""
    of = hp.counterparts(wrapper, items)
    seen = lambda s: of.get(id(s), s)
    changes = lambda s: seen(s).fixed is None or seen(s).pages < 2
    mass = lambda xs: sum((seen(s).chars - seen(s).links) / max(1, seen(s).pages) for s, _ in _kept(xs) if changes(s))
    parts, marked = _parts(items, lambda sig: _name(sig) == "article"), True
    if not parts:
        parts = sorted(_parts(items, _is_main), key=lambda x: mass(x.kids))[-1:]
        if parts and mass(parts[0].kids) < 0.25 * mass(items):
            parts = []
    if not parts:
        marked, inside = False, items
        while True:
            heavy = [x for x in inside if x.kids is not None and not (x.sig[0] != "(" and _is_dropped(x)) and mass(x.kids) >= MOST * max(1e-9, mass(inside))]
            if len(heavy) != 1 or heavy[0].rep or _name(heavy[0].sig) in HEADINGS or heavy[0].kids[0].kids is None:
                break
            inside = heavy[0].kids
        parts = [hp.Item("", inside)]
    held = [k for x in parts for k in _kept(x.kids)]
    moving = any(seen(s).fixed is None and seen(s).pages >= SEEN for s, _ in held)
    keep = {id(s) for s, heading in held if heading or not (moving and seen(s).fixed is not None and seen(s).pages >= SEEN)}
    if not marked:  # no mark says where the main part is: lists of links are menus
        keep -= {id(s) for s, heading in held if not heading and 2 * seen(s).links > seen(s).chars}
    return [id(s) in keep for s in hp.slots(items)]


def _choices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        last, keep = None, []
        for host, own, wrapper in zip(part["host"], part["own"], part["wrapper"], strict=True):
            if last is None or last[0] != host:
                last = (host, hp.loads(wrapper))
            keep.append(choose(last[1], hp.loads(own)))
        yield pd.DataFrame({"host": part["host"], "key": part["key"], "pages": part["pages"], "keep": keep})


def shape_choices(shapes: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, key, pages, keep): each shape's choice, its host's wrapper sent to every FAN * FAN of its shapes."""
    counted = shapes.groupBy("host").agg(F.ceil(F.count("*") / (FAN * FAN)).cast("int").alias("deals"))
    sent = wrappers.join(counted, "host").select("host", "wrapper", "deals", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    own = shapes.join(counted, "host").select("host", "key", "pages", F.col("wrapper").alias("own"), F.pmod(F.xxhash64("key"), F.col("deals")).cast("int").alias("deal"))
    met = own.join(sent.select("host", "deal", "wrapper"), ["host", "deal"])
    return met.select("host", "key", "pages", "own", "wrapper").mapInPandas(_choices, "host string, key long, pages long, keep array<boolean>")


@F.pandas_udf(T.StringType())
def _selected(pages: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The blocks of a page's kept slots, in its order."""
    for html, keeps in pages:
        out = []
        for page, keep in zip(html, keeps, strict=True):
            blocks = [b for s, k in zip(hp.slots(_expression(page)), keep, strict=True) if k for b in s.blocks_at]
            out.append("\n\n".join(b.text for b in sorted(blocks, key=lambda b: b.at)))
        yield pd.Series(out)


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(row, text): every input row as a struct, with its main text."""
    shapes = host_shapes(pages, url_col, html_col)
    shapes = materialize(shapes.select("host", "key", "pages", _as_wrapper("shape", "slots").alias("wrapper")), "html-shapes")
    choices = materialize(shape_choices(shapes, infer_wrappers(shapes)), "html-choices")
    total = choices.agg(F.sum("pages")).first()[0] or 0
    # fewer than HOT of them, as each holds more than a HOTth of all pages
    hot = choices.where(F.col("pages") * HOT > total).select("host", "key", F.ceil(F.col("pages") * HOT / max(total, 1)).cast("int").alias("n")).collect()
    spread = F.lit(1)
    for r in hot:
        spread = F.when((F.col("host") == r["host"]) & (F.col("key") == r["key"]), r["n"]).otherwise(spread)
    rows = pages.select(F.struct("*").alias("row"), host_of(F.col(url_col)).alias("host"), page_keys(F.col(html_col).cast("string")).alias("key"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(f"row.`{url_col}`", f"row.`{html_col}`", F.monotonically_increasing_id()), spread).cast("int"))
    sent = choices.withColumn("salt", F.explode(F.sequence(F.lit(0), spread - 1))).select("host", "key", "salt", "keep")
    return rows.join(sent.hint("shuffle_hash"), ["host", "key", "salt"]).select("row", _selected(F.col(f"row.`{html_col}`").cast("string"), F.col("keep")).alias("text"))


def op11_html_extraction(spark, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
