"""HTML extraction: expressions on literal pages, whole templates, and the given pages against the articles they hold."""

import html
import random
import re
from collections import Counter

import pytest

from caretrail.llm import html_extraction as hx
from caretrail.llm import html_pages as hp

SF = "/root/testdata/sf0.001"


def shape(page):
    def say(items):
        return " ".join((x.sig if x.kids is None else f"{'' if x.sig[0] == '(' else x.sig}({say(x.kids)})") + "+" * x.rep + "?" * x.opt for x in items)

    return say(page if page and isinstance(page[0], hp.Item) else hp.folded(hp.read_page(page)))


def test_a_page_folds_to_slots_and_repeats():
    assert shape("<h1>a</h1><p>b<p>c</p><p>d") == "h1(#) p(#)+"
    assert shape("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "ul(li(# ul(li(#))?)+)"
    assert shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "dl((dt(#) dd(#))+)"
    assert shape("<table><tr><td>a<td>b<tr><td>c</table>") == "table(tr(td(#)+)+)"
    assert shape("") == ""


def test_alignment_resolves_mismatches():
    of = lambda t: hp.folded(hp.read_page(t))
    both = hp.aligned(of("<h1>a</h1><p>b</p><div class=x>s</div>"), of("<h1>c</h1><h2>d</h2><p>e</p><p>f</p><div class=x>s</div>"))
    assert shape(both) == "h1(#) h2(#)? p(#)+ div.x(#)"
    assert [(s.pages, s.blocks, s.fixed is None) for s in hp.slots(both)] == [(2, 2, True), (1, 1, False), (2, 3, True), (2, 2, False)]
    groups = hp.aligned(of("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>"), of("<h2>e</h2><p>f</p>"))
    assert shape(groups) == "(h2(#) p(#))+"
    assert hp.dumps(hp.loads(hp.dumps(both))) == hp.dumps(both)


def test_alignment_keeps_every_text_and_its_order():
    r = random.Random(2)
    page = lambda: "".join(f"<{t}>{t}{r.random()}</{t}>" for t in r.choices(["p", "div", "h2", "pre", "section"], k=r.randint(0, 14)))
    for _ in range(60):
        items, total = [], 0
        for _ in range(5):
            one = hp.folded(hp.read_page(page()))
            total += sum(s.blocks for s in hp.slots(one))
            items = hp.aligned(items, one)
        assert sum(s.blocks for s in hp.slots(items)) == total


def test_reading():
    texts = lambda t: [b.text for s in hp.slots(hp.folded(hp.read_page(t))) for b in s.blocks_at]
    assert texts("a &amp; b&lt;c&#233;&nbsp;d <b>e</b>f<br>g \n\t h") == ["a & b<cé d ef g h"]
    assert texts('<p title="a>b">x</p><!-- <p>no</p> --><script>var t="</p>";</script><style>p{}</style>y < z') == ["x", "y < z"]
    assert texts("<title>t</title><textarea>no</textarea><SCRIPT>a</ScRipt >b<script>never closed") == ["b"]
    assert texts("<p>a &lt;b&gt; &amp;amp;</p></div></span>tail<!-- open") == ["a <b> &amp;", "tail"]
    assert texts("<div>" * 500 + "deep" + "</div>" * 500 + "after") == ["deep", "after"]
    assert texts("<p>" + "word " * 100_000)[0] == " ".join(["word"] * 100_000)


def plain_page(k, paragraphs, mark):
    words = lambda n, seed: " ".join(random.Random(seed).choices("alpha beta gamma delta epsilon zeta".split(), k=n)) + f" {seed}"
    title, body = f"Title {k}", [words(30, f"{k}-{j}") for j in range(paragraphs)]
    main = f"<h1>{title}</h1>" + "".join(f"<p>{t}</p>" for t in body)
    comments = f'<section id="comments"><article class="comment"><p>{words(60, f"c{k}")}</p></article></section>' if k % 2 else ""
    inner = {
        "article": f"<article>{main}<div class='share-buttons'>Share {k}</div><p class=x>Printed from the site</p>{comments}</article>",
        "content": f"<div id=content class='entry-content no-sidebar'>{main}{comments}</div>",
        "none": f"<div><div>{main}</div></div>{comments}",
    }[mark]
    page = (
        f"<!DOCTYPE html><html><head><title>{title}</title></head><body><header>Site</header><div class=menu><ul>{''.join(f'<li><a href=/{j}>Link {k} {j}</a>' for j in range(9))}</ul></div>"
        f"<div id='cookie-notice'><p>We use cookies {words(80, k)}</p></div><div class=\"wrap\">{inner}<aside><p>{words(50, f'a{k}')}</p></aside></div>"
        f"<form><p>{words(20, f'f{k}')}</p></form><div class='ad-slot'>{words(40, f'ad{k}')}</div><footer>Foot {k}</footer></body></html>"
    )
    return page, "\n\n".join([title, *body])


@pytest.mark.parametrize("mark", ["article", "content", "none"])
def test_templates(spark, mark):
    made = [(k, f"https://{mark}.example/{k}", *plain_page(k, 1 + k % 4, mark)) for k in range(24)]
    out = hx.extract_main_text(spark.createDataFrame([x[:3] for x in made], "page_id long, url string, html string"))
    got = {r.row.page_id: r.text for r in out.collect()}
    assert got == {k: text for k, _, _, text in made}


def test_awkward_rows_many_shapes_and_a_hot_host(spark, monkeypatch):
    monkeypatch.setattr(hx, "FAN", 2)
    r, rows, want = random.Random(7), [], Counter()
    for k in range(120):
        tags = [(r.choice(["p", "h2", "pre", "blockquote"]), f"{k} text {j}") for j in range(r.randint(0, 6))]
        rows.append((k, "http://hot.example/x" if k % 3 else f"HTTP://u@h{k % 5}.example:80/", f"<nav>menu</nav><article>{''.join(f'<{t}>{x}</{t}>' for t, x in tags)}</article><footer>f"))
        want[k, "\n\n".join(x for _, x in tags)] += 1
    for row, text in (((None, None, None), ""), ((500, "", ""), ""), ((501, "no url", "just text"), "just text"), ((502, "http://a.example", "<article>cut <b>off"), "cut off"), ((502, "http://a.example", "<article>cut <b>off"), "cut off")):
        rows.append(row)
        want[row[0], text] += 1
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    from pyspark.sql import functions as F

    for c in ["host", "key", "shape", "slots", "keep", "salt", "row", "text", "pages"]:
        df = df.withColumn(c, F.lit("clash"))
    out = hx.extract_main_text(df.repartition(3))
    assert Counter((x.row.page_id, x.text) for x in out.collect()) == want
    assert hx.extract_main_text(df.limit(0)).count() == 0


def test_given_pages(spark):
    from caretrail.llm.queries import QUERIES

    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op11_html_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        blocks = re.split("</?(?:p|h1)>", re.search("<article>(.*?)</article>", r.html, re.S)[1])
        texts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
        text = "\n\n".join(t for t in texts if t)
        assert got[r.page_id] == (text, len(text))
