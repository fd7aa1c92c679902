"""Page elements against a reader that keeps a stack."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from nestfold.sources import html
from nestfold.sources.elements import VOID, all_texts, elements, matching


def read(spark, pages, pattern):
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, page string")
    got = df.select("k", elements(F.col("page"), matching(pattern)).alias("found")).orderBy("k").collect()
    return [[(e.tag, e.inner, e.texts) for e in r.found] for r in got]


class Stack(HTMLParser):
    """Text nodes of all elements of class ``c`` of a page whose tags are balanced."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.open, self.texts = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append("c" in (dict(attrs).get("class") or "").split())

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if any(self.open):
            self.texts.append(data)


def page(rng, depth=0):
    parts = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        if kind < 0.4 or depth > 4:
            parts.append(rng.choice(["tekst", " ", "a b", "\n", "č"]))
        elif kind < 0.55:
            parts.append(rng.choice(["<br>", "<br/>", '<img alt="</div>">', "<!-- </div> -->", "<hr class='c'>", "<span/>"]))
        else:
            tag = rng.choice(["div", "span", "DIV", "section", "ul"])
            css = rng.choice(["", "", ' class="c"', " class='x c'", ' title="<div>"', ' class="cc"'])
            parts.append(f"<{tag}{css}>{page(rng, depth + 1)}</{tag.lower() if rng.random() < 0.5 else tag}>")
    return "".join(parts)


def test_nested_elements(spark):
    rng = random.Random(11)
    pages = [page(rng) for _ in range(400)]
    got = read(spark, pages, html.of_class("c"))
    for p, found in zip(pages, got, strict=True):
        # Neighbouring texts without a tag between them are one node; so they are in the stack's reader.
        assert [t for _, _, texts in found for t in texts] == Stack(p).texts, p
        for tag, inner, _ in found:
            assert tag + inner in p


def test_text_behind_a_nested_end(spark):
    pages = [
        '<div class="description"><p>Lep stan.</p><div>Lista</div> Bez ljubimaca, minimum 18 meseci.</div>dalje',
        '<p class="description">jedan<p class="description">dva<div>ne</div>',
        '<div class="description">bez kraja <b>i ovo',
        '<section class="description"><script>if (a < b) "</section>"</script>x</section>',
        "<div class=description title=\"a>b\">y</div><div class='description x'>z</div>",
        "", "bez oznaka", None,
    ]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, page string")
    out = df.select(all_texts(elements(F.col("page"), matching(html.of_class("description")))).alias("t")).orderBy("k").collect()
    assert [r.t for r in out] == ["Lep stan. Lista  Bez ljubimaca, minimum 18 meseci.", "jedan dva", "bez kraja  i ovo", "x", "y z", "", "", ""]


def test_long_pages(spark):
    """Thousands of tags and one very long attribute: linear, and no deep recursion."""
    big = '<div class="c">' + "<i>t</i>" * 20_000 + f'<a title="{"x" * 300_000}">u</a>' + "</div><p>v</p>"
    (found,) = read(spark, [big], html.of_class("c"))
    assert len(found) == 1 and len(found[0][2]) == 20_001


def test_a_card_is_parsed_once(spark):
    """Its fields and the filter over them share one reading: one of the headings, one of the links in them."""
    from nestfold.sources import html

    plan = html.cards_b(spark.createDataFrame([("x",)], "html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2


def test_ends_are_stripped_of_any_white_space(spark):
    from pyspark.sql import functions as F

    from nestfold.functions.space import full_strip
    from nestfold.functions.text import unescape

    texts = [" a b\n", "\u00a0\u2028x\u3000\r\n", "\x1c\t ", "", "a\nb c", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(full_strip(F.col("t"))).collect()] == ["a b", "x", "", "", "a\nb c", None]
    refs = spark.createDataFrame([("&#8364;&#x20aC;&amp;lt;&#0;&#xD800;&nope;&#x110000;",)], "t string")
    assert refs.select(unescape(F.col("t"))).first()[0] == "€€&lt;&#0;&#xD800;&nope;&#x110000;"
