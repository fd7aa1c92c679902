"""Captured HTML pages to rows, by regular block structure.

A page is cut at its block heads with one ``split`` and one ``regexp_extract_all``; both run
in linear time over the whole page, so large pages cost no backtracking. Free text and titles, which may
nest anything, are read by ``elements``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestfold.functions import parse, text
from nestfold.sources.elements import all_texts, elements, matching


def cut_blocks(html: Column, head_re: str) -> Column:
    """Array of blocks, each from one match of ``head_re`` to the next (or the page end)."""
    heads = F.regexp_extract_all(html, F.lit(head_re), F.lit(0))
    bodies = F.slice(F.split(html, head_re, -1), F.lit(2), F.size(heads))
    return F.zip_with(heads, bodies, lambda h, b: F.concat(h, b))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def extract_blocks(
    pages: DataFrame,
    html_col: str,
    head_re: str,
    fields: dict[str, str],
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per block of each page, with a column per named pattern (group 1, or null)."""
    keep = keep or []
    blocks = pages.select(
        *keep, F.posexplode(cut_blocks(F.col(html_col), head_re)).alias("block_no", "block")
    )
    return blocks.select(
        *keep, "block_no", "block", *[found(F.col("block"), p).alias(n) for n, p in fields.items()]
    )


def kv_pairs(html: Column, pair_re: str) -> Column:
    """Label/value pairs of a page as a map; a repeated label keeps its last value.

    ``pair_re`` has two groups. Values are reduced to one line of text. The last-value rule
    is the session's ``mapKeyDedupPolicy=LAST_WIN``.
    """
    labels = F.regexp_extract_all(html, F.lit(pair_re), F.lit(1))
    values = F.transform(F.regexp_extract_all(html, F.lit(pair_re), F.lit(2)), text.clean_inline)
    return F.map_from_entries(F.arrays_zip(labels.alias("key"), values.alias("value")))


def extract_kv_pairs(
    df: DataFrame, html_col: str, pair_re: str, out: str = "pairs", keep: list[str] | None = None
) -> DataFrame:
    return df.select(*(keep or []), kv_pairs(F.col(html_col), pair_re).alias(out))


# --- patterns built from names ---------------------------------------------------------------


def tag_of(name: str, holds: str = "") -> str:
    """An opening tag of that name (any, if empty) whose attributes match ``holds``."""
    return rf"<{name or '[a-z][a-z0-9]*'}\b(?=[^>]*{holds})[^>]*>" if holds else rf"<{name or '[a-z][a-z0-9]*'}\b[^>]*>"


def of_class(name: str, tag: str = "") -> str:
    """An opening tag that has the class ``name`` among its classes."""
    return tag_of(tag, rf"""\sclass=(?:["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["']|{name}(?=[\s/>]))""")


def attr(name: str) -> str:
    """The value of an attribute, in either quotes."""
    return rf"""\s{name}=["']([^"']*)["']"""


def json_field(name: str, value: str = '"([^"]*)"') -> str:
    """A field of a JSON object inside a text."""
    return rf'"{name}"\s*:\s*{value}'


def inner(opening: str, closing: str) -> str:
    """What stands between an opening tag and the first ``closing`` behind it."""
    return rf"(?s){opening}(.*?){closing}"


def text_after(opening: str) -> str:
    """The text between an opening tag and the next tag."""
    return rf"{opening}([^<]*)"


# Names in the pages of the HTML sources (fixed values).
LIST_B_BASE = "https://www.nekretnine.rs"
LIST_C_BASE = "https://www.halooglasi.com"
LIST_B_CARD, LIST_B_TITLE, LIST_B_META, LIST_B_PLACE = "offer-body", "offer-title", "offer-meta-info", "offer-location"
EXTRAS_HEADING, LIFT = "Dodatna opremljenost", "Lift"
LIST_C_CARD, LIST_C_FEATURES, LIST_C_PLACES = "product-item", "product-features", "subtitle-places"
POST_TEXT = "tgme_widget_message_text"

LIST_B_HEAD = of_class(LIST_B_CARD)
DETAIL_B_PAIR = inner(r"<span>\s*([^<:]+?)\s*:\s*</span>\s*<br\s*/?>", "</span>")
LIST_C_HEAD = of_class(LIST_C_CARD)
POST_HEAD = tag_of("div", attr("data-post"))


def cards_b(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """List pages of source B to cards; a card without link or date is dropped."""
    def read(b: Column, n: Column) -> Column:
        headings = elements(b, matching(of_class(LIST_B_TITLE, "h2")))
        anchors = elements(F.array_join(F.transform(headings, lambda e: e["inner"]), ""), matching(tag_of("a")))
        return text.once(anchors, lambda found_here: text.once(told(found_here), lambda x: card(b, n, x)))

    def told(anchors: Column) -> Column:
        # The link and, in its script, the facts of the card.
        raw_tag = F.get(anchors, F.lit(0))["tag"]
        title = text.full_strip(text.unescape(all_texts(anchors)))
        return F.struct(text.unescape(raw_tag).alias("tag"), text.unescape(found(raw_tag, attr("href"))).alias("href"), title.alias("title"))

    def card(b: Column, n: Column, x: Column) -> Column:
        tag, href, title = x["tag"], x["href"], x["title"]
        currency = F.coalesce(found(tag, json_field("currency")), F.lit("EUR"))
        price = F.coalesce(found(tag, json_field("price")).try_cast("double"), F.lit(0.0))
        m2 = F.translate(found(tag, json_field("item_category4")), ",", ".")
        kind = F.coalesce(found(tag, json_field("item_category2")), F.lit(""))
        meta = found(b, text_after(of_class(LIST_B_META)))
        place = found(b, text_after(of_class(LIST_B_PLACE)))
        return F.struct(
            n.alias("block_no"),
            F.substring_index(F.regexp_replace(href, "/+$", ""), "/", -1).alias("id"),
            F.concat(F.lit(LIST_B_BASE), href).alias("url"),
            title.alias("title"),
            F.when(currency == "EUR", price).otherwise(F.lit(0.0)).alias("price_eur"),
            F.coalesce(m2.try_cast("double"), F.lit(0.0)).alias("m2"),
            F.coalesce(parse.rooms_from_text(F.concat_ws(" ", kind, title)), F.lit(0.0)).alias("rooms"),
            text.full_strip(text.unescape(F.coalesce(place, F.lit("")))).alias("location"),
            parse.parse_dotted_date(meta, anchored=False).alias("posted_at"),
        )

    # Blocks are read inside the array, so each is parsed once and a dropped one never becomes a row.
    cards = F.transform(cut_blocks(F.col(html_col), LIST_B_HEAD), lambda b, n: read(b, n))
    whole = F.filter(cards, lambda c: c["url"].isNotNull() & c["posted_at"].isNotNull())
    return pages.select(*(keep or []), F.inline(whole))


def details_b(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Detail pages of source B: labelled facts, lift, text and picture."""
    h = F.col(html_col)
    pairs = F.col("_pairs")
    rows = pages.select(url_col, h, kv_pairs(h, DETAIL_B_PAIR).alias("_pairs"))
    fact = lambda label: F.nullif(F.try_element_at(pairs, F.lit(label)), F.lit(""))
    spot = parse.parse_floor(fact("Sprat"), "listed")
    body = all_texts(elements(h, matching(of_class("description"))))
    # The items listed under the heading, up to the next heading.
    extras = F.get(F.split(F.get(F.split(h, EXTRAS_HEADING, 2), F.lit(1)), r"<h[1-6]\b", 2), F.lit(0))
    items = F.transform(F.regexp_extract_all(extras, F.lit(inner(tag_of("li"), "</li>")), F.lit(1)), text.clean_inline)
    words = text.full_strip(text.unescape(body))
    return rows.select(
        url_col,
        spot["floor"].alias("floor"),
        spot["total"].alias("total_floors"),
        F.coalesce(F.array_contains(items, LIFT), F.lit(False)).alias("elevator"),
        fact("Grejanje").alias("heating_type"),
        fact("Opremljenost").alias("furnished"),
        words.alias("description"),
        text.unescape(found(found(h, f"({tag_of('meta', 'og:image')})"), attr("content"))).alias("image_url"),
        fact("Adresa").alias("address"),
    )


def same_floor(floor: Column, total: Column) -> Column:
    return F.coalesce(floor == total, F.lit(False))


def card_detail_join(cards: DataFrame, details: DataFrame, on: str = "url") -> DataFrame:
    """Cards with their detail page; a card whose detail is missing is dropped."""
    places = F.slice(
        F.filter(F.transform(F.split("location", ","), text.full_strip), lambda p: p != ""), 1, 3
    )
    return cards.join(details, on, "inner").select(
        "id",
        F.lit("nekretnine").alias("source"),
        on,
        "price_eur",
        "m2",
        "rooms",
        "floor",
        "total_floors",
        same_floor(F.col("floor"), F.col("total_floors")).alias("last_floor"),
        "elevator",
        "furnished",
        "heating_type",
        F.lit(None).cast("boolean").alias("pets_allowed"),
        "title",
        "description",
        "address",
        places.alias("place_names"),
        "image_url",
        F.lit(False).alias("is_agency"),
        F.col("posted_at").alias("created_at"),
    )


def listings_c(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """List pages of source C straight to listings; inserts without id or link are dropped."""
    b = F.col("block")
    item_re = inner(tag_of("li"), "</li>")
    feature_list = F.regexp_extract(b, inner(of_class(LIST_C_FEATURES), "</ul>"), 1)
    legend_first, value_first = text_after(of_class("legend")), text_after(of_class("value-wrapper"))
    place_list = F.regexp_extract(b, inner(of_class(LIST_C_PLACES), "</ul>"), 1)
    rows = extract_blocks(
        pages,
        html_col,
        LIST_C_HEAD,
        {
            "id": f"^<[^>]*{attr('data-id')}",
            "link": f"(?s)({of_class('a-images', 'a')}.*?</a>)",
            "price": f"(?s){of_class('central-feature')}.*?<span[^>]*{attr('data-value')}",
            "title": f"(?s){of_class('product-title')}.*?{text_after(tag_of('a'))}",
            "published": text_after(of_class("publish-date", "span")),
            "owner_tag": f"({tag_of('', 'oglasivac_nekretnine_s')})",
            "body": text_after(of_class("text-description-list")),
        },
    )
    rows = rows.withColumn(
        "features",
        F.map_from_entries(
            F.transform(
                F.regexp_extract_all(feature_list, F.lit(item_re), F.lit(1)),
                lambda li: F.struct(
                    text.full_strip(F.regexp_extract(li, legend_first, 1)).alias("key"),
                    text.full_strip(F.regexp_extract(li, value_first, 1)).alias("value"),
                ),
            )
        ),
    ).withColumn(
        "places",
        F.filter(
            F.transform(
                F.regexp_extract_all(place_list, F.lit(item_re), F.lit(1)),
                lambda li: text.full_strip(text.unescape(F.regexp_replace(li, "<[^>]+>", ""))),
            ),
            lambda p: p != "",
        ),
    )
    feature = lambda name: F.try_element_at("features", F.lit(name))
    spot = parse.parse_floor(feature("Spratnost"), "roman")
    href = text.unescape(found(F.col("link"), f"^<a\\b[^>]*{attr('href')}"))
    plain = lambda c: text.full_strip(text.unescape(F.coalesce(F.col(c), F.lit(""))))
    out = rows.select(
        "id",
        F.lit("halooglasi").alias("source"),
        F.concat(F.lit(LIST_C_BASE), F.substring_index(href, "?", 1)).alias("url"),
        parse.parse_price(F.col("price")).alias("price_eur"),
        F.coalesce(parse.first_int(feature("Kvadratura")).cast("double"), F.lit(0.0)).alias("m2"),
        F.coalesce(parse.first_float(feature("Broj soba")), F.lit(0.0)).alias("rooms"),
        spot["floor"].alias("floor"),
        spot["total"].alias("total_floors"),
        same_floor(spot["floor"], spot["total"]).alias("last_floor"),
        F.lit(None).cast("boolean").alias("elevator"),
        F.lit(None).cast("string").alias("furnished"),
        F.lit(None).cast("string").alias("heating_type"),
        F.lit(None).cast("boolean").alias("pets_allowed"),
        plain("title").alias("title"),
        plain("body").alias("description"),
        F.get("places", F.size("places") - 1).alias("address"),
        F.col("places").alias("place_names"),
        text.unescape(found(F.col("link"), f"<img[^>]*{attr('src')}")).alias("image_url"),
        F.coalesce(found(F.col("owner_tag"), attr("data-field-value")) == "agencija", F.lit(False)).alias("is_agency"),
        parse.parse_dotted_date(F.col("published")).alias("created_at"),
    )
    return out.filter(
        F.col("id").isNotNull() & F.col("url").isNotNull() & F.col("created_at").isNotNull()
    )


def extract_posts(
    pages: DataFrame, html_col: str = "html", channel_col: str = "channel", keep: list[str] | None = None
) -> DataFrame:
    """Channel preview pages to posts.

    Cards of other channels and service messages (no text, no picture) are dropped.
    """
    keep = keep or []
    channel = F.col(channel_col)
    address = lambda b: F.regexp_extract(b, attr("data-post"), 1)  # noqa: E731  channel/number

    def read(b: Column) -> Column:
        body = found(b, inner(of_class(POST_TEXT, "div"), "</div>"))
        pictures = F.regexp_extract_all(b, F.lit(r"background-image:\s*url\((?:'|&#39;)?(.*?)(?:'|&#39;)?\)"), F.lit(1))
        photos = F.filter(pictures, lambda u: u.startswith("http"))
        return F.struct(
            F.substring_index(address(b), "/", 1).alias("channel"),
            F.substring_index(address(b), "/", -1).try_cast("bigint").alias("message_id"),
            F.coalesce(text.strip_markup(body), F.lit("")).alias("text"),
            photos.alias("photo_urls"),
            parse.parse_iso_time(found(found(b, f"({tag_of('time')})"), attr("datetime"))).alias("posted_at"),
        )

    # Blocks are read inside the array, so each is parsed once and a dropped one never becomes a row.
    own = F.filter(cut_blocks(F.col(html_col), POST_HEAD), lambda b: F.substring_index(address(b), "/", 1) == channel)
    posts = F.filter(
        F.transform(own, lambda b: read(b)), lambda p: (p["text"] != "") | (F.size(p["photo_urls"]) > 0)
    )
    return pages.select(*keep, F.inline(posts))
