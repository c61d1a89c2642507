"""Features of arbitrary page markup by the standard library's parser, in Arrow batches: text, links and forms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as texts
from ..functions import urls

FORM_WORDS = ("appointment", "book", "contact", "patient")
POLICY_WORDS = ("privacy", "hipaa")
_SPACES = " \t\n\r\f\x0b"
#: Pages whose features go back at once.
SLICE = 64

FORM_TYPE = T.StructType().add("fields", T.ArrayType(T.StringType())).add("action", T.StringType()).add("hasHttps", T.BooleanType())
PAGE_TYPE = T.StructType().add("text", T.StringType()).add("policy_href", T.StringType()).add("form", FORM_TYPE)


# Elements by what the HTML standard does with them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text: in the second group, with entities.
RAW, RAW_WITH_ENTITIES = frozenset("script style xmp iframe noembed noframes noscript".split()), frozenset(("textarea", "title"))
#: They don't begin a body.
HEAD = frozenset("html head base basefont bgsound link meta noframes script style template title noscript".split())
#: What an end tag of another element doesn't reach through.
BARRIERS = frozenset("applet caption html table td th marquee object template".split())
#: Start tags that end an open paragraph.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp dd dt".split())
#: Elements that end tags without an open element of their own leave alone, and inline ones pass through them no further.
SPECIAL = BLOCKS | BARRIERS | frozenset("body button col colgroup frame frameset head input select tbody textarea tfoot thead tr".split())
#: Open elements that a start tag of one of them ends.
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())

_BARE = re.compile("&(?!#?[0-9A-Za-z]+;)")


class _Page(HTMLParser):
    """Collects the text outside dropped elements, the anchors and the forms of a page, over a stack of open elements.

    Elements nest as in a browser's tree where that decides what is inside a form, an anchor or a dropped element: a slash
    ends void elements only, raw elements hold text, an end tag closes what is open inside its element and nothing where
    there is none, and siblings, paragraphs and cells end by the next one's start. Misplaced content of tables stays where
    it is, which changes its order only.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.mark = "&"
        self.all_text: list[str] = []
        self.body: list[str] = []
        self.in_body = False
        self.open: list[tuple[str, object]] = []
        self.links: list[list] = []
        self.forms: list[dict] = []
        self.pointer: dict | None = None

    def _within(self, kind: str):
        """What the innermost open element of a kind stands for."""
        return next((own for tag, own in reversed(self.open) if tag == kind), None)

    def _close(self, tag: str, stops: frozenset = BARRIERS) -> bool:
        """Closes the innermost element of this tag with all that is open in it, unless a barrier comes first."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return True
            if self.open[k][0] in stops:
                return False
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)

    def handle_starttag(self, tag, attrs):
        attrs = {k: (v or "").replace(self.mark, "&") for k, v in reversed(attrs)}  # the first of equal names counts
        if tag not in HEAD:
            self.in_body = True
        if tag in BLOCKS:
            self._close("p", BARRIERS | {"button"})
        if tag in SIBLINGS:
            stops = TABLE_PARTS if tag in ("td", "th") else frozenset(("table",)) if tag == "tr" else SPECIAL - {"address", "div", "p"} - set(SIBLINGS[tag])
            while any(self._close(t, stops) for t in SIBLINGS[tag]):
                pass
        own = None
        if tag == "a":
            self._close("a", frozenset(("table", "td", "th")))
            if "href" in attrs:
                own = [attrs["href"].strip(_SPACES), []]
                self.links.append(own)
        elif tag == "form":
            if self.pointer is not None:
                return
            own = self.pointer = {"action": attrs.get("action", ""), "fields": [], "labels": []}
            self.forms.append(own)
            if self.open and self.open[-1][0] in TABLE_PARTS:  # a form between rows and cells holds nothing
                return
        elif tag in ("input", "select", "textarea"):
            form = self._within("form")
            if form is not None:
                form["fields"].append({"tag": tag, "type": attrs.get("type", "").lower(), "name": attrs.get("name", ""), "id": attrs.get("id", "")})
        elif tag == "label":
            form, own = self._within("form"), []
            if form is not None:
                form["labels"].append(own)
        if tag in ("html", "head", "body"):
            return
        if tag not in VOID:
            self.open.append((tag, own))
        if tag in RAW | RAW_WITH_ENTITIES:
            self.set_cdata_mode(tag)

    def handle_endtag(self, tag):
        if tag in VOID or tag in ("html", "head", "body"):
            return
        if tag == "form":
            form, self.pointer = self.pointer, None
            self.open = [x for x in self.open if form is None or x[1] is not form]
        elif tag == "table":
            self._close(tag, frozenset(("template",)))
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            self._close(tag, frozenset(("table", "template")))
        elif tag in SPECIAL or tag == "a":
            self._close(tag, BARRIERS)
        else:
            self._close(tag, SPECIAL)

    def handle_data(self, data):
        if self.cdata_elem in RAW_WITH_ENTITIES:
            data = unescape(data)
        data = data.replace(self.mark, "&")
        inside = {tag for tag, _ in self.open}
        if not self.in_body and data.strip(_SPACES) and not inside & HEAD:
            self.in_body = True
        for tag, own in self.open:
            if tag == "a" and own is not None:
                own[1].append(data)
            elif tag == "label":
                own.append(data)
        if not inside.intersection(texts.DROPPED):
            self.all_text.append(data)
            if self.in_body:
                self.body.append(data)


def _read(html: str | None, bare: bool = True) -> _Page:
    """bare: references without a semicolon count too, as in browsers; otherwise they stay as they are written."""
    page, html = _Page(), html or ""
    if not bare:  # a noncharacter that the page doesn't hold stands for "&" meanwhile
        page.mark = next(c for c in map(chr, range(0xFDD0, 0xFDF0)) if c not in html)
        html = _BARE.sub(page.mark, html)
    page.feed(html)
    page.close()
    return page


def page_text(page: _Page, cap: int | None = texts.TEXT_CAP) -> str:
    """The body's text, or the whole document's where the body has none: at most cap code points, or all without a cap."""
    return " ".join(("".join(page.body) or "".join(page.all_text)).replace("﻿", " ").split())[:cap]


def policy_href(page: _Page) -> str | None:
    """The first link whose address or text speaks of privacy; there is no second choice."""
    for href, words in page.links:
        if href and any(w in href.lower() or w in "".join(words).strip().lower() for w in POLICY_WORDS):
            return href
    return None


def _is_primary(form: dict) -> bool:
    fields = form["fields"]
    return (
        any(f["tag"] == "input" and f["type"] == "email" for f in fields)
        or any("phone" in f["name"].lower() or "phone" in f["id"].lower() for f in fields)
        or any(w in "".join(label).lower() for label in form["labels"] for w in FORM_WORDS)
    )


def field_names(form: dict) -> list[str]:
    """Names (else ids) of visible fields, each once, in document order."""
    keys = [f["name"].strip(_SPACES) or f["id"].strip(_SPACES) for f in form["fields"] if f["type"] != "hidden"]
    return list(dict.fromkeys(k for k in keys if k))


def primary_form(page: _Page, url: str | None) -> dict | None:
    form = next((f for f in page.forms if _is_primary(f)), None)
    if form is None:
        return None
    action, encrypted = urls.resolve_action(form["action"], url)
    return {"fields": field_names(form), "action": action, "hasHttps": encrypted}


def _page_parser(bare: bool, cap: int | None):
    @F.pandas_udf(PAGE_TYPE)
    def parse_page(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        """Gives a batch back in slices, so that a worker holds few whole texts at once."""
        for html, url in batches:
            for start in range(0, len(html), SLICE):
                rows = []
                for h, u in zip(html[start : start + SLICE], url[start : start + SLICE]):
                    page = _read(h, bare)
                    rows.append((page_text(page, cap), policy_href(page), primary_form(page, u)))
                yield pd.DataFrame(rows, columns=["text", "policy_href", "form"])

    return parse_page


def page_features(pages: DataFrame, html: str = "html", url: str = "url", bare: bool = True, cap: int | None = texts.TEXT_CAP) -> DataFrame:
    """pages with text, policy_href and form. A null page has no text, link or form. bare: as _read has it. cap: as page_text has it."""
    return pages.withColumn("_page", _page_parser(bare, cap)(F.col(html), F.col(url))).select("*", "_page.text", "_page.policy_href", "_page.form").drop("_page")


PART_TYPE = T.StructType().add("kind", T.StringType()).add("place", T.IntegerType()).add("address", T.StringType()).add("text", T.StringType()).add("fields", T.ArrayType(T.StringType())).add("chosen", T.BooleanType())


class _Parts:
    """Every anchor with an address and every form of a page in document order: for `page_parts`."""

    def eval(self, html: str, url: str):
        page = _read(html)
        link = policy_href(page)
        for k, (href, words) in enumerate(page.links):
            yield "link", k, href, " ".join("".join(words).split()), None, href == link and next(j for j, x in enumerate(page.links) if x[0] == link) == k
        first = next((k for k, f in enumerate(page.forms) if _is_primary(f)), None)
        for k, form in enumerate(page.forms):
            yield "form", k, urls.resolve_action(form["action"], url)[0], None, field_names(form), k == first


def page_parts(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(key, kind, place, address, text, fields, chosen): a row for each link and form, by a lateral join. chosen: the policy
    link by its address, and the primary form. Pages without any have no row; null markup has none."""
    parts = F.udtf(_Parts, returnType=PART_TYPE)
    return pages.alias("p").lateralJoin(parts(F.col(f"p.{html}").outer(), F.col(f"p.{url}").outer())).select(f"p.{key}", *PART_TYPE.fieldNames())


def _text_parser(bare: bool):
    @F.pandas_udf(T.StringType())
    def parse_text(html: pd.Series) -> pd.Series:
        """The text of each page's body."""
        return html.map(lambda h: page_text(_read(h, bare)))

    return parse_text


def policy_link(html: Column) -> Column:
    """The first policy link of well-formed markup without a parser: anchors with double-quoted addresses."""
    anchors = F.regexp_extract_all(html, F.lit('(?is)(<a [^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    href = lambda a: F.btrim(F.regexp_extract(a, '(?is)href="([^"]*)"', 1), F.lit(_SPACES))
    words = lambda a: F.regexp_replace(a, "(?s)<[^>]*>", "")
    pattern = "(?i)" + "|".join(POLICY_WORDS)
    return F.get(F.transform(F.filter(anchors, lambda a: (href(a) != "") & (href(a).rlike(pattern) | words(a).rlike(pattern))), href), F.lit(0))


def fetch_policies(pages: DataFrame, store: DataFrame, href: str = "policy_href", url: str = "url", bare: bool = True) -> DataFrame:
    """pages with policy_url and policy_text, read from a table of fetched documents (url, ok, body).

    A link that isn't http or https, a document that is missing and one that wasn't fetched well give an empty text. Both
    sides' addresses are compared in their normal form. Of several documents of one address the least counts. Only wanted documents are shuffled with their markup, and each
    is parsed once. bare: as _read has it.
    """
    wanted = pages.withColumn("policy_url", urls.resolve_policy_url(F.col(href), F.col(url)))
    keys = wanted.select(urls.url_key(F.col("policy_url")).alias("_key")).filter("_key is not null").distinct()
    address = urls.url_key(urls.resolve_policy_url(F.col("url"), F.col("url")))
    found = store.filter("ok").select(address.alias("_key"), F.col("body").alias("_body")).join(keys, "_key", "left_semi")
    got = found.groupBy("_key").agg(F.min("_body").alias("_body")).select("_key", _text_parser(bare)("_body").alias("_text"))
    joined = wanted.join(got, urls.url_key(F.col("policy_url")) == F.col("_key"), "left")
    return joined.withColumn("policy_text", F.coalesce("_text", F.lit(""))).drop("_key", "_text")
