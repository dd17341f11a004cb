"""Main text of HTML pages by site template removal.

Each page is parsed once into blocks of text (paragraphs, headings, list items, cells) and the tree
of elements that holds them, of any depth. An element has two hashes: of its content (tag and all that is
below it) and of its place (tag, class, id and role of it and of all that it stands in). Both are
counted per host in Spark.

* Content that recurs on `TEMPLATE_SHARE` of a host's differing pages (`TEMPLATE_PAGES` at least) is
  template, and goes.
* A container (div, section, nav ...) whose place recurs on `SLOT_PAGES` of a host's pages and holds
  less than `SLOT_SHARE` of their text on average is a slot of the template, whatever its words: menus,
  adverts and footers that differ from page to page. Containers within `article` or `main` are no slots.
* A page most of whose text would go that way is a copy of a common page, not template, and keeps it.
* What HTML itself names as other than the article goes too, and is all there is to go by on hosts of
  few pages: navigation, headers, footers, asides, forms, scripts, styles, and elements whose class, id
  or role says advert, notice, menu, comments and the like.

Of what is left the `article` elements count alone if they hold half of the text or more, else
`main` and `article` if these do, else all.

Defined results: html null or empty -> empty text; url null -> pages without host form one host;
repeated rows -> one result each; broken or cut-off markup -> parsed as far as it goes; empty
table -> empty result; extra columns are ignored. Texts are never cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm._shared import read_table, stored

TEMPLATE_SHARE = 0.3
TEMPLATE_PAGES = 5
SLOT_PAGES, SLOT_SHARE = 0.6, 0.2
#: Most subtree hashes of all hosts that are broadcast.
BROADCAST_HASHES = 500_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
#: Elements that never belong to the article.
DROPPED = frozenset("head nav footer aside form script style title textarea noscript iframe noembed noframes template svg math canvas object audio video button select option dialog menu datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: start tag -> (elements it ends, elements beyond which it ends none)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of a class or id that mark what is no article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adslot adbox adsense sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup paywall sidebar sidebars rail menu menus nav navbar navigation navi breadcrumb breadcrumbs crumbs footer foot header masthead topbar toolbar comment comments commentlist disqus respond replies related recommended recommendations teaser teasers share sharing social widget widgets pagination pager login search searchform hidden skip sitemap copyright banner".split())
#: Elements that may be slots of a template.
CONTAINERS = frozenset("div section nav aside header footer form main article".split())
#: What is kept of an element beside its hashes.
MARKED, ARTICLE, MAIN = 1, 2, 4

_TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|([!?][^>]*)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_MARK = re.compile(r"[a-z0-9]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


def _unwanted(tag: str, attrs: str) -> bool:
    if tag in DROPPED:
        return True
    if not attrs.strip():
        return tag == "header"
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    if tag not in ("html", "body", "article", "main") and (found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|$)", _ATTR.sub("", attrs))):
        return True
    if re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if tag not in ("html", "body", "main"):
        names = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower()
        marks = MARKS if tag != "article" else {"comment", "comments", "ad", "advert", "related", "teaser"}
        if any(w in marks for w in _MARK.findall(names)):
            return True
    return tag == "header"


def _place(tag: str, attrs: str) -> str:
    found = {k.lower(): x or y or z for k, x, y, z in _ATTR.findall(attrs)} if attrs.strip() else {}
    return "\x02".join((tag, " ".join(sorted(found.get("class", "").split())), found.get("id", ""), found.get("role", "")))


def tree(html: str | None) -> tuple[list[str], list[int], list[int], list[int], list[int], list[int]]:
    """Blocks: texts and the elements that hold them. Elements, parents first: parent (-1 for the
    outermost), hash of the content, hash of the place, flags."""
    if not html:
        return [], [], [], [], [], []
    tags, parents, parts, marks, places = ["#root"], [-1], [[]], [False], [0]
    events: list[tuple[int, object]] = []  # (node, text), (node, True) begins, (node, False) ends
    stack, at, end, open_ = [0], 0, len(html), Counter()

    def text(s: str) -> None:
        if s:
            s = unescape(s)  # a reference does not go beyond its own run of text
            parts[stack[-1]].append(s)
            events.append((stack[-1], s))

    def pop() -> None:
        open_[tags[stack[-1]]] -= 1
        events.append((stack.pop(), False))

    def end_until(names: set[str], fence: set[str]) -> None:
        if not any(open_[x] for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if tags[stack[i]] in names:
                while len(stack) > i:
                    pop()
                return
            if tags[stack[i]] in fence:
                return

    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            text(html[at:])
            break
        m = _TAG.match(html, begin)
        if not m:
            # no tag, or a quote that never ends: the sign is text unless a name follows
            stop = html.find(">", begin) if re.match(r"</?[a-zA-Z]", html[begin : begin + 3]) else begin
            text(html[at : begin if stop != begin else begin + 1])
            at = begin + 1 if stop == begin else (end if stop < 0 else stop + 1)
            continue
        text(html[at:begin])
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag == "br":
                text(" ")
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                t = tags[stack[i]]
                if t == tag:
                    while len(stack) > i:
                        pop()
                    break
                if tag in INLINE and t not in INLINE or tag == "p" and t in ("article", "body", "div", "section", "td", "li", "main"):
                    break
            continue
        if tag in CLOSES_P:
            end_until({"p"}, {"article", "body", "div", "section", "td", "th", "li", "main", "blockquote", "button", "table", "figure", "dd"})
        if tag in ENDS:
            end_until(*ENDS[tag])
        if tag == "body" or tag in CLOSES_P:
            end_until({"head"}, {"body"})
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                events += [(stack[-1], None)]
            continue
        if tag == "html" or tag == "body" and open_["body"]:
            continue
        if tag in RAW:
            close = _RAW_END[tag].search(html, at)
            at = close.end() if close else end
            continue
        if m[4].rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        node = len(tags)
        tags.append(tag)
        parents.append(stack[-1])
        parts.append([])
        marks.append(_unwanted(tag, m[4]))
        places.append(xxhash.xxh64_intdigest(f"{places[stack[-1]]:x}\x03{_place(tag, m[4])}".encode("utf-8", "replace")))
        parts[stack[-1]].append(node)
        events.append((node, True))
        stack.append(node)
        open_[tag] += 1
    while len(stack) > 1:
        pop()

    hashes = [0] * len(tags)
    for i in range(len(tags) - 1, -1, -1):
        content = "\x00".join(f"\x01{hashes[x]:x}" if isinstance(x, int) else " ".join(x.split()) for x in parts[i])
        hashes[i] = xxhash.xxh64_intdigest(f"{tags[i]}\x02{content}".encode("utf-8", "replace")) >> 1

    # inline elements belong to the box around them; a marked one takes its text along
    inline = [t in INLINE for t in tags]
    box, gone = list(range(len(tags))), [False] * len(tags)
    for i in range(1, len(tags)):
        if inline[i]:
            box[i], gone[i] = box[parents[i]], gone[parents[i]] or marks[i]
    held: list[str] = []
    texts, owners, where = [], [], 0

    def flush() -> None:
        words = " ".join("".join(held).split()) if held else ""
        if words:
            texts.append(words)
            owners.append(where)
        held.clear()

    for node, what in events:
        if isinstance(what, str):
            if not gone[node]:
                if not held:
                    where = box[node]
                held.append(what)
        elif what is None or not inline[node]:
            flush()
    flush()
    some = [False] * len(tags)  # boxes that hold text
    for i in sorted(set(owners), reverse=True):
        some[i] = True
    for i in range(len(tags) - 1, 0, -1):
        if some[i]:
            some[box[parents[i]]] = True
    kept = [i for i in range(len(tags)) if some[i]]
    new = {i: n for n, i in enumerate(kept)}
    flags = [MARKED * marks[i] | ARTICLE * (tags[i] == "article") | MAIN * (tags[i] == "main") for i in kept]
    # places below an article are its own affair, others than containers none
    closed = [False] * len(tags)
    for i in range(1, len(tags)):
        closed[i] = closed[parents[i]] or tags[i] in ("article", "main")
    slots = [places[i] >> 1 if tags[i] in CONTAINERS and not closed[i] else 0 for i in kept]
    return texts, [new[i] for i in owners], [new[box[parents[i]]] if i else -1 for i in kept], [hashes[i] if i else 0 for i in kept], slots, flags


def shares(texts: list[str], owners: list[int], parents: list[int], slots: list[int]) -> dict[int, float]:
    """The share of a page's text that stands in each slot."""
    size = [0] * len(parents)
    for t, i in zip(texts, owners, strict=True):
        size[i] += len(t)
    out: dict[int, float] = {}
    for i in range(len(parents) - 1, -1, -1):
        if slots[i]:
            out[slots[i]] = out.get(slots[i], 0) + size[i]
        if parents[i] >= 0:
            size[parents[i]] += size[i]
    return {k: v / size[0] for k, v in out.items()}


def main_text(texts: list[str], owners: list[int], parents: list[int], hashes: list[int], slots: list[int], flags: list[int], common: set[int]) -> tuple[list[str], int, int, int]:
    """Blocks that are left without template content, template slots and what is marked; how many
    each of these took, in this order."""
    content, slot, marked, level = ([0] * len(parents) for _ in range(4))
    for i, up in enumerate(parents):
        above = (lambda x: x[up]) if up >= 0 else (lambda x: 0)
        content[i] = above(content) | (hashes[i] in common)
        slot[i] = above(slot) | (slots[i] in common)
        marked[i] = above(marked) | flags[i] & MARKED
        level[i] = max(above(level), 2 if flags[i] & ARTICLE else 1 if flags[i] & MAIN else 0)
    left, taken = list(range(len(texts))), []
    size = lambda some: sum(len(texts[k]) for k in some)
    for by in (content, slot):
        rest = [k for k in left if not by[owners[k]]]
        plain = [k for k in left if not marked[owners[k]]]
        # a page that would lose most of its text is a copy; what is marked is no loss
        if 2 * size(k for k in rest if not marked[owners[k]]) < size(plain):
            rest = [k for k in left if not (by[owners[k]] and marked[owners[k]])]
        taken.append(len(left) - len(rest))
        left = rest
    rest = [k for k in left if not marked[owners[k]]]
    taken.append(len(left) - len(rest))
    for least in (2, 1):
        inner = [k for k in rest if level[owners[k]] >= least]
        if inner and 2 * size(inner) >= size(rest):
            rest = inner
            break
    return [texts[k] for k in rest], *taken


PARSED = "page_id {kind}, url string, host string, digest long, texts array<string>, owners array<int>, parents array<int>, hashes array<long>, slots array<long>, flags array<int>, places array<long>, shares array<double>"


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    kind = pages.schema[id_col].dataType.simpleString()
    lists = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    names = ["page_id", "url", "host", "digest", "texts", "owners", "parents", "hashes", "slots", "flags", "places", "shares"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, digests, rows = b.slice(at, 500), [], []
                for h in part.column(3):
                    found = tree(h.as_py())
                    share = shares(*found[:3], found[4])
                    rows.append((*found, list(share), list(share.values())))
                    digests.append(xxhash.xxh64_intdigest("\x00".join(found[0]).encode("utf-8", "replace")) >> 1)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), lists, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(digests, pa.int64()), *columns], names=names)

    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(url, "://([^/?#]*)", 1))
    slim = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(run, PARSED.format(kind=kind))


def templates(table: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES, slot_pages: float = SLOT_PAGES, slot_share: float = SLOT_SHARE) -> DataFrame:
    """(host, site): hashes of content and of places that belong to a host's template."""
    # pages of one host with the same text count once
    of_page = table.select("host", "digest", F.explode(F.array_distinct("hashes")).alias("h"))
    differing = table.groupBy("host", "digest").count().groupBy("host").agg(F.count("*").alias("pages"))
    content = of_page.groupBy("host", "h", "digest").count().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    content = content.join(differing, "host").where((F.col("n") >= share * F.col("pages")) & (F.col("h") != 0)).select("host", "h")
    pages = table.where(F.size("texts") > 0).groupBy("host").agg(F.count("*").alias("pages"))
    places = table.select("host", F.explode(F.arrays_zip("places", "shares")).alias("p")).groupBy("host", F.col("p.places").alias("h")).agg(F.count("*").alias("n"), F.sum("p.shares").alias("s"))
    places = places.where(F.col("n") >= least).join(pages, "host").where((F.col("n") >= slot_pages * F.col("pages")) & (F.col("s") < slot_share * F.col("n"))).select("host", "h")
    # each recurs on a share of the host's pages, so a host has 1 / share times a page's elements at most
    return content.unionByName(places).groupBy("host").agg(F.collect_set("h").alias("site"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, and how many blocks template content, template slots and marks took."""
    table = stored(parsed(pages, id_col, url_col, html_col), "blocks")
    of_host = stored(templates(table, share, least), "templates")
    hashes = of_host.agg(F.coalesce(F.sum(F.size("site")), F.lit(0))).first()[0]
    if hashes <= BROADCAST_HASHES:  # a checked size; beyond it a join, whose skew Spark splits
        of_host = F.broadcast(of_host)
    kind = table.schema["page_id"].dataType.simpleString()
    own = F.array_intersect(F.concat("hashes", "slots"), "site")
    out = table.join(of_host, "host", "left").select("page_id", "url", "texts", "owners", "parents", "hashes", "slots", "flags", F.coalesce(own, F.array().cast("array<long>")).alias("common"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [main_text(*(c[k].as_py() for c in part.columns[2:8]), set(part.column(8)[k].as_py()) - {0}) for k in range(part.num_rows)]
                texts = ["\n\n".join(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *(pa.array([f[i] for f in found], pa.int32()) for i in (1, 2, 3))], names=["page_id", "url", "text", "n_chars", "n_template_blocks", "n_slot_blocks", "n_marked_blocks"])

    return out.mapInArrow(judge, f"page_id {kind}, url string, text string, n_chars long, n_template_blocks int, n_slot_blocks int, n_marked_blocks int")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
