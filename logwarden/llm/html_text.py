"""Main text of web pages by host consensus.

Every page scores its containers by the running text they hold, widens the best one until
it holds the running text around it, and votes for its path: tags and classes from the root, numbers left out. Votes are counted per host, and each
page is read again along the paths that won on its host, so a page whose own best container
is a long comment or advert still yields what its siblings call the article.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from logwarden.llm import arrow
from logwarden.operators.skew import salted_join
from logwarden.stage import written

LEVELS = 12  # elements that a path names, from the container upwards
WRAPPER = 0.75  # share of a page's running text that makes a form or a class named so a wrapper
RUNNING = 20.0  # worth from which text counts as running: one line of 40 characters
LEAD = 80  # characters from which a paragraph in an article's own header is text of it
SHARE = 0.1  # of a host's votes that a further path needs to be used as well
SMALL_LIST = 100_000  # hosts; a longer list is joined by a shuffle

# Fixed lists of HTML elements.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math", "canvas", "select", "xmp"}
_TO_THE_END = {"script", "style", "textarea", "title", "iframe", "xmp"}  # without an end tag they reach to the end of the page
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "label",
    "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul", "video", "audio",
}
_CONTAINERS = {"body", "html", "div", "article", "section", "main", "td", "center", "aside", "form", "nav", "header", "footer", "dialog", "details"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# An element of the first kind ends an open one of the second, up to the third.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "body": ({"head"}, {"html"}),
}
# Elements, and words of classes and ids, that are no part of an article. A form, or an
# element with such a word, that holds most of a page's text is a wrapper all the same.
_OUTSIDE = {"nav", "aside", "footer", "button", "menu", "dialog", "head"}
_OF_FORMS = {"label", "fieldset"}  # outside within a form
_OUTSIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "menu", "nav",
    "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "topbar", "toolbar", "cookie", "cookies",
    "consent", "popup", "modal", "newsletter", "subscribe", "signup", "login", "commentlist", "disqus", "pagination", "pager",
}
# Words of everyday use: they say so only in a name without other words than the second kind's.
_EVERYDAY_WORDS = {
    "notice", "notices", "alert", "overlay", "subscription", "share", "sharing", "social", "related", "recommended", "comment", "comments",
    "respond", "reply", "replies", "widget", "skip", "hidden",
}
_PART_WORDS = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "count", "feed", "form",
    "global", "has", "header", "icon", "icons", "id", "inner", "is", "item", "items", "js", "left", "link", "links", "list", "media", "module",
    "outer", "page", "panel", "post", "posts", "reader", "readers", "right", "row", "section", "site", "strip", "text", "thread", "threads",
    "title", "to", "top", "user", "users", "wp", "wrap", "wrapper", "article", "articles", "stories", "story", "us", "new", "open",
}
# A tag ends behind its attributes; a quote opens a value only behind "=", and only if it is closed.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++|))?+)*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(?!["'])([^\s>]+)|))?""")
_WORD = re.compile(r"[a-z]+")


class Element(NamedTuple):
    tag: str
    names: str  # tag and classes without numbers
    parent: int
    outside: bool  # it or an element around it is no part of an article


class Block(NamedTuple):
    owner: int  # the element that holds the text
    text: str
    linked: int  # characters within links


def tags_of(html: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(begin, end, does it close, name, attributes) of tags in order; comments and
    declarations have no name. Nothing is read twice: behind the last ">" there are no tags,
    and once a tag's quotes run past all of them, quotes no longer count."""
    last, place, pattern = html.rfind(">"), html.find("<"), _TAG
    while place >= 0:
        kind = html[place + 1:place + 2]
        if kind == "!" and html.startswith("<!--", place):
            stop = html.find("-->", place + 2 if html.startswith("<!-->", place) else place + 4)
            end = stop + 3 if stop >= 0 else len(html)
            place = html.find("<", (yield place, end, False, None, "") or end)
            continue
        if place > last:
            place = html.find("<", place + 1)
            continue
        if kind and kind in "!?":
            end = html.index(">", place) + 1
            place = html.find("<", (yield place, end, False, None, "") or end)
            continue
        slash = kind == "/"
        letter = html[place + 2:place + 3] if slash else kind
        if not ("a" <= letter.lower() <= "z" and letter.isascii()):
            place = html.find("<", place + 1)
            continue
        tag = pattern.match(html, place)
        if not tag:
            pattern = _LOOSE_TAG
            tag = pattern.match(html, place)
        place = html.find("<", (yield place, tag.end(), slash, tag[2].lower(), tag[3]) or tag.end())


def raw_end(html: str, name: str, place: int) -> int:
    """Where the end tag of an element that is read as raw text ends, or -1."""
    stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, place)
    return html.find(">", stop.end()) + 1 or len(html) if stop else -1


def is_outside(value: str) -> bool:
    """Whether one of the names in a class or id is that of something that is no part of an article."""
    for name in value.lower().split():
        words = set(_WORD.findall(name))
        if words & _OUTSIDE_WORDS or words & _EVERYDAY_WORDS and words <= _EVERYDAY_WORDS | _PART_WORDS:
            return True
    return False


def read_page(html: str) -> tuple[list[Element], list[Block]]:
    """Elements and text blocks in page order. Unclosed and misnested elements are closed
    as browsers do it in the common cases; what cannot be read as a tag is text."""
    elements, blocks = [Element("", "", -1, False)], []
    doubtful: list[int] = []  # a form, or a class or id with a word that is no part of an article
    stack, inline = [0], []  # open block elements; open inline elements
    parts: list[str] = []
    links, linked, place = 0, 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append(Block(stack[-1], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(tags, until):
        for depth in range(len(stack) - 1, 0, -1):
            tag = elements[stack[depth]].tag
            if tag in tags:
                del stack[depth:]
                return
            if tag in until:
                return

    end = len(html)
    tags = tags_of(html)
    tag, forms = next(tags, None), 0
    endless: set[str] = set()  # raw elements that no end tag closes from here on
    while place < end:
        start = tag[0] if tag else end
        if start > place:
            parts.append(html[place:start])
            if links:
                linked += start - place
        if not tag:
            break
        _, place, closes, name, attributes = tag
        raw = name in _RAW and not closes and not attributes.endswith("/")
        if raw:
            stop = -1 if name in endless else raw_end(html, name, place)
            if stop < 0:
                endless.add(name)
            if stop >= 0 or name in _TO_THE_END:
                place = stop if stop >= 0 else end
                tag = _sent(tags, place)
                continue
        tag = next(tags, None)
        if name is None or raw:
            continue
        if closes:
            if name == "a":
                links = max(0, links - 1)
            if name in _BLOCKS:
                flush()
                if name == "form":
                    forms = max(0, forms - 1)
                if name == "p" or name in _HEADINGS:
                    close({name}, _CONTAINERS | {"li", "td", "th", "blockquote"})
                else:
                    close({name}, {"html"} if name != "html" else set())
            elif name == "br":
                parts.append(" ")
            continue
        if name in _RAW:
            continue
        if name == "br" or name in _VOID and name not in _BLOCKS:
            parts.append(" " if name == "br" else "")
            continue
        if name == "a":
            links += 1
        if name not in _BLOCKS:
            continue
        flush()
        if name == "hr":
            continue
        close({"p"}, _CONTAINERS | {"li", "td", "th", "blockquote", "figure"})
        if name in _ENDS:
            close(*_ENDS[name])
        names, hidden, named = [], False, False
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            hidden = hidden or key == "hidden"
            if key in ("class", "id"):
                named = named or is_outside(value)
                names += sorted(set(_WORD.findall(value.lower()))) if key == "class" else []
        parent = stack[-1]
        forms += name == "form"
        if name == "form" or named and name not in ("html", "body"):
            doubtful.append(len(elements))
        outside = elements[parent].outside or hidden or name in _OUTSIDE or forms > 0 and name in _OF_FORMS
        elements.append(Element(name, ".".join([name, *names]), parent, outside))
        stack.append(len(elements) - 1)
    flush()
    return judged(elements, blocks, doubtful), blocks


def _sent(tags: Iterator, place: int):
    """The first tag behind ``place``."""
    try:
        return tags.send(place)
    except StopIteration:
        return None


def judged(elements: list[Element], blocks: list[Block], doubtful: list[int]) -> list[Element]:
    """``elements`` with the doubtful ones that are no wrappers, and all within them, outside.
    A wrapper holds most of the running text, and the article or main element if there is one."""
    if not doubtful:
        return elements
    sums = text_sums(elements, blocks)
    main = [element.tag == "article" or element.tag == "main" and sums[k] > 0 for k, element in enumerate(elements)]
    within, above = [0] * len(elements), [0] * len(elements)  # main elements
    for k in range(1, len(elements)):
        above[k] = above[elements[k].parent] + main[elements[k].parent]
    for k in range(len(elements) - 1, 0, -1):
        within[elements[k].parent] += within[k] + main[k]
    marked = {
        k for k in doubtful
        if not sums[k] or sums[k] < WRAPPER * sums[0] or not within[k] and within[0] > above[k] + main[k]
    }
    out: list[Element] = []
    for k, element in enumerate(elements):
        outside = element.outside or k in marked or k > 0 and out[element.parent].outside
        out.append(element._replace(outside=outside) if outside and not element.outside else element)
    return out


def container(elements: list[Element], at: int) -> int:
    while at and elements[at].tag not in _CONTAINERS:
        at = elements[at].parent
    return at


def around(elements: list[Element], outer: int, at: int) -> bool:
    while at > outer:
        at = elements[at].parent
    return at == outer


def path_of(elements: list[Element], at: int) -> str:
    names = []
    while at and len(names) < LEVELS:
        names.append(elements[at].names)
        at = elements[at].parent
    return ">".join(reversed(names))


def worth(elements: list[Element], block: Block, lists: bool = False) -> float:
    """How much a block counts as running text: its length less what is linked; short ones
    hardly count. Entries of lists count only where ``lists`` says so, and without links."""
    owner = elements[block.owner]
    if owner.outside or owner.tag == "li" and (not lists or block.linked):
        return 0.0
    return max(0.0, (len(block.text) - 2 * block.linked) * min(1.0, len(block.text) / 80))


def text_sums(elements: list[Element], blocks: list[Block], lists: bool = False) -> list[float]:
    """Of each element the running text in it and below, without that of headers; that of lists
    where the page has no other."""
    sums = [0.0] * len(elements)
    header = [False] * len(elements)
    for k, element in enumerate(elements):
        header[k] = element.tag == "header" or k > 0 and header[element.parent]
    for block in blocks:
        if not header[block.owner]:
            sums[block.owner] += worth(elements, block, lists)
    for k in range(len(elements) - 1, 0, -1):
        sums[elements[k].parent] += sums[k]
    return sums if lists or sums[0] >= RUNNING else text_sums(elements, blocks, True)


def headers(elements: list[Element], chosen: set[int]) -> list[int]:
    """Of each element whether it is in a header: 1 of the page, 2 of an article, a main
    element or a chosen container other than the page's frame, 0 none."""
    of = [0] * len(elements)
    inner = [False] * len(elements)  # within an article
    for k, element in enumerate(elements):
        inner[k] = k > 0 and inner[element.parent] or element.tag in ("article", "main") or k in chosen and element.tag not in ("body", "html", "")
        of[k] = of[element.parent] if k else 0
        if element.tag == "header" and not of[k] or of[k] and k in chosen:
            of[k] = 2 if inner[k] else 1
    return of


def best_container(elements: list[Element], blocks: list[Block], lists: bool = False) -> int | None:
    """The container with most running text: a block counts whole for its own container and
    half for the one around that. Lists count on pages that have no other running text."""
    score: Counter = Counter()
    header = headers(elements, set())
    for block in blocks:
        value = worth(elements, block, lists)
        if value <= 0 or header[block.owner] == 1:
            continue
        own = container(elements, block.owner)
        score[own] += value
        if own:
            score[container(elements, elements[own].parent)] += value / 2
    if not lists and sum(score.values()) < RUNNING:
        listed = best_container(elements, blocks, True)
        return listed if listed is not None or not score else max(score, key=lambda k: (score[k], -k))
    if not score:
        return None
    return max(score, key=lambda k: (score[k], -k))


def whole(elements: list[Element], blocks: list[Block], at: int | None) -> int | None:
    """The widest container around ``at`` that holds running text which narrower ones do not:
    an article may be split over sections of any names and depth. An article element
    belongs to its text even if only its title is added."""
    if not at:
        return at
    sums = text_sums(elements, blocks)
    best = at
    while at:
        at = container(elements, elements[at].parent)
        if sums[at] - sums[best] >= RUNNING or elements[at].tag == "article":
            best = at
    return best


def article(elements: list[Element], blocks: list[Block], paths: list[str] | None) -> str:
    """Text of the containers on the first of ``paths`` that the page has, or of the page's
    own whole container if that lies around those and is on another of ``paths``; without
    any of these of its own one."""
    chosen: set[int] = set()
    own = whole(elements, blocks, best_container(elements, blocks))
    if paths:
        places: dict[str, set[int]] = {}
        wanted = {p.rpartition(">")[2] for p in paths}
        for k, element in enumerate(elements):
            if element.names in wanted and element.tag in _CONTAINERS and not element.outside:
                places.setdefault(path_of(elements, k), set()).add(k)
        chosen = next((places[p] for p in paths if p in places), set())
        if own is not None and path_of(elements, own) in paths and any(around(elements, own, k) for k in chosen):
            chosen = chosen | {own}
    if not chosen:
        if own is None:
            return ""
        chosen = {own}
    return "\n\n".join(block.text for block in taken(elements, blocks, chosen))


def taken(elements: list[Element], blocks: list[Block], chosen: set[int]) -> list[Block]:
    """Blocks of the chosen containers: headings and long unlinked paragraphs of a header
    inside, not its other lines. Also what stands next to them in the container around:
    headings and unlinked lines right before, lines right behind (headings there begin
    something else), as far as nothing else comes between; beside a page's frame only
    headings before."""
    within, header = [False] * len(elements), headers(elements, chosen)
    for k, element in enumerate(elements):
        within[k] = k in chosen or k > 0 and within[element.parent]

    def has(block):
        owner = elements[block.owner]
        if not within[block.owner] or owner.outside:
            return False
        if header[block.owner] and owner.tag not in _HEADINGS:
            return header[block.owner] == 2 and len(block.text) >= LEAD and 2 * block.linked < len(block.text)
        return True

    mine = [has(block) for block in blocks]
    inside = [k for k, yes in enumerate(mine) if yes]
    if inside:
        frames = {container(elements, elements[k].parent) for k in chosen if k}

        def beside(k, behind):
            block, owner = blocks[k], elements[blocks[k].owner]
            at = container(elements, block.owner)
            if at not in frames or owner.outside or header[block.owner] == 1 or owner.tag == "li" or 2 * block.linked >= len(block.text):
                return False
            heading = owner.tag in _HEADINGS
            return not behind and heading if elements[at].tag in ("body", "html", "") else not (behind and heading)

        k = inside[0] - 1
        while k >= 0 and beside(k, False):
            mine[k], k = True, k - 1
        k = inside[-1] + 1
        while k < len(blocks) and beside(k, True):
            mine[k], k = True, k + 1
    return [block for block, yes in zip(blocks, mine) if yes]


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes). A task adds up the votes of a batch before they are shuffled."""
    schema = StructType([StructField("host", StringType()), StructField("path", StringType()), StructField("votes", LongType())])

    def run(batches):
        for batch in batches:
            count: Counter = Counter()
            for url, html in zip(batch.column(0), batch.column(1)):
                elements, blocks = read_page(html.as_py() or "")
                best = whole(elements, blocks, best_container(elements, blocks))
                if best is not None:
                    count[host_of(url.as_py()), path_of(elements, best)] += 1
            keys = list(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()), pa.array([count[k] for k in keys], pa.int64())],
                names=schema.names,
            )

    cast = pages.select(F.col("url").cast("string"), F.col("html").cast("string"))
    return cast.mapInArrow(run, schema).groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winners(counted: DataFrame) -> DataFrame:
    """(host, paths): the path with most votes, and others with a tenth of the host's votes,
    most voted first; so there are at most ten."""
    total = counted.groupBy("host").agg(F.sum("votes").alias("total"))
    strong = counted.join(total, "host").where(F.col("votes") >= SHARE * F.col("total"))
    top = counted.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("top")).select("host", "top.votes", "top.path")
    rows = strong.select("host", "votes", "path").union(top).distinct()
    ordered = rows.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))).alias("all"))
    return ordered.select("host", F.col("all.path").alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` for every row. A null or empty html, or
    one without running text, gives an empty text. Rows without a url, or with one that
    names no host, vote together. Repeated rows are read each. Pages are read whole."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "(?s)^.*?://([^/?#]*)", 1))
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    counted = written(votes(pages))
    chosen = winners(counted)
    sized = counted.select("host").distinct().count()
    if sized <= SMALL_LIST:
        joined = source.join(F.broadcast(chosen), "host", "left")
    else:
        joined = salted_join(source, chosen, "host", source.groupBy("host").agg(F.count("*").alias("n")))
    joined = joined.select("page_id", "url", "html", "paths")
    kept = joined.schema.fields[:2]
    fields = [*kept, StructField("text", StringType()), StructField("n_chars", LongType())]

    def run(batches):
        for batch in batches:
            row = 0
            for chunk in arrow.chunks(batch.column(2)):
                part = batch.slice(row, len(chunk))
                row += len(chunk)
                out = [
                    article(*read_page(html), paths) for html, paths in zip(chunk.to_pylist(), part.column(3).to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=[f.name for f in fields]
                )

    return joined.mapInArrow(run, StructType(fields))
