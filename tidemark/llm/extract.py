"""Main text of web pages by scoring the element tree.

A page is read once into flat arrays of block elements, in page order, and of text blocks, each in its nearest element.
A text block is worth its length and commas, less its share of links; its points go to its element and, halved or less a
level, to the elements above. The element with most points leads to the container: the ``article`` around it, or else the
element marked as main content, or else itself with those siblings that are paragraphs, lists or tables not made of links,
containers worth a fifth of it, sentences beside it, or headings of what is kept. Sums over the tree are single passes over the arrays, so nothing recurses, and a page costs
time and memory in proportion to its length.

Left out wherever they stand: scripts, styles, forms and their controls, ``nav``, ``footer``, ``aside``, ``header`` outside
of the article, hidden elements, elements whose role, class or id names menus, notices, adverts, sharing or comments, and
lists of nothing but short links. A form is a wrapper, not a form, if it has half of a page's points, or nine tenths of those of
the article it stands in, and holds a sentence or a mark of an article.

Defined results: a null or empty page, and one without text outside of what is left out, has an empty text; a page without
markup is a text of one block; an end tag without its start is ignored, and paragraphs, list items and cells end where the
next one begins; a comment or tag that is not closed runs to the page's end. References are decoded as browsers do, white
space is what ``str.split`` takes for it, ``br`` is white space, and ``pre`` is treated like any block. Repeated pages are
rows of their own; an empty table gives no rows; other columns of the table are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# Element names of HTML by their part in a page.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style noscript template iframe object svg canvas math head title textarea select button datalist nav footer aside menu dialog xmp noembed noframes audio video label legend fieldset input".split())
LISTS = frozenset("ul ol dl div table section".split())
#: An open element of the first kind ends where one of the second begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}}
#: Elements that end the search for an open paragraph or list item.
SCOPES = frozenset("html body table td th caption object button ul ol dl".split())
ENDS_PARAGRAPH = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class or id for what is not the article; those of the second list may also name a layout around it.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus "
    "gdpr login modal newsletter notice notices outbrain pager pagination paywall popup promo promos promotion promoted recommendations recommended related replies reply respond "
    "share sharing signup skip social sponsor sponsored subscribe subscription taboola tags toolbar trending".split()
)
LAYOUT = frozenset("aside footer header masthead menu menus nav navbar navigation sidebar sidebars topbar widget widgets".split())
MODIFIERS = frozenset("has with without no".split())
CONTENT_NAMES = frozenset("articlebody article-body article__body article-content articlecontent story-body entry-content post-content post-body".split())

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # comments
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"""|<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_COMMAS = re.compile("[,，、،]")  # noqa: RUF001
_SENTENCE = re.compile(r"[.!?…。！？:][\"'”’»)\]]*$")  # noqa: RUF001


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" else value))
    return found


class Page:
    """A page as flat arrays: elements (name, parent, whether left out) and text blocks (element, text, characters in links)."""

    def __init__(self, html: str) -> None:
        self.names, self.parents, self.marks, self.classes = ["#page"], [-1], [""], [""]
        self.noise: list[str] = [""]  # why an element may be left out
        self.at: list[int] = []  # of blocks
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.links: list[int] = []
        self._read(html)

    def _read(self, html: str) -> None:
        names, parents = self.names, self.parents
        stack, open_count = [0], {"#page": 1}
        paragraph = [-1]  # per open element: the place in the stack of the paragraph that the next block ends
        pieces: list[str] = []
        linked, links, in_link, begun = 0, 0, False, 0
        dropped_from = -1  # place in the stack from which nothing is text

        def flush() -> None:
            nonlocal linked, links
            if pieces:
                text = " ".join(unescape("".join(pieces)).split())
                if text:
                    self.at.append(stack[-1])
                    self.texts.append(text)
                    self.linked.append(min(linked, len(text)))
                    self.links.append(links)
                pieces.clear()
            linked = links = 0

        def close(place: int) -> None:
            nonlocal dropped_from, in_link
            flush()
            for node in stack[place:]:
                open_count[names[node]] -= 1
            del stack[place:], paragraph[place:]
            in_link = False
            if place <= dropped_from:
                dropped_from = -1

        def text(part: str) -> None:
            nonlocal linked
            if part and dropped_from < 0:
                pieces.append(part)
                if in_link:
                    linked += len(part.strip())

        while True:
            found = _TAG.search(html, begun)
            if not found:
                break
            text(html[begun : found.start()])
            begun = found.end()
            end, start = found.group(1), found.group(2)
            if end:
                name = end.lower()
                if name == "a":
                    in_link = False
                elif name == "br":
                    text(" ")
                elif open_count.get(name):
                    place = len(stack) - 1
                    while names[stack[place]] != name:
                        place -= 1
                    if place:
                        close(place)
            elif start:
                name, extra = start.lower(), found.group(3)
                if name == "br":
                    text(" ")
                    continue
                if name == "a":
                    in_link = True
                    links += 1
                    continue
                if name in RAW and not extra.endswith("/"):
                    # What these hold is no markup: on to their end tag.
                    stop = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(html, begun)
                    begun = stop.end() if stop else len(html)
                    if name in BLOCKS:
                        flush()
                    continue
                block, left_out = name in BLOCKS, name in DROPPED
                if name in VOID:
                    if block:
                        flush()
                    continue
                given = _attributes(extra) if extra.strip() else {}
                why = "always" if left_out else self._why(name, given)
                if not block and not why and not open_count.get(name):
                    continue
                if extra.endswith("/") and not block:
                    continue
                if block:
                    flush()
                    if name in ENDS_PARAGRAPH and paragraph[-1] > 0:
                        close(paragraph[-1])
                    top = names[stack[-1]]
                    while name in ENDED_BY.get(top, ()) and len(stack) > 1:
                        close(len(stack) - 1)
                        top = names[stack[-1]]
                    if name in ("html", "body") and open_count.get(name):
                        continue
                else:
                    flush()  # an inline element that is left out is no part of the block around it
                names.append(name)
                parents.append(stack[-1])
                self.noise.append(why)
                self.marks.append(self._mark(name, given))
                self.classes.append(given.get("class", ""))
                stack.append(len(names) - 1)
                open_count[name] = open_count.get(name, 0) + 1
                paragraph.append(len(stack) - 1 if name == "p" else -1 if name in SCOPES else paragraph[-1])
                if why == "always" and dropped_from < 0:
                    dropped_from = len(stack) - 1
        text(html[begun:])
        flush()

    @staticmethod
    def _why(name: str, given: dict[str, str]) -> str:
        """Why an element is no content: always; noise or layout by its names; a form; a header. Empty if there is no reason."""
        if "hidden" in given or re.search(r"display\s*:\s*none", given.get("style", ""), re.IGNORECASE):
            return "always"
        role = given.get("role", "").lower()
        if role in NOISE_ROLES:
            return "layout"
        if name in ("html", "body", "main"):
            return ""
        words = [w.lower() for key in ("class", "id") for w in _WORDS.findall(given.get(key, ""))]
        if words and MODIFIERS.isdisjoint(words):
            if not NOISE.isdisjoint(words):
                return "noise"
            if not LAYOUT.isdisjoint(words) and name != "article":
                return "layout"
        return name if name in ("form", "header") else ""

    @staticmethod
    def _mark(name: str, given: dict[str, str]) -> str:
        if name in ("article", "main"):
            return name
        role, prop = given.get("role", "").lower(), given.get("itemprop", "").lower()
        if role in ("article", "main"):
            return role
        names = {x.lower() for x in (given.get("class", "") + " " + given.get("id", "")).split()}
        return "content" if prop == "articlebody" or not CONTENT_NAMES.isdisjoint(names) else ""

    def main_text(self) -> str:
        """The blocks of the article, joined by an empty line."""
        n, parents, names = len(self.names), self.parents, self.names
        if not self.texts:
            return ""
        lengths, linked, links, most, own = [0] * n, [0] * n, [0] * n, [0] * n, [0.0] * n
        for at, text, in_links, count in zip(self.at, self.texts, self.linked, self.links, strict=True):
            lengths[at] += len(text)
            linked[at] += in_links
            links[at] += count
            most[at] = max(most[at], in_links)
            own[at] += (len(text) / 100 + len(_COMMAS.findall(text))) * (1 - in_links / len(text))
        whole = own[:]
        holds = [self.marks[i] in ("article", "main") or names[i] == "h1" for i in range(n)]
        strong = [self.marks[i] == "main" or names[i] == "h1" for i in range(n)]
        for i in range(n - 1, 0, -1):
            up = parents[i]
            lengths[up] += lengths[i]
            linked[up] += linked[i]
            links[up] += links[i]
            most[up] = max(most[up], most[i])
            whole[up] += whole[i]
            # What a comment or an advert is made of does not vouch for what is around it.
            if self.noise[i] != "noise":
                holds[up] |= holds[i]
                strong[up] |= strong[i]
        prose = [False] * n
        if "form" in self.noise:
            for at, text in zip(self.at, self.texts, strict=True):
                prose[at] = prose[at] or _SENTENCE.search(text) is not None
            for i in range(n - 1, 0, -1):
                prose[parents[i]] |= prose[i]
        out = [False] * n
        article = [-1] * n
        for i in range(1, n):
            up, why = parents[i], self.noise[i]
            article[i] = article[up] if article[up] >= 0 else i if self.marks[i] == "article" and why != "noise" else -1
            menu = names[i] in LISTS and links[i] >= 2 and linked[i] > 0.9 * lengths[i] and most[i] < 60
            out[i] = (
                out[up]
                or why == "always"
                or (why == "noise" and not strong[i])
                or (why == "layout" and not holds[i])
                or (why == "form" and (whole[i] < (0.9 * whole[article[up]] if article[up] >= 0 else 0.5 * whole[0]) or not (prose[i] or holds[i])))
                or (why == "header" and article[up] < 0)
                or menu
            )
        kept = [k for k, at in enumerate(self.at) if not out[at]]
        if not kept:
            return ""
        # Points: to the block's element (a paragraph's go one level up in full), then a half, a third of that, and so on.
        points, worths = [0.0] * n, [0.0] * n
        for k in kept:
            text, node = self.texts[k], self.at[k]
            worth = (len(text) / 100 + len(_COMMAS.findall(text))) * (1 - self.linked[k] / len(text))
            worths[node] += worth
            if names[node] not in ("div", "section", "article", "main", "body", "td", "#page", "form") and parents[node] >= 0:
                node = parents[node]
            for share in (1.0, 0.5, 0.17, 0.12, 0.08):
                points[node] += worth * share
                node = parents[node]
                if node < 0:
                    break
        for i in range(n - 1, 0, -1):
            worths[parents[i]] += worths[i]
        best = max(range(n), key=lambda i: (points[i], -i))
        chosen = self._container(best, article, worths, out)
        inside = [False] * n
        for i in chosen:
            if i >= 0:
                inside[i] = True
        for i in range(1, n):
            inside[i] = inside[i] or inside[parents[i]]
        loose = self._loose(chosen, kept) if -1 in chosen else frozenset()
        return "\n\n".join(self.texts[k] for k in kept if inside[self.at[k]] or k in loose)

    def _container(self, best: int, article: list[int], worths: list[float], out: list[bool]) -> list[int]:
        """The elements whose blocks are the article; -1 stands for loose blocks, judged one by one."""
        if article[best] >= 0:
            return [article[best]]
        names, parents = self.names, self.parents
        marked, i = -1, best
        while i > 0:
            if self.marks[i] == "main" or (self.marks[i] == "content" and marked < 0):
                marked = i
            i = parents[i]
        if marked >= 0 and self.marks[marked] == "main":
            return [marked]
        best = marked if marked >= 0 else best
        around = best if names[best] in ("body", "html", "#page") else parents[best]
        children = [i for i in range(1, len(names)) if parents[i] == around and not out[i]]
        lead = worths[best] if around != best else max([worths[i] for i in children], default=0.0)
        lengths, linked = self._spans(children)
        wanted = {i for i in children if i == best or self._like(i, lead, worths, lengths, linked, self.classes[best] if around != best else "")}
        chosen, pending = [-1], []
        self._around = around
        for i in children:
            if names[i] in HEADINGS:
                pending.append(i)
            elif i in wanted:
                chosen += [*pending, i]
                pending = []
            elif lengths[i]:
                pending = []
        return chosen

    def _spans(self, children: list[int]) -> tuple[dict[int, int], dict[int, int]]:
        top = {i: i for i in children}
        lengths, linked = dict.fromkeys(children, 0), dict.fromkeys(children, 0)
        owner = [-1] * len(self.names)
        for i in range(1, len(self.names)):
            owner[i] = top.get(i, owner[self.parents[i]])
        for at, text, in_links in zip(self.at, self.texts, self.linked, strict=True):
            if owner[at] >= 0:
                lengths[owner[at]] += len(text)
                linked[owner[at]] += in_links
        return lengths, linked

    def _like(self, i: int, lead: float, worths: list[float], lengths: dict[int, int], linked: dict[int, int], kind: str) -> bool:
        """Whether a sibling belongs to the article."""
        if not lengths[i] or linked[i] > 0.33 * lengths[i]:
            return False
        if self.names[i] in ("div", "section", "td", "form", "header", "center", "article"):
            same = kind and self.classes[i] == kind
            return worths[i] >= (0 if same else 0.2 * lead)
        return self.names[i] != "address"

    def _loose(self, chosen: list[int], kept: list[int]) -> frozenset[int]:
        """Blocks that stand in the element around the chosen ones themselves, and read like sentences."""
        alone = len(kept) == 1
        return frozenset(k for k in kept if self.at[k] == self._around and self.linked[k] <= 0.33 * len(self.texts[k]) and (alone or len(self.texts[k]) >= 80 or _SENTENCE.search(self.texts[k])))


def main_text(html: str | None) -> str:
    return Page(html).main_text() if html else ""


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url and the main text of each page. Pages are read where they lie; nothing is shuffled."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x.as_py()) for x in b.column(2)], pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return map_arrow(rows, read, "page_id long, url string, text string")


def op11_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))


# The tables' pages mark their articles; there the main text is what stands between the tags, cut at blocks.
ORACLE_SQL = {
    "op11_html_extraction": r"""
        WITH bodies AS (
            SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
        parts AS (
            SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1|div|ul|li)(?:\s[^>]*)?>'),
                lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')) AS parts
            FROM bodies),
        decoded AS (
            SELECT page_id, url, list_transform(parts,
                lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'),
                                                             '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts
            FROM parts),
        joined AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM decoded)
        SELECT page_id, url, text, length(text) AS n_chars FROM joined
    """,
}
