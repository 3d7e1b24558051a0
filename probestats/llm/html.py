"""Main text of web pages by paths on which the pages of a host agree.

Each page is read into blocks of text inside containers; the containers are scored by their text outside of links,
and the page votes for the generalised tag-class path of its main container. Votes are counted per host in Spark;
then the text of every page is taken from its host's winning path, and from the page's own main container where
the winning path does not occur.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from probestats.llm.shared import parts, small
from probestats.operators.stage import stage

# fixed values: elements of the HTML standard by how they end and show
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes plaintext".split())
CONTAINERS = frozenset("body main article section div center td th blockquote figure details fieldset".split())
BLOCKS = CONTAINERS | frozenset(
    "html head p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption pre hr address header footer nav aside form figcaption summary hgroup menu dialog search".split()
)
#: Elements that are never article text.
DROPPED = frozenset("head nav footer aside form menu dialog search button select option datalist label legend svg canvas object audio video template map math noscript iframe applet".split())
#: What an open element of the first kind is ended by.
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"])}
#: Words of class, id and role that name what is not the article.
OTHER = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars rail widget widgets
    menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer colophon comment comments commentlist discussion disqus respond
    reply replies notice notices alert alerts cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login search share sharing
    social related recommended recirculation trending pagination pager toolbar tags contentinfo complementary form disclaimer copyright skip hidden""".split()
)
#: Words of names that elements of an article have.
ARTICLE = frozenset("article entry hentry post story".split())
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Containers that are parts of a text, never the whole of it; cells are so inside an article only, as tables also lay out pages.
PARTS, CELLS = frozenset(["blockquote", "figure"]), frozenset(["td", "th"])
#: A container is left for an article in it that holds this share of its score, and for a child that nothing marks
#: as an article while that child holds this share of the whole page's.
ARTICLE_SHARE, UNMARKED_SHARE = 0.6, 0.85


def _names(more: str) -> tuple[list[list[str]], bool]:
    """Words of each class, id and role name, and whether the element is hidden."""
    names, hidden = [], False
    for key, value in _ATTRIBUTE.findall(more):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            names += [_NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", x).lower()) for x in value.split()]
        elif key == "style":
            hidden = hidden or bool(_HIDDEN.search(value))
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            hidden = True
    return [n for n in names if n], hidden


def _is_other(names: list[list[str]]) -> bool:
    """Whether some name ends with, or is led by, a word for what is not the article (``site-footer``, ``ad-box``).

    Names that tell what an element comes with (``has-sidebar``) do not count.
    """
    return any(n[0] not in ("has", "with", "no", "without", "is") and (n[-1] in OTHER or (n[0] in OTHER and len(n) <= 3)) for n in names)


class Page:
    """Blocks of a page, each in a container; a container knows its parent and its path's number."""

    def __init__(self, source: str):
        self.parent, self.path = [-1], [0]
        self.tag, self.article = [""], [False]  # of each container; article: is one or belongs to one
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        self._read(source)

    def _read(self, source: str) -> None:
        # of each open element: tag, container, whether its content is dropped, whether it belongs to an article
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        text: list[str] = []
        links, in_links, linked = 0, 0, 0
        at, size = 0, len(source)

        def flush() -> None:
            nonlocal text, linked
            if text:
                whole = " ".join(entities.unescape("".join(text)).split())
                if whole:
                    self.blocks.append((stack[-1][1], whole, min(linked, len(whole))))
                text, linked = [], 0

        while at < size:
            found = _MARKUP.search(source, at)
            start = found.start() if found else size
            if start > at and not stack[-1][2]:
                text.append(source[at:start])
                linked += (start - at) if in_links else 0
            if not found:
                break
            at = found.end()
            if found["data"] and not stack[-1][2]:
                text.append(found["data"].replace("&", "&amp;"))
            if not found["tag"]:
                continue
            tag, more = found["tag"].lower(), found["more"]
            if found["end"]:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if tag in BLOCKS:
                    flush()
                if depth and (tag in BLOCKS or not any(x[0] in CONTAINERS for x in stack[depth:])):
                    in_links -= sum(x[0] == "a" for x in stack[depth:])
                    del stack[depth:]
                continue
            if tag in VOID:
                if tag in ("br", "hr", "img", "wbr") and not stack[-1][2]:
                    if tag == "hr":
                        flush()
                    elif tag == "br":
                        text.append(" ")
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else size
                continue
            if tag in BLOCKS:
                flush()
                while len(stack) > 1 and tag in CLOSED_BY.get(stack[-1][0], ()):
                    stack.pop()
                # a paragraph also ends under open inline elements
                if tag in CONTAINERS or tag == "p":
                    inline = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in BLOCKS), 0)
                    if inline and stack[inline][0] == "p":
                        in_links -= sum(x[0] == "a" for x in stack[inline:])
                        del stack[inline:]
            _, container, dropped, article = stack[-1]
            names, hidden = _names(more) if "=" in more or "hidden" in more else ([], False)
            own = tag in DROPPED or hidden
            if not own and tag == "header":
                own = not article  # an article's header is its title
            if not own and names and tag not in ("html", "body", "main"):
                own = _is_other(names) if tag != "article" else any({"comment", "reply"} & {n[0], n[-1]} for n in names)
            dropped = dropped or own
            article = article or tag in ("article", "main") or any(ARTICLE.intersection(n) for n in names)
            if tag in CONTAINERS and not dropped:
                parent, label = container, ".".join([tag, *sorted({"-".join(n) for n in names})])
                container = len(self.parent)
                self.parent.append(parent)
                self.tag.append(tag)
                self.article.append(article)
                self.path.append(self.paths.setdefault((self.path[parent], label), len(self.paths) + 1))
            if more.endswith("/>") and tag not in BLOCKS:
                continue
            stack.append((tag, container, dropped, article))
            in_links += tag == "a"
        flush()

    def main(self) -> tuple[int, float]:
        """The smallest container that holds the article, and its text outside of links.

        Text that stands in a container itself, or in an article beside other text of it, is never left behind.
        """
        own = [0] * len(self.parent)
        for container, text, linked in self.blocks:
            own[container] += len(text) - linked
        score, marked = list(own), [x if a else 0 for x, a in zip(own, self.article, strict=True)]
        children: dict[int, list[int]] = {}
        for c in range(len(self.parent) - 1, 0, -1):
            score[self.parent[c]] += score[c]
            marked[self.parent[c]] += marked[c]
            children.setdefault(self.parent[c], []).append(c)
        at = 0
        while children.get(at) and not own[at]:
            best = max(children[at], key=lambda c: (score[c], -c))
            if not score[best] or self.tag[best] in PARTS or (self.tag[best] in CELLS and self.article[best]):
                break
            if score[best] < score[at]:
                if self.article[at] or marked[best] < marked[at]:
                    break
                if score[best] < (ARTICLE_SHARE * score[at] if self.article[best] else UNMARKED_SHARE * score[0]):
                    break
            at = best
        return at, float(score[at])

    def path_text(self, number: int) -> str:
        """A path's labels from the outermost on."""
        back = {n: key for key, n in self.paths.items()}
        labels = []
        while number:
            number, label = back[number]
            labels.append(label)
        return ">".join(reversed(labels))

    def number(self, path: str) -> int | None:
        at = 0
        for label in path.split(">") if path else ():
            at = self.paths.get((at, label))
            if at is None:
                return None
        return at

    def left_behind(self, container: int, number: int) -> bool:
        """Whether ``container`` encloses all containers at the path ``number`` and text outside of links besides."""
        inside, at_path = [container == 0], [self.path[0] == number]
        for c in range(1, len(self.parent)):
            inside.append(inside[self.parent[c]] or c == container)
            at_path.append(at_path[self.parent[c]] or self.path[c] == number)
        if at_path[container] or any(there and not within for there, within in zip(at_path, inside, strict=True)):
            return False
        return any(inside[c] and not at_path[c] and len(text) > linked for c, text, linked in self.blocks)

    def text(self, number: int) -> str | None:
        """Text of all containers at a path in page order; None if there is none."""
        if number not in self.path:
            return None
        inside = [self.path[0] == number]
        for c in range(1, len(self.parent)):
            inside.append(inside[self.parent[c]] or self.path[c] == number)
        return " ".join(t for c, t, _ in self.blocks if inside[c])


def vote(source: str | None) -> tuple[str, float]:
    """The path of a page's main container and its score."""
    page = Page(source or "")
    container, score = page.main()
    return page.path_text(page.path[container]), score


def extract(source: str | None, path: str | None) -> tuple[str, bool]:
    """Text at the host's path and True, or at the page's own best path and False.

    The page's own container is taken, too, where it encloses all of the host's path and has text outside of links beside it.
    """
    page = Page(source or "")
    number = page.number(path) if path is not None else None
    found = page.text(number) if number is not None else None
    own = page.main()[0]
    if found and not page.left_behind(own, number):
        return found, True
    return page.text(page.path[own]) or "", False


def _host(url: str = "url"):
    """The host of a URL without user, port and leading ``www.``; NULL and odd URLs share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host and its winning ``path``: most votes, then the highest score, then the last in order."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found, "html"):
            votes = [vote(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([p for p, _ in votes], pa.string()), pa.array([s for _, s in votes], pa.float64())], ["host", "path", "score"])

    votes = pages.select(_host().alias("host"), F.col("html").cast("string")).mapInArrow(batches, "host string, path string, score double")
    # pages without text have no say
    counted = votes.where("score > 0").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("votes", F.round("score"), "path")).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, ``text``, ``n_chars``, ``path``, ``agreed``. Runs jobs.

    ``agreed`` tells whether the host's path was there and had text. A host of few pages counts as any other: one
    page decides by itself.

    NULL and empty html: empty text. NULL or odd url: the pages of that kind vote together. NULL page_id stays
    NULL. Repeated rows vote and return each. Other columns are ignored. An empty table gives no rows.
    """
    winners = small(stage(host_paths(pages).select(F.col("host").alias("of"), "path"), "host-paths"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found, "html"):
            out = [extract(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in out], pa.string()), pa.array([len(t) for t, _ in out], pa.int64()), batch.column("path"), pa.array([a for _, a in out], pa.bool_())],
                ["page_id", "url", "text", "n_chars", "path", "agreed"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), _host().alias("host"))
    joined = rows.join(winners, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(batches, "page_id long, url string, text string, n_chars long, path string, agreed boolean")
