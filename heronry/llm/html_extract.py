"""Main text of web pages by consensus container paths of their hosts.

Every page's containers are scored by the text of the blocks in them, links
counting against it. The best container votes for its generalised path (tags
with classes, digits and random suffixes folded away); Spark adds up the votes
per host; and each page is extracted again from the containers at the most
voted path of its host that it has text at, however many paths the host has.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.llm.scratch import cut, small_or_not

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_SKIP = frozenset("head nav header footer aside form button select option textarea script style noscript template iframe svg math object dialog menu canvas audio video map".split())
_BLOCK = frozenset(
    "html body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article main blockquote pre figure figcaption address details summary fieldset hgroup center hr".split()
) | _SKIP
_CONTAINER = frozenset("body main article section div td blockquote center".split())
#: Elements that are an article by their meaning.
_ARTICLE = frozenset("article main".split())
#: Elements that a start tag of the same kind ends.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("html body table td th ul ol dl article section div main".split())
#: Words in names of elements that hold what readers write, even if it is longer than the article.
_READERS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Words in names of elements beside an article; wrappers of a whole page have them, too.
_BESIDE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner sidebar menu navbar nav navigation breadcrumb breadcrumbs footer header masthead "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommend recommended recommendations widget toolbar pagination pager skiplink copyright disclaimer tags".split()
)
#: Classes of elements that hold a page's content, whatever else they are called.
_WHOLE = frozenset("page content article post entry story main wrapper layout site".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Names that tell whether a layout has such a part, not that this is one.
_LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[-_]\S+", re.I)
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())


class _Node:
    """An open element. ``skip``: nothing in it counts. ``noise``: the nearest element around, itself included, whose name says that it is beside the article.

    What is asked of the elements around is kept here, so that no question
    climbs a page of any depth. ``around``: the nearest container, itself
    included, or the root. ``meant``: the outermost ``_ARTICLE`` element, itself
    included. ``among_readers``: a named element here or around is what readers
    write. ``length``: of the path.
    """

    __slots__ = ("tag", "key", "parent", "skip", "noise", "readers", "whole", "score", "worth", "marked", "around", "meant", "among_readers", "length")

    def __init__(self, tag: str, key: str, parent: _Node | None, skip: bool, named: str = "") -> None:
        self.tag, self.key, self.parent, self.skip = tag, key, parent, skip
        self.readers, self.whole = named == "readers", named == "whole"
        self.noise: _Node | None = self if named else parent.noise if parent is not None else None
        self.score = self.worth = 0.0
        self.marked = False  # of a named element: a block in it is part of an article
        self.around: _Node = self if parent is None or tag in _CONTAINER else parent.around
        self.meant: _Node | None = (parent.meant if parent is not None else None) or (self if tag in _ARTICLE else None)
        self.among_readers: bool = self.readers or (parent is not None and parent.among_readers)
        self.length: int = len(key) + (parent.length + 1 if parent is not None else 0)

    def path(self) -> str:
        steps, node = [], self
        while node is not None:
            steps.append(node.key)
            node = node.parent
        return ">".join(reversed(steps))


def _said(value: str) -> str:
    """What the words of a class or id say: ``readers``, ``beside`` or nothing; camel case, dashes and underlines part words."""
    words = [w.lower() for w in _WORDS.findall(_LAYOUT.sub("", value))]
    if not _READERS.isdisjoint(words):
        return "readers"
    return "" if _BESIDE.isdisjoint(words) and not any(a == "side" and b == "bar" or a == "skip" and b == "link" for a, b in zip(words, words[1:], strict=False)) else "beside"


def _named(tag: str, attrs: str) -> tuple[str, str]:
    """The generalised step of an element, and what its names say of it."""
    if not attrs or "=" not in attrs:
        return tag, ""
    classes, said = "", ""
    for m in _ATTR.finditer(attrs):
        value, kind = m[2] or m[3] or m[4] or "", m[1].lower()
        if kind == "role":
            said = said or "beside" * (value.strip().lower() in _NOISE_ROLE)
        else:
            if tag not in ("html", "body", "article", "main") and said != "readers":
                said = _said(value) or said
            if kind == "class":
                classes = value
    if said == "beside" and not _WHOLE.isdisjoint(classes.lower().split()):
        said = "whole"
    names = sorted({re.sub(r"[-_]*(?:\d[\da-f]*)+$|\d+", "", c.lower()) for c in classes.split()} - {""})
    return f"{tag}.{'.'.join(names)}" if names else tag, said


def _content(raw: list[tuple[str, _Node, float]], seen: list[_Node]) -> tuple[list[tuple[str, _Node]], list[_Node]]:
    """Of all blocks and containers of a page those that aren't beside the article, with their scores.

    A named element is a wrapper, and not beside the article, if it holds an
    article while none stands outside, or more text than stands outside and
    either other named elements or a class of elements that hold content. If nothing is left, the elements named for
    what they are beside count as wrappers, and last those of readers.
    """
    named = {id(n): n for _, leaf, _ in raw if (n := leaf.noise) is not None}
    for n in list(named.values()):
        while (n := n.parent.noise if n.parent is not None else None) is not None and id(n) not in named:
            named[id(n)] = n
    wrappers: set[int] = set()
    if named:
        outer: set[int] = set()  # named elements around other ones
        for n in named.values():
            if (up := n.parent.noise if n.parent is not None else None) is not None:
                outer.add(id(up))
        free, article = 0.0, False
        for _, leaf, worth in raw:
            if leaf.noise is None:
                free += worth
                article = article or leaf.meant is not None
            else:
                leaf.noise.worth += worth
        for n in named.values():
            if not n.readers and ((n.marked and not article) or ((id(n) in outer or n.whole) and n.worth > free)):
                wrappers.add(id(n))

    known: dict[int, bool] = {}

    def open_(n: _Node | None) -> bool:
        """Whether the named element and all those around it are wrappers."""
        line = []
        while n is not None and id(n) in wrappers and id(n) not in known:
            line.append(n)
            n = n.parent.noise if n.parent is not None else None
        found = n is None or known.get(id(n), False)
        known.update((id(x), found) for x in line)
        return found

    kept = [r for r in raw if open_(r[1].noise)]
    for last in (False, True):
        if kept:
            break
        wrappers |= {i for i, n in named.items() if last or not n.readers}
        known.clear()
        kept = [r for r in raw if open_(r[1].noise)]
    for _, node, worth in kept:
        node = node.around
        node.score += worth
        above = node.parent.around if node.parent is not None else None
        if above is not None and above.tag in _CONTAINER:
            above.score += 0.5 * worth
    return [(text, n.around) for text, n, _ in kept], [n for n in seen if open_(n.noise)]


def parse(page: str) -> tuple[list[tuple[str, _Node]], list[_Node]]:
    """The content blocks of a page with the container of each, and all containers in page order."""
    root = _Node("#", "#", None, False)
    stack, blocks, containers = [root], [], []
    text: list[str] = []
    links = 0
    in_link = 0
    pos, end = 0, len(page)

    def flush() -> None:
        nonlocal links
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                worth = max(0.0, len(block) - 2.0 * links) * (0.3 if stack[-1].tag == "li" else 1.0)
                blocks.append((block, stack[-1], worth))
                if stack[-1].noise is not None and (article := stack[-1].meant) is not None and article.parent is not None and not article.parent.among_readers:
                    n = article.parent.noise
                    while n is not None and not n.marked:  # those around a marked one are marked
                        n.marked = True
                        n = n.parent.noise if n.parent is not None else None
        links = 0

    while pos < end:
        m = _TAG.search(page, pos)
        stop = m.start() if m else end
        if stop > pos and not stack[-1].skip:
            piece = page[pos:stop]
            if "&" in piece:
                piece = html.unescape(piece)
            text.append(piece)
            if in_link:
                links += len(piece)
        if m is None:
            break
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag == "br" and not stack[-1].skip:
                text.append(" ")
            at = len(stack) - 1
            while at > 0 and stack[at].tag != tag:
                if stack[at].tag in _SCOPE and tag not in _BLOCK:
                    at = 0
                    break
                at -= 1
            if at > 0:
                if any(n.tag in _BLOCK for n in stack[at:]):
                    flush()
                    in_link = 0
                del stack[at:]
            continue
        if tag in _VOID:
            if not stack[-1].skip:
                if tag == "hr":
                    flush()
                elif tag in ("br", "wbr"):
                    text.append(" " if tag == "br" else "")
            continue
        if tag in _BLOCK:
            flush()
            in_link = 0
            ends = _SIBLINGS.get(tag, set()) | {"p"}
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag in ends:
                    del stack[at:]
                    break
                if stack[at].tag in _SCOPE and not (tag in ("td", "th", "tr") and stack[at].tag in ("td", "th")):
                    break
        attrs = m[3] or m[6] or ""
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            pos = close.end() if close else end
            continue
        if attrs.endswith("/") and tag not in _BLOCK and tag not in ("a", "b", "i", "em", "strong", "span"):
            continue
        if tag == "a":
            in_link += 1
        key, said = _named(tag, attrs)
        if tag in _BLOCK and stack[-1].skip and tag not in _SKIP:
            _reopen(stack)  # a block inside an inline element makes it a wrapper like any other
        inline = bool(said) and tag not in _BLOCK
        node = _Node(tag, key, stack[-1], stack[-1].skip or tag in _SKIP or inline, said)
        stack.append(node)
        if tag in _CONTAINER and not node.skip:
            containers.append(node)
    flush()
    found, open_ = _content(blocks, containers)
    return found, open_ or [root]


def _reopen(stack: list[_Node]) -> None:
    """Let the text of open inline elements count that were skipped for their names alone."""
    for at, n in enumerate(stack):
        if n.skip:
            if n.tag in _SKIP:
                return
            if n.noise is n:
                n.skip = False
            else:
                n.skip = stack[at - 1].skip if at else False


def _best(containers: list[_Node]) -> _Node:
    """The container with the highest score, or the article around it; the first of equals."""
    top = max(containers, key=lambda n: n.score)
    return top.meant or top


def page_paths(page: str | None) -> tuple[str, float, bytes, list[bytes]] | None:
    """What a page votes with, and the paths that it has text at; None without text.

    The path and score of the container that holds most of the text, the digest
    of that path, and the digests of the paths of all containers around blocks.
    """
    blocks, containers = parse(page or "")
    if not blocks:
        return None
    found: dict[int, bytes] = {}

    def digest(node: _Node) -> bytes:
        line = []
        while node is not None and id(node) not in found:
            line.append(node)
            node = node.parent
        above = b"" if node is None else found[id(node)]
        for n in reversed(line):
            above = found[id(n)] = hashlib.blake2b(above + n.key.encode(), digest_size=16).digest()
        return above

    top = _best(containers)
    own = digest(top)
    found.clear()
    for _, n in blocks:
        digest(n)
    return top.path(), max(n.score for n in containers), own, sorted({found[id(n)] for n in containers if id(n) in found})


def main_text(page: str | None, paths: list[str] | None = None) -> str:
    """Blocks of the containers at the first of ``paths`` that the page has text at, else at its best one's path.

    Blocks have their character references decoded and white space folded, and
    are joined by an empty line.
    """
    blocks, containers = parse(page or "")
    if not blocks:
        return ""
    for path in [*(paths or ()), _best(containers).path()]:
        # only paths of its length are spelled out, so that deep pages don't spell one a level
        chosen = {id(n) for n in containers if n.length == len(path) and n.path() == path}
        if not chosen:
            continue
        inside: dict[int, bool] = {}

        def within(n: _Node | None) -> bool:
            line = []
            while n is not None and id(n) not in inside and id(n) not in chosen:
                line.append(id(n))
                n = n.parent
            found = n is not None and inside.get(id(n), True)
            inside.update((i, found) for i in line)
            return found

        if found := [b for b, n in blocks if within(n)]:
            return "\n\n".join(found)
    return "\n\n".join(b for b, _ in blocks)


def url_host(url) -> F.Column:
    """What stands between ``://`` and the next ``/``, ``?`` or ``#``, ASCII lower-cased; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _seen(pages: DataFrame) -> DataFrame:
    """Rows ``(host, key, path, score, own, at)`` of the pages that have text; ``key`` is a digest of their html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(h, k, *f) for h, k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True) if (f := page_paths(x.as_py()))]
            cols = list(zip(*found, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.binary(), pa.string(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["host", "key", "path", "score", "own", "at"])

    return pages.select("host", "key", "html").mapInArrow(run, "host string, key binary, path string, score double, own binary, at array<binary>")


def _placed(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    page = F.col(html_col).cast("string")
    return pages.withColumns({"host": url_host(F.col(url_col)), "key": F.unhex(F.sha2(page, 256)), "html": page})


def _votes(seen: DataFrame) -> DataFrame:
    """Rows ``(host, own, place)``: every path of a host that has votes; of two places the less is the better."""
    counted = seen.groupBy("host", "path", "own").agg(F.count("*").alias("votes"), F.sum(F.floor("score")).alias("score"))
    return counted.select("host", "own", F.struct((-F.col("votes")).alias("votes"), (-F.col("score")).alias("score"), "path").alias("place"))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row ``(host, paths)`` per host that has text: all its voted paths, best first. To look at; ``extract`` needs no such lists."""
    voted = _votes(_seen(_placed(pages.select(url_col, html_col), url_col, html_col)))
    return voted.groupBy("host").agg(F.sort_array(F.collect_list("place")).getField("path").alias("paths"))


def _moved(seen: DataFrame) -> DataFrame:
    """Rows ``(host, key, path)``: the host's best path that the page has text at, where that isn't the page's own.

    Every page's own path has its vote, so pages without a row are read from their own.
    """
    voted = cut(_votes(seen), "path-votes")
    several = cut(voted.groupBy("host").count().where("count > 1").select("host"), "several-paths")
    could = seen.join(small_or_not(several), "host", "left_semi").dropDuplicates(["host", "key"])
    at = could.select("host", "key", F.col("path").alias("mine"), F.explode("at").alias("own"))
    best = at.join(small_or_not(voted), ["host", "own"]).groupBy("host", "key", "mine").agg(F.min("place").alias("place"))
    return best.where("place.path <> mine").select("host", "key", F.col("place.path").alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row ``(page_id, url, text, n_chars)`` per row of ``pages``.

    ``text`` is the article's text, empty for null or empty html and for pages
    without content; ``n_chars`` counts its code points. Pages of any length
    are read whole. Pages with a null url share the empty host. Of a host's
    paths with as many votes the one with more text comes first, then the
    lesser path. Repeated rows give rows of their own, an empty table none;
    other columns are not read, whatever their names.
    """
    kept = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    placed = _placed(kept, "url", "html")
    moved = cut(_moved(cut(_seen(placed), "page-paths")), "moved-pages")
    joined = placed.join(small_or_not(moved), ["host", "key"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), p and [p]) for x, p in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(
        run, f"page_id {kept.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    )
