"""The main text of web pages by composite text density.

A page is read into a tree of its elements. What can't be part of an article goes first: scripts, styles, forms, menus, page
headers and footers, sidebars, adverts, notices and reader comments, known by their tag, role, or the words of their
class and id. Of what is left every node gets its density: characters per tag, adjusted by a logarithm that falls with the share
of characters and tags inside links. The subtree whose children's densities add up to most is the article, and where it
lies inside an ``article`` or ``main`` element, that whole element. The least density on the path from it to the body is the
threshold: other parts of the body that reach it are text of the article, too.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.llm.common import set_aside, table

# The kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
GONE = frozenset("head script style noscript template title iframe object embed audio video canvas svg select button input textarea form nav menu header footer aside dialog noembed noframes datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the first kind ends where one of these starts, unless one of the last stands between them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ()),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of a class or id that name what isn't the article, wherever they stand in the name.
ALIEN = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup popup modal overlay breadcrumb breadcrumbs pagination pager comment comments commentlist disqus replies respond share sharing social related recommended recommendations".split())
#: Those that name what readers wrote, which may itself be articles.
READERS = frozenset("comment comments commentlist disqus replies respond".split())
#: The same, unless the name also has one of OWN: "entry-header" is a part of the article.
LAYOUT = frozenset("header footer nav navbar navigation menu menubar sidebar sidenav aside side rail masthead topbar toolbar banner widget widgets notice notices disclaimer copyright skip search login".split())
OWN = frozenset("article content entry main post story text body page has with no without".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")


def alien(tag: str, attributes: str) -> int:
    """What an element's role, or a name in its class or id, says: 2 that readers wrote it or it isn't shown, 1 that it isn't part of an article, 0 neither."""
    said = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return 2
        if name == "role" and value.strip().lower() in ROLES:
            said = 1
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            for each in value.split():
                words = {w.lower() for w in _WORD.findall(each)}
                if words & READERS and not words & {"no", "without", "has", "with"}:
                    return 2
                if words & ALIEN or words & LAYOUT and not words & OWN:
                    said = 1
    return said


class Tree:
    """Elements in page order. ``items`` of each: its children's numbers and its own texts, in order."""

    def __init__(self, page: str):
        self.tag, self.parent, self.attributes, self.items = ["html"], [-1], [""], [[]]
        stack, at = [0], 0
        while True:
            found = _TOKEN.search(page, at)
            text = page[at : found.start() if found else len(page)]
            if text:
                self.items[stack[-1]].append(html.unescape(text) if "&" in text else text)
            if not found:
                return
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                self._end(stack, tag)
                continue
            if tag in ("html", "body") and tag in (self.tag[i] for i in stack) and tag != "body":
                continue
            self._implied(stack, tag)
            number = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.attributes.append(found[3] or "")
            self.items.append([])
            self.items[stack[-1]].append(number)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
            elif tag not in VOID:
                stack.append(number)

    def _implied(self, stack: list[int], tag: str) -> None:
        """End tags that the start of ``tag`` implies."""
        stops, bounds = ENDS.get(tag, ((), ()))
        if tag in BLOCKS:  # a paragraph ends where any block starts
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] == "p":
                    del stack[k:]
                    break
                if self.tag[stack[k]] in BLOCKS or self.tag[stack[k]] in ("button", "object"):
                    break
        if stops:
            low = None
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in bounds:
                    break
                if self.tag[stack[k]] in stops:
                    low = k
                elif tag in ("li", "dt", "dd") and self.tag[stack[k]] in BLOCKS and self.tag[stack[k]] not in ("div", "p", "address"):
                    break
            if low is not None:
                del stack[low:]

    def _end(self, stack: list[int], tag: str) -> None:
        if tag in ("html", "body"):
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                del stack[k:]
                return
            if tag not in BLOCKS and self.tag[stack[k]] in BLOCKS:
                return  # the end of an inline element doesn't end a block


def _removed(tree: Tree) -> list[bool]:
    """Elements that can't be part of an article, and all inside them.

    An element that holds an ``article`` stays whatever it is called, unless readers wrote it or it isn't shown; one that holds ``main``
    stays in any case, and a form with a heading of the first level.
    """
    n = len(tree.tag)
    holds = [0] * n  # 3: main, 2: an article, 1: a first heading
    for i in range(n - 1, 0, -1):
        own = {"main": 3, "article": 2, "h1": 1}.get(tree.tag[i], 0)
        holds[tree.parent[i]] = max(holds[tree.parent[i]], holds[i], own)
    gone = [False] * n
    for i in range(1, n):
        tag = tree.tag[i]
        if gone[tree.parent[i]]:
            gone[i] = True
        elif tag in GONE:
            gone[i] = not (holds[i] >= 2 and tag in ("form", "header", "aside") or holds[i] and tag == "form")
        elif tree.attributes[i]:
            gone[i] = holds[i] < 3 and alien(tag, tree.attributes[i]) > (holds[i] == 2)
    return gone


def densities(tree: Tree, gone: list[bool]) -> tuple[list[float], list[float]]:
    """(density of each node, sum of its children's densities)."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags, inside = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(n):
        inside[i] = tree.tag[i] == "a" or i > 0 and inside[tree.parent[i]]
    for i in range(n - 1, -1, -1):
        if gone[i]:
            continue
        own = sum(len(" ".join(x.split())) for x in tree.items[i] if isinstance(x, str))
        chars[i] += own
        if inside[i]:
            link_chars[i] += own
        if i:
            p = tree.parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
    share = link_chars[0] / max(1, chars[0])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if gone[i] or not chars[i]:
            continue
        c, t, linked = chars[i], max(1, tags[i]), link_chars[i]
        base = math.log(c / max(1, c - linked) * linked + share * c + math.e)
        adjusted = math.log(max(1.0, c / max(1, linked) * t / max(1, link_tags[i])))
        density[i] = c / t * adjusted / math.log(max(base, math.e))
        if i:
            total[tree.parent[i]] += density[i]
    return density, total


def _selected(tree: Tree, gone: list[bool]) -> tuple[list[bool], dict[int, float]]:
    """(gone, now with what isn't the article; nodes around it with the threshold that their own texts must reach)."""
    n = len(tree.tag)
    density, total = densities(tree, gone)
    best = max(range(n), key=lambda i: (total[i], -i))
    path = [best]
    while path[-1] > 0:
        path.append(tree.parent[path[-1]])
    least = min(density[i] for i in path if i == best or tree.tag[i] != "html")
    named = [i for i in path if tree.tag[i] == "article"] or [i for i in path if tree.tag[i] == "main"]
    top = named[-1] if named else best
    around = set(path[path.index(top) + 1 :])
    out, whole = list(gone), [i == top for i in range(n)]
    for i in range(1, n):
        p = tree.parent[i]
        if out[i] or out[p]:
            out[i] = True
        elif whole[i] or whole[p]:
            whole[i] = True
        elif named and i not in around:
            out[i] = True
        elif i not in around:
            whole[i] = density[i] >= least or tree.tag[i] == "h1"
            if not whole[i]:
                around.add(i)  # parts of it may reach the threshold
    return out, {i: math.inf if named else least for i in around if not whole[i]}


def _rendered(tree: Tree, gone: list[bool], around: dict[int, float]) -> str:
    """Blocks are apart; what is inside a block isn't, but for line breaks."""
    out: list[str] = []
    work: list = [0]
    while work:
        i = work.pop()
        if isinstance(i, str):
            out.append(i)
            continue
        edge = " " if tree.tag[i] in BLOCKS or tree.tag[i] == "br" or i in around else ""
        out.append(edge)
        if gone[i]:
            continue
        work.append(edge)
        for x in reversed(tree.items[i]):
            if not isinstance(x, str) or i not in around:
                work.append(x)
            elif (c := len(x.strip())) and c * math.log(c) >= around[i]:
                work.append(x)
            else:
                work.append(" ")
    return _SPACE.sub(" ", "".join(out)).strip()


def article(page: str | None) -> str:
    """The main text of a page; empty for a null or empty one, and for one in which nothing can be an article."""
    if not page:
        return ""
    tree = Tree(page)
    return _rendered(tree, *_selected(tree, _removed(tree)))


def main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` with ``text`` and ``n_chars``, its characters, in front of those.

    Nothing but ``column`` is read; nulls in others, repeated rows and columns of any name are passed on (one called text or
    n_chars then stands twice). A page is read whole, in one task, without a shuffle.
    """
    plain, _ = set_aside(pages, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts = [article(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *batch.columns], names=["found_text", "found_chars", *batch.schema.names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    got = plain.mapInArrow(run, f"found_text string, found_chars long, {kinds}")
    return got.select(F.col("found_text").alias("text"), F.col("found_chars").alias("n_chars"), *[F.col(inner).alias(c) for inner, c in zip(plain.columns, pages.columns)])


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
