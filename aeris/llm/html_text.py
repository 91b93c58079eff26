"""Main-text extraction by composite text density.

A page is parsed into a tree of elements. For every node the link-adjusted characters per tag are computed: with
C characters, T tags, LC characters and LT tags inside links, density is ``C / T`` scaled down by the share of
link characters, and a node's density sum is the sum over its children. The subtree with the largest density sum
is the core of the page; the smallest density on the path from the core up to the body's child is the threshold. The text is the
core, and what stands beside the core or beside an element of that path with a density that reaches the threshold
(a run of text and inline elements counts as one element). A core inside an ``article`` or ``main`` element is
widened to it; a core that holds most of its text in such elements is narrowed to them.

Before that, elements that are no text of a page by their kind go: scripts, styles, controls, navigation, page
headers and footers, asides, and forms and elements whose class, id or role marks them as menus, sidebars, notices,
adverts or reader comments. Such words also name layouts (``content sidebar-right``), so a marked element goes only
after densities are measured, and stays if it holds the core or the chosen article; adverts, consent and reader
comments may be denser than the article and stay only if they hold the page's only articles, or all text of an article or page.
``has-``, ``no-``, ``with-``, ``without-`` forms and the like mark nothing. Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined in page order by one space.

Null and empty pages give an empty text. Broken pages (open tags at the end, cut references, stray end tags) are
read as far as they go, as browsers do. Every row has one row in the result, repeated rows too; other columns are
ignored; an empty table gives an empty result. A page is parsed in one pass, whatever its length.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeris.llm.common import forget, sliced

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre
search section select summary table tbody td tfoot th thead title tr ul""".split())
_DROP = frozenset("""applet aside audio button canvas datalist dialog embed fieldset footer frame frameset head header
iframe input link menu meta nav noembed noframes noscript object search select script style svg template textarea title
video""".split())
_CLOSES_P = _BLOCK - {"br", "body", "html", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "title",
                      "legend", "select"}
#: forms that say how a page is laid out
_MODIFIER = re.compile(r"(?:^|(?<=[\s_-]))(?:(?:has|no|with|without)[_-]\S*|(?:ads?|comments?)[_-](?:free|open|closed|enabled|disabled|on|off)(?!\S))")
#: words of a class, id or role that mark an element as not part of the article
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|adslot|adbox|banners?|sponsor(?:ed|s)?|promo(?:s|tion|ted)?"
    r"|nav|navbar|navigation|navigations|menu|menus|breadcrumbs?|sidebars?|aside|widgets?|complementary"
    r"|comments?|commentlist|disqus|replies|respond|reader-comments|header|masthead|topbar|footer|contentinfo|colophon"
    r"|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search(?![_-]results?)"
    r"|share|sharing|social|related|recommended|pagination|pager|skip-link|toolbar|hidden|sr-only)(?:$|[\s_-])")
#: those that often hold more text than the article
_OTHERS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|adslot|adbox|banners?|sponsor(?:ed|s)?"
    r"|comments?|commentlist|disqus|replies|respond|reader-comments|cookies?|consent|gdpr)(?:$|[\s_-])")
_HEADER = re.compile(r"(?:^|(?<=[\s_-]))header(?=$|[\s_-])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MARK_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

#: attributes by the HTML rules: a quote opens a value only after "="; elsewhere it is an ordinary character
_VALUE = r"""\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+)|(?=>|\Z))"""
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:" + _VALUE + ")?+")
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:" + re.sub(r"\((?!\?)", "(?:", _VALUE)
                  + r")?+)*+)>?|!--(.*?)(?:--!?>|\Z)|[!?/][^>]*>?)", re.S)


class Node:
    __slots__ = ("tag", "parent", "kids", "dropped", "mark", "chars", "tags", "link_chars", "link_tags", "sum", "density")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, mark: int = 0):
        self.tag, self.parent, self.dropped, self.mark = tag, parent, dropped, mark
        self.kids: list[Node | str] = []


def _judge(tag: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is no text of a page by its kind, and what its class, id or role marks it as: 0 nothing,
    1 boilerplate or a layout (a form too: some pages stand in one), 2 adverts, consent or comments."""
    if tag in _DROP:
        return True, 0
    mark = 1 if tag == "form" else 0
    if not attributes or tag in ("html", "body"):
        return False, mark
    for m in _ATTR.finditer(attributes):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, 0
        if name == "style" and _HIDDEN.search(value):
            return True, 0
        if name == "role" and value.strip().lower() in _MARK_ROLES:
            mark = max(mark, 1)
        if name in ("class", "id"):
            value = _MODIFIER.sub(" ", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())
            if in_article:  # its title block
                value = _HEADER.sub(" ", value)
            if _MARKS.search(value):
                mark = max(mark, 2 if _OTHERS.search(value) else 1)
    return False, mark


def parse(page: str) -> Node:
    """The tree of a page; text is kept where it stands, references undecoded."""
    root = node = Node("#root", None)
    at, end = 0, len(page)
    article_depth = 0
    open_tags: Counter[str] = Counter()

    def up_to(n: Node, top: Node) -> Node:
        """Close elements from ``n`` up; ``top`` is the one that stays open."""
        while n is not top:
            open_tags[n.tag] -= 1
            n = n.parent
        return top
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            node.kids.append(page[at:])
            break
        if lt > at:
            node.kids.append(page[at:lt])
        m = _TAG.match(page, lt)
        if m is None:
            nxt = page[lt + 1:lt + 2]
            if nxt and (nxt.isascii() and nxt.isalpha() or nxt in "!?/"):
                break  # an unfinished tag at the end
            node.kids.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:  # an end tag closes the nearest such element, if it is open
            if open_tags[name]:
                p = node
                while p.tag != name:
                    p = p.parent
                article_depth -= name in ("article", "main")
                node = up_to(node, p.parent)
            elif name in _BLOCK:
                node.kids.append(Node("br", node))
            continue
        if not page.endswith(">", lt, at):
            break  # an unfinished tag at the end
        if name in _CLOSES_P or name in ("li", "dd", "dt", "option", "tr", "td", "th"):
            p = node  # an open paragraph or list item ends here
            while open_tags["p"] and p is not root and (p.tag == "p" and name in _CLOSES_P or p.tag not in _BLOCK):
                if p.tag == "p":
                    node = up_to(node, p.parent)
                    break
                p = p.parent
            same = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"),
                    "td": ("td", "th"), "th": ("td", "th")}.get(name)
            if same and any(open_tags[t] for t in same):
                p = node
                while p is not root and p.tag not in ("ul", "ol", "dl", "table", "select", "menu", "tbody", "thead", "tfoot"):
                    if p.tag in same and (name != "tr" or p.tag == "tr"):
                        node = up_to(node, p.parent)
                        break
                    p = p.parent
        elif name == "body":
            p = node  # whatever the head left open ends here
            while p is not root and p.tag != "html":
                p = p.parent
            node = up_to(node, p)
        # a header inside an article is its title block, not the page's header
        dropped, mark = _judge(name, m[3], article_depth > 0)
        new = Node(name, node, dropped and not (name == "header" and article_depth), mark)
        node.kids.append(new)
        if name in _VOID or m[3].endswith("/") and name not in _BLOCK and name not in _RAW:
            continue
        if name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = end if close is None else (page.find(">", close.end()) + 1 or end)
            continue
        if name in ("article", "main"):
            article_depth += 1
        open_tags[name] += 1
        node = new
    return root


def _density(chars: int, tags: int, link_chars: int, link_tags: int) -> float:
    return (chars - link_chars) / max(1, tags) / (1 + link_tags / max(1, tags)) if chars else 0.0


def _measure(root: Node) -> None:
    """Characters, tags and densities bottom-up, without recursion (trees may be deep)."""
    order, stack = [], [(root, False)]
    while stack:
        n, in_link = stack.pop()
        in_link = in_link or n.tag == "a"
        n.chars = sum(len(" ".join(k.split())) for k in n.kids if type(k) is str)
        n.tags = n.link_tags = 0
        n.link_chars = n.chars if in_link else 0
        order.append(n)
        stack += [(k, in_link) for k in n.kids if type(k) is not str and not k.dropped]
    for n in reversed(order):
        n.sum = 0.0
        for k in n.kids:
            if type(k) is not str and not k.dropped:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags + (k.tag == "a")
                n.sum += k.density
        n.density = _density(n.chars, n.tags, n.link_chars, n.link_tags)
        n.sum += n.density if n.tags == 0 else 0.0


def _descend(node: Node):
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += [k for k in reversed(n.kids) if type(k) is not str and not k.dropped]


def _body(root: Node) -> Node:
    for n in _descend(root):
        if n.tag == "body":
            return n
    return root


def _core(body: Node) -> tuple[Node, list[Node]]:
    """The subtree with the largest density sum, and the articles and mains with text."""
    core, semantic = body, []
    for n in _descend(body):
        if n.sum > core.sum:
            core = n
        if n.tag in ("article", "main") and n.chars:
            semantic.append(n)
    return core, semantic


def _plain(n: Node) -> int:
    return n.chars - n.link_chars


def _article(core: Node, semantic: list[Node]) -> Node | None:
    """The core's own article or main; where the core holds most of its text in some, the one with most text."""
    p, found = core, None
    while p is not None:
        if p.tag in ("article", "main"):
            found = p
        p = p.parent
    if found is None:
        held = [n for n in semantic if _inside(n, [core])]
        if held and 2 * sum(_plain(n) for n in held if not _inside(n, held)) >= _plain(core):
            found = max(held, key=lambda n: (_plain(n), n.tag == "main"))
    return found


def _up(n: Node | None):
    while n is not None:
        yield n
        n = n.parent


def _settle(body: Node) -> None:
    """Drop the marked elements that do not hold the core or the chosen article, and measure what is left. An article,
    main or h1 is not dropped for its own marks, but no evidence for the element it stands in."""
    marked, free, inside = [], [], []
    stack = [(body, False)]
    while stack:  # free articles stand in no advert, consent or comment
        n, others = stack.pop()
        own = n.tag in ("article", "main", "h1")
        if n.mark and not own:
            marked.append(n)
            others = others or n.mark == 2
        elif own and n.tag != "h1" and not n.mark:
            (inside if others else free).append(n)
        stack += [(k, others) for k in n.kids if type(k) is not str and not k.dropped]
    if not marked:
        _measure(body)
        return
    held = set() if free else {p for n in inside for p in _up(n)}
    for n in marked:
        n.dropped = n.mark == 2 and n not in held
    _measure(body)
    bare = {a for a in (free if body.chars else [body]) if not a.chars}
    if bare:
        for n in marked:
            n.dropped = n.dropped and not any(p in bare for p in _up(n))
        _measure(body)
    core, semantic = _core(body)
    stays = {*_up(core), *_up(_article(core, semantic))}
    for n in marked:
        n.dropped = n not in stays
    _measure(body)
    if not body.chars:  # all the core's text stands in marked elements
        for n in marked:
            n.dropped = False
        _measure(body)


def content(root: Node) -> list[Node]:
    """Subtrees that hold the main text, in page order."""
    body = _body(root)
    _settle(body)
    core, semantic = _core(body)
    found = _article(core, semantic)
    if found is not None:
        # articles beside each other under the body are parts of one page's text when there is no main
        tops = [n for n in semantic if not _inside(n, semantic)]
        return tops if found.tag == "article" and found in tops else [found]
    path = [core]
    while path[-1] is not body and path[-1].parent is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    kept, on_path = core, core
    while on_path is not body:  # from the core up: each parent without what is below the threshold
        parent = on_path.parent
        holder = Node(parent.tag, None)
        for unit in _units(parent):
            if on_path in unit:
                holder.kids += [kept if k is on_path else k for k in unit]
            elif _unit_density(unit) >= threshold:
                holder.kids += unit
        kept, on_path = holder, parent
    return [kept]


def _units(parent: Node) -> list[list[Node | str]]:
    """Children of an element: blocks one by one, runs of text and inline elements (and line breaks) together."""
    out: list[list[Node | str]] = []
    run = False
    for k in parent.kids:
        inline = type(k) is str or k.tag == "br" or k.tag not in _BLOCK
        if inline and run:
            out[-1].append(k)
        else:
            out.append([k])
        run = inline
    return out


def _unit_density(unit: list[Node | str]) -> float:
    """As an element with these children would have; a block has its own."""
    nodes = [k for k in unit if type(k) is not str and not k.dropped]
    if len(unit) == 1 and nodes:
        return nodes[0].density if nodes[0].chars else -1.0
    chars = sum(k.chars for k in nodes) + sum(len(" ".join(k.split())) for k in unit if type(k) is str)
    tags = sum(k.tags + 1 for k in nodes)
    link_tags = sum(k.link_tags + (k.tag == "a") for k in nodes)
    return _density(chars, tags, sum(k.link_chars for k in nodes), link_tags) if chars else -1.0


def _inside(n: Node, others: list[Node]) -> bool:
    p = n.parent
    while p is not None:
        if p in others:
            return True
        p = p.parent
    return False


def text_of(nodes: list[Node]) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def close():
        if run:
            line = " ".join(_html.unescape("".join(run)).split())
            if line:
                blocks.append(line)
            run.clear()

    for top in nodes:
        close()
        stack: list = [top]
        while stack:
            n = stack.pop()
            if n is None:
                close()
            elif type(n) is str:
                run.append(n)
            elif not n.dropped or n is top:
                if n.tag in _BLOCK:
                    close()
                    stack.append(None)
                stack += reversed(n.kids)
        close()
    return " ".join(blocks)


def main_text(page: str | None) -> str:
    """The main text of one page."""
    return text_of(content(parse(page))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    def run(batches):
        import pyarrow as pa
        for b in sliced(batches, column=2):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
        forget()

    three = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.col(html_col).alias("html"))
    return three.mapInArrow(run, "page_id long, url string, text string, n_chars long")
