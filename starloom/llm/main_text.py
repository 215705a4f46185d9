"""Main text of web pages by tree scoring.

Tags become a tree of blocks; inline tags only matter for the share of link text. Paragraphs pass points for length
and commas to their ancestors (all to the parent, half to the next, less further up), each container's points are
discounted by its link density, and the best container is kept together with those siblings that score well or, if
it is no article itself, are headings, paragraphs, lists, quotes, tables or sections of few links. Inside, boilerplate by tag or role is left
out, and by name only with a second sign, as headings and sections are named after their titles, or if a whole name is unmistakable. Pages are independent rows: no shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml", "object", "select", "xmp", "noframes")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button label head".split()
)
#: Tags that close an open paragraph, and those that close an open sibling of their kind up to the given container.
CLOSES_P = BLOCKS - frozenset(("button", "label", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "head", "body"))
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
BOILERPLATE_TAGS = frozenset("nav aside footer header form head button menu dialog fieldset label legend".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class and id names, whole words of hyphen, underscore or camel case names.
BOILERPLATE_NAMES = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disqus footer footnav gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification notifications overlay pager pagination popup "
    "promo promoted promotion promotions recommend recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Whole class names that are enough on any tag, those that are on articles, and ids that are.
SURE = frozenset("ad ads adbox adsense adslot advert adverts advertisement comment comments commentlist disqus gdpr newsletter promo promoted sponsored".split())
SURE_ARTICLES = frozenset("ad ads advert adverts advertisement comment comments commentlist".split())
SURE_IDS = frozenset("comment comments commentlist disqus newsletter respond".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A page's heading may stand in a header inside its article.
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SCORED = frozenset("p pre td dd blockquote li div section article main body figcaption h1 h2 h3 h4 h5 h6 html dt th center details summary address".split())
#: What belongs to the text beside it unless it is mostly links.
BESIDE = HEADINGS | frozenset("p pre ul ol dl blockquote table figure section hgroup".split())
#: Blocks without a meaning of their own, for which a boilerplate class is enough.
NEUTRAL = frozenset("div ul ol dl table center".split())
ROOTS = frozenset(("html", "body"))
#: Ancestors get points until their share is less, so that a page's time does not grow with its depth times its blocks.
LEAST_SHARE = 1e-6


class Block:
    __slots__ = ("children", "hidden", "named", "points", "tag", "up")

    def __init__(self, tag: str, up: Block | None, hidden: bool):
        self.tag, self.up, self.hidden, self.points = tag, up, hidden, 0.0
        #: Hidden by its name alone: "sure", "class" or "part", "id", or "title" for an id of which only some words are boilerplate.
        self.named = ""
        #: Blocks, and runs of text as (text, whether in a link).
        self.children: list = []


def _boilerplate(tag: str, attributes: str, inside_article: bool, by_name: bool) -> tuple[bool, str]:
    """Whether tag, role or style tell boilerplate, and else how sure its names are: "sure", a whole "class" or only a "part" of one, "id" or "title"."""
    if tag in BOILERPLATE_TAGS and not (tag == "header" and inside_article):
        return True, ""
    if "=" in attributes or "hidden" in attributes:
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
        if found.get("role", "").lower() in BOILERPLATE_ROLES or found.get("aria-hidden") == "true":
            return True, ""
        if "hidden" in re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes).split() or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
            return True, ""
        if by_name and tag not in ("html", "body", "main"):
            classes, ids = found.get("class", "").split(), found.get("id", "").split()
            if tag == "article":
                return False, "sure" if SURE_ARTICLES & {c.lower() for c in classes} else ""
            if SURE & {c.lower() for c in classes} or (tag not in HEADINGS and SURE_IDS & {i.lower() for i in ids}):
                return False, "sure"
            heeded = BOILERPLATE_NAMES - {"header"} if inside_article else BOILERPLATE_NAMES
            parts = [[n.lower() for n in NAME_PARTS.findall(c)] for c in classes]
            if any(heeded.intersection(p) for p in parts):
                return False, "class" if any(p and (p[0] in SURE or heeded.issuperset(p)) for p in parts) else "part"
            names = {n.lower() for n in NAME_PARTS.findall(found.get("id", ""))}
            if names & heeded and tag not in HEADINGS:
                return False, "id" if names <= heeded else "title"
    return False, ""


def tree(page: str, by_name: bool = True) -> Block:
    """The page's blocks; unclosed and stray tags are forgiven. ``by_name``: class and id names tell boilerplate too."""
    root = Block("html", None, False)
    at, links, spot, articles = root, 0, 0, 0
    #: How many blocks of a tag are open, so that a stray end tag need not look for its block.
    opened: Counter[str] = Counter()

    def close_to(target: Block) -> None:
        nonlocal at
        above = target.up or root
        while at is not above:
            opened[at.tag] -= 1
            at = at.up

    def say(text: str) -> None:
        if text:
            at.children.append((text, links > 0))

    while m := TOKEN.search(page, spot):
        say(page[spot : m.start()])
        spot = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW_END and not m[1]:
            end = RAW_END[tag].search(page, spot)
            spot = end.end() if end else len(page)
        elif m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                say(" ")
            elif tag in BLOCKS and opened[tag]:
                node = at
                while node is not root and node.tag != tag:
                    node = node.up
                if node is not root:
                    close_to(node)
                    links = 0
                    articles -= tag == "article"
        elif tag == "a":
            links = 0 if m[3].endswith("/") else 1
        elif tag == "br":
            say(" ")
        elif tag in BLOCKS:
            if tag in ("html", "body"):
                at.hidden = at.hidden and at is root
                continue
            if tag in CLOSES_P and opened["p"]:
                node = at
                while node is not root and node.tag != "p":
                    if node.tag in ("td", "th", "table", "button", "div", "section", "article", "li", "blockquote"):
                        break
                    node = node.up
                if node.tag == "p":
                    close_to(node)
            if tag in SIBLINGS:
                kinds, limit = SIBLINGS[tag]
                node, outer = at, None
                while node is not root and node.tag not in limit:
                    if node.tag in kinds:
                        outer = node
                    node = node.up
                if outer is not None:
                    close_to(outer)
            if at.tag == "head" and tag != "head":
                close_to(at)
            certain, named = _boilerplate(tag, m[3], articles > 0, by_name)
            child = Block(tag, at, at.hidden or certain)
            child.named = named
            at.children.append(child)
            if tag not in VOID:
                at = child
                opened[tag] += 1
                articles += tag == "article"
                links = 0
    say(page[spot:])
    return root


def _clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def _runs(node: Block) -> Iterator[tuple[str, int]]:
    """The node's own blocks of text between its child blocks, with the length of their link text."""
    parts: list[str] = []
    linked: list[str] = []
    for child in [*node.children, None]:
        if isinstance(child, tuple):
            parts.append(child[0])
            if child[1]:
                linked.append(child[0])
        elif parts:
            if text := _clean(parts):
                yield text, len(_clean(linked))
            parts, linked = [], []


def _walk(root: Block, named: bool = False) -> list[Block]:
    """Blocks that are not hidden, parents first; ``named``: also those hidden by name."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.hidden and (named or not node.named):
            order.append(node)
            todo.extend(c for c in node.children if isinstance(c, Block))
    return order


def _heed_signs(container: Block) -> None:
    """Shows blocks of an article or container that are hidden by name without a second sign: links, or standing at its end. Some whole names are enough."""
    order = _walk(container, named=True)
    if not any(n.named for n in order):
        return
    length = {id(n): [0, 0] for n in order}
    for node in reversed(order):
        for text, links in _runs(node):
            length[id(node)][0] += len(text)
            length[id(node)][1] += links
        if node is not container:
            length[id(node.up)][0] += length[id(node)][0]
            length[id(node.up)][1] += length[id(node)][1]
    last, ends = container, set()
    while last is not None:
        node, last = last, None
        for child in reversed(node.children):
            if isinstance(child, tuple):
                if child[0].strip():
                    break
            elif child.named in ("sure", "class", "part", "id") and child.tag not in HEADINGS:
                ends.add(id(child))
            elif not child.hidden:
                last = child
                break
    for node in order:
        chars, linked = length[id(node)]
        sign = node.named == "sure" or id(node) in ends or linked > 0.3 * chars or (node.named == "class" and node.tag in NEUTRAL)
        if node is not container and node.named and not sign:
            node.named = ""


def best_blocks(root: Block) -> list[Block]:
    """The best container and its kept siblings, in page order."""
    within: set[int] = set()
    for node in _walk(root):
        if node.tag == "article" or id(node.up) in within:
            if id(node.up) not in within:
                _heed_signs(node)
            within.add(id(node))
    order = _walk(root)
    own = {id(n): list(_runs(n)) for n in order}
    length = {id(n): [0, 0] for n in order}
    for node in reversed(order):
        chars, linked = length[id(node)]
        for text, links in own[id(node)]:
            chars, linked = chars + len(text), linked + links
        length[id(node)] = [chars, linked]
        if node.up is not None:
            above = length[id(node.up)]
            above[0] += chars
            above[1] += linked
    for node in order:
        if node.tag not in SCORED:
            continue
        for text, links in own[id(node)]:
            points = (1.0 + text.count(",") + min(len(text) / 100, 3.0)) * (1.0 if len(text) >= 25 else 0.25) * (1 - links / max(len(text), 1))
            above, share = node.up if node.tag in ("p", "pre", "li", "td", "dd", "dt", "blockquote", "th") or node.tag in HEADINGS else node, 1.0
            while above is not None and share > LEAST_SHARE:
                above.points += points * share
                above, share = above.up, share / 2 if share == 1.0 else share * 2 / 3

    def score(n: Block) -> float:
        chars, linked = length[id(n)]
        bonus = 1.5 if n.tag in ("article", "main") else 1.0
        return n.points * bonus * (1 - linked / chars) if chars else 0.0

    candidates = [n for n in order if n.points > 0]
    if not candidates:
        return [n for n in order if own[id(n)]][:1] and [root]
    best = max(candidates, key=score)
    # A part of an article stands for the whole article.
    node = best
    while node.up is not None:
        node = node.up
        if node.tag in ("article", "main"):
            best = node
    _heed_signs(best)
    if best.up is None:
        return [best]
    floor, kept = max(10.0, 0.2 * score(best)), []
    for sibling in best.up.children:
        if not isinstance(sibling, Block) or sibling.hidden or sibling.named:
            continue
        chars, linked = length[id(sibling)]
        plain = sibling.tag == "p" and chars > 80 and linked < 0.25 * chars
        beside = best.tag not in ("article", "main") and sibling.tag in BESIDE and linked < 0.25 * chars
        if sibling is best or score(sibling) >= floor or plain or beside:
            kept.append(sibling)
    return kept


def _emit(node: Block, out: list[str]) -> None:
    parts: list[str] = []
    todo: list = [(node, 0)]
    while todo:
        at, i = todo.pop()
        while i < len(at.children):
            child = at.children[i]
            i += 1
            if isinstance(child, tuple):
                parts.append(child[0])
                continue
            if text := _clean(parts):
                out.append(text)
            parts.clear()
            if not (child.hidden or child.named):
                todo.append((at, i))
                at, i = child, 0
        if text := _clean(parts):
            out.append(text)
        parts.clear()


def main_text(page: str | None) -> str:
    """The page's article, a line per block; empty for null, empty and text-free pages.

    If names of classes would leave nothing (a wrapper named after the sidebar that it holds), they are not heeded.
    """
    if not page:
        return ""
    out: list[str] = []
    for by_name in (True, False):
        for node in best_blocks(tree(page, by_name)):
            _emit(node, out)
        if out:
            break
    return "\n".join(out)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """All rows as ``page_id, url, text, n_chars``. Null html gives an empty text; null keys and urls stay; repeated rows stay."""
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
