"""Main-text extraction by tree scoring.

The page becomes a tree.  What its own markup calls boilerplate (navigation,
forms, scripts, adverts, comments and the like) is cut.  Every paragraph then
passes points for its length and commas, less its links, to its ancestors: whole
up to the article or main element it stands in, and ever fewer beyond; a
container's points are discounted by its link density.  The best container is
kept whole, together with those of its siblings that also look like text.

Names of classes and ids count as words, not as parts of words.  Some words tell
boilerplate wherever they stand in a name (sidebar, advert, comments, ...), some
only alone (header, side, ...); elements so named that hold the page's article,
main or first heading are no boilerplate, nor is a form around it.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by a line break, in page order.

Reading is linear in the length of the page: no search for a missing end is made
twice, and elements nested deeper than DEEPEST count as their neighbours.

Defined cases: null or empty pages, and pages without text, give the empty
string; pages are read whole; markup that is never closed ends with its parent;
a tag whose quote is never closed ends at the next >; repeated pages get equal
texts; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquarry.llm import textkit as tk

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never main text.
DROPPED = frozenset("script style noscript iframe template head title nav footer aside button select option input textarea menu dialog object embed svg canvas audio video map xmp noembed noframes".split())
#: Roles that are never main text.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of boilerplate anywhere in the name of a class or id.
ANYWHERE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr popup modal subscribe subscription newsletter signup "
    "sidebar sidebars related recommended recommendations share sharing social comment comments commentlist disqus nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar".split()
)
#: Those of them that also name parts of articles (related work, a share price, menu items); inside an article they tell boilerplate only where the text agrees.
DOUBTFUL = frozenset("related recommended recommendations share sharing social menu menus toolbar topbar nav navbar navigation promo promos promotion promotions sponsor sponsors subscription subscribe signup modal masthead".split())
#: Those that tell boilerplate inside an article if there are only a few characters.
BUTTONS = frozenset("share sharing social toolbar subscribe signup".split())
#: Words of boilerplate only as the whole name of a class or id.
ALONE = frozenset("banner notice notices alert alerts overlay login side widget widgets reply replies respond responses skip hidden site-header global-header top-header skip-link site-notice sitenotice".split())
#: Names that tell boilerplate where most of the text is links, or outside the article.
PERHAPS = frozenset("header tags meta".split())
#: Beginnings of names that only tell of a state.
STATES = re.compile(r"(?:has|with|no|without|is|js)[-_]", re.I)
#: Words in the names of containers of text.
CONTENT = frozenset("article post entry story content body text main".split())
WORD = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: What an opening tag ends by itself: an open element of the second set, sought up to one of the third.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Where the search for an open paragraph stops.
P_SCOPE = frozenset("article aside blockquote body button caption dd details dialog div dl dt fieldset figure footer form header html li main nav object ol section table td th ul".split())
#: A tag without attributes; a letter has to follow < or </ for there to be a tag.
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(\s*/?)>")
OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"[\s/]*(=?[^\s/>=]*)(?:\s*=\s*([\"']|[^\s>\"'][^\s>]*)?)?")
COMMENT_END = re.compile("--!?>")
COMMAS = re.compile("[,،、，;；]")


#: Elements nested deeper than this are not descended into; their text stays.
DEEPEST = 512
#: Elements that pass points on to their parents without keeping any.
PASSING = frozenset("p pre li dd dt ul ol dl blockquote figcaption figure summary caption h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("children", "content", "cut", "depth", "holds", "length", "linked", "name", "parent", "score", "words")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []
        self.cut = self.holds = ""
        self.words: frozenset[str] = frozenset()
        self.content = parent is not None and parent.content
        self.score = 0.0
        self.length = self.linked = 0


class Reader:
    """Finds the ends of tags and comments; what is found missing once is not sought again."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """The attributes from a place inside a tag, whether it closes itself, and the place after it."""
        told: dict[str, str] = {}
        page, begin = self.page, at
        while at < len(page):
            m = ATTRIBUTE.match(page, at)
            name, value, at = m[1].lower(), m[2] or "", m.end()
            if value in ('"', "'"):
                end = self.find(value, at)
                if end < 0:
                    break
                value, at = page[at:end], end + 1
            if name:
                told.setdefault(name, value)
            if at < len(page) and page[at] == ">":
                return told, page[at - 1] == "/", at + 1
            if not name and at == m.start():
                at += 1
        end = self.find(">", begin)
        return told, False, end + 1 if end >= 0 else len(page)


def _named(words: str, inside: bool) -> tuple[str, frozenset[str]]:
    """What the names of class and id tell: cut, perhaps, doubtful or nothing; and their words."""
    told, parts = "", set()
    for token in words.split():
        if STATES.match(token):
            continue
        own = [w.lower() for w in WORD.findall(token)]
        parts.update(own)
        found = ANYWHERE.intersection(own)
        if token.lower() in ALONE or (found and not (inside and found <= DOUBTFUL)):
            return "cut", frozenset(parts)
        if found:
            told = "doubtful"
        elif token.lower() in PERHAPS:
            told = told or "perhaps"
    return told, frozenset(parts)


def _judged(node: Node, told: dict[str, str], inside: bool) -> None:
    """Marks the element if it is boilerplate by its own markup."""
    name = node.name
    if told:
        node.cut, node.words = _named(f"{told.get('class', '')} {told.get('id', '')}", inside or node.content)
        if name in ("html", "body", "main", "article") or name in HEADINGS:
            node.cut = "cut" if name == "article" and not node.words.isdisjoint(("comment", "comments")) else ""
        if told.get("role", "").lower() in ROLES or "hidden" in told or told.get("aria-hidden", "").lower() == "true" or HIDING.search(told.get("style", "")):
            node.cut = "always" if name not in ("html", "body") else ""
    if name in DROPPED:
        node.cut = "always"
    elif name == "form":
        node.cut = "cut"
    elif name == "header" and not inside and not node.cut:
        up = node.parent
        while up is not None and up.words.isdisjoint(CONTENT):
            up = up.parent
        node.cut = "" if up is not None else "cut"
    elif node.cut == "perhaps" and "header" in node.words and inside:
        node.cut = ""


def _doubted(node: Node) -> bool:
    """Whether the text of an element with a doubtful name is boilerplate after all: at least half of it is links, or it is a few words beside buttons."""
    return 2 * node.linked >= max(1, node.length) or (node.length < 40 and not node.words.isdisjoint(BUTTONS))


HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def parse(page: str) -> Node:
    """The tree without comments and scripts; text is decoded, boilerplate is marked."""
    root = here = Node("html", None)
    nodes, reader = [root], Reader(page)
    at, inside, flattened = 0, 0, Counter()
    open_now: Counter[str] = Counter()

    def closed(upto: Node) -> None:
        nonlocal here, inside
        while here is not upto:
            open_now[here.name] -= 1
            inside -= here.name in ("article", "main")
            here = here.parent

    while (lt := page.find("<", at)) >= 0:
        tag = OPEN.match(page, lt)
        if lt > at:
            here.children.append(html.unescape(page[at:lt]))
        if not tag:
            if page.startswith("<!--", lt):
                end = COMMENT_END.search(page, lt + 4) if not page.startswith((">", "->"), lt + 4) else None
                at = end.end() if end else lt + page[lt : lt + 7].index(">") + 1 if page.startswith((">", "->"), lt + 4) else len(page)
            elif page.startswith(("<!", "<?", "</"), lt):
                end = reader.find(">", lt)
                at = end + 1 if end >= 0 else len(page)
            else:
                here.children.append("<")
                at = lt + 1
            continue
        name = tag[2].lower()
        if plain := PLAIN.match(page, lt):
            told, alone, at = {}, plain[3].endswith("/"), plain.end()
        else:
            told, alone, at = reader.attributes(tag.end())
        if tag[1]:
            if flattened[name]:
                flattened[name] -= 1
            elif open_now[name]:
                node = here
                while node.name != name:
                    node = node.parent
                if node.parent is not None and not (name not in BLOCKS and _crosses(here, node)):
                    closed(node.parent)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCKS and open_now["p"]:
            closed(_close(here, frozenset({"p"}), P_SCOPE))
        if name in CLOSES:
            closed(_close(here, *CLOSES[name]))
        if name in VOID:
            here.children.append(" " if name != "hr" else Node("hr", here))
            continue
        if name in ("html", "body") and open_now[name]:
            continue
        node = Node(name, here)
        _judged(node, told, inside > 0)
        if name not in ("html", "body") and not node.cut and not node.words.isdisjoint(CONTENT):
            node.content = True
        if here.depth >= DEEPEST and not node.cut:
            flattened[name] += 1
            if name in BLOCKS:
                here.children.append(node)
            continue
        nodes.append(node)
        here.children.append(node)
        if alone and name not in BLOCKS:
            continue
        if name in ("article", "main", "h1"):
            _held(node.parent, name)
        here = node
        open_now[name] += 1
        inside += name in ("article", "main")
    here.children.append(html.unescape(page[at:]))
    _measure(nodes)
    for node in nodes:
        if node.cut == "cut" and _holds_text(node, root):
            node.cut = ""
        elif node.cut == "perhaps":
            node.cut = "cut" if "header" in node.words or 2 * node.linked >= max(1, node.length) else ""
        elif node.cut == "doubtful":
            node.cut = "cut" if _doubted(node) else ""
    for node in nodes:
        if node.cut == "cut" and not node.words.isdisjoint(COMMENTS):
            _cut_heading(node)
    return root


#: Words in names of parts with readers' comments.
COMMENTS = frozenset("comment comments commentlist disqus replies responses respond".split())


def _cut_heading(node: Node) -> None:
    """The heading right before readers' comments goes with them."""
    before = None
    for child in node.parent.children if node.parent is not None else ():
        if child is node:
            break
        before = child if isinstance(child, Node) else before if not child.strip() else None
    if before is not None and before.name in HEADINGS and ABOUT_COMMENTS.search(" ".join(c for c in before.children if isinstance(c, str))):
        before.cut = "cut"


ABOUT_COMMENTS = re.compile(r"comment|repl(?:y|ies)|response|discussion", re.I)


def _holds_text(node: Node, root: Node) -> bool:
    """Whether the element named like boilerplate holds the page's article, or its first heading and half its text."""
    if node.holds == "h1":
        return 2 * node.length >= root.length + node.length
    return bool(node.holds) and node.words.isdisjoint(("comment", "comments"))


def _held(node: Node | None, name: str) -> None:
    while node is not None and (not node.holds or (node.holds == "h1" and name != "h1")):
        node.holds = name
        node = node.parent


def _measure(nodes: list[Node]) -> None:
    """Characters and linked characters under each node that stays; children come after their parents."""
    for node in reversed(nodes):
        own = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        node.length += own
        node.linked = node.length if node.name == "a" else node.linked
        if node.parent is not None and node.cut not in ("cut", "always"):
            node.parent.length += node.length
            node.parent.linked += node.linked


def _crosses(here: Node, node: Node) -> bool:
    """Whether a block stands open inside the inline element that is to be closed."""
    while here is not node:
        if here.name in BLOCKS:
            return True
        here = here.parent
    return False


def _close(here: Node, names: frozenset[str], scope: frozenset[str]) -> Node:
    node = here
    while node.parent is not None:
        if node.name in names:
            return _close(node.parent, names, scope) if len(names) > 1 else node.parent
        if node.name in scope:
            return here
        node = node.parent
    return here


def _blocks(node: Node) -> list[tuple[Node, str, int]]:
    """The node's blocks in page order: the element that holds each, its text, and how many characters of it are links."""
    out: list[tuple[Node, str, int]] = []
    run: list[str] = []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal linked
        if text := " ".join("".join(run).split()):
            out.append((owner, text, linked))
        run.clear()
        linked = 0

    stack: list[tuple[Node, int, Node, bool]] = [(node, 0, node, False)]
    while stack:
        own, k, owner, link = stack.pop()
        while k < len(own.children):
            child = own.children[k]
            k += 1
            if isinstance(child, str):
                run.append(child)
                linked += len(" ".join(child.split())) if link else 0
                continue
            if child.cut:
                if child.name in BLOCKS:
                    flush(owner)
                continue
            if child.name in BLOCKS:
                flush(owner)
                stack.append((own, k, owner, link))
                own, k, owner = child, 0, child
            else:
                stack.append((own, k, owner, link))
                own, k, link = child, 0, link or child.name == "a"
        if own.name in BLOCKS:
            flush(owner)
    flush(node)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    scored: dict[int, Node] = {}
    for owner, text, linked in _blocks(root):
        points = 0.0 if owner.name in HEADINGS or len(text) < 25 else (1 + min(len(text) / 100, 3) + len(COMMAS.findall(text))) * (1 - min(1.0, linked / len(text)))
        if not points:
            continue
        node, share, beyond = owner, 1.0, 0
        whole = _within(owner)
        while node is not None:
            if node.name not in PASSING:
                scored[id(node)] = node
                node.score += points * share
                if not whole or beyond:
                    beyond += 1
                    share = share / 2 if beyond == 1 else share / 3
                elif node.name in ("article", "main"):
                    beyond, share = 1, share / 2
            node = node.parent
    best, top = None, 0.0
    for node in scored.values():
        value = _value(node)
        if value > top or (value == top and best is not None and node.depth < best.depth):
            best, top = node, value
    if best is None:
        return "\n".join(text for _, text, linked in _blocks(root) if linked < 0.5 * len(text))
    best = _headed(best)
    chosen = [best] if best.parent is None else [n for n in best.parent.children if isinstance(n, Node) and (n is best or not n.cut and (_alike(n, best) or _joins(n, top)))]
    semantic = best.name in ("article", "main") or _within(best) or best.content
    if not semantic:
        for n in chosen:
            _drop_menus(n)
    return "\n".join(text for n in chosen for _, text, _ in _blocks(n))


def _headed(best: Node) -> Node:
    """The container, or the one around it if that has the heading and hardly any links: then what stands beside the best part belongs to the text."""
    up = best.parent
    while up is not None and up.name in ("div", "section") and not up.cut and not best.content and not _within(best) and _density(up) < 0.25 and any(isinstance(c, Node) and c.name in ("h1", "h2") and not c.cut for c in up.children):
        best, up = up, up.parent
    return best


def _alike(node: Node, best: Node) -> bool:
    """Whether a sibling is another article, or another part named as text as the best one is."""
    if node.name != best.name:
        return False
    return node.name == "article" or not node.words.isdisjoint(best.words & CONTENT)


def _within(node: Node | None) -> bool:
    while node is not None:
        if node.name in ("article", "main"):
            return True
        node = node.parent
    return False


def _density(node: Node) -> float:
    return min(1.0, node.linked / max(1, node.length))


def _value(node: Node) -> float:
    weight = 1.25 if node.name in ("article", "main") or not node.words.isdisjoint(CONTENT) else 1.0
    return node.score * weight * (1 - _density(node))


def _drop_menus(node: Node) -> None:
    """Cuts lists below the node that are nothing but three or more links."""
    stack = [node]
    while stack:
        own = stack.pop()
        for child in own.children:
            if isinstance(child, Node) and not child.cut:
                if child.name in ("ul", "ol", "dl", "table") and _density(child) >= 0.9 and sum(isinstance(c, Node) for c in child.children) >= 3:
                    child.cut = "cut"
                stack.append(child)


def _joins(node: Node, top: float) -> bool:
    """Whether a sibling of the best container is kept: by its own points, or as a heading or paragraph of plain text."""
    if _value(node) >= max(2.0, 0.2 * top):
        return True
    if node.name in HEADINGS:
        return _density(node) < 0.3
    if node.name == "header":
        return _density(node) < 0.3
    return node.name in ("p", "pre", "blockquote", "ul", "ol", "dl", "table", "figure", "hgroup") and _density(node) < 0.25 and node.length > 25


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The id, the columns named in keep, and text: the main text of each page."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "_html"):
                text = pa.array([main_text(p) for p in part.column("_html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], text], names=[*part.schema.names[:-1], "text"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep)) + ", text string"
    return pages.select(id_col, *keep, F.col(html_col).alias("_html")).mapInArrow(run, schema)
