"""Main text of web pages by inferred wrappers.

Pages of a host come from few templates. Their token streams are aligned one after another into a
wrapper, a regular expression without unions: tags, text slots, optional and repeated groups. What
differs in the number of its repeats becomes a repeated group, what some pages lack becomes
optional, texts that differ become slots. Slots keep how much text they hold, how much of it is
linked and whether it is always the same; from these and the tags around them follows which parts of
the wrapper are the article. Each task makes a partial wrapper for each host it meets, so only wrappers
are shuffled, never pages.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeledger.llm.common import picked
from lakeledger.runtime import checkpoint, ship

ship(__name__)

ONE, OPTIONAL, REPEATED = 0, 1, 2
#: A text is part of the template if it never changes where it stands, if it is there in this share of the pages
#: that hold that part, and if the article has this many slots whose text changes for each whose text does not.
TEMPLATE_SHARE, CHANGING = 0.9, 2
#: Elements nested deeper than this are placed beside each other.
DEEPEST = 100
#: Hosts held by a task before it hands their partial wrappers on.
HELD = 500
#: Linked share of a block's text from which it is navigation.
LINKED = 0.6
#: Part of the text from which an element is not boilerplate by a part of its class names only.
MOST = 0.5
#: Part of a page's plain text that elements marked as article must hold to be taken for it.
MARKED = 0.2

# Names from the HTML standard and class names in common use.
_RAW = "script|style|noscript|iframe|textarea|title"  # only these may run to the page's end
_LEFT_OUT = frozenset("template object svg math head select video audio canvas map".split())
_IN_HEAD = frozenset("base link meta template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_BREAK_OUT = _ENDS_P | frozenset("body li dt dd".split())  # end svg, math and select that were left open
_SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_NOT_ARTICLE = frozenset("nav header footer aside form button label fieldset menu dialog legend input".split())
_BOILERPLATE = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer gdpr header hidden login masthead menu modal "
    "nav navbar navigation newsletter notice pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags toolbar".split()
)
# Compound class names with one of these tell a state or a kind, not what the element is.
_STATES = frozenset("has no not with without is hide show hidden open closed off on enabled disabled none category tag type format layout template page post single".split())
_BODY = frozenset("articlebody article-body article-content entry-content post-content post-body story-body main-content".split())
_CONTAINERS = frozenset("html body div section center table tbody tr td main span form".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

def _tokens_of(attributes: str) -> re.Pattern:
    # no part gives back what it took, so a tag that does not end is given up after one pass
    return re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({attributes})>|<[!?][^>]*+>|[^<]++|<", re.S | re.I)


_TOKEN = _tokens_of("(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_UNQUOTED = _tokens_of("[^>]*+")
_NO_TAG = re.compile(r"<(?!/?[a-zA-Z])")
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+(?:-[a-z]+)*")


def tokens(page: str) -> Iterator[re.Match | str]:
    """Matches of ``_TOKEN`` over a page, in time that grows with its length; at last the text behind all tags.

    Behind the last ``>`` there are no tags. A tag whose quotes do not close is met once: from there on
    quotes mean nothing, and tags end at the next ``>``.
    """
    end, at, pattern = page.rfind(">") + 1, 0, _TOKEN
    while at < end:
        for m in pattern.finditer(page, at, end):
            if pattern is _TOKEN and m.end() - m.start() == 1 and m[0] == "<" and not _NO_TAG.match(page, m.start()):
                at, pattern = m.start(), _UNQUOTED
                break
            yield m
            last = m
        else:
            at = end
    rest = page[end:]
    if end and (last[0].startswith("<!--") and not (last[0].endswith("-->") and len(last[0]) > 6) or last[1] and not re.search(rf"</{last[1]}\s*>\Z", last[0], re.I)):
        return  # what never ended takes the rest with it
    rest = rest.partition("<!--")[0]
    if rest:
        yield rest


def symbol(name: str, attributes: str) -> str:
    """Tag and its class, id and role words; numbers in them are left out."""
    if not attributes or "=" not in attributes:
        return name
    found = sorted({w for m in _NAMES.finditer(attributes) for w in _PARTS.findall((m[2] or m[3] or m[4] or "").lower())})
    return f"{name}.{'.'.join(found)}" if found else name


def words_of(sym: str) -> list[str]:
    """Class words of a symbol, compound ones also by their parts."""
    names = sym.split(".")[1:]
    return names + [p for n in names if "-" in n for p in n.split("-")]


def _parts(sym: str) -> set[str]:
    """Boilerplate words in a symbol's compound class names, those of states left out."""
    compound = [set(n.split("-")) for n in sym.split(".")[1:] if "-" in n]
    return {p for c in compound if _STATES.isdisjoint(c - _BOILERPLATE) for p in c & _BOILERPLATE}


def is_boilerplate(sym: str) -> bool:
    """Whether an element alone, its contents not known, looks like boilerplate."""
    name, *names = sym.split(".")
    return name in _NOT_ARTICLE or (name not in ("html", "body", "main") and (not _BOILERPLATE.isdisjoint(names) or (name != "article" and bool(_parts(sym)))))


def _is_header(sym: str) -> bool:
    """Whether it is being a header alone that makes an element boilerplate."""
    name, *_ = sym.split(".", 1)
    return (name == "header" or name not in _NOT_ARTICLE) and (_BOILERPLATE & set(sym.split(".")) | _parts(sym)) - {name} <= {"header"}


def parse(page: str) -> list:
    """The page as nested ``[symbol, children]``; a text run is ``(raw text, linked characters)``.

    Inline tags are part of their text. Scripts, styles, comments and the head are left out. End
    tags without a start are ignored, omitted end tags are supplied as browsers do.
    """
    root: list = ["", []]
    stack, names = [root], [""]
    where: dict[str, list[int]] = {}  # places of each name in names
    text: list[str] = []
    linked = anchor = 0
    out = 0  # place of the element left out that is open

    def close_text() -> None:
        nonlocal linked
        if out:
            return
        if text:
            run = "".join(text)
            if not run.isspace():
                stack[-1][1].append((run, linked))
            text.clear()
        linked = 0

    def cut(k: int) -> None:
        for n in reversed(names[k:]):
            where[n].pop()
        del stack[k:], names[k:]

    def pop_to(k: int) -> None:
        nonlocal out
        if out and k <= out:
            cut(out)
            out = 0
        if k < len(names):
            close_text()
            cut(k)

    def last(*some: str) -> int:
        return max((where[n][-1] for n in some if where.get(n)), default=0)

    def push(name: str, node: list) -> None:
        where.setdefault(name, []).append(len(names))
        names.append(name)
        stack.append(node)

    for m in tokens(page):
        t, name = (m, None) if isinstance(m, str) else (m[0], m[3])
        if name is None:
            if t == "<" or t[0] != "<" or isinstance(m, str):
                if names[-1] == "head" and not t.isspace():
                    pop_to(len(names) - 1)
                if out:
                    continue
                text.append(t)
                if anchor:
                    linked += len(t)
            continue
        name = name.lower()
        start = not m[2]
        if out and start:
            if names[-1] == "head" and name not in _IN_HEAD:
                pop_to(len(names) - 1)
            elif name in _BREAK_OUT and (k := last("svg", "math", "select")) > last("foreignobject", "annotation-xml"):
                pop_to(k)
        if name in _VOID:
            if out:
                continue
            if name == "br":
                text.append(" ")
            elif name == "hr":
                close_text()
            continue
        if name in _LEFT_OUT or out:
            if not start:
                if k := last(name):
                    pop_to(k)
            elif not (m[4].endswith("/") and last("svg", "math") or name in ("svg", "math") and m[4].endswith("/")):
                out = out or len(names)
                push(name, ["", []])
            continue
        if name in _INLINE:
            if name == "a":
                anchor = start
            if not (start and is_boilerplate(sym := symbol(name, m[4]))) and not (not start and names[-1] == name):
                continue
        if start:
            if name in _ENDS_P and (k := last("p")) and last("td", "th", "button", "div", "section", "article") < k:
                pop_to(k)
            if name in _SELF_ENDING and (k := last(*_SELF_ENDING[name])) > last(*_SCOPES[name]):
                pop_to(k)
            close_text()
            node: list = [symbol(name, m[4]), []]
            stack[-1][1].append(node)
            push(name, node if len(stack) <= DEEPEST else stack[-1])
        elif k := last(name):
            pop_to(k)
        else:
            close_text()
    pop_to(1)
    close_text()
    return root[1]


def block_text(run: str) -> str:
    """Character references decoded, white space as single spaces."""
    return " ".join(entities.unescape(run).split())


# --- wrappers: [symbol, mark, children, pages] and text slots ["#", mark, constant text, pages, characters, linked] ---


def _kept_text(text: str) -> str:
    """A text as slots keep it; a long one as its digest."""
    return text if len(text) <= 200 else "\0" + blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def shape(children: list) -> list:
    """A page's tree as a wrapper of one page."""
    out = []
    for c in children:
        if isinstance(c, tuple):
            text = block_text(c[0])
            if text:
                out.append(["#", ONE, _kept_text(text), 1, len(text), min(len(text), c[1])])
        else:
            out.append([c[0], ONE, shape(c[1]), 1])
    return folded(out)


def _alike(a: list, b: list) -> bool:
    """Whether two neighbours may be repeats of one group; plain containers must also hold the same things."""
    if a[0] != b[0]:
        return False
    if a[0] == "#" or a[0].split(".", 1)[0] not in _CONTAINERS or "." in a[0]:
        return True
    inner = ({c[0] for c in x[2]} for x in (a, b))
    return next(inner) == next(inner)


def folded(items: list) -> list:
    """Neighbouring repeats of one to four items as one repeated group."""
    out: list = []
    for it in items:
        if out and _alike(out[-1], it):
            out[-1] = _merge(out[-1], it, False)
            out[-1][1] |= REPEATED
        else:
            out.append(it)
    for period in (2, 3, 4):
        k = 0
        while k + 2 * period <= len(out):
            a, b = out[k : k + period], out[k + period : k + 2 * period]
            if all(_alike(x, y) for x, y in zip(a, b)):
                group = ["(" + " ".join(x[0] for x in a) + ")", REPEATED, [_merge(x, y, False) for x, y in zip(a, b)], 1]
                end = k + 2 * period
                while end + period <= len(out) and all(_alike(x, y) for x, y in zip(a, out[end : end + period])):
                    group[2] = [_merge(x, y, False) for x, y in zip(group[2], out[end : end + period])]
                    end += period
                out[k:end] = [group]
            k += 1
    return out


def _merge(a: list, b: list, apart: bool = True) -> list:
    """Two items of one symbol as one; ``apart`` tells that they are of different pages."""
    n = a[3] + b[3] if apart else max(a[3], b[3])
    if a[0] == "#":
        return ["#", a[1] | b[1], a[2] if a[2] == b[2] else "", n, a[4] + b[4], a[5] + b[5]]
    return [a[0], a[1] | b[1], align(a[2], b[2], apart), n]


def _grouped(items: list, groups: list) -> list:
    """Items with plain runs that match a repeated group of the other side put into that group."""
    for g in groups:
        names = [c[0] for c in g[2]]
        k = 0
        while k + len(names) <= len(items):
            if [c[0] for c in items[k : k + len(names)]] == names:
                items = [*items[:k], [g[0], g[1], run := items[k : k + len(names)], max(c[3] for c in run)], *items[k + len(names) :]]
            k += 1
    return items


def align(a: list, b: list, apart: bool = True) -> list:
    """The wrapper that fits both sides: what only one of them has is optional."""
    names_a, names_b = [x[0] for x in a], [x[0] for x in b]
    if names_a == names_b:
        return [_merge(x, y, apart) for x, y in zip(a, b)]
    groups_a, groups_b = ([x for x in s if x[0][0] == "("] for s in (a, b))
    if groups_a or groups_b:
        a, b = _grouped(a, [g for g in groups_b if g[0] not in names_a]), _grouped(b, [g for g in groups_a if g[0] not in names_b])
        names_a, names_b = [x[0] for x in a], [x[0] for x in b]
    out = []
    for op, i, j, k, m in SequenceMatcher(None, names_a, names_b, autojunk=False).get_opcodes():
        if op == "equal":
            out += [_merge(x, y, apart) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [[x[0], x[1] | OPTIONAL, *x[2:]] for x in (*a[i:j], *b[k:m])]
    return out


def expression(items: list) -> str:
    """A wrapper as a regular expression: ``?`` optional, ``+`` repeated, ``*`` both, ``#`` a text slot."""
    out = []
    for x in items:
        mark = ("", "?", "+", "*")[x[1]]
        if x[0] == "#":
            out.append((json.dumps(x[2], ensure_ascii=False) if x[2] and x[2][0] != "\0" and x[3] > 1 else "#") + mark)
        elif x[0][0] == "(":
            out.append(f"({expression(x[2])}){mark}")
        else:
            inside = f"<{x[0]}>{expression(x[2])}</{x[0].split('.', 1)[0]}>"
            out.append(f"({inside}){mark}" if mark else inside)
    return " ".join(out)


# --- which parts are the article ---


def _marked(sym: str) -> bool:
    names = sym.split(".")
    return names[0] in ("article", "main") or "main" in names[1:] or not _BODY.isdisjoint(words_of(sym))


def boilerplate(items: list) -> set[int]:
    """Ids of the items that are boilerplate: by their tag, by a class word, or by part of one if they hold little text.

    html, body and main are none by class, nor is what holds a marked article with much of the text.
    """
    out: set[int] = set()
    size = {}

    def measure(x: list) -> int:
        size[id(x)] = n = x[4] if x[0] == "#" else sum(map(measure, x[2]))
        return n

    total = sum(map(measure, items))

    def visit(x: list) -> int:
        """Characters of marked elements below an item or of itself."""
        if x[0] == "#":
            return 0
        marked = sum(map(visit, x[2]))
        name, *names = x[0].split(".")
        if name in _NOT_ARTICLE:
            out.add(id(x))
            return 0
        if is_boilerplate(x[0]):
            whole = not _BOILERPLATE.isdisjoint(names)
            if marked < (MOST if whole else MARKED) * total and ((whole and name != "article") or size[id(x)] < MOST * total):
                out.add(id(x))
                return 0
        return size[id(x)] if _marked(x[0]) else marked

    for x in items:
        visit(x)
    return out


def _volume(x: list, cut: set[int], linked: bool = False) -> int:
    """Characters without link text (or of link text) below an item, boilerplate left out."""
    if x[0] == "#":
        return x[5] if linked else x[4] - x[5]
    return 0 if id(x) in cut else sum(_volume(c, cut, linked) for c in x[2])


def _find(items: list, wanted, cut: set[int]) -> list:
    """Outermost items for which ``wanted`` holds, boilerplate left out."""
    out = []
    for x in items:
        if x[0] == "#" or id(x) in cut:
            continue
        out += [x] if wanted(x) else _find(x[2], wanted, cut)
    return out


def main_parts(items: list, cut: set[int]) -> list:
    """Items of the wrapper that hold the article: marked as such, or the smallest holding most of the plain text."""
    tag = lambda x: x[0].split(".", 1)[0]
    for wanted in (lambda x: tag(x) == "article", lambda x: not _BODY.isdisjoint(words_of(x[0])), lambda x: tag(x) == "main" or "main" in x[0].split(".")[1:]):
        found = _find(items, wanted, cut)
        if (held := sum(_volume(x, cut) for x in found)) and held >= MARKED * sum(_volume(x, cut) for x in items):
            return found
    here = [["", ONE, items]]
    while True:
        inner = [x for x in here[0][2] if x[0] != "#" and (x[0][0] == "(" or tag(x) in _CONTAINERS) and id(x) not in cut]
        best = max(inner, key=lambda x: _volume(x, cut), default=None)
        if best is None or _volume(best, cut) < 0.6 * sum(_volume(x, cut) for x in here[0][2]) or not any(_volume(c, cut) for c in best[2] if c[0] != "#"):
            return here
        here = [best]


def rule(items: list) -> list:
    """What to keep: ``[symbol, mark, children]`` as in the wrapper; a kept slot is ``["#", 1]``, others 0.

    Kept are the slots inside the main parts, but for boilerplate elements (of a header only the
    headings stay), blocks that are mostly links, and texts that are the same on ``TEMPLATE_SHARE`` of the
    pages with the element around them, two at least, where most of the article differs: it has ``CHANGING``
    slots that change for each such text, so that near copies of a page lose nothing. Empty pages do not count. Where this keeps nothing, blocks of links stay,
    then elements that are boilerplate by class, then forms and headers.
    """
    cut = boilerplate(items)
    tags, plainly = set(), set()

    def named(x: list) -> None:
        if x[0] != "#":
            name = x[0].split(".", 1)[0]
            if name in _NOT_ARTICLE:
                tags.add(id(x))
                if name not in ("form", "fieldset", "label", "header"):
                    plainly.add(id(x))
            for c in x[2]:
                named(c)

    for x in items:
        named(x)
    for left, links in ((cut, True), (cut, False), (tags, False), (plainly, False)):
        out = _rule(items, left, links)
        if _any_kept(out):
            break
    return out


def _rule(items: list, cut: set[int], by_links: bool) -> list:
    main = main_parts(items, cut)
    pages = max((x[3] for x in items), default=0)
    same, other = map(sum, zip(*(_slots(x, cut, pages if x[0] == "" else x[3]) for x in main), strict=True))
    differs = other >= CHANGING * same

    def walk(x: list, inside: bool, linked: bool, around: int) -> list:
        if x[0] == "#":
            return ["#", int(inside and not linked and not (differs and _is_constant(x, around)))]
        inside = inside or any(x is m for m in main)
        below = inside and id(x) not in cut
        head = inside and not below and _is_header(x[0])
        plain, links = sum(_volume(c, cut) for c in x[2]), sum(_volume(c, cut, True) for c in x[2])
        linked = linked or (by_links and below and x[0].split(".", 1)[0] not in ("p", *_HEADINGS) and links > LINKED * (plain + links))
        # a text may stand in an element of its own: that one's place is what counts
        return [x[0], x[1], [walk(c, below or (head and c[0].split(".", 1)[0] in _HEADINGS), linked, max(around, x[3]) if len(x[2]) == 1 else x[3]) for c in x[2]]]

    top = any(m[0] == "" for m in main)
    return [walk(x, top, False, pages if x[0] == "#" else x[3]) for x in items]


def _is_constant(slot: list, around: int) -> bool:
    return bool(slot[2]) and slot[3] > 1 and slot[3] >= TEMPLATE_SHARE * around


def _slots(x: list, cut: set[int], around: int) -> tuple[int, int]:
    """Slots below an item whose text never changes, and others; boilerplate left out."""
    if x[0] == "#":
        same = _is_constant(x, around)
        return int(same), int(not same)
    if id(x) in cut or not x[2]:
        return 0, 0
    pages = around if len(x) < 4 else max(around, x[3]) if len(x[2]) == 1 else x[3]
    same, other = zip(*(_slots(c, cut, pages) for c in x[2]), strict=True)
    return sum(same), sum(other)


def _any_kept(items: list) -> bool:
    return any(x[1] if x[0] == "#" else _any_kept(x[2]) for x in items)


def pruned(items: list) -> list:
    """A rule without what lies below parts of which nothing is kept."""
    return [x if x[0] == "#" else [x[0], x[1], pruned(x[2]) if _any_kept(x[2]) else []] for x in items]


def _flat(rules: list) -> list:
    """Rules with groups, also those in groups, opened."""
    return [r for x in rules for r in (_flat(x[2]) if x[0][0] == "(" else [x])]


def _texts(c: list | tuple) -> list[str]:
    """Texts of a page part, boilerplate left out."""
    if isinstance(c, tuple):
        return [t] if (t := block_text(c[0])) else []
    return [] if is_boilerplate(c[0]) else [t for x in c[1] for t in _texts(x)]


def extract(page: str, kept: list) -> str:
    """Main text of a page: blocks of the kept slots, in page order."""
    out: list[str] = []

    def walk(children: list, rules: list) -> None:
        flat = _flat(rules)
        single = {id(x) for x in rules}
        at = 0
        for c in children:
            sym = "#" if isinstance(c, tuple) else c[0]
            k = next((k for k in (*range(at, len(flat)), *range(at)) if flat[k][0] == sym), None)
            if k is None:  # no page of the wrapper has it: kept where its neighbours are
                if _any_kept(rules):
                    out.extend(_texts(c))
                continue
            r = flat[k]
            if isinstance(c, tuple):
                at = k
                if r[1] and (text := block_text(c[0])):
                    out.append(text)
            else:
                at = k if r[1] & REPEATED and id(r) in single else k + 1
                if r[2]:
                    walk(c[1], r[2])

    walk(parse(page), kept)
    return " ".join(out)


# --- on Spark ---


def host(url: Column) -> Column:
    """Host of a URL in lower case; null and malformed URLs share an empty one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, pages, wrapper, rule``: one wrapper for each host, inferred from all of its pages.

    ``wrapper`` is a regular expression over tags and text, ``rule`` tells the article's slots. Empty
    and null pages add an empty stream.
    """
    rows = picked(pages, host=host(pages[url_col]), html=html_col)

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        part = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            names = ["host", "part", "pages", "tree"]
            columns = [list(held), [part] * len(held), [n for n, _ in held.values()], [json.dumps(t) for _, t in held.values()]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string()))], names=names)

        for b in parts:
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tree = shape(parse(page or ""))
                known = held.get(h)
                if known is None:
                    held[h] = [1, tree]
                else:
                    known[0] += 1
                    known[1] = align(known[1], tree)
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    def joined(pdf: pd.DataFrame) -> tuple[int, list]:
        trees = [json.loads(t) for t in pdf.sort_values(["pages", "tree"], ascending=[False, True])["tree"]]
        tree = trees[0]
        for t in trees[1:]:
            tree = align(tree, t)
        return int(pdf["pages"].sum()), tree

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        n, tree = joined(pdf)
        return pd.DataFrame({"host": [pdf["host"].iat[0]], "part": [0], "pages": [n], "tree": [json.dumps(tree)]})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        n, tree = joined(pdf)
        return pd.DataFrame({"host": [pdf["host"].iat[0]], "pages": [n], "wrapper": [expression(tree)], "rule": [json.dumps(pruned(rule(tree)), separators=(",", ":"))]})

    found = rows.mapInArrow(partial, "host string, part int, pages bigint, tree string")
    # partial wrappers of a busy host meet by the square root of their number
    some_of = found.withColumn("grp", F.floor(F.sqrt("part"))).groupBy("host", "grp").applyInPandas(some, "host string, part int, pages bigint, tree string")
    return some_of.groupBy("host").applyInPandas(last, "host string, pages bigint, wrapper string, rule string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every row, by the wrapper of its host.

    ``text`` is empty for null and empty pages and where nothing is left; ``n_chars`` counts code
    points. Rows that repeat are extracted each.
    """
    found = wrappers(pages, url_col, html_col)
    rules = checkpoint(found.select(F.col("host").alias("_host"), F.col("rule").alias("_rule")))  # its size known, a small one needs no shuffle of pages
    rows = picked(pages, id=id_col, url=url_col, html=html_col)
    met = rows.join(rules, host(rows["url"]) == rules["_host"], "left").select("id", "url", "html", "_rule")
    kind = rows.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for b in parts:
            out = []
            for page, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if r not in known:
                    if len(known) >= HELD:
                        known.clear()
                    known[r] = json.loads(r)
                out.append(extract(page or "", known[r]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["id", "url", "text", "n_chars"])

    return met.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
