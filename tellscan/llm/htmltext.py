"""Operator 13: main text of web pages by composite text density.

A page is read into a tree in one pass. What its tags, roles or names say is a menu, a footer, an advert, a form or the
like is left out. For every node that is left, the characters for each tag are taken and adjusted by the share that links
have in them; the sum over its children is the node's density sum. The node of the greatest sum is the centre of the
article; the least density on its path to the body is the threshold that other subtrees must reach, and of these again
the node of the greatest sum is taken. (Sun, Song and Liao, "DOM based content extraction via text density", 2011.)
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellscan.llm import duck
from tellscan.llm._util import fresh

#: A comment, declaration or instruction; an end tag; a start tag, whose quoted values may hold anything. No step is ever taken back.
MARKUP = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s/"'])(class|id|role|hidden|style|aria-hidden|aria-label)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)

HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# What HTML says about its elements; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody tfoot thead tr ul".split())
#: A start tag of the key ends open elements of these names, up to one of BOUND.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th", "caption"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, "option": {"option"}}
ENDS |= {"thead": ENDS["tbody"], "tfoot": ENDS["tbody"], "optgroup": {"option", "optgroup"}}
BOUND = frozenset("article aside body dl html main menu nav ol section select table td th ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements that hold no article text.
DROPPED = frozenset("aside button canvas datalist dialog footer form head iframe input menu nav noembed noframes noscript object script search select style svg template textarea title xmp audio video math map".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split())
#: Words in a class or an id that name a part beside the article.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adunit banner breadcrumb breadcrumbs byline captcha comment comments commentlist consent cookie cookies copyright cta "
    "disclaimer discussion disqus donate footer footers gdpr header hidden related login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay paginate "
    "pager pagination paywall popup privacy promo promoted promotion recommended recommendations replies reply respond share sharing shares sidebar sidebars signin signup skip social "
    "sponsor sponsored sponsors subscribe subscription survey tags teaser teasers toolbar topbar tracking warning widget widgets".split()
)
#: Words before such a one that take it back: a page that has a sidebar is none.
EXCEPT = frozenset("has have no not with without".split())
#: Words before "header" that make it the article's own head.
OWN = frozenset("article content entry post section story".split())
#: Of all text outside dropped elements, the share from which a part is no box of notices or adverts, whatever it is called.
MOST_OF_PAGE = 0.8
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: Of these, the ones that hold articles of their own: what readers wrote, and other pages.
OTHERS = frozenset("comment comments commentlist discussion disqus recommended recommendations related replies reply respond sidebar sidebars teaser teasers widget widgets".split())
READERS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())


def named(value: str, known: frozenset[str] = NAMED) -> bool:
    """Whether a class or id holds one of the known words, and none before it that takes it back."""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words[:1] or words[0] in EXCEPT:
            continue
        for k, w in enumerate(words):
            before = words[k - 1] if k else ""
            if w in known and before not in EXCEPT and not (w == "header" and before in OWN):
                return True
    return False


@dataclass
class Tree:
    """A page's nodes in page order: each has its tag, its parent's number and its attributes; texts hang on nodes."""

    tags: list[str] = field(default_factory=lambda: ["body"])
    parents: list[int] = field(default_factory=lambda: [-1])
    attributes: list[str] = field(default_factory=lambda: [""])
    #: Of text, (node, number of nodes before it, decoded text).
    texts: list[tuple[int, int, str]] = field(default_factory=list)


def parse(page: str) -> Tree:
    """The tree of a page. Missing end tags are put where HTML puts them; end tags of nothing are left out."""
    tree = Tree()
    tags, parents, attributes, texts = tree.tags, tree.parents, tree.attributes, tree.texts
    stack, open_ = [0], Counter()
    at, n = 0, len(page)

    def up_to(depth: int) -> None:
        for node in stack[depth:]:
            open_[tags[node]] -= 1
        del stack[depth:]

    def close(names, bound) -> None:
        """Ends the nearest open element of names that lies above no bound."""
        if not any(open_[x] for x in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = tags[stack[depth]]
            if tag in names:
                return up_to(depth)
            if tag in bound:
                return None
        return None

    while at < n:
        m = MARKUP.search(page, at)
        start = m.start() if m else n
        if start > at:
            texts.append((stack[-1], len(tags), html.unescape(page[at:start])))
        if not m:
            break
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name not in ("body", "html") and open_[name]:
                close({name}, BOUND - {name} if name not in BOUND else frozenset())
        elif m[2]:
            name = m[2].lower()
            if name in ("html", "body"):
                if name == "body":
                    attributes[0] = m[3]
                continue
            if name in BLOCK or name == "hr":
                close({"p"}, BOUND | {"button", "object"})
            if name in HEADINGS and tags[stack[-1]] in HEADINGS:
                up_to(len(stack) - 1)
            if name in ENDS:
                names = ENDS[name]
                while True:  # a row ends its cells first
                    before = len(stack)
                    close(names, BOUND - names)
                    if len(stack) == before or name in ("li", "dt", "dd", "option"):
                        break
            node = len(tags)
            tags.append(name)
            parents.append(stack[-1])
            attributes.append(m[3])
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else n
                shut = page.find(">", at)
                at = shut + 1 if shut >= 0 and end else n
            elif name not in VOID and not m[3].rstrip().endswith("/") or name in ("p", "div", "li", "a", "b"):
                stack.append(node)
                open_[name] += 1
    return tree


def dropped(tree: Tree) -> list[bool]:
    """Of each node, whether it is beside the article by its tag, role or name, or lies inside such a node."""
    tags, parents = tree.tags, tree.parents
    n = len(tags)
    names, hidden, roles = [""] * n, [False] * n, [""] * n
    for k in range(1, n):
        if tree.attributes[k]:
            a = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(tree.attributes[k])}
            names[k] = html.unescape(f"{a.get('class', '')} {a.get('id', '')}")
            roles[k] = a.get("role", "").lower()
            hidden[k] = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(a.get("style", "")))
    # what holds the article itself, the first one on the page or what main has, is not judged by its names
    holds, inside, others = [False] * n, [False] * n, [False] * n
    first = True
    for k in range(1, n):
        others[k] = others[parents[k]] or tags[k] in DROPPED or named(names[k], OTHERS)
        inside[k] = inside[parents[k]] or tags[k] in ("main", "article") and not others[k]
        holds[k] = not others[k] and (tags[k] == "main" or tags[k] == "article" and first)
        first = first and not (holds[k] and tags[k] == "article")
    for k in range(n - 1, 0, -1):
        if holds[k]:
            holds[parents[k]] = True
    size, gone = [0] * n, [False] * n
    for k in range(1, n):
        gone[k] = gone[parents[k]] or tags[k] in DROPPED or hidden[k]
    for node, _, text in tree.texts:
        size[node] += 0 if gone[node] else len(text)
    for k in range(n - 1, 0, -1):
        size[parents[k]] += size[k]
    out = [False] * n
    for k in range(1, n):
        tag, up = tags[k], parents[k]
        if out[up] or tag in DROPPED or hidden[k]:
            out[k] = True
        elif tag == "header":
            out[k] = not inside[k] and not holds[k]
        elif tags[up] == "header" and inside[k] and tag not in HEADINGS and tag != "hgroup":
            out[k] = True  # of an article's own head the headings stay
        elif not holds[k]:
            out[k] = roles[k] in ROLES or named(names[k]) and (size[k] <= MOST_OF_PAGE * size[0] or named(names[k], READERS))
    return out


def densities(tree: Tree, out: list[bool]) -> tuple[list[float], list[float]]:
    """Of each node, its characters for each tag, adjusted by its links, and the sum of its children's."""
    tags, parents = tree.tags, tree.parents
    n = len(tags)
    chars, link_chars, tag_n, link_n = [0] * n, [0] * n, [0] * n, [0] * n
    link = [False] * n
    for k in range(1, n):
        link[k] = tags[k] == "a" or link[parents[k]]
    for node, _, text in tree.texts:
        if not out[node]:
            size = len(" ".join(text.split()))
            chars[node] += size
            if link[node]:
                link_chars[node] += size
    for k in range(n - 1, 0, -1):
        if not out[k]:
            up = parents[k]
            chars[up] += chars[k]
            link_chars[up] += link_chars[k]
            tag_n[up] += tag_n[k] + 1
            link_n[up] += link_n[k] + (tags[k] == "a")
    share = link_chars[0] / chars[0] if chars[0] else 0.0
    density, sums = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        if out[k] or not chars[k]:
            continue
        c, t, lc, lt = chars[k], tag_n[k] or 1, link_chars[k], link_n[k] or 1
        base = math.log(c / ((c - lc) or 1) * lc + share * c + math.e)
        density[k] = c / t * max(0.0, math.log(c / (lc or 1) * t / lt) / math.log(base)) if base > 1.0 else float(c) / t
        if k:
            sums[parents[k]] += density[k]
    return density, sums


def chosen(tree: Tree, out: list[bool]) -> list[bool]:
    """Of each node, whether it belongs to the main text."""
    tags, parents = tree.tags, tree.parents
    n = len(tags)
    density, sums = densities(tree, out)
    centre = max(range(n), key=lambda k: (sums[k], -k))
    least, k = density[centre], centre
    while k > 0:
        k = parents[k]
        least = min(least, density[k])
    best = list(range(n))
    for k in range(n - 1, 0, -1):
        if not out[k] and (sums[best[k]], -best[k]) > (sums[best[parents[k]]], -best[parents[k]]):
            best[parents[k]] = best[k]
    taken = [False] * n
    for k in range(n):
        if not out[k] and density[k] >= least and density[k] > 0:
            taken[best[k]] = True
    # an element that says it is the article is taken whole, and nothing beside it
    holds = list(taken)
    for k in range(n - 1, 0, -1):
        holds[parents[k]] = holds[parents[k]] or holds[k]
    for k in range(1, n):
        taken[k] = taken[k] or taken[parents[k]]
    for name in ("article", "main"):
        own = [(holds[k] or taken[k]) and tags[k] == name and not out[k] for k in range(n)]
        if any(own):
            taken = own
            break
    for k in range(1, n):
        taken[k] = (taken[k] or taken[parents[k]]) and not out[k]
    return taken


def main_text(page: str | None) -> str:
    """The blocks of a page's main text, white space squeezed, joined by line ends; empty if there is none."""
    if not page:
        return ""
    tree = parse(page)
    out = dropped(tree)
    taken = chosen(tree, out)
    tags, parents = tree.tags, tree.parents
    block = list(range(len(tags)))  # the block each node's text belongs to
    for k in range(1, len(tags)):
        if tags[k] not in BLOCK:
            block[k] = block[parents[k]]
    pieces: list[list[str]] = []
    at, seen = None, 0
    for node, before, text in tree.texts:
        # a block that began and ended since the last text parts it from this one
        between = any(tags[k] in BLOCK for k in range(seen, before))
        gap = any(tags[k] in ("br", "td", "th", "img") for k in range(seen, before))
        seen = before
        if not taken[node]:
            at = at if not between and at == block[node] else None
            continue
        if at != block[node] or between:
            pieces.append([])
            at = block[node]
        pieces[-1].append(" " + text if gap else text)
    lines = [" ".join("".join(p).split()) for p in pieces]
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """Every row and column of pages with main_text.

    Character references are decoded once; white space inside a block, line breaks included, is one space; blocks stand
    in page order, one to a line. A null or empty page, and one without text, gives an empty text. Repeated rows fare
    alike; nothing is cut, and nothing is shuffled. The work is linear in a page's length, and in its depth where ends
    are missing. Where pages has a column of that name, the new one has an underscore before it.
    """
    name = fresh(pages, text_col)
    given = pages.withColumn(body := fresh(pages, "html_body"), F.coalesce(F.col(html_col).cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in duck.slices(batches, body):
            texts = rows.column(rows.schema.get_field_index(body)).cast(pa.binary()).to_pylist()
            found = [main_text(x.decode("utf-8", "replace")) for x in texts]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.string())], [*rows.schema.names, name])

    return given.mapInArrow(run, duck.with_columns(given, {name: "string"})).drop(body)


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages."""
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
