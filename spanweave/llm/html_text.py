"""HTML extraction by tag-path ratios (operator 8).

A page is read into text nodes with their root-to-leaf tag paths.  What mark-up
names as menus, adverts, comments and the like is left out at once.  For every
path the text length and punctuation of its nodes are added up, links counting
little; both ratios to the number of nodes are smoothed along the page and fused
by product.  Paths above a share of the spread are content, and their nodes are
the text.

The container settles what the ratios leave open.  It is the outermost article
elements, or else main elements, if they have most of the fused weight, and
otherwise the smallest element around all content.  Content outside it goes.
Within an article or main element, blocks of weak paths (captions, short items)
stay.  Within other containers headings stay, and weak blocks that aren't links
if the container is within the body, if they stand between content, or if no
element that sets parts of a page apart separates them from the body; a title
just before the container is taken in.

Defined results: null, empty and text-free pages give an empty text; unclosed
and cut-off mark-up is read as far as it goes, a quote that never closes ends
with its tag; equal weights go to the outer, then the earlier element; repeated
rows get equal results; an empty table gives an empty result; only the named
columns are read.  Time and memory are linear in the page, whatever its depth.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A plain tag in one go; all others are read attribute by attribute.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<=]*)((?:\s+[^\s\"'<>/=]+(?:=(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>`=]+))?)*)\s*(/?)>")
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMED = re.compile(r"[^\s/><=\"']+")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s><]+")
_NAME = re.compile(r"[a-z]+", re.I)
_PUNCT = re.compile(r"[.,;:!?…。，；：！？、¿¡]")
#: Elements by their part in the language.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option optgroup p pre section "
    "select summary table tbody td tfoot th thead title tr ul video audio".split()
)
NEVER = set(
    "nav footer aside form script style noscript template iframe button select textarea svg object embed canvas dialog menu head title "
    "audio video map datalist".split()
)
#: Words of class and id names that mark what is not the article.
NAMED = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner nav navbar navigation menu "
    "submenu sidebar sidenav footer comment comments commentlist reply replies disqus discussion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription share sharing social related recommended breadcrumb breadcrumbs pagination "
    "pager login signup toolbar widget skip hidden masthead copyright legal disclaimer announcement announcements toast snackbar promoted "
    "adbox adslot adunit adbanner outbrain taboola respond responses cookiebar cookiebanner".split()
)
#: "header" names the site's header, outside articles, if nothing but these stands with it.
SITE = {"header", "site", "top", "global", "bar"}
#: An article element is the article unless its name is one of these.
NAMED_ARTICLE = {"comment", "reply", "advert", "sponsored", "related"}
ABOUT = {"with", "without", "has", "no", "open"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: What an opening tag closes, up to the barrier that stops it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CLOSE_P = BLOCK - {"br", "body", "html", "head", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "title", "caption", "col", "colgroup", "legend", "summary"}
WHOLE = {"article", "main"}


#: Part of the spread of fused weights that a content path has at least.
SHARE = 0.8
#: Part of all fused weight that article or main elements have at least where they are the container.
MOST = 0.8
#: What a character of a link counts.
LINK = 0.2
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks that set parts of a page apart.
MODULES = set("address aside center dialog details div fieldset footer form header main nav section table tbody tr td th".split())
ROOTS = {"", "html", "body"}
#: Blocks that hold text rather than other blocks, so they are no container.
NOT_AROUND = HEADINGS | {"p", "br", "hr", "li", "dt", "dd", "pre", "caption", "figcaption", "legend", "summary", "tr", "td", "th"}


@dataclass
class Page:
    """Elements by number, parents first, 0 for the page itself; text runs of one block number stand in one block."""

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    #: Numbers of tag paths: elements with the same tags from the root down share one.
    paths: list[int] = field(default_factory=lambda: [0])
    out: list[bool] = field(default_factory=lambda: [False])
    #: The outermost article or main element that each stands in or is, 0 for none.
    articles: list[int] = field(default_factory=lambda: [0])
    mains: list[int] = field(default_factory=lambda: [0])
    links: list[bool] = field(default_factory=lambda: [False])
    heads: list[bool] = field(default_factory=lambda: [False])
    #: (element, text, block)
    runs: list[tuple[int, str, int]] = field(default_factory=list)


def _is_out(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag in NEVER or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    marks = NAMED_ARTICLE if tag == "article" else NAMED
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        words = set(_NAME.findall(name))
        # "with-sidebar" names what stands around a sidebar.
        if words & marks and not words & ABOUT:
            return True
        if "header" in words and words <= SITE and not inside:
            return True
    return False


class _Ahead:
    """Where a string occurs next; places only grow, so each page is searched once for each string."""

    def __init__(self, page: str) -> None:
        self.page, self.known = page, {}

    def __call__(self, what: str, at: int) -> int:
        found = self.known.get(what, -1)
        if found < at:
            found = self.page.find(what, at)
            self.known[what] = found = len(self.page) if found < 0 else found
        return found


def _attributes(page: str, at: int, ahead: _Ahead) -> tuple[dict[str, str], int, bool]:
    """(attributes, where the tag ends, whether it is whole) from behind a tag's name.

    A quoted value may hold any character.  If what follows its closing quote
    can't follow a value, and the value spans the end of one tag and the start
    of another, the quote was never closed and the value ends with its tag.
    """
    attrs: dict[str, str] = {}
    size = len(page)
    while at < size:
        c = page[at]
        if c == ">":
            return attrs, at + 1, True
        if c == "<":
            return attrs, at, True
        name = _NAMED.match(page, at)
        if name is None:
            at += 1
            continue
        key, at, value = name[0].lower(), name.end(), ""
        equals = _EQUALS.match(page, at)
        if equals:
            at = equals.end()
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote:
                at += 1
                end, close = ahead(quote, at), ahead(">", at)
                torn = close < end and ahead("<", close) < end and page[end + 1 : end + 2] not in ("", " ", "\n", "\t", "\r", ">", "/")
                if end == size or torn:
                    end, quote = close, ""
                value, at = page[at:end], min(end + len(quote), size)
            elif bare := _BARE.match(page, at):
                value, at = bare[0], bare.end()
        attrs.setdefault(key, html.unescape(value))
    return attrs, size, False


def parse(page: str) -> Page:
    """Elements and text runs of a page."""
    out = Page()
    known: dict[tuple[int, str], int] = {}
    stack: list[int] = [0]
    #: Depths of the open elements of each tag.
    held: dict[str, list[int]] = defaultdict(list)
    ahead = _Ahead(page)
    at, block, size = 0, 0, len(page)

    def text(a: int, b: int) -> None:
        if a < b and not out.out[stack[-1]]:
            out.runs.append((stack[-1], html.unescape(page[a:b]), block))

    def close(tags: set[str], barrier: set[str]) -> None:
        """Pops up to the innermost open element of ``tags``, if none of ``barrier`` stands further in."""
        depth = max((held[t][-1] for t in tags if held.get(t)), default=0)
        if depth and depth > max((held[t][-1] for t in barrier if held.get(t)), default=0):
            while len(stack) > depth:
                held[out.tags[stack.pop()]].pop()

    while at < size:
        lt = ahead("<", at)
        text(at, lt)
        if lt == size:
            break
        if page.startswith("<!--", lt):
            at = min(ahead("-->", lt + 2) + 3, size)
            continue
        if page.startswith(("<!", "<?"), lt):
            at = min(ahead(">", lt) + 1, size)
            continue
        m = _TAG.match(page, lt)
        if m:
            slash, tag, raw, whole = m[1], m[2].lower(), m[3], True
            attrs = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(raw)} if raw else {}
            at, ended = m.end(), bool(m[4])
        else:
            m = _OPEN.match(page, lt)
            if not m:
                if page.startswith("</", lt):
                    at = min(ahead(">", lt) + 1, size)
                else:
                    at = lt + 1
                    if not out.out[stack[-1]]:
                        out.runs.append((stack[-1], "<", block))
                continue
            slash, tag = m[1], m[2].lower()
            attrs, at, whole = _attributes(page, m.end(), ahead)
            ended = page[at - 2 : at] == "/>"
        if not whole:
            # A tag that the end cuts off isn't text.
            break
        if tag in BLOCK:
            block += 1
        if slash:
            if tag == "p" or tag in VOID:
                close({tag}, {"article", "body", "td", "th"})
            else:
                close({tag}, {"table"} if tag not in ("table", "body", "html", "article", "main", "div", "section") else set())
            continue
        if tag in VOID:
            continue
        if tag == "p":
            close({"p"}, {"td", "th", "table", "button", "object", "article", "section", "div"})
        elif tag in CLOSE_P:
            close({"p"}, {"td", "th", "table", "button", "object"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        above = stack[-1]
        number = len(out.tags)
        is_article = tag == "article" or attrs.get("itemprop", "").lower() == "articlebody"
        is_main = tag == "main" or attrs.get("role", "").lower() == "main"
        out.tags.append(tag)
        out.parents.append(above)
        out.paths.append(known.setdefault((out.paths[above], tag), len(known) + 1))
        out.out.append(out.out[above] or _is_out(tag, attrs, bool(out.articles[above] or out.mains[above])))
        out.articles.append(out.articles[above] or is_article * number)
        out.mains.append(out.mains[above] or is_main * number)
        out.links.append(tag == "a" or out.links[above])
        out.heads.append(tag in HEADINGS or out.heads[above])
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            stop = end.start() if end else size
            stack.append(number)
            text(at, stop)
            stack.pop()
            at = stop
        elif not ended or tag not in ("svg", "path"):
            stack.append(number)
            held[tag].append(len(stack) - 1)
    return out
def content_paths(page: Page, share: float = SHARE) -> dict[int, float]:
    """Fused weight of each path that passes ``share`` of the spread."""
    runs = [(page.paths[n], len(t) * (LINK if page.links[n] else 1.0), len(_PUNCT.findall(t))) for n, x, _ in page.runs if (t := x.strip())]
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for path, chars, marks in runs:
        s = sums[path]
        s[0] += chars
        s[1] += marks
        s[2] += 1
    if not runs:
        return {}
    ratios = {p: (chars / n, (marks + 0.1) / n) for p, (chars, marks, n) in sums.items()}
    smooth = {p: [0.0, 0.0] for p in ratios}
    for i, (path, _, _) in enumerate(runs):
        before, after = ratios[runs[max(0, i - 1)][0]], ratios[runs[min(len(runs) - 1, i + 1)][0]]
        for k in (0, 1):
            smooth[path][k] += (before[k] + 4 * ratios[path][k] + after[k]) / 6
    fused = {p: (a * b) ** 0.5 / sums[p][2] for p, (a, b) in smooth.items()}
    mean = sum(fused.values()) / len(fused)
    spread = (sum((x - mean) ** 2 for x in fused.values()) / len(fused)) ** 0.5
    return {p: f for p, f in fused.items() if f >= share * spread}


def _container(page: Page, content: list[tuple[int, float]]) -> tuple[list[bool], list[bool], bool]:
    """For content runs (element, weight): which elements the container holds, which of them keep weak blocks, whether links are among these."""
    total = sum(w for _, w in content)
    for kind in (page.articles, page.mains):
        if sum(w for n, w in content if kind[n]) >= MOST * total:
            held = [bool(x) for x in kind]
            return held, held, True
    below = [0] * len(page.tags)
    for n, _ in content:
        below[n] += 1
    for n in range(len(below) - 1, 0, -1):
        below[page.parents[n]] += below[n]
    top = max(n for n, k in enumerate(below) if k == len(content))
    while top and page.tags[top] not in BLOCK - NOT_AROUND:
        top = page.parents[top]
    tight = page.tags[top] not in ROOTS
    inside, keeps = [False] * len(below), [False] * len(below)
    inside[top] = keeps[top] = True
    for n in range(top + 1, len(below)):
        inside[n] = inside[page.parents[n]]
        keeps[n] = keeps[page.parents[n]] and (tight or page.tags[n] not in MODULES)
    # Headings straight in an element around the container belong to it, or else the last h1 before it that stands beside it.
    around, n = set(), page.parents[top]
    while n >= 0:
        around.add(n)
        n = page.parents[n]
    titles = {n for n in range(1, top) if page.tags[n] in HEADINGS and page.parents[n] in around}
    if not titles and top:
        beside = [False] * top
        beside[page.parents[top]] = True
        for n in range(page.parents[top] + 1, top):
            beside[n] = beside[page.parents[n]]
        said = {n for n, text, _ in page.runs if n < top and text.strip()}
        titles = set([n for n in range(1, top) if page.tags[n] == "h1" and beside[n] and n in said][-1:])
    for n in range(1, top):
        inside[n] = inside[n] or n in titles or inside[page.parents[n]]
    return inside, keeps, False


def main_text(page: str, share: float = SHARE) -> str:
    tree = parse(page)
    chosen = content_paths(tree, share)
    content = [(n, chosen[tree.paths[n]]) for n, text, _ in tree.runs if tree.paths[n] in chosen and text.strip()]
    if not content:
        return ""
    inside, keeps, links = _container(tree, content)
    blocks: dict[int, list[tuple[int, str]]] = {}
    for n, text, block in tree.runs:
        if inside[n]:
            blocks.setdefault(block, []).append((n, text))
    said = {block: [n for n, t in runs if t.strip()] for block, runs in blocks.items()}
    strong = [block for block, own in said.items() if any(tree.paths[n] in chosen for n in own)]

    def stays(block: int, own: list[int]) -> bool:
        if not own or any(tree.paths[n] in chosen or tree.heads[n] for n in own):
            return True
        if not links and all(tree.links[n] for n in own):
            return False
        return all(keeps[n] for n in own) or strong[0] < block < strong[-1]

    joined = (" ".join("".join(t for _, t in runs).split()) for block, runs in blocks.items() if stays(block, said[block]))
    return " ".join(b for b in joined if b)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py() or "") for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return chosen.mapInArrow(run, "page_id long, url string, text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
