"""Main text of web pages: site templates are found as element subtrees that recur across the pages of a host, and removed."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, written

#: A subtree is a template of its host if it is on so many of the host's pages at least, and on this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.2
#: Inside an article a subtree must be in this share of the host's different articles: a mirrored or slightly edited article may fill a third of a host.
MIN_SHARE_INSIDE = 0.5
#: Up to so many templates of all hosts are broadcast, as eight bytes each; more are joined to the pages by a shuffle.
MAX_BROADCAST_TEMPLATES = 500_000

#: Fixed values of HTML: elements without an end tag, raw text, what ends an open paragraph, what makes a block of its own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object canvas audio video select".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - {"body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
#: An open element of the first kind ends where one of the second begins, unless one of the third stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
#: Elements that are never part of the main text.
NOT_TEXT = frozenset("head script style nav header footer aside form menu noscript template iframe object canvas svg math audio video button select input textarea dialog search noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note".split())
#: Words of class and id attributes that mark menus, adverts, notices, sidebars, forms and reader comments.
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|"
    r"notice|notices|pager|pagination|popup|promo|promoted|related|replies|respond|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|topbar|widget)(?:$|[\s_-])"
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


class Element:
    __slots__ = ("attributes", "children", "digest", "has_text", "name")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children, self.digest, self.has_text = name, attributes, [], 0, False


def parse(page: str) -> Element:
    """The tree of elements and strings of a page; missing and misplaced end tags are allowed, and so is a page that breaks off."""
    root = Element("")
    stack, is_open = [root], Counter()
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].children.append(page[at:])
            break
        if lt > at:
            stack[-1].children.append(page[at:lt])
        m = _TOKEN.match(page, lt)
        if m is None:
            stack[-1].children.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if is_open[name]:
                while (last := stack.pop().name) != name:
                    is_open[last] -= 1
                is_open[name] -= 1
            continue
        _close_implied(stack, name, is_open)
        element = Element(name, m[3].strip().rstrip("/").rstrip())
        stack[-1].children.append(element)
        if name in VOID:
            continue
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
            element.children.append(page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
        else:
            stack.append(element)
            is_open[name] += 1
    return root


def _close_implied(stack: list[Element], name: str, is_open: Counter) -> None:
    """Ends what the start of name ends. is_open counts the names in the stack, so that nothing is searched that isn't there."""
    ways = [({"p"}, BLOCKS)] if name in ENDS_P else []
    for ends, fences in [*ways, *([IMPLIED[name]] if name in IMPLIED else [])]:
        if any(is_open[x] for x in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ends:
                    is_open.subtract(x.name for x in stack[i:])
                    del stack[i:]
                    break
                if stack[i].name in fences:
                    break


def digest_tree(root: Element) -> None:
    """Sets every element's digest: of its name, attributes, strings with white space unified, and the digests of its children; and whether it has text."""
    order, todo = [], [root]
    while todo:
        element = todo.pop()
        order.append(element)
        todo += [x for x in element.children if type(x) is Element]
    for element in reversed(order):
        h = xxhash.xxh3_64(f"{element.name} {element.attributes}\x00".encode("utf-8", "surrogatepass"))
        for x in element.children:
            if type(x) is Element:
                h.update(x.digest.to_bytes(8, "little", signed=True))
                element.has_text |= x.has_text
            elif text := _SPACE.sub(" ", x).strip(" "):
                h.update(text.encode("utf-8", "surrogatepass"))
                h.update(b"\x00")
                element.has_text = True
        element.digest = h.intdigest() - (1 << 63)


def marked(element: Element) -> bool:
    """Whether its name, role, class or id says that it isn't main text."""
    if element.name in NOT_TEXT:
        return True
    if element.attributes:
        for m in _ATTRIBUTE.finditer(element.attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id") and _MARKS.search(value) or key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                return element.name not in ("html", "body", "main", "article")
    return False


def main_elements(root: Element) -> list[Element]:
    """The outermost article elements that stand in no marked element, or else the main elements; none if the page has neither."""
    found: dict[str, list[Element]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        x = todo.pop()
        for child in reversed(x.children):
            if type(child) is Element and not marked(child):
                todo.append(child)
        if x.name in found:
            found[x.name].append(x)
            if x.name == "article":
                inner = sum(type(c) is Element and not marked(c) for c in x.children)
                del todo[len(todo) - inner :]
    return found["article"] or [x for i, x in enumerate(found["main"]) if i == 0]


def template_candidates(root: Element) -> dict[int, int | None]:
    """The digests of the subtrees with text that could be templates. The value is None outside the main elements; inside, the digest of the main element.
    The main elements themselves and what holds them are content."""
    content = {id(x): x.digest for x in main_elements(root)}
    out: dict[int, int | None] = {}
    todo: list[tuple[Element, int | None]] = [(x, None) for x in root.children if type(x) is Element]
    while todo:
        x, article = todo.pop()
        if id(x) in content:
            article = content[id(x)]
        elif x.name not in ("html", "body", "head") and x.has_text:
            out[x.digest] = article
        todo += [(c, article) for c in x.children if type(c) is Element]
    return out


def text_of(root: Element, templates: set[int]) -> str:
    """Blocks of the main elements (or of the whole page if it has none) without templates and marked elements, joined by an empty line."""
    mains = main_elements(root)
    content = {id(x) for x in mains}
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line.clear()

    todo: list = list(reversed(mains)) or [root]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif type(x) is str:
            line.append(x)
        elif x.name == "br":
            line.append(" ")
        elif id(x) not in content and x is not root and (x.digest in templates or marked(x)):
            if x.name in BLOCKS:
                close()
        else:
            block = x.name in BLOCKS or x is root
            if block:
                close()
                todo.append(None)
            todo += reversed(x.children)
    close()
    return "\n\n".join(blocks)


def host_of(url):
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, ascii_lower(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0))).otherwise("")


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, digest, inside, article) for each possible template of each page; rows without a digest count the pages and, inside, the articles."""
    for batch in batches:
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            root = parse(page.as_py() or "")
            digest_tree(root)
            rows.append((host, None, False, None))
            rows += [(host, None, True, x.digest) for x in main_elements(root)]
            rows += [(host, digest, article is not None, article) for digest, article in template_candidates(root).items()]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.int64()))], names=["host", "digest", "inside", "article"])


def site_templates(pages: DataFrame, url: str = "url", markup: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_share_inside: float = MIN_SHARE_INSIDE) -> DataFrame:
    """(host, templates): the digests of the host's template subtrees.

    Outside articles the pages count that have a subtree, inside the different articles, so that an article which is mirrored counts once. Counts are
    pre-aggregated before the shuffle. A host has at most its pages' mean number of subtrees, divided by the share, of templates.
    """
    found = pages.select(host_of(F.col(url)).alias("host"), F.col(markup).alias("html")).mapInArrow(_subtrees, "host string, digest long, inside boolean, article long")
    counts = written(found.groupBy("host", "digest", "inside", "article").agg(F.count("*").alias("n")), "subtrees")
    counts = counts.groupBy("host", "digest", "inside").agg(F.when(F.col("inside"), F.count("*")).otherwise(F.sum("n")).alias("n"))
    sizes = counts.where("digest is null").select("host", "inside", F.col("n").alias("all"))
    share = F.when(F.col("inside"), min_share_inside).otherwise(min_share)
    often = counts.where(F.col("digest").isNotNull() & (F.col("n") >= min_pages)).join(sizes, ["host", "inside"]).where(F.col("n") >= share * F.col("all"))
    return often.groupBy("host").agg(F.collect_set("digest").alias("templates"))


def extract_text(pages: DataFrame, keep: list[str], url: str = "url", markup: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_share_inside: float = MIN_SHARE_INSIDE) -> DataFrame:
    """The columns keep of every row and text, the main text of the page (a column text among keep is replaced).

    Subtrees that recur on the host are removed, inside articles too, and so are menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles and reader comments by their tags, roles, classes and ids; of what is left, the article elements count, or else the main element, or else all.
    Character references are decoded, white space inside a block is one space, blocks are trimmed and joined by an empty line. Null and empty pages give
    ''; rows are neither dropped nor joined, and repeated rows are rows. Work and memory grow with the length of a page, however it is nested.
    """
    keep = [c for c in keep if c != "text"]
    templates = written(site_templates(pages, url, markup, min_pages, min_share, min_share_inside), "templates")
    total = templates.agg(F.coalesce(F.sum(F.size("templates")), F.lit(0))).first()[0]
    if total <= MAX_BROADCAST_TEMPLATES:
        templates = F.broadcast(templates)
    held = F.struct(*keep)
    rows = pages.select(held.alias("_row"), F.col(markup).alias("_html"), host_of(F.col(url)).alias("host")).join(templates, "host", "left").select("_row", "_html", "host", "templates")
    schema = T.StructType([rows.schema["_row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[int]] = {}  # of the last hosts
        for batch in batches:
            out = []
            for page, host, digests in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                if host not in known:
                    if len(known) == 64:
                        known.clear()
                    known[host] = set(digests.as_py() or [])
                root = parse(page.as_py() or "")
                digest_tree(root)
                out.append(text_of(root, known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_row", "text"])

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col("_row")[c].alias(c) for c in keep], "text")
