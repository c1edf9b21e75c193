"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree.  An element is known by its
path of tags and classes, and text that stands beside child elements is a leaf
of its own.  Each path counts how often every layout (sequence of children) and
every content (text below it) occurs, over distinct pages.  Its importance is

    (entropy * evidence) ** (1 - mass)

- entropy: the spread of its contents and layouts, 1 where all differ and 0
  where all are alike, drawn towards 1 while it was seen a few times only;
- evidence: less than 1 where its tag, class, id or role speak of something else
  than an article (navigation, adverts, comments, ...), and where it stands
  beside the article or main element of its pages;
- mass: its share of all text of the host, likewise drawn towards 0.  A path
  that holds nearly all text is content, whatever it looks like.

Branches of importance under LOW are removed from each page; what remains is the
text.  Only what is never shown (scripts, styles, form controls, hidden
elements, ...) is left out without asking the tree.  A page that would lose all
text keeps that which no evidence speaks against.

Each page is parsed once; texts and coded elements are written to the shared
folder, counted by Spark (summed in each task before the shuffle, so a host with
a third of all pages is spread) and cut in a second pass over the written rows.

Cases: null or empty html gives the empty text; broken markup is closed where
HTML does so; repeated rows are counted once and extracted alike; a null url
belongs to the empty host; pages of any size and depth are parsed whole in one
pass; an empty table gives no rows; columns other than page_id, url and html are
dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.session import materialize, table

#: Production parameters.  Paths of less importance are removed.
LOW = 0.5
#: Share of content in an inner element's entropy; the rest is its layout's.  A leaf has content only.
CONTENT_SHARE = 0.9
#: Entropy and mass count in full only beyond so many occurrences.
DOUBT = 8
#: Factors for what an element says of itself, and for standing beside article or main.
LABELLED = 0.3
OUTSIDE = 0.4
#: Up to so many low paths are broadcast (under 10 MB).
BROADCAST_PATHS = 100_000
#: A host with more than this share of all pages is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.0005

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Start tag -> (open elements that it ends, elements that hide them).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
#: Elements whose text is never shown, or is a control's.
UNSEEN = frozenset("audio button canvas datalist head iframe input map noembed noframes noscript object option script select style svg template textarea title video xmp".split())
#: Elements that are seldom part of an article, and words of a class, id or role that say so.
DROP_TAGS = frozenset("aside dialog fieldset footer form label menu nav".split())
DROP_WORDS = frozenset("ad ads adsense advert advertisement advertorial adverts alert aside banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo complementary cookie cookies copyright dialog discussion disqus footer form gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?(?P<loose>[a-zA-Z])[^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


SEEN_LABELLED, SEEN_OUTSIDE, SEEN_LEAF = 1, 2, 4
_MASK = (1 << 63) - 1


class Element:
    __slots__ = ("tag", "at", "code", "labelled", "unseen", "main", "children", "inner", "content", "size", "texts")

    def __init__(self, tag: str, at: int, code: int, labelled: bool, unseen: bool, main: bool):
        self.tag, self.at, self.code, self.labelled, self.unseen, self.main = tag, at, code, labelled, unseen, main
        self.children = self.content = self.size = 0
        self.inner = False
        self.texts: list[int] = []


class Page:
    """Texts of a page's blocks and the elements they stand in, as parallel lists.

    ``leaf``: the innermost element of each text.  Elements have their parent (-1
    at the top), the code of their path, the codes of their layout and content,
    the characters below them and flags.
    """

    __slots__ = ("texts", "leaf", "parent", "code", "layout", "content", "size", "flags")

    def __init__(self):
        for name in self.__slots__:
            setattr(self, name, [])

    def add(self, parent: int, code: int, flags: int) -> int:
        self.parent.append(parent)
        self.code.append(code)
        self.layout.append(0)
        self.content.append(0)
        self.size.append(0)
        self.flags.append(flags)
        return len(self.code) - 1


def _mix(a: int, b: int) -> int:
    return ((a ^ (a >> 31)) * 0x9E3779B97F4A7C15 + b + 1) & _MASK


def _kind(tag: str, attrs: str, in_main: bool) -> tuple[str, bool, bool]:
    """Label of an element in the style tree, whether it says that it is no article, and whether it isn't shown."""
    labelled, unseen = tag in DROP_TAGS or (tag == "header" and not in_main), tag in UNSEEN
    if not attrs or attrs.isspace():
        return tag, labelled, unseen
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"
    words = {w.lower() for w in _WORDS.findall(names)}
    if tag not in ("html", "body", "main"):
        labelled |= not words.isdisjoint(DROP_WORDS) or ("header" in words and not in_main)
    unseen |= "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    style = ".".join(re.sub(r"\d+", "#", c) for c in sorted(found.get("class", "").split()))
    return (f"{tag}.{style}" if style else tag), labelled, unseen


def parse(html: str | None) -> Page:
    """Texts and elements of a page, in one pass."""
    page = Page()
    stack = [Element("", page.add(-1, 0, 0), 0, False, False, False)]
    parts: list[str] = []
    within: list[bool] = [False]  # by element: whether it is an article or main, or inside one
    around: set[int] = set()  # elements around those

    def block() -> Element:
        """The innermost element that is no inline one."""
        for e in reversed(stack):
            if e.tag not in INLINE:
                return e
        return stack[0]

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                e = block()
                e.texts.append(len(page.texts))
                e.children = _mix(e.children, 7)
                e.content = _mix(e.content, zlib.crc32(text.encode("utf-8", "surrogatepass")))
                e.size += len(text)
                page.texts.append(text)
                page.leaf.append(e.at)

    def leave(e: Element) -> None:
        """Write down an element that ends; texts beside child elements become leaves of their own."""
        page.layout[e.at], page.content[e.at], page.size[e.at] = e.children, e.content, e.size
        if not e.inner:
            page.flags[e.at] |= SEEN_LEAF
            page.layout[e.at] = 0
        else:
            code = _mix(e.code, 3)
            for i in e.texts:
                at = page.add(e.at, code, SEEN_LEAF)
                within.append(e.main)
                page.content[at], page.size[at] = zlib.crc32(page.texts[i].encode("utf-8", "surrogatepass")), len(page.texts[i])
                page.leaf[i] = at
        up = page.parent[e.at]
        if up >= 0:
            top = block()
            top.content, top.size = _mix(top.content, e.content), top.size + e.size

    def close(n: int) -> None:
        """Leave the n innermost elements."""
        if n and any(e.tag not in INLINE for e in stack[-n:]):
            flush()
        for _ in range(n):
            e = stack.pop()
            if e.tag not in INLINE:
                leave(e)

    def say(text: str) -> None:
        if text and not stack[-1].unseen:
            parts.append(entities.unescape(text) if "&" in text else text)

    html, at = html or "", 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            say(m["cdata"])
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            for depth in range(1, len(stack)):
                if stack[-depth].tag == tag:
                    close(depth)
                    break
                if tag in INLINE and stack[-depth].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P or tag in ENDS:
            ended, hidden = ENDS.get(tag, ({"p"}, set()))
            if tag in CLOSES_P:
                ended = ended | {"p"}
            deepest = 0
            for depth in range(1, len(stack)):
                t = stack[-depth].tag
                if t in ended:
                    deepest = depth
                elif t in hidden or (t not in INLINE and t not in ended):
                    break
            if deepest:
                close(deepest)
        top = stack[-1]
        if tag not in INLINE:
            flush()
        label, labelled, unseen = _kind(tag, m["attrs"], top.main)
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if tag in INLINE:
            # No element of the tree; what it says of itself holds for elements inside.
            e = Element(tag, top.at, top.code, top.labelled or labelled, top.unseen or unseen, top.main)
        else:
            under = block()
            code = _mix(under.code, zlib.crc32(label.encode("utf-8", "surrogatepass")))
            under.children, under.inner = _mix(under.children, code), True
            main = top.main or (tag in ("article", "main") and not (top.labelled or labelled))
            e = Element(tag, page.add(under.at, code, SEEN_LABELLED * (labelled or (top.labelled and top.tag in INLINE))), code, top.labelled or labelled, top.unseen or unseen, main)
            within.append(main)
            if main and not top.main:
                up = under.at
                while up >= 0 and up not in around:
                    around.add(up)
                    up = page.parent[up]
        stack.append(e)
        if tag in _RAW_END:
            found = _RAW_END[tag].search(html, at)
            at = found.end() if found else len(html)
            close(1)
    close(len(stack) - 1)
    flush()
    leave(stack[0])
    if around:
        for i, main in enumerate(within):
            if not main and i not in around:
                page.flags[i] |= SEEN_OUTSIDE
    return page


def cut(texts: list[str], leaf: list[int], parent: list[int], code: list[int], flags: list[int], low: frozenset[int]) -> str:
    """The main text of a page; ``low`` has the codes of its host's paths of low importance."""

    def kept(gone: list[bool]) -> list[str]:
        for i, up in enumerate(parent):
            if up >= 0 and gone[up]:
                gone[i] = True
        return [t for t, i in zip(texts, leaf, strict=True) if not gone[i]]

    out = kept([c in low for c in code])
    if texts and not out:
        out = kept([bool(f & (SEEN_LABELLED | SEEN_OUTSIDE)) for f in flags]) or kept([bool(f & SEEN_LABELLED) for f in flags])
    return "\n".join(out)


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.withColumn("host", host)


_LISTS = (("texts", pa.string(), "string"), ("leaf", pa.int32(), "int"), ("parent", pa.int32(), "int"), ("code", pa.int64(), "bigint"), ("layout", pa.int64(), "bigint"), ("content", pa.int64(), "bigint"), ("size", pa.int32(), "int"), ("flags", pa.int8(), "tinyint"))
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("digest", pa.binary()), *((n, pa.list_(t)) for n, t, _ in _LISTS)])
PARSED = "page_id long, url string, host string, digest binary, " + ", ".join(f"{n} array<{t}>" for n, _, t in _LISTS)


def parse_pages(pages: DataFrame) -> DataFrame:
    """A row for each of ``pages(page_id, url, html)``: its texts and elements, host, and a digest of its html."""

    def rows(held: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in held], _PARSED.field(i).type) for i in range(4)]
        columns += [pa.array([getattr(r[4], n) for r in held], pa.list_(t)) for n, t, _ in _LISTS]
        return pa.RecordBatch.from_arrays(columns, schema=_PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for key, url, host, html in zip(*(batch.column(i) for i in range(4)), strict=True):
                html = html.as_py() or ""
                held.append((key.as_py(), url.as_py(), host.as_py(), hashlib.md5(html.encode("utf-8", "surrogatepass")).digest(), parse(html)))
                size += len(html)
                if size > 4 << 20:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    rows_of = _with_host(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")).select("page_id", "url", "host", "html")
    return rows_of.mapInArrow(run, PARSED)


def style_tree(parsed: DataFrame) -> DataFrame:
    """``(host, code, n, importance)`` of every path of every host of ``parse_pages``' rows.  Copies of a page count once."""
    copies = parsed.groupBy("host", "digest").agg(F.count("*").alias("copies"), F.min("page_id").alias("first")).filter("copies > 1").drop("copies")
    copies = materialize(copies, "style-copies")
    if copies.count() <= BROADCAST_PATHS:
        copies = F.broadcast(copies)
    distinct = parsed.join(copies, ["host", "digest"], "left").filter("first IS NULL OR first = page_id")
    element = F.explode(F.arrays_zip("code", "layout", "content", "size", "flags")).alias("e")
    rows = distinct.select("host", element).select("host", "e.*")
    views = F.explode(F.array(F.struct(F.lit(True).alias("look"), F.col("layout").alias("feature")), F.struct(F.lit(False).alias("look"), F.col("content").alias("feature")))).alias("v")
    flag = lambda bit: F.sum((F.col("flags").bitwiseAND(F.lit(bit).cast("tinyint")) > 0).cast("bigint"))
    counts = rows.select("host", "code", "size", "flags", views).groupBy("host", "code", "v").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), flag(SEEN_LABELLED).alias("labelled"), flag(SEEN_OUTSIDE).alias("outside"), flag(SEEN_LEAF).alias("leaf")
    )
    # Entropy from two sums: ln N - sum(n ln n) / N, as a share of its largest value ln N.
    n, look = F.col("n"), F.col("v.look")
    sums = counts.groupBy("host", "code").agg(
        *[F.sum(F.when(look, F.col(c))).alias(c) for c in ("n", "size", "labelled", "outside", "leaf")],
        *[F.sum(F.when(look == F.lit(x), n * F.ln(n.cast("double")))).alias(f"log_{name}") for x, name in ((True, "layout"), (False, "content"))],
    )
    top = F.ln(n.cast("double"))
    spread = {x: F.when(n > 1, (top - F.col(f"log_{x}") / n) / top).otherwise(F.lit(1.0)) for x in ("layout", "content")}
    entropy = F.when(2 * F.col("leaf") > n, spread["content"]).otherwise(CONTENT_SHARE * spread["content"] + (1 - CONTENT_SHARE) * spread["layout"])
    entropy = (n * entropy + DOUBT) / (n + DOUBT)
    evidence = F.when(2 * F.col("labelled") > n, F.lit(LABELLED)).otherwise(F.lit(1.0)) * F.when(2 * F.col("outside") > n, F.lit(OUTSIDE)).otherwise(F.lit(1.0))
    # The root's path has code 0 and holds all text of its host.
    whole = sums.filter("code = 0").select("host", F.col("size").alias("whole"))
    mass = F.when(F.col("whole") > 0, F.col("size") / F.col("whole")).otherwise(F.lit(0.0)) * n / (n + DOUBT)
    return sums.join(whole, "host").select("host", "code", "n", F.pow(F.greatest(entropy * evidence, F.lit(0.01)), 1 - mass).alias("importance"))


def extract_pages(pages: DataFrame, low: float = LOW) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``."""
    parsed = materialize(parse_pages(pages), "style-pages")
    tree = style_tree(parsed).filter((F.col("importance") < low) & (F.col("code") != 0))
    paths = materialize(tree.groupBy("host").agg(F.collect_set("code").alias("low")), "style-tree")
    rows = parsed.select("page_id", "url", "host", "texts", "leaf", "parent", "code", "flags")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            hosts, lows = b.column(2).to_pylist(), b.column(8)
            out = []
            for i, host in enumerate(hosts):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = frozenset(lows[i].as_py() or ())
                out.append(cut(*(b.column(c)[i].as_py() for c in range(3, 8)), known[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = "page_id long, url string, text string, n_chars long"
    if (paths.agg(F.sum(F.size("low"))).first()[0] or 0) <= BROADCAST_PATHS:
        return rows.join(F.broadcast(paths), "host", "left").select(*rows.columns, "low").mapInArrow(run, schema)
    # Too many paths for one broadcast: those of hot hosts, which are few, are broadcast, so no host's pages meet in one task.
    counts = materialize(rows.groupBy("host").agg(F.count("*").alias("pages")), "style-hosts")
    total = counts.agg(F.sum("pages")).first()[0]
    hot = counts.filter(F.col("pages") > HOT_SHARE * total).select("host")
    parts = []
    for of_hot, how in ((True, "left_semi"), (False, "left_anti")):
        mine, own = rows.join(F.broadcast(hot), "host", how), paths.join(F.broadcast(hot), "host", how)
        parts.append(mine.join(F.broadcast(own) if of_hot else own, "host", "left").select(*rows.columns, "low"))
    return parts[0].unionByName(parts[1]).mapInArrow(run, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
ORACLE_SQL: dict[str, str] = {}
