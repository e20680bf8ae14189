"""HTML extraction by consensus host paths.

First pass: the containers of each page are scored by the text below them, less for depth and link words, and each
votes for its generalised path (tags and classes from the root, digits left out) with its share of the page's score.
The votes of a host are summed in Spark. Second pass: each page is extracted anew from the containers on the best
path of its host that it has; a page that has none of them falls back on its own best container. Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out inside containers as well; a heading inside an
article's or main element's own header stays. A page without a body element is its own container.

What is left out is told by elements and roles, and by words of classes and ids. A name made up of such words alone ("comments",
"share-buttons") tells it for certain, unless the element is an article and has a content name as well. A name with further words
("social-issues", "editorial-comment"), or one of words that name parts of articles too ("discussion"), is doubtful: its element stays
if it holds more than half of the page's text, lies on a winning path of the host, or is prose inside an article or main element. Names
that speak of what an element has beside it ("with-comments", "comment-status-open") tell nothing, and inline elements are part of
their sentence whatever their names.

Hosts' winning paths are broadcast only where they are counted to be at most BROADCAST_HOSTS rows of bounded size;
beyond that, pages are joined with them by host and salt, so that a host with a third of all pages is dealt over SALTS tasks.

Defined results: null or empty html, and pages with nothing but the parts left out, give the empty text; a null url
is a host of its own; broken markup (unclosed or crossing tags, cut pages) is read like browsers do, roughly; equal
rows give equal results; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, table, texts, written

#: Paths kept for each host, and when they are broadcast.
PATHS = 3
BROADCAST_HOSTS = 10_000
SALTS = 16
#: Code points of a block from which it reads like prose, if it isn't mostly links.
PROSE = 40
#: A container's score falls by this for each level between it and a block.
DECAY = 0.85

#: Fixed values of HTML: elements without content, with raw text, that make blocks, that hold text containers.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div body td blockquote #root".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes, up to the given limits.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr",), "tbody": ("tr", "thead"), "tfoot": ("tr", "tbody")}
LIMITS = frozenset("html body article main section div td th ul ol table aside nav header footer form".split())
#: Elements, roles and words of classes or ids that mark what isn't the article; weak ones don't, beside a content word.
DROPPED = frozenset("nav footer aside form button select svg canvas object menu dialog script style head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
STRONG = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promos promotion comment comments commentlist commenters reply replies respond disqus discussion cookie cookies consent gdpr newsletter subscribe subscription signup login share sharing shares social related recommended recommendations popup modal overlay breadcrumb breadcrumbs pagination pager".split())
WEAK = frozenset("nav navbar navigation menu header masthead footer sidebar aside widget widgets notice notices notification alert banner toolbar rail skip topbar bottombar copyright".split())
READERS = frozenset("comment comments commentlist commenters reply replies respond disqus".split())
#: Words of the strong ones that name a part of an article as often: they never tell anything for certain.
EITHER = frozenset("discussion".split())
BESIDE = frozenset("with has no without layout columns status open closed enabled disabled".split())
NEUTRAL = frozenset("area areas list lists section sections box boxes wrapper wrap container block blocks body content text item items bar bars inner outer module unit units slot slots button buttons link links icon icons media count counter title heading holder panel group row col column post posts article articles story stories news site page global left right top bottom primary secondary main thread threads policy message cta form forms now here".split())
CONTENT = frozenset("content main article post entry story body text".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_OPEN_COMMENT = re.compile(r"()()()()()()<!--.*\Z", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: dropped if it is left out for certain, doubtful the nearest element (itself or around it) that may be."""

    __slots__ = ("tag", "path", "up", "dropped", "doubtful", "headings", "depth", "link", "score", "weight", "chars", "prose", "part")

    def __init__(self, tag: str, path: bytes, up: Node | None, dropped: bool, headings: bool, link: bool, weight: float):
        self.tag, self.path, self.up, self.dropped, self.headings, self.link, self.weight = tag, path, up, dropped, headings, link, weight
        self.depth = up.depth + 1 if up else 0
        self.doubtful = up.doubtful if up else None
        self.score = 0.0
        self.chars = 0
        #: Code points of text that reads like prose; whether a doubtful element lies inside the article and may be a part of it.
        self.prose = 0
        self.part = False


def _told(names: list[str]) -> tuple[str, bool, bool]:
    """What an element's names tell: (certain, doubtful, "part" for doubtful that may be a part of an article, or nothing; is there a
    content name; is it a header or footer of content)."""
    told, content, header = "", False, False
    weak, strong = [], []
    for name in names:
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & STRONG:
            if not words & BESIDE:
                strong.append(words)
        elif words & WEAK:
            weak.append(words)
            content |= bool(words & CONTENT)
            header |= not words.isdisjoint(("header", "footer"))
        elif words & CONTENT:
            content = True
    pure = any(not words & EITHER and all(w in STRONG or w in WEAK or w in NEUTRAL or w.isdigit() for w in words) for words in strong)
    if strong:
        told = "certain" if pure and not content else "part"
    elif weak and not content and not any(words & BESIDE for words in weak):
        told = "certain" if any(all(w in WEAK or w in NEUTRAL or w.isdigit() for w in words) for words in weak) else "doubtful"
    return told, content, header and not told


def _node(tag: str, attrs: str, up: Node | None) -> Node:
    dropped = up.dropped if up else False
    headings = up.headings if up else False
    doubtful = False
    label, weight = tag, 1.4 if tag in ("article", "main") else 1.0
    if attrs and not attrs.isspace():
        found = {k.lower(): entities.unescape(v.strip("\"'")) if v else "" for k, v in _ATTR.findall(attrs)}
        role = found.get("role", "").lower()
        whole = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articleBody"
        names = found.get("class", "").split()
        if names:
            label = ".".join([tag, *sorted({_DIGITS.sub("", x.lower()) for x in names})])
        if found.get("id"):
            names.append(found["id"])
        if names and tag not in ("html", "body", "main"):
            told, content, header = _told(names)
            if whole and (content or told in ("doubtful", "part")) or tag not in BLOCK:
                told = ""  # an inline element is part of its sentence, whatever its names
            if told == "certain":
                dropped = True
            elif told:
                doubtful = True
            headings |= header and not whole
            if content and not told:
                weight *= 1.2
        if tag not in ("html", "body"):
            if role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "style" in found and _HIDDEN.search(found["style"]):
                dropped = True
            if role in ("main", "article") or found.get("itemprop") == "articleBody":
                weight *= 1.4
    if tag in DROPPED:
        dropped = True
    elif tag == "header":
        at, inside = up, False
        while at and not inside:
            inside, at = at.tag in ("article", "main"), at.up
        if inside:
            headings = True
        else:
            dropped = True
    # A path is the digest of the labels from the root, so that paths of any depth and width differ and take fixed space.
    path = hashlib.blake2b((up.path if up else b"") + b">" + label.encode("utf-8", "replace"), digest_size=12).digest()
    node = Node(tag, path, up, dropped, headings, bool(up and up.link) or tag == "a", weight)
    if doubtful:
        node.doubtful = node
        at = up if told == "part" else None
        while at and not node.part:
            node.part, at = at.tag in ("article", "main"), at.up
    return node


def blocks(source: str, paths: list[bytes] | None = None) -> tuple[list[tuple[str, Node, int]], list[Node]]:
    """(text, innermost container, link chars) of each block that isn't left out, in page order; all containers. Doubtful
    elements stay where they hold most of the text or a container on one of the paths lies in them, or around them; inside an article
    or main element also where their names have an article's meaning as well and most of their text is prose."""
    found, containers = read_blocks(source)
    if not any(node.doubtful for _, node, _ in found):
        return found, containers
    total = 0
    for text, node, linked in found:
        total += len(text)
        at = node.doubtful
        while at:
            at.chars += len(text)
            at.prose += len(text) if len(text) >= PROSE and 4 * linked < len(text) else 0
            at = at.up.doubtful
    kept = set()
    won = set(paths or [])
    for x in containers if won else []:
        if x.path in won:
            at = x
            while at:
                kept.add(id(at))
                at = at.up

    def stays(node: Node) -> bool:
        at = node.doubtful
        while at:
            if 2 * at.chars <= total and id(at) not in kept and not (at.part and 2 * at.prose > at.chars):
                return False
            at = at.up.doubtful
        return True

    return [x for x in found if stays(x[1])], [x for x in containers if stays(x)]


def read_blocks(source: str) -> tuple[list[tuple[str, Node, int]], list[Node]]:
    """blocks() with those of doubtful elements."""
    root = Node("#root", b"", None, False, False, False, 1.0)
    root.path = hashlib.blake2b(b"#root", digest_size=12).digest()
    stack, containers, out = [root], [], []
    over: list[str] = []
    # How many elements of a tag are open, and open beyond the limit of nesting: what closes nothing isn't looked for.
    opened: dict[str, int] = defaultdict(int)
    beyond: dict[str, int] = defaultdict(int)
    pieces: list[str] = []
    linked = 0
    at, n = 0, len(source)

    def cut(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                node = inner = stack[-1]
                while node.tag not in CONTAINER and node.up and node.up.doubtful is inner.doubtful:
                    node = node.up
                out.append((text, node, linked))
            pieces.clear()
        linked = 0

    def say(a: int, b: int) -> None:
        nonlocal linked
        node = stack[-1]
        if b > a and not node.dropped:
            if node.headings and not any(x.tag in HEADING for x in stack):
                return
            text = source[a:b]
            if "&" in text:
                text = entities.unescape(text)
            pieces.append(text)
            if node.link:
                linked += len(text.strip())

    end = source.rfind(">") + 1  # no tag ends behind: else each unclosed one would be read to the end of the page
    while m := _TOKEN.search(source, at, end) or _OPEN_COMMENT.search(source, at):
        say(at, m.start())
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            at = n
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag in BLOCK:
                flush()
            if beyond[tag]:
                while beyond[tag]:
                    last = over.pop()
                    beyond[last] -= 1
                    if last == tag:
                        break
                continue
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    cut(k)
                    break
                if stack[k].tag in LIMITS and tag not in LIMITS:
                    break
            continue
        if tag in RAW:
            closing = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = closing.end() if closing else n
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br" and not stack[-1].dropped:
                pieces.append(" ")
            continue
        if tag in BLOCK:
            flush()
            gone = CLOSES.get(tag, ()) if tag in CLOSES else ("p",)
            for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in gone) else ():
                if stack[k].tag in gone:
                    cut(k)
                    break
                if stack[k].tag in LIMITS and stack[k].tag not in gone:
                    break
        if tag in VOID or attrs.endswith("/") and tag in ("img", "input"):
            continue
        if len(stack) > 512:  # deeper nesting than browsers keep: the text belongs to the node above
            over.append(tag)
            beyond[tag] += 1
            continue
        node = _node(tag, attrs, stack[-1])
        stack.append(node)
        opened[tag] += 1
        if tag in CONTAINER and not node.dropped:
            containers.append(node)
    if at < n:
        say(at, n)
    flush()
    # Blocks outside every container, as on a page without a body element, have the page itself for one.
    if any(node is root for _, node, _ in out):
        containers.insert(0, root)
    return out, containers


def scored(found: list[tuple[str, Node, int]], containers: list[Node]) -> list[Node]:
    """The containers by falling score."""
    for text, node, linked in found:
        worth, far, at = max(0.0, len(text) - 1.5 * linked), 0, node
        while at:
            if at.tag in CONTAINER:
                at.score += worth * DECAY**far
                far += 1
            at = at.up
    for node in containers:
        node.score *= node.weight
    return sorted((x for x in containers if x.score > 0), key=lambda x: (-x.score, -x.depth))


def whole_of(best: Node) -> Node:
    """The article or main element around a container, which also holds its heading."""
    at = best.up
    while at:
        if at.tag in ("article", "main"):
            return at
        at = at.up
    return best


def joined(found: list[tuple[str, Node, int]], chosen: set[int]) -> str:
    out = []
    for text, node, _ in found:
        at: Node | None = node
        while at:
            if id(at) in chosen:
                out.append(text)
                break
            at = at.up
    return "\n\n".join(out)


def votes_of(source: str) -> list[tuple[bytes, float]]:
    """(path, share of the page's score) of each scored container; the best one has a whole vote more."""
    found, containers = blocks(source)
    ranked = scored(found, containers)
    total = sum(x.score for x in ranked)
    out: dict[bytes, float] = {}
    for k, x in enumerate(ranked):
        path = whole_of(x).path if k == 0 else x.path
        out[path] = out.get(path, 0.0) + x.score / total + (k == 0)
    return list(out.items())


def extracted(source: str, paths: list[bytes] | None = None) -> str:
    """Text of the containers on the first of the paths that the page has, or of its own best container."""
    found, containers = blocks(source, paths)
    if not found:
        return ""
    for path in paths or []:
        on = {id(x) for x in containers if x.path == path}
        if on and (text := joined(found, on)):
            return text
    ranked = scored(found, containers)
    if not ranked:
        return "\n\n".join(t for t, _, _ in found)
    return joined(found, {id(whole_of(ranked[0]))})


def host_of(url: Column) -> Column:
    """Host of an address, lower case, without user and port; null stays null."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the PATHS best generalised container paths of each host, best first."""

    def make():
        kind = pa.list_(pa.struct([("path", pa.binary()), ("share", pa.float64())]))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            votes = [[{"path": p, "share": s} for p, s in votes_of(t)] for t in texts(batch, 1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, kind)], ["host", "votes"])

        return work

    votes = map_batches(pages.select(host_of(F.col("url")).alias("host"), "html"), make, "host string, votes array<struct<path:binary,share:double>>")
    sums = votes.select("host", F.explode("votes").alias("v")).groupBy("host", F.col("v.path").alias("path")).agg(F.sum(F.round("v.share", 6).cast("decimal(18,6)")).alias("votes"))
    rank = F.row_number().over(W.partitionBy("host").orderBy(F.col("votes").desc(), "path"))
    best = sums.withColumn("rank", rank).where(F.col("rank") <= PATHS)
    return best.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    winners = written(host_paths(pages), "host-paths")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if winners.count() <= BROADCAST_HOSTS:
        named = winners.withColumnRenamed("host", "h")
        both = rows.join(F.broadcast(named), F.col("host").eqNullSafe(F.col("h")), "left")
    else:
        salted = winners.withColumnRenamed("host", "h").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, F.col("host").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("s")), "left")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [extracted(t, p) for t, p in zip(texts(batch, 2), batch.column(3).to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return work

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(both.select("page_id", "url", "html", "paths"), make, f"page_id {kind}, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
