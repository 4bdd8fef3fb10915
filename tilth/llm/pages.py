"""Main text of web pages by a site style tree.

Every page becomes a list of blocks, each at a style node: the path of its block elements
with their classes and ids.  The pages of a host are merged: for every style node of the host
the entropy of what stands below it over the pages is taken, of its presentation (sequences
of child elements: the more kinds, the more important) and of its content (texts: the more a
text is spread over the host's pages, the less important).  Every text has an importance of
its own: the share of the host's pages without it at the node.

Both are mixed with a prior that weighs as much as ``SMOOTH`` pages, so that small hosts lean
on it and large ones on what was counted.  The prior of a text is 1.  Plain elements below the
page's article or main element are judged by their text alone.  The prior of a node is
``LEAST_IMPORTANCE`` for other blocks there, or anywhere on a page without such an element; and
nought for blocks that a class name marks as furniture or that stand outside the article, which
are kept only where node importance reaches ``SURE_IMPORTANCE``.  What is left in page order is
the text.  Not asked about are elements, roles and hidden parts that are furniture by
themselves, comments, and blocks both marked and outside, or marked or outside and mostly links.
Where a page has no article or main element, a mark on a branch with most of its text is void.

Pages are counted once for each distinct article, so that copies do not erase each other.
Counting is by (host, node, feature) with partial sums first, so a host may hold any share
of all pages.  Pages are parsed once and their blocks written to the shared folder.

Scripts and other raw elements end at their close tag or the page's end; svg, video, button and
the like hide what is in them if their end tag comes before that of their parent.

Defined results: null and empty pages have an empty text; unclosed and stray tags are read
as browsers do in the common cases; a null url is a host of its own without a tree; every
row gives one row; input columns named like added ones are replaced.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tilth.llm.base import in_tasks
from tilth.session import staged

#: Pages that the prior importance counts for.
SMOOTH = 8
#: Importance below which a branch is cut, that which outweighs a mark, and the part of content in it (the rest is presentation).
LEAST_IMPORTANCE = 0.3
SURE_IMPORTANCE = 0.7
CONTENT_PART = 0.9
#: Kinds of blocks, and of the features that are child elements.
RUNNING, OTHER, DOUBTED, SHOWN = range(4)

# fixed values: elements of HTML by their role in the layout
RAW = "title script style noscript textarea iframe"
MUTED = "template svg math object canvas select button datalist audio video"
BLOCKS = (
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre "
    "section summary table caption tbody td tfoot th thead tr ul"
)
VOID = "area base br col embed hr img input link meta param source track wbr"
FURNITURE = "nav footer aside form menu dialog header head title"
ROLES = "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar"
WORDS = (
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion "
    "sidebar sidenav aside menu submenu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar "
    "cookie cookies consent gdpr notice notices notification disclaimer popup modal overlay lightbox newsletter "
    "subscribe subscription signup signin login register search searchbox share sharing sharebar social related "
    "recommended recommendations comment comments commentlist disqus respond reply replies feedback widget widgets "
    "toolbar pagination pager copyright skip sitemap tracking teaser"
)
#: Of the words above, those of reader comments: never text of the article where a whole class name
#: says so, alone or with words of either list; in other names they are a prior like the rest.
NEVER_HOLD = "comment comments commentlist disqus respond reply replies"
BESIDE = "list section area block box container wrapper wrap form item body content inner thread post user reader id count header title"

_MUTED, _BLOCKS, _VOID, _FURNITURE = (frozenset(x.split()) for x in (MUTED, BLOCKS, VOID, FURNITURE))
_ROLES, _WORDS, _NEVER, _BESIDE = (frozenset(x.split()) for x in (ROLES, WORDS, NEVER_HOLD, BESIDE))
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?!iframe[^>]*/>)(" + "|".join(RAW.split()) + r")(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*|[^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_CLOSED_BY = {
    "li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}),
    "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"}),
}


def _never(names: str) -> bool:
    """Whether one of the class names or ids is about reader comments and nothing else."""
    for name in names.split():
        words = {w.lower() for w in _NAME.findall(name)}
        if words & _NEVER and words <= _WORDS | _BESIDE:
            return True
    return False


class _Node:
    __slots__ = ("tag", "above", "path", "furniture", "marked", "weak", "holds", "region", "plain", "children", "mute", "own", "link", "muted", "ended")

    def __init__(self, tag: str, above: "_Node | None", attributes: dict):
        self.tag, self.above = tag, above
        names = " ".join(attributes.get(x, "") for x in ("class", "id"))
        words = {w.lower() for w in _NAME.findall(names)} if names.strip() else set()
        never = bool(words & _NEVER) and _never(names)
        role = attributes.get("role", "").lower()
        style = "." + re.sub(r"\d+", "0", names) if names.strip() else ""
        hidden = "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        inside = above is not None and above.in_region()
        cue = tag in _FURNITURE and not (tag == "header" and inside) or role in _ROLES
        marked = words & _WORDS - ({"header"} if inside else set()) if tag not in ("html", "body", "main") else set()
        if tag == "article":
            marked &= _NEVER if never else set()
        self.furniture = bool(cue or marked & _NEVER and never or hidden)
        self.marked = bool(marked) and not self.furniture
        self.weak = not (tag in ("nav", "footer", "aside", "head", "title") or never or hidden)
        self.holds = False
        self.region = (tag == "article" and 2 or (tag == "main" or role == "main") and 1 or 0) if not self.furniture else 0
        self.plain = not style
        self.children: list[str] = []
        # text below an inline element that is furniture is not part of the block around it
        self.mute = tag not in _BLOCKS and (self.furniture or above.mute)
        # its text is left out once its own end tag has come; what ends with its parent hides nothing
        self.muted, self.ended = tag in _MUTED, False
        # a marked inline element is a style node, so that the tree can judge its text
        self.own = tag in _BLOCKS or self.marked or self.muted
        self.path = ((above.path if above else "") + ">" + tag + style) if self.own else above.path
        self.link = tag == "a" or above is not None and above.link

    def in_region(self) -> bool:
        node = self
        while node is not None:
            if node.region:
                return True
            node = node.above
        return False


def blocks_of(page: str) -> tuple[list, list]:
    """Blocks (path, text, kind, line, gap, whole) in page order, and nodes (path, child elements).

    Blocks of one ``line`` are parts of one block, with white space between them where their
    ``gap`` differs; parts without a mark are judged by the line's ``whole`` text.  Furniture is
    left out.
    """
    root = _Node("html", None, {})
    open_: list[_Node] = [root]
    texts: list[str] = []
    blocks: list = []
    nodes: list[_Node] = [root]
    line = gap = linked = 0

    def part() -> None:
        nonlocal gap, linked
        raw = html.unescape("".join(texts))
        texts.clear()
        text = " ".join(raw.split())
        gap += raw[:1].isspace()
        if text:
            node = open_[-1]
            while not node.own:
                node = node.above
            blocks.append((node, text, line, gap, 2 * linked > len(text)))
            gap += raw[-1:].isspace()
        linked = 0

    def flush() -> None:
        nonlocal line
        part()
        line += 1

    def close(upto: int) -> None:
        if any(n.tag in _BLOCKS for n in open_[upto:]):
            flush()
        elif any(n.own for n in open_[upto:]):
            part()
        del open_[upto:]

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at and not open_[-1].mute:
            texts.append(page[at : token.start()])
            linked += open_[-1].link * (token.start() - at)
        at = token.end()
        tag = token[3]
        if tag is None:
            continue
        tag = tag.lower()
        if token[2]:
            if tag in ("html", "body"):
                continue
            if tag == "br":
                texts.append(" ")
                continue
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    open_[i].ended = True
                    close(i)
                    break
                if open_[i].tag in ("table", "td", "th", "article", "main", "section") and tag not in _BLOCKS:
                    break
            continue
        if tag == "br":
            texts.append(" ")
            continue
        if tag in ("html",):
            continue
        if tag in _VOID:
            if tag in _BLOCKS:
                flush()
            continue
        if tag in _BLOCKS:
            if tag in _CLOSED_BY:
                ended, scope = _CLOSED_BY[tag]
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].tag in scope or open_[i].muted:
                        break
                    if open_[i].tag in ended.split():
                        close(i)
                        if tag != "tr":
                            break
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == "p":
                    close(i)
                    break
                if open_[i].tag in _BLOCKS or open_[i].muted:
                    break
            flush()
            if tag == "body" and any(n.tag == "head" for n in open_):
                close(next(i for i, n in enumerate(open_) if n.tag == "head"))
        body = token[4]
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(body)} if body and not body.isspace() else {}
        node = _Node(tag, open_[-1], found)
        if tag in _BLOCKS:
            above = open_[-1]
            while above.tag not in _BLOCKS:
                above = above.above
            above.children.append(tag)
            nodes.append(node)
        if node.region:
            for n in open_:
                n.holds = True
        if not body.rstrip().endswith("/") or tag in _BLOCKS:
            if node.own and tag not in _BLOCKS:
                part()
            open_.append(node)
    if at < len(page) and not open_[-1].mute:
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that the page's end cuts off
        texts.append(rest[: cut.start()] if cut else rest)
    flush()

    void: set[int] = set()
    state: dict[int, tuple] = {}

    def judged(node: _Node) -> tuple:
        """Whether the node is cut, the mark above it, its level, and whether its text runs right below the region."""
        if id(node) not in state:
            cut, mark, level, running = judged(node.above) if node.above is not None else (False, None, 0, False)
            kept = node.holds and node.weak
            cut = cut or node.furniture and not kept or node.muted and node.ended
            if mark is None and node.marked and not kept and id(node) not in void:
                mark = node
            if node.region:
                level, running = max(level, node.region), True
            elif node.own:
                running = running and node.plain
            state[id(node)] = cut, mark, level, running
        return state[id(node)]

    best = max((judged(b[0])[2] for b in blocks if not judged(b[0])[0] and judged(b[0])[1] is None), default=0)
    while not best:
        # of a page without article, a mark on the branch with most of the text says nothing
        held = [(judged(b[0])[1], len(b[1])) for b in blocks if not judged(b[0])[0]]
        sums: dict[int, int] = {}
        for mark, size in held:
            if mark is not None:
                sums[id(mark)] = sums.get(id(mark), 0) + size
        most = [x for x, size in sums.items() if 2 * size > sum(n for _, n in held)]
        if not most:
            break
        void.update(most)
        state.clear()
    lines: dict[int, list] = {}
    for node, text, line, *_ in blocks:
        if not judged(node)[0]:
            lines.setdefault(line, []).append(text)
    found = []
    for node, text, line, gap, links in blocks:
        cut, mark, level, running = judged(node)
        doubts = (mark is not None) + (level < best)
        if not (cut or doubts == 2 or doubts and links):
            found.append((node.path, text, DOUBTED if doubts else RUNNING if running else OTHER, line, gap,
                          " ".join(lines[line]) if len(lines[line]) > 1 and node.tag in _BLOCKS else None))
    return found, [(n.path, " ".join(n.children)) for n in nodes if n.children]


def parsed(pages: DataFrame, url: str, body: str, kept: list[str]) -> DataFrame:
    """Each page's host, its blocks, and the features of its nodes."""
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    rows = pages.select(*kept, host.alias("__host"), F.coalesce(F.col(body), F.lit("")).alias("__html"))
    block = pa.struct([("path", pa.string()), ("text", pa.string()), ("kind", pa.int32()), ("line", pa.int32()), ("gap", pa.int32()),
                       ("whole", pa.string())])
    node = pa.struct([("path", pa.string()), ("children", pa.string())])
    names = [f.name for f in block]
    one = T.StructType().add("path", "string").add("text", "string").add("kind", "integer").add("line", "integer")
    one = one.add("gap", "integer").add("whole", "string")
    nodes_type = T.ArrayType(T.StructType().add("path", "string").add("children", "string"))
    schema = pages.select(*kept).schema.add("__host", "string").add("__blocks", T.ArrayType(one)).add("__nodes", nodes_type)

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                blocks, nodes = [], []
                for page in some.column(some.num_columns - 1):
                    found, tree = blocks_of(page.as_py())
                    blocks.append([dict(zip(names, b)) for b in found])
                    nodes.append([{"path": p, "children": c} for p, c in tree])
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:-1], pa.array(blocks, pa.list_(block)), pa.array(nodes, pa.list_(node))],
                    [*kept, "__host", "__blocks", "__nodes"])

    return in_tasks(rows, work, schema)


def _mixed(value: Column, prior: float) -> Column:
    """An importance with its prior, by the host's pages."""
    return (value * F.col("pages") + SMOOTH * prior) / (F.col("pages") + SMOOTH)


def _feature(b: Column) -> Column:
    return F.xxhash64(F.coalesce(b["whole"], b["text"]))


def _entry(kind: Column, node: Column, feature: Column | None = None) -> Column:
    return F.xxhash64(kind, node, *([] if feature is None else [feature]))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, low, sure): of every host the nodes and texts of low importance, and the doubted nodes of sure importance.

    A feature counts once for each distinct article that has it at the node.
    """
    core = F.transform(F.filter("__blocks", lambda b: b["kind"] < DOUBTED), lambda b: b["text"])
    every = F.transform("__blocks", lambda b: b["text"])
    marked = pages.where("__host <> ''").select(
        F.col("__host").alias("host"), F.xxhash64(F.when(F.size(core) > 0, core).otherwise(every)).alias("page"), "__blocks", "__nodes")
    pair = ["host", "page"]
    sizes = marked.select(*pair).distinct().groupBy("host").agg(F.count("*").alias("pages"))
    content = marked.select(*pair, F.explode("__blocks").alias("b")).select(
        *pair, F.col("b.kind").alias("kind"), F.xxhash64("b.path").alias("node"), _feature(F.col("b")).alias("feature"))
    shown = marked.select(*pair, F.explode("__nodes").alias("b")).select(
        *pair, F.lit(SHOWN).alias("kind"), F.xxhash64("b.path").alias("node"), F.xxhash64("b.children").alias("feature"))
    once = content.unionByName(shown).distinct()
    counts = staged(once.groupBy("host", "kind", "node", "feature").agg(F.count("*").cast("double").alias("k")), "style-features")
    most = F.log(F.col("pages") + SMOOTH)

    each = counts.where(F.col("kind") != RUNNING).groupBy("host", "kind", "node").agg(
        F.sum("k").alias("all"), F.sum(F.col("k") * F.log("k")).alias("klogk")).join(sizes, "host")
    value = F.when(F.col("kind") != SHOWN, 1 - F.col("klogk") / F.col("all") / most).otherwise(
        F.least((F.log("all") - F.col("klogk") / F.col("all")) / most, F.lit(1.0)))
    tree = each.groupBy("host", "node", "pages").agg(*[F.max(F.when(F.col("kind") == k, value)).alias(f"v{k}") for k in (OTHER, DOUBTED, SHOWN)])

    def node_of(kind: int, prior: float) -> Column:
        own = F.col(f"v{kind}")
        return _mixed(CONTENT_PART * own + (1 - CONTENT_PART) * F.coalesce(F.col(f"v{SHOWN}"), own), prior)

    low_node = F.when(node_of(OTHER, LEAST_IMPORTANCE) < LEAST_IMPORTANCE, _entry(F.lit(OTHER), F.col("node")))
    sure_node = F.when(node_of(DOUBTED, 0.0) >= SURE_IMPORTANCE, _entry(F.lit(DOUBTED), F.col("node")))
    own = _mixed(1 - F.col("k") / F.col("pages"), 1.0)
    texts = counts.where((F.col("kind") != SHOWN) & (F.col("k") > 1)).join(sizes, "host").where(own < LEAST_IMPORTANCE)
    entries = tree.select("host", low_node.alias("low"), sure_node.alias("sure")).where("low IS NOT NULL OR sure IS NOT NULL").unionByName(
        texts.select("host", _entry(F.col("kind"), F.col("node"), F.col("feature")).alias("low"), F.lit(None).cast("long").alias("sure")))
    return entries.groupBy("host").agg(F.collect_set("low").alias("low"), F.collect_set("sure").alias("sure"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html",
              carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default all but the html) of every page with ``text`` and ``n_chars``."""
    kept = [c for c in (carry or [c for c in pages.columns if c != body]) if c not in ("text", "n_chars")]
    done = staged(parsed(pages, url, body, kept), "pages")
    tree = staged(style_tree(done).select(F.col("host").alias("__of"), F.col("low").alias("__low"), F.col("sure").alias("__sure")), "style-tree")
    entries = tree.agg(F.sum(F.size("__low") + F.size("__sure"))).first()[0] or 0
    side = F.broadcast(tree) if entries <= 100_000 else tree
    joined = done.join(side, F.col("__host") == F.col("__of"), "left")

    def stays(b: Column) -> Column:
        node = F.xxhash64(b["path"])
        low = F.array_contains("__low", _entry(b["kind"], node)) | F.array_contains("__low", _entry(b["kind"], node, _feature(b)))
        sure = (b["kind"] != DOUBTED) | F.array_contains("__sure", _entry(b["kind"], node))
        return F.when(F.col("__of").isNull(), b["kind"] != DOUBTED).otherwise(~low & sure)

    good = joined.withColumn("__good", F.filter("__blocks", stays))

    def led(b: Column, i: Column) -> Column:
        before = F.get("__good", i - 1)
        return F.when(i == 0, b["text"]).otherwise(F.concat(
            F.when(before["line"] != b["line"], F.lit("\n")).when(before["gap"] != b["gap"], F.lit(" ")).otherwise(F.lit("")), b["text"]))

    text = F.array_join(F.transform("__good", led), "")
    return good.select(*kept, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
