"""HTML extraction by wrapper induction: pages of a host are aligned as trees; what is the same on all of them is template, what differs is content."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterlake.llm.common import released, small, small_batches, table, written

#: Layouts of a host that its wrapper is merged from, the most common first, and nodes of a wrapper; slots beyond are known by their path from the nearest slot of the wrapper.
LAYOUTS, NODES = 8, 2000
#: A slot is template if so many of a host's different pages have it and this share of them with the same text.
LEAST_PAGES, CONSTANT = 4, 0.9
#: Share of a host's varying text from which on a slot's parent gives way to the slot as the root of the content.
MAIN_SHARE = 0.6
#: Levels of a tree, and slots below one node; what is deeper belongs to the last level, further siblings to an earlier one of their label.
DEPTH, WIDTH = 60, 200
#: Rows that a host's wrapper is copied to where there are too many hosts to send them all; pages of a hot host are dealt out over them.
SALT = 32

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table caption colgroup thead tbody tfoot tr td th figure figcaption details summary center address hgroup".split())
_VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object select canvas audio video datalist".split())
_LEFT_OUT = frozenset("nav footer aside form button menu dialog fieldset head".split())
#: What an opening tag ends: an open element of the first names, unless one of the second is nearer.
_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr")), "tbody": ("thead tbody tfoot tr td th", ("table",)), "tfoot": ("thead tbody tfoot tr td th", ("table",)), "thead": ("thead tbody tfoot tr td th caption", ("table",))}
#: Words of class names and ids, and roles, of parts that are not an article's text.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe subscription signup login paywall nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars widget widgets footer footers "
    "comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations toolbar masthead skip".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/[^a-zA-Z][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CARES = re.compile("class|id|role|hidden|style", re.I)
_NUMBER = re.compile(r"\d{3,}")
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Node:
    """A slot of a page's tree: neighbouring siblings of one label are one slot, as are adjacent paragraphs, headings, lists and tables, whose label is ''."""

    __slots__ = ("label", "kids", "parent", "left_out", "article", "depth", "at")

    def __init__(self, label: str, parent: Node | None, left_out: bool, article: bool):
        self.label, self.parent, self.left_out, self.article, self.kids = label, parent, left_out, article, []
        self.depth = 0 if parent is None else parent.depth + 1
        self.at = -1

    def child(self, label: str, left_out: bool, article: bool) -> Node:
        """The slot of a further child: the last one if it has this label."""
        if self.kids and self.kids[-1].label == label:
            return self.kids[-1]
        if self.depth >= DEPTH:
            return self
        if len(self.kids) >= WIDTH:
            for k in self.kids:
                if k.label == label:
                    return k
        self.kids.append(Node(label, self, left_out or self.left_out, article or self.article))
        return self.kids[-1]


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def named(tag: str, own: dict[str, str]) -> tuple[list[str], bool]:
    """An element's class names and id, without numbers of three digits and more; and whether the words in them, its role or its style say that it is no part of an article."""
    names = own.get("class", "") + " " + own.get("id", "")
    words = {w.lower() for w in _WORDS.findall(names)}
    hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
    return sorted(set(_NUMBER.sub("", names).split())), hidden or own.get("role", "").lower() in _ROLES or not _NAMES.isdisjoint(words)


def parsed(html: str) -> tuple[Node, list[tuple[Node, str, str]]]:
    """The tree of slots of a page, and its blocks of text in page order: (slot, tag, text), character references decoded, white space made one space.

    Elements without a closing tag end where their parent does or the next of their kind begins; closing tags without an element are
    passed over. Scripts, styles and other elements whose content isn't text are left out, and comments; inline elements are no slots.
    """
    root = Node("html", None, False, False)
    stack: list[tuple[str, Node, bool]] = [("html", root, False)]  # tag, slot, whether an inline element
    blocks: list[tuple[Node, str, str]] = []
    held: list[str] = []
    at, lower = 0, None

    search, inline = _TAG.search, _INLINE

    def flush() -> None:
        text = " ".join((entities.unescape("".join(held)) if len(held) > 1 or "&" in held[0] else held[0]).split()) if held else ""
        held.clear()
        if text:
            tag, slot, _ = stack[-1]
            blocks.append((slot if slot.label == "" else slot.child("", False, False), tag, text))

    def pop(to: int) -> None:
        if held:
            flush()
        del stack[to:]

    while True:
        m = search(html, at)
        if m is None:
            if at < len(html):
                held.append(html[at:])
            break
        begin, end = m.span()
        if begin > at:
            held.append(html[at:begin])
        at = end
        closing, tag, rest = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag == "br":
                flush()
            elif tag == "head":
                pop(1)
            elif tag not in ("html", "body") and (tag not in inline or any(s[2] for s in stack)):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        pop(i)
                        break
                    if tag in _INLINE and not stack[i][2]:
                        break
            continue
        marks = rest and _CARES.search(rest)
        if tag in inline and not marks:
            continue
        if tag in _RAW:
            lower = lower if lower is not None else html.lower()
            lower = lower if len(lower) == len(html) else html
            end = lower.find(f"</{tag}", at)
            at = len(html) if end < 0 else html.find(">", end) + 1 or len(html)
            if tag not in ("script", "style", "template", "noscript"):
                flush()
            continue
        if tag in _VOID:
            if tag not in ("wbr", "img", "input") and held:
                flush()
            continue
        if tag in ("html", "body"):
            flush()
            if tag == "body":
                while len(stack) > 1 and stack[-1][1].left_out:
                    stack.pop()
            continue
        known = tag in inline
        own = attributes(rest) if marks else {}
        words, out = named(tag, own) if own else ([], False)
        if known or tag not in _FLOW and "-" in tag and not out:
            if not out:
                continue  # inline elements, and elements of the page's own make, leave text as it is
        if held:
            flush()
        if not known:
            for i in range(len(stack) - 1, 0, -1):  # a block ends a paragraph
                if stack[i][0] == "p" or stack[i][2]:
                    pop(i)
                    continue
                break
            if tag in _ENDS:
                ends, stop = _ENDS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in stop:
                        break
                    if stack[i][0] in ends.split():
                        pop(i)
                        if tag not in ("tr", "tbody", "tfoot", "thead"):
                            break
        slot = stack[-1][1]
        article = tag in ("article", "main") or own.get("role") == "main"
        if article:
            out = False
        elif tag in _LEFT_OUT or tag == "header" and not slot.article:
            out = True
        if tag in _FLOW and not out:
            slot = slot if slot.label == "" else slot.child("", False, False)
        else:
            while slot.label == "":
                slot = slot.parent
            slot = slot.child(".".join([tag, *words]), out, article)
        stack.append((tag, slot, known))
    flush()
    return root, blocks


def numbered(root: Node) -> list[Node]:
    """All slots, parents before children, each with its place in the list."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        n.at = len(out)
        out.append(n)
        todo.extend(reversed(n.kids))
    return out


def shape(nodes: list[Node]) -> str:
    """A tree as text: label, place of the parent and marks of each slot."""
    return json.dumps([[n.label, n.parent.at if n.parent else -1, int(n.left_out), int(n.article)] for n in nodes], separators=(",", ":"))


def tree(text: str) -> list[Node]:
    out: list[Node] = []
    for i, (label, parent, left_out, article) in enumerate(json.loads(text)):
        n = Node(label, out[parent] if parent >= 0 else None, bool(left_out), bool(article))
        n.at = i
        if n.parent:
            n.parent.kids.append(n)
        out.append(n)
    return out


def matched(a: Node, b: Node) -> dict[int, int]:
    """Simple tree matching: places in a of the slots of b, for a greatest set of pairs of one label whose parents are a pair and whose order is the same in both trees."""
    weights: dict[tuple[int, int], int] = {}

    def table_of(x: Node, y: Node) -> np.ndarray:
        best = np.zeros((len(x.kids) + 1, len(y.kids) + 1), np.int32)
        for i, c in enumerate(x.kids, 1):
            for j, d in enumerate(y.kids, 1):
                w = best[i - 1, j - 1] + weight(c, d) if c.label == d.label else 0
                best[i, j] = max(w, best[i - 1, j], best[i, j - 1])
        return best

    def weight(x: Node, y: Node) -> int:
        key = (x.at, y.at)
        if key not in weights:
            weights[key] = 1 + int(table_of(x, y)[-1, -1])
        return weights[key]

    out: dict[int, int] = {}
    todo = [(a, b)] if a.label == b.label else []
    while todo:
        x, y = todo.pop()
        out[y.at] = x.at
        best = table_of(x, y)
        i, j = len(x.kids), len(y.kids)
        while i and j:
            c, d = x.kids[i - 1], y.kids[j - 1]
            if c.label == d.label and best[i, j] == best[i - 1, j - 1] + weight(c, d):
                todo.append((c, d))
                i, j = i - 1, j - 1
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
    return out


def merged(shapes: list[str]) -> str:
    """The wrapper of layouts: the first one, into which each further one is aligned; slots that find no partner are added behind the partner of the sibling before them."""
    nodes = tree(shapes[0])[:NODES]
    kept = {id(n) for n in nodes}
    for n in nodes:
        n.kids = [k for k in n.kids if id(k) in kept]
    for s in shapes[1:]:
        other = tree(s)
        place = matched(nodes[0], other[0])
        partner = {b: nodes[a] for b, a in place.items()}
        for n in other:
            if n.at in partner or len(nodes) >= NODES or n.parent is None or n.parent.at not in partner:
                continue
            home = partner[n.parent.at]
            before = [partner[k.at] for k in n.parent.kids[: n.parent.kids.index(n)] if k.at in partner]
            new = Node(n.label, home, n.left_out, n.article)
            home.kids.insert(home.kids.index(before[-1]) + 1 if before else 0, new)
            nodes.append(new)
            partner[n.at] = new
        nodes = numbered(nodes[0])
    return shape(nodes)


def whole(nodes: list[Node], places: dict[int, int]) -> tuple[list[int], list[int]]:
    """For each slot its place in the wrapper, or a negative number of its path where it has none, and the place of its nearest slot in the wrapper or 0: slots of one path, in any layout, are one."""
    ids, ups = [], []
    path: dict[int, str] = {}
    times: dict[tuple[int, str], int] = {}
    for n in nodes:  # parents come before children
        if n.at in places:
            path[n.at] = str(places[n.at])
            ids.append(places[n.at])
            ups.append(places[n.at])
            continue
        up = n.parent.at if n.parent else -1
        nth = times[up, n.label] = times.get((up, n.label), -1) + 1
        path[n.at] = f"{path.get(up, '')}\n{n.label} {nth}"
        ids.append(-1 - (digest([path[n.at]]) & (1 << 62) - 1))
        ups.append(ups[up] if n.parent else 0)
    return ids, ups


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


class Aligned:
    """Pages aligned with their host's wrapper; pages of one layout are aligned once for a worker."""

    def __init__(self):
        self.wrappers: dict[str, list[Node]] = {}
        self.places: dict[tuple[str, str], tuple[dict[int, int], list[int]]] = {}

    def page(self, html: str, wrapper: str | None) -> tuple[list[Node], list[tuple[Node, str, str]], dict[int, int], list[int]]:
        """Slots, blocks, the place in the wrapper of each slot that has one, and the number of each slot."""
        root, blocks = parsed(html)
        nodes = numbered(root)
        if wrapper is None:
            return nodes, blocks, {}, []
        own = shape(nodes)
        if (wrapper, own) not in self.places:
            if len(self.places) > 5000:
                self.places.clear()
                self.wrappers.clear()
            if wrapper not in self.wrappers:
                self.wrappers[wrapper] = tree(wrapper)
            at = matched(self.wrappers[wrapper][0], nodes[0])
            self.places[wrapper, own] = at, whole(nodes, at)[0]
        return nodes, blocks, *self.places[wrapper, own]


def digest(texts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(texts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def observed(pages: DataFrame) -> DataFrame:
    """(host, layout, shape, page, slots): the layout of each page, by its digest and, once for a task, in full; a digest of its text; and of what each slot of its own tree holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set = set()
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.int64()), ("chars", pa.int64())]))
        for b in batches:
            rows = []
            for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                root, blocks = parsed(html or "")
                form = shape(numbered(root))
                held: dict[int, list[str]] = {}
                for slot, _, text in blocks:
                    held.setdefault(slot.at, []).append(text)
                key = digest([form])
                rows.append((host, key, None if (host, key) in sent else form, digest([t for _, _, t in blocks]), [{"slot": k, "text": digest(v), "chars": sum(map(len, v))} for k, v in held.items()]))
                if len(sent) < 100_000:
                    sent.add((host, key))
            if rows:
                columns = zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), kind), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["host", "layout", "shape", "page", "slots"])

    return pages.select("host", "html").mapInArrow(run, "host string, layout long, shape string, page long, slots array<struct<slot:int,text:long,chars:long>>")


def layouts(seen: DataFrame) -> DataFrame:
    """(host, layout, shape, n): the layouts of each host with the number of its pages."""
    return seen.groupBy("host", "layout").agg(F.max("shape").alias("shape"), F.count(F.lit(1)).alias("n"))


def wrappers(found: DataFrame) -> DataFrame:
    """(host, wrapper) of layouts: merged from the most common ones of each host; ties go by the digest."""
    at = F.row_number().over(W.partitionBy("host").orderBy(F.desc("n"), "layout"))
    some = found.withColumn("at", at).where(F.col("at") <= LAYOUTS).groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "shape"))), lambda x: x["shape"]).alias("shapes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([merged(s) for s in b.column(1).to_pylist()], pa.string())], names=["host", "wrapper"])

    return some.mapInArrow(run, "host string, wrapper string")


def met(many: DataFrame, few: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """many with the columns of few, a written table of one row a key. Few rows are sent to the workers, their number checked; beyond that each is copied SALT times, so that the rows of a hot key, dealt out by a hash of the columns by, meet it in as many tasks."""
    sent = small(few, 5000)
    if sent is not few:
        return many.join(sent, keys, "left")
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALT)).cast("int")).join(salted, [*keys, "_salt"], "left").drop("_salt")


def aligned(found: DataFrame, w: DataFrame) -> DataFrame:
    """(host, layout, places array<struct<slot, up>>): the number of each slot of a layout, and its nearest place in the host's wrapper, by whole()."""
    kind = pa.list_(pa.struct([("slot", pa.int64()), ("up", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = []
            for form, wrapper in zip(b.column("shape").to_pylist(), b.column("wrapper").to_pylist(), strict=True):
                own = tree(form)
                places.append([{"slot": i, "up": up} for i, up in zip(*whole(own, matched(tree(wrapper)[0], own[0])), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("layout"), pa.array(places, kind)], names=["host", "layout", "places"])

    return met(found.select("host", "layout", "shape"), w, ["host"], ["layout"]).mapInArrow(run, "host string, layout long, places array<struct<slot:bigint,up:int>>")


def slot_texts(seen: DataFrame, places: DataFrame) -> DataFrame:
    """(host, slot, up, text, chars): what slots hold on each different page of a host, as digests."""
    each = seen.groupBy("host", "page").agg(F.min(F.struct("layout", "slots")).alias("x")).select("host", "x.layout", "x.slots")
    each = met(each, places, ["host", "layout"], ["page"]).select("host", "places", F.inline("slots"))
    return each.select("host", F.expr("places[slot]").alias("at"), "text", "chars").select("host", "at.slot", "at.up", "text", "chars")


def slots(texts: DataFrame) -> DataFrame:
    """(host, slots array<struct<slot, constant, chars>>): which slots hold the same on nearly all of a host's different pages, and the characters of each; those of varying slots beyond the wrapper count for the nearest slot of it."""
    each = texts.groupBy("host", "slot", "up", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    each = each.groupBy("host", "slot", "up").agg(F.sum("n").alias("pages"), F.max("n").alias("most"), F.sum("chars").alias("chars"))
    constant = (F.col("pages") >= LEAST_PAGES) & (F.col("most") >= CONSTANT * F.col("pages"))
    each = each.select("host", "slot", "up", constant.alias("constant"), "chars")
    beyond = each.where("slot < 0 AND NOT constant").groupBy("host", F.col("up").cast("long").alias("slot")).agg(F.lit(False).alias("constant"), F.sum("chars").alias("chars"))
    each = each.where("slot >= 0 OR constant").drop("up").withColumn("own", F.lit(True)).unionByName(beyond.withColumn("own", F.lit(False)))
    return each.groupBy("host").agg(F.collect_list(F.struct("slot", "constant", "chars", "own")).alias("slots"))


def judged(wrapper: str, found: list[dict]) -> tuple[set[int], set[int] | None]:
    """Slots that are template, and those that make up the content: the articles if the host has any, else the lowest slot that holds most of the varying text, and what is below; None if nothing varies."""
    nodes = tree(wrapper)
    template = {s["slot"] for s in found if s["constant"] and (s["slot"] < 0 or not (nodes[s["slot"]].parent or nodes[0]).article)}
    mass = [0] * len(nodes)
    for s in found:
        if s["slot"] >= 0 and not (s["own"] and s["slot"] in template) and not nodes[s["slot"]].left_out:
            mass[s["slot"]] += s["chars"]
    for n in sorted(nodes, key=lambda n: -n.depth):
        if n.parent:
            mass[n.parent.at] += mass[n.at]
    if not mass[0]:
        return template, None
    inside = {n.at for n in nodes if n.article and not n.left_out}
    if sum(mass[n.at] for n in nodes if n.article and not (n.parent and n.parent.article)) < MAIN_SHARE / 2 * mass[0]:
        top = nodes[0]
        while heavy := [k for k in top.kids if k.label and mass[k.at] >= MAIN_SHARE * mass[0]]:
            top = heavy[0]
        inside = {top.at}
        for n in nodes:  # parents come before children
            if n.parent and n.parent.at in inside:
                inside.add(n.at)
    return template, inside


def content(nodes: list[Node], blocks: list[tuple[Node, str, str]], places: dict[int, int], ids: list[int], judgement: tuple[set[int], set[int] | None]) -> list[str]:
    """Blocks of a page that are its article's: in slots that are not template and not named as something else, and within the content's root, or a first heading before it."""
    template, inside = judgement
    own = [(slot, tag, text) for slot, tag, text in blocks if not slot.left_out]
    fixed = lambda s: bool(ids) and ids[s.at] in template and (s.at in places or not (s.parent or s).article)
    varying = [x for x in own if not fixed(x[0])]
    if inside is None:
        return [t for _, _, t in varying or own]

    def within(slot: Node) -> bool:
        n: Node | None = slot
        while n is not None and n.at not in places:  # a slot that the wrapper lacks belongs where its nearest known parent does
            if n.article:
                return True
            n = n.parent
        return n is not None and places[n.at] in inside

    some = [(within(slot) or tag == "h1", text) for slot, tag, text in varying]
    return [t for keep, t in some if keep] if any(keep for keep, _ in some) else [t for _, _, t in varying or own]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html): the main text of each.

    Pages are parsed to trees whose repeated siblings are one slot each. A host's wrapper is merged from its most common layouts by
    simple tree matching; every page of the host is aligned with it. Slots that hold the same text on nearly all different pages of the
    host are template; of the others, those are left out whose tags or names say that they are menus, headers, footers, sidebars, notices,
    adverts, forms or comments, and those outside of the part that holds most of the varying text. Text directly in an article or
    main element is content even where it is the same on all pages. Hosts with too few different pages have names and tags to go by alone.

    Null html, and pages without text, give an empty text; a null url, or one that can't be read, counts as a host of its own name.
    Repeated rows and rows without an id give a row each; an empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark, 200)

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([host_of(u) for u in b.column("url").to_pylist()], pa.string())], names=["page_id", "url", "html", "host"])

    src = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    src = src.mapInArrow(hosts, f"page_id {kinds['page_id']}, url string, html string, host string")
    seen = written(observed(src), "observed")
    found = written(layouts(seen), "layouts")
    w = written(wrappers(found), "wrappers")
    places = written(aligned(found, w), "places")
    judged_ = written(w.join(slots(slot_texts(seen, places)), "host", "left"), "slots")
    released(seen, found, w, places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Aligned()
        known: dict[str, tuple] = {}
        for b in batches:
            texts = []
            for host, html, wrapper, found in zip(*(b.column(c).to_pylist() for c in ("host", "html", "wrapper", "slots")), strict=True):
                if host not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[host] = judged(wrapper, found or []) if wrapper is not None else (set(), None)
                texts.append(" ".join(content(*own.page(html or "", wrapper), known[host])))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return met(src, judged_, ["host"], ["page_id", "url", "html"]).mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html and pages without text give an empty text. Repeated rows and rows without an id give a row each, and count once where a host's pages are compared; a null url is a host like others; very long pages are read whole; an empty table gives an empty result; other columns are not read."""
    return extract(table(spark, sf_dir, "pages"))


#: What the pages of the given tables come to, whose articles are one element each.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(t, '</?(p|br|h1)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM a),
c AS (SELECT page_id, url, trim(replace(replace(replace(replace(replace(regexp_replace(t, '&amp\b;?', '&#38;', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#38;', '&')) AS t FROM b)
SELECT page_id, url, t AS text, length(t) AS n_chars FROM c
"""
