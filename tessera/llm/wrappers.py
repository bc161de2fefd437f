"""Main texts of web pages by wrapper induction: what the pages of a host share is template, what varies is content.

1. Each page's tree of blocks is folded: neighbouring blocks of running text are one slot, records of a list are one node.
   Few folded shapes are left for a host. Shapes, sizes of slots and hashes of blocks are what the first pass tells.
2. A host's shapes are aligned by simple tree matching, commonest first, into one tree. Its parts that hold articles by
   their element, or else the smallest part with most of the text that isn't links, are the content; slots elsewhere, and
   parts that are menus, headers, footers, sidebars, notices, adverts, forms or reader comments by element, role or name, are template.
3. A block that stands in nearly all pages of a host is template, too. Pages with one title count once for this, so copies of a page
   don't make its text a template.
4. The second pass reads the pages again, and takes the blocks of content slots in page order.

A host's shapes are aligned in parts of ``shapes_at_once``, by order of shape, each of which gives a wrapper of its own; a host
with any number of pages has few, and no page goes through the driver.

Defined results: a null or empty page, and one whose host's content it lacks, has the empty text; a null url is a host of its own
(the empty one); rows that repeat are each a page, and count once as one title; pages of any length are one row and handled whole, and
blocks deeper than dom.MOST_DEEP are not told apart; an empty table gives an empty table. Columns of the input stay, but for the html and
those called text or n_chars, which are replaced.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import dom
from tessera.llm.common import fresh, input_bytes, materialize, tidy

#: Wrappers of this size are broadcast, larger ones are joined.
MOST_BROADCAST = 16 << 20


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Part:
    """A node of a folded tree: its label (tag, whether outside, whether told to be content, kind), children, and blocks if it is a slot."""

    __slots__ = ("label", "kids", "blocks", "shape")

    def __init__(self, label: list, kids: list[Part]):
        self.label, self.kids, self.blocks = label, kids, []
        self.shape = f"[{json.dumps(label, separators=(',', ':'), ensure_ascii=False)},[{','.join(k.shape for k in kids)}]]"

    def absorb(self, other: Part) -> None:
        """Take the blocks of a part of the same shape."""
        self.blocks += other.blocks
        for mine, its in zip(self.kids, other.kids, strict=True):
            mine.absorb(its)


def _leaves(node: dom.Node) -> Iterator[dom.Node]:
    if node.tag == "#text":
        yield node
    for kid in node.kids:
        yield from _leaves(kid)


def _plain(node: dom.Node) -> bool:
    """Running text all through: paragraphs, headings, quotes, tables of such."""
    return not node.outside and not node.inside and (node.tag in dom.FLOW or node.tag in ("table", "thead", "tbody", "tfoot", "tr", "td", "th")) and (not node.header) and all(map(_plain, node.kids))


def _headings(node: dom.Node) -> Iterator[dom.Node]:
    for kid in node.kids:
        if kid.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            yield from _leaves(kid)
        elif not kid.outside:
            yield from _headings(kid)


def _fold(kids: list[dom.Node], records: bool) -> list[Part]:
    """Parts for a block's children; as records, those of one label are one, wherever they stand."""
    out: list[Part] = []
    flow: Part | None = None
    grouped: dict[str, list[dom.Node]] = {}
    places: dict[str, int] = {}

    def to_flow(leaves: Iterator[dom.Node]) -> None:
        nonlocal flow
        blocks = [(x.order, x.text, x.linked) for x in leaves]
        if blocks:
            if flow is None:
                flow = Part(["#"], [])
                out.append(flow)
            flow.blocks += blocks

    for kid in kids:
        if _plain(kid):
            to_flow(_leaves(kid))
            continue
        if not records:
            flow = None
        label = [kid.tag, int(kid.outside), kid.inside, kid.kind]
        if kid.outside:
            part = Part(label, [])
        elif kid.header:  # of the page or of an article: its headings alone
            inner = Part(["#"], [])
            inner.blocks = [(x.order, x.text, x.linked) for x in _headings(kid)]
            part = Part(label, [inner] if inner.blocks else [])
        elif records or kid.tag in dom.RECORDS:
            key = json.dumps(label)
            if key not in grouped:
                places[key] = len(out)
                out.append(Part(label, []))
            grouped.setdefault(key, []).append(kid)
            continue
        else:
            part = Part(label, _fold(kid.kids, False))
        if out and out[-1].shape == part.shape and out[-1].label[0] != "#":
            out[-1].absorb(part)
        else:
            out.append(part)
    for key, nodes in grouped.items():
        label = out[places[key]].label
        out[places[key]] = Part(label, _fold([k for n in nodes for k in n.kids], len(nodes) > 1))
    return out


def folded(page: str | None) -> tuple[str, list[tuple[int, int, str, int]]]:
    """A page's shape, and its blocks as (place in the page, slot, text, characters in links); slots are numbered as a walk from the root meets nodes."""
    root = Part(["body", 0, 0, ""], _fold(dom.tree_of(page).kids, False))
    blocks, n, stack = [], 0, [root]
    while stack:
        part = stack.pop()
        blocks += [(order, n, text, linked) for order, text, linked in part.blocks]
        n += 1
        stack += reversed(part.kids)
    return root.shape, sorted(blocks)


class Template:
    """A tree that shapes of one host are aligned with; its nodes gather sizes of their slots."""

    __slots__ = ("label", "kids", "chars", "linked", "content")

    def __init__(self, shape: list):
        self.label, self.kids = shape[0], [Template(k) for k in shape[1]]
        self.chars = self.linked = 0
        self.content = False

    def matched(self, shape: list) -> tuple[int, list[tuple[int, int]]]:
        """Simple tree matching: the most pairs of nodes in order, and which children make them up."""
        if not _alike(self.label, shape[0]):
            return 0, []
        a, b = self.kids, shape[1]
        weight = [[x.matched(y)[0] for y in b] for x in a]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight[i][j])
        pairs, i, j = [], len(a), len(b)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
        return best[-1][-1] + (2 if self.label == shape[0] else 1), pairs[::-1]

    def take(self, shape: list, nodes: list[Template]) -> None:
        """Align a shape with the tree; nodes gets the tree's node for each of the shape's, in walking order. What has no match becomes a part of the tree."""
        nodes.append(self)
        of = {j: self.kids[i] for i, j in self.matched(shape)[1]}
        at = 0
        for j, kid in enumerate(shape[1]):
            if j not in of:
                of[j] = Template([kid[0], []])
                self.kids.insert(at, of[j])
            at = next(i for i, x in enumerate(self.kids) if x is of[j]) + 1
            of[j].take(kid, nodes)

    def walk(self) -> Iterator[Template]:
        yield self
        if not (self.label[0] != "#" and self.label[1]):
            for kid in self.kids:
                yield from kid.walk()

    def size(self) -> int:
        """Characters of its slots that are in no link."""
        return sum(x.chars - x.linked for x in self.walk())

    def choose(self) -> None:
        """Mark the slots that are content."""
        tops: list[Template] = []
        for grade in (2, 1):
            if not tops:
                tops = [x for x in self._told(grade) if x.size() > 0]
                most = max((x.size() for x in tops), default=0)
                tops = [x for x in tops if 4 * x.size() >= most]
        told = bool(tops)
        if not told:  # the smallest part with most of the text
            top = self
            while True:
                whole = top.size()
                inner = next((k for k in top.kids if k.label[0] != "#" and not k.label[1] and 10 * k.size() >= 7 * whole > 0), None)
                if inner is None:
                    break
                top = inner
            tops = [top]
        for top in tops:
            for x in top.walk():
                x.content = x.label[0] == "#" and (told or 2 * x.linked <= x.chars)

    def _told(self, grade: int) -> Iterator[Template]:
        if self.label[0] != "#" and self.label[1]:
            return
        if self.label[0] != "#" and self.label[2] >= grade:
            yield self
            return
        for kid in self.kids:
            yield from kid._told(grade)


def _alike(a: list, b: list) -> bool:
    return a[:3] == b[:3]


def wrapper_of(shapes: list[tuple[int, str, dict[int, tuple[int, int]]]]) -> list[tuple[int, list[int]]]:
    """The content slots of each shape (id, shape, characters and linked characters by slot), of one host and commonest first."""
    parsed = [json.loads(s) for _, s, _ in shapes]
    tree = Template([parsed[0][0], []])
    nodes: list[list[Template]] = []
    for shape, (_, _, sizes) in zip(parsed, shapes, strict=True):
        tree.take(shape, own := [])
        nodes.append(own)
        _gather(own, sizes)
    tree.choose()
    out = []
    for shape, own, (key, _, sizes) in zip(parsed, nodes, shapes, strict=True):
        slots = [k for k, x in enumerate(own) if x.content]
        if not any(sizes.get(k, (0, 0))[0] for k in slots) and sizes:  # a page of another make: by itself
            alone = Template([shape[0], []])
            alone.take(shape, own := [])
            _gather(own, sizes)
            alone.choose()
            slots = [k for k, x in enumerate(own) if x.content]
        out.append((key, slots))
    return out


def _gather(nodes: list[Template], sizes: dict[int, tuple[int, int]]) -> None:
    for slot, (chars, linked) in sizes.items():
        nodes[slot].chars += chars
        nodes[slot].linked += linked


def host_of(url: Column) -> Column:
    """The url's host in lower case, without user and port; the empty string where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of (host, page): its shapes with their number of pages (kind 0), sizes of their slots (1), and blocks with their page's title, as hashes (2)."""
    for batch in batches:
        pages: Counter = Counter()
        sizes: dict[tuple, list[int]] = {}
        shapes, rows = {}, []
        for i in range(batch.num_rows):
            host, page = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            shape, blocks = folded(page)
            key = _hash(shape)
            shapes[key] = shape
            pages[host, key] += 1
            title = _hash(dom.title_of(page or "") or (blocks[0][2] if blocks else ""))
            for _, slot, text, linked in blocks:
                size = sizes.setdefault((host, key, slot), [0, 0])
                size[0] += len(text)
                size[1] += linked
                rows.append((2, host, key, None, slot, _hash(text), title))
        rows += [(0, host, key, shapes[key], None, n, None) for (host, key), n in pages.items()]
        rows += [(1, host, key, None, slot, *size) for (host, key, slot), size in sizes.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TOLD_TYPES, strict=True)], names=["kind", "host", "shape_id", "shape", "slot", "a", "b"])


_TOLD = "kind int, host string, shape_id long, shape string, slot int, a long, b long"
_TOLD_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]


def _wrap(table: pa.Table) -> pa.Table:
    rows = sorted(table.select(["pages", "shape_id", "shape", "sizes"]).to_pylist(), key=lambda r: (-r["pages"], r["shape"]))
    found = wrapper_of([(r["shape_id"], r["shape"], {x["slot"]: (x["chars"], x["linked"]) for x in r["sizes"] or ()}) for r in rows])
    return pa.table({"host": pa.array([table.column("host")[0].as_py()] * len(found), pa.string()), "shape_id": pa.array([k for k, _ in found], pa.int64()), "slots": pa.array([s for _, s in found], pa.list_(pa.int32()))})


def induce_wrappers(pages: DataFrame, html: str = "html", url: str = "url", shapes_at_once: int = 64, least_titles: int = 8, share: float = 0.95) -> DataFrame:
    """host, shape_id, slots, template: the content slots of each folded shape of each host, and hashes of blocks that at least ``share`` of the host's titles (least_titles or more) have."""
    told = materialize(pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").cast("string").alias("page")).mapInArrow(tidy(_tell), _TOLD), "pages")
    shapes = told.filter("kind = 0").groupBy("host", "shape_id").agg(F.first("shape").alias("shape"), F.sum("a").alias("pages"))
    sizes = told.filter("kind = 1").groupBy("host", "shape_id", "slot").agg(F.sum("a").alias("chars"), F.sum("b").alias("linked"))
    sizes = sizes.groupBy("host", "shape_id").agg(F.collect_list(F.struct("slot", "chars", "linked")).alias("sizes"))
    many = shapes.groupBy("host").count().filter(F.col("count") > shapes_at_once).select("host", F.ceil(F.col("count") / shapes_at_once).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("shape"), F.col("parts")), F.lit(0))
    grouped = shapes.join(sizes, ["host", "shape_id"], "left").join(many, "host", "left").select("host", "shape_id", "shape", "pages", "sizes", part.alias("part"))
    wrappers = grouped.groupBy("host", "part").applyInArrow(tidy(_wrap), "host string, shape_id long, slots array<int>")
    blocks = told.filter("kind = 2").select("host", F.col("a").alias("block"), F.col("b").alias("title")).distinct()
    titles = blocks.select("host", "title").distinct().groupBy("host").agg(F.count("*").alias("titles")).filter(F.col("titles") >= least_titles)
    common = blocks.groupBy("host", "block").agg(F.count("*").alias("n")).filter(F.col("n") >= least_titles).join(titles, "host").filter(F.col("n") >= share * F.col("titles"))
    common = common.groupBy("host").agg(F.collect_list("block").alias("template"))  # a page's number of blocks at most
    return wrappers.join(common, "host", "left")


def extract_pages(pages: DataFrame, html: str = "html", url: str = "url", **options: int | float) -> DataFrame:
    """pages with text, the main text of the whole html, and n_chars, its code points, instead of the html."""
    wrappers = materialize(induce_wrappers(pages, html, url, **options), "wrappers")
    keep = [c for c in pages.columns if c.lower() not in {html.lower(), "text", "n_chars"}]
    host, shape, blocks, slots, template = fresh(pages, "host", "shape", "blocks", "slots", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for page in batch.column(len(keep) + 1).to_pylist():
                made, rows = folded(page)
                keys.append(_hash(made))
                found.append([{"slot": slot, "hash": _hash(text), "text": text} for _, slot, text, _ in rows])
            kind = pa.list_(pa.struct([("slot", pa.int32()), ("hash", pa.int64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], pa.array(keys, pa.int64()), pa.array(found, kind)], names=[*keep, host, shape, blocks])

    source = pages.select(*[F.col(f"`{c}`") for c in keep], host_of(F.col(f"`{url}`")).alias(host), F.col(f"`{html}`").cast("string"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*[f"`{c}`" for c in keep]).schema] + [f"{host} string, {shape} long, {blocks} array<struct<slot: int, hash: long, text: string>>"])
    wrappers = wrappers.select(F.col("host").alias(host), F.col("shape_id").alias(shape), F.col("slots").alias(slots), F.coalesce("template", F.array().cast("array<long>")).alias(template))
    if input_bytes(wrappers) <= MOST_BROADCAST:
        wrappers = F.broadcast(wrappers)
    rows = source.mapInArrow(tidy(run), schema).join(wrappers, [host, shape], "left")
    content = F.filter(blocks, lambda b: F.array_contains(F.col(slots), b["slot"]) & ~F.array_contains(F.col(template), b["hash"]))
    text = F.coalesce(F.array_join(F.transform(content, lambda b: b["text"]), "\n\n"), F.lit(""))
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], text.alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
