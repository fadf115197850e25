"""Passes over document trees: merged runs, fused lists, blocks lifted out of inlines, wrapped runs, normal tables, no empty boxes.

A tree here is a row for each node: page_id, node and parent (strings), at (an array that orders siblings), tag, attrs,
text. A pass takes and returns such rows and changes only the rows that it moves or makes; siblings, parents and children
are told by windows whose keys begin with the page, so rows that are dealt by page are not exchanged again. Nodes that a
pass makes are named after the node they come from, so names never meet. lifted_blocks() follows chains of inlines,
normal_tables() gives tables their sections and numbered() gives pre, post, depth and place anew; there one page, as in
the parser, is the most that a task holds. numbered() also takes trees of packed rows (page_id, nodes: an array of nodes)
and passes over whole pages, which then need no sort of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from codexlake.operators.documents import TEXT

#: Elements of running text; of these, the ones that can be split; elements whose inline runs get a box of
#: their own beside blocks; elements that go when nothing is in them; attributes that keep an empty box.
INLINE = (TEXT, "a", "abbr", "b", "bdi", "bdo", "br", "cite", "code", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr")
SPLIT = ("a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var")
MIXED = ("article", "aside", "blockquote", "body", "caption", "dd", "div", "dt", "figcaption", "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "li", "main", "nav", "p", "pre", "section", "td", "th")
PRUNED = ("article", "aside", "blockquote", "div", "dl", "figure", "footer", "header", "main", "nav", "ol", "section", "table", "tbody", "tfoot", "thead", "tr", "ul", *SPLIT)
KEEPS = ("id", "src", "class", "style")
_INLINE, _SPLIT = frozenset(INLINE), frozenset(SPLIT)
COLUMNS = ["page_id", "node", "parent", "at", "tag", "attrs", "text"]
_SIBLINGS = ["page_id", "parent"]


def opened(nodes: DataFrame) -> DataFrame:
    """Node rows (page_id, node_id, parent_id, pre, tag, attrs, text) as a tree, dealt by page; runs of white space alone are left out."""
    tree = nodes.select("page_id", F.col("node_id").cast("string").alias("node"), F.col("parent_id").cast("string").alias("parent"), F.array(F.col("pre").cast("long")).alias("at"), "tag", "attrs", "text")
    return tree.where((F.col("tag") != TEXT) | F.col("text").rlike(r"\S")).repartition("page_id")


def _kin(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, code, up) of the nodes of whole pages: number of the page, code of the parent's name, 0 where there is none, row of the parent or -1."""
    n = len(t)
    names = pa.concat_arrays([t["node"].combine_chunks(), t["parent"].combine_chunks()])
    codes = names.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    of = _page_numbers(t["page_id"].combine_chunks())
    most = codes.max(initial=0) + 1
    key, want = of * most + codes[:n], np.where(codes[n:] > 0, of * most + codes[n:], -1)
    by_key = np.argsort(key, kind="stable")
    at = np.minimum(np.searchsorted(key[by_key], want), n - 1)
    return of, codes[n:], np.where((want >= 0) & (key[by_key[at]] == want), by_key[at], -1)


def _ordered(keys: Sequence[np.ndarray], at: pa.ListArray, node: pa.Array) -> np.ndarray:
    """Rows in order of the keys, of `at` and of `node`."""
    size = pc.list_value_length(at).fill_null(-1).to_numpy(zero_copy_only=False)
    starts, values = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), pc.list_flatten(at).to_numpy(zero_copy_only=False)
    columns = [*keys]
    for k in range(size.max(initial=0)):  # what is shorter comes first
        part = np.full(len(size), np.iinfo(np.int64).min)
        part[size > k] = values[starts[size > k] + k]
        columns.append(part)
    names = [str(k) for k in range(len(columns) + 2)]
    return pc.sort_indices(pa.table([*columns, size, node], names=names), sort_keys=[(name, "ascending") for name in names]).to_numpy()


def _places(of: np.ndarray, up: np.ndarray, root: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, ...]:
    """(r, size, depth, ord, said): preorder place in the page from 1, nodes and said ones in the subtree; depth -1: no root leads there. Rows are in order of page, parent and place."""
    n = len(of)
    kids = np.bincount(up[up >= 0], minlength=n)
    first = np.flatnonzero((up >= 0) & (np.r_[-2, up[:-1]] != up))
    begins = np.zeros(n, np.int64)
    begins[up[first]] = first
    depth, size, held = np.full(n, -1), np.ones(n, np.int64), said.astype(np.int64)
    levels = [np.flatnonzero(root)]
    while len(levels[-1]):
        depth[levels[-1]] = len(levels) - 1
        many = kids[levels[-1]]
        levels.append(np.repeat(begins[levels[-1]] - np.cumsum(many) + many, many) + np.arange(many.sum()))
    for level in levels[:0:-1]:
        np.add.at(size, up[level], size[level])
        np.add.at(held, up[level], held[level])
    r, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, level in enumerate(levels[:-1]):
        group = up[level] if k else of[level]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        start = np.repeat(starts, np.diff(np.r_[starts, len(level)]))
        before = np.cumsum(size[level]) - size[level]
        r[level] = (r[group] if k else 0) + 1 + before - before[start]
        place[level] = np.arange(len(level)) - start
    return r, size, depth, place, held


def _page_numbers(page: pa.Array) -> np.ndarray:
    """The number of each row's page, where rows of a page stand together; no page is one too."""
    code = page.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.cumsum(np.r_[False, code[1:] != code[:-1]][: len(code)])


def _page_ends(page: np.ndarray) -> list[int]:
    """Where each page ends among rows in order of page."""
    same = page[1:] == page[:-1]
    return [*(np.flatnonzero(~same) + 1).tolist(), len(page)]


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches, whose first column is the page and which are in its order, in tables that no page leaves."""
    held: list[pa.RecordBatch] = []  # rows of a page that may go on
    for batch in batches:
        page = batch.column(0)
        if not len(page):
            continue
        ends = _page_ends(_page_numbers(page))
        cut = ends[-2] if len(ends) > 1 else 0
        if held and (cut or page[0] != held[-1].column(0)[0]):
            first = ends[0] if page[0] == held[-1].column(0)[0] else 0
            if first:
                held.append(batch.slice(0, first))
            yield pa.Table.from_batches(held).combine_chunks()
            held, batch, cut = [], batch.slice(first), max(cut - first, 0)
        if cut:
            yield pa.Table.from_batches([batch.slice(0, cut)]).combine_chunks()
        if cut < len(batch):
            held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


PagePass = Callable[[pa.Table], pa.Table]


def _together(tree: DataFrame) -> DataFrame:
    """Rows whose pages come whole and one after the other: a window brings them together, by an exchange or a sort only where the plan doesn't tell that they are. Its count is read, so that it stays in the plan."""
    return tree.withColumn("_n", F.count("*").over(Window.partitionBy("page_id"))).where("_n > 0").drop("_n")


def _unpacked(t: pa.Table) -> pa.Table:
    """A row for each node of (page_id, nodes)."""
    nodes = t["nodes"].combine_chunks()
    flat = pc.list_flatten(nodes)
    return pa.table([t["page_id"].take(pc.list_parent_indices(nodes)), *flat.flatten()], names=["page_id", *(f.name for f in flat.type)])


def _placed(tree: DataFrame, keep: list[str], said: Column | None = None, passes: Sequence[PagePass] = ()) -> DataFrame:
    """The columns `keep` of a tree with node_id, parent_id, pre, post, depth, ord and, with `said`, how many nodes of the subtree it holds for; passes are run first.

    Whole pages are put in order and numbered batch by batch.
    """
    packed = "nodes" in tree.columns
    types = {f.name: f for f in [*tree.schema, *(tree.schema["nodes"].dataType.elementType if packed else ())]}
    numbers = [StructField(c, IntegerType()) for c in ("node_id", "parent_id", "pre", "post", "depth", "ord", "said")]
    schema = StructType([*(types[c] for c in keep), *numbers])
    rows = tree.where("page_id IS NOT NULL")
    if packed:
        rows = rows.select("page_id", "nodes")
    else:
        used = dict.fromkeys(["page_id", "node", "parent", "at", *(COLUMNS if passes else ()), *keep])
        rows = rows.select(*used, (F.coalesce(said, F.lit(False)) if said is not None else F.lit(False)).alias("_said"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_pages(batches):
            t = reduce(lambda x, step: step(x), passes, _unpacked(t) if packed else t)
            if not len(t):
                continue
            of, code, up = _kin(t)
            order = _ordered([of, code], t["at"].combine_chunks(), t["node"].combine_chunks())
            row = np.empty(len(t), np.int64)
            row[order] = np.arange(len(t))
            of, code, up, t = of[order], code[order], np.where(up[order] >= 0, row[up[order]], -1), t.take(pa.array(order))
            said = t["_said"].to_numpy(zero_copy_only=False) if "_said" in t.column_names else np.zeros(len(t), bool)
            r, size, depth, place, n = _places(of, up, code == 0, said)
            pre = 2 * r - 1 - depth
            found = (r - 1, np.where(up >= 0, r[up] - 1, 0), pre, pre + 2 * size - 1, depth, place, n)
            out = t.select(keep)
            for field, values in zip(numbers, found, strict=True):
                out = out.append_column(field.name, pa.array(values, pa.int32(), mask=up < 0 if field.name == "parent_id" else None))
            yield from (out if (depth >= 0).all() else out.filter(pa.array(depth >= 0))).to_batches()

    return _together(rows).mapInArrow(number, schema)


def numbered(tree: DataFrame, *passes: PagePass) -> DataFrame:
    """The tree, after passes over whole pages, as node rows: node_id, parent_id, pre, post, depth and ord are given anew. Rows that no root leads to are left out."""
    return _placed(tree, ["page_id", "tag", "attrs", "text"], passes=passes).select("page_id", "node_id", "parent_id", "pre", "post", "depth", "ord", "tag", "attrs", "text")


def _runs(member: Column) -> tuple[Column, Column]:
    """(number of its run among siblings of consecutive members, its first member's node) of a member."""
    w = Window.partitionBy(*_SIBLINGS).orderBy("at", "node")
    starts = member & ~F.coalesce(F.lag(member).over(w), F.lit(False))
    return F.sum(starts.cast("int")).over(w), starts


def merged_runs(tree: DataFrame) -> DataFrame:
    """Sibling runs of text that follow one another are one."""
    text = F.col("tag") == TEXT
    run, _ = _runs(text)
    rows = tree.withColumn("_run", F.when(text, run)).withColumn("_own", F.when(~text, F.col("node")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "node", "text"))), lambda x: x["text"])
    attrs = F.when(F.first(text), F.create_map().cast("map<string,string>")).otherwise(F.first("attrs"))
    said = F.when(F.first(text), F.array_join(parts, "")).otherwise(F.first("text"))
    one = rows.groupBy(*_SIBLINGS, "_run", "_own").agg(F.min(F.struct("at", "node")).alias("_first"), F.first("tag").alias("tag"), attrs.alias("attrs"), said.alias("text"))
    return one.select("page_id", "_first.node", "parent", "_first.at", "tag", "attrs", "text")


def fused_lists(tree: DataFrame) -> DataFrame:
    """Lists of one kind that follow one another are one list, the first, with the items of all."""
    w = Window.partitionBy(*_SIBLINGS).orderBy("at", "node")
    goes = F.col("tag").isin("ol", "ul") & F.coalesce(F.lag("tag").over(w) == F.col("tag"), F.lit(False))
    rows = tree.withColumn("_goes", goes)
    rows = rows.withColumn("_into", F.last(F.when(~F.col("_goes"), F.col("node")), ignorenulls=True).over(w))
    # a list that goes meets its items and tells them where they go
    rows = rows.withColumn("_key", F.when(F.col("_goes"), F.col("node")).otherwise(F.col("parent")))
    rows = rows.withColumn("_to", F.max(F.when(F.col("_goes"), F.col("_into"))).over(Window.partitionBy("page_id", "_key")))
    return rows.where(~F.col("_goes")).withColumn("parent", F.coalesce("_to", "parent")).select(*COLUMNS)


def _lifted(node: list[str], parent: list[str | None], tag: list[str], own_id: list[str | None], link: list[bool]) -> list[tuple] | None:
    """What one page, in order of place, becomes: (source row, node, parent, row of its place, whether the id goes, id that comes, whether it is made); None if nothing is to be lifted."""
    row = {name: k for k, name in enumerate(node)}
    up = [row.get(name, -1) if name is not None else -1 for name in parent]
    block = [t not in _INLINE for t in tag]
    split: set[int] = set()
    for k in range(len(node)):
        j = up[k] if block[k] else -1
        while j >= 0 and j not in split and tag[j] in _SPLIT:
            split.add(j)
            j = up[j]
    if not split:
        return None
    chains: dict[int, tuple[int, ...]] = {}
    for j in split:
        way = [j]
        while way[-1] not in chains and up[way[-1]] in split:
            way.append(up[way[-1]])
        for x in reversed(way):
            chains.setdefault(x, (*chains.get(up[x], ()), x))
    blocks: dict[int, int] = {}  # of an outermost inline so far
    begun: set[int] = set()
    made: set[tuple[int, int]] = set()
    linked: dict[str, int] = {}
    out: list[tuple] = []
    for k, name in enumerate(node):
        if k in split:
            continue
        if up[k] not in split:
            out.append((k, name, parent[k], k, False, None, False))
            continue
        chain = chains[up[k]]
        base = parent[chain[0]]
        f = blocks[chain[0]] = blocks.get(chain[0], 0) + block[k]
        fresh = [x for x in chain if x not in begun]
        begun.update(fresh)
        if block[k]:
            comes = next((own_id[x] for x in fresh if own_id[x] is not None), None) if own_id[k] is None else None
            out.append((k, name, base, k, False, comes, False))
            if (of := next((x for x in chain if link[x]), None)) is not None:
                linked[name] = of
            continue
        above = base
        for x in chain:
            fragment = f"{node[x]}/{f}"
            if (x, f) not in made:
                made.add((x, f))
                out.append((x, fragment, above, k, x not in fresh, None, True))
            above = fragment
        out.append((k, name, above, k, False, None, False))
    return _linked(out, block, linked) if linked else out


def _linked(rows: list[tuple], block: list[bool], linked: dict[str, int]) -> list[tuple]:
    """rows with the inline runs of linked blocks, and of the blocks in them, in links; the nearest link counts."""
    kids: dict[str | None, list[int]] = {}
    for i, r in enumerate(rows):
        kids.setdefault(r[2], []).append(i)
    front = [*linked.items()]
    while front:
        name, of = front.pop()
        inner = [(rows[i][1], of) for i in kids.get(name, ()) if block[rows[i][0]] and rows[i][1] not in linked]
        linked.update(inner)
        front += inner
    for name, of in linked.items():
        box = None
        for i in sorted(kids.get(name, ()), key=lambda i: (rows[i][3], rows[i][1])):
            r = rows[i]
            if block[r[0]]:
                box = None
                continue
            if box is None:
                box = f"{r[1]}/a"
                rows.append((of, box, name, r[3], True, None, True))
            rows[i] = (*r[:2], box, *r[3:])
    return rows


def lifted_blocks(tree: DataFrame) -> DataFrame:
    """Blocks that an inline holds stand beside it: the inline is split into fragments around them.

    What stands in split inlines is numbered by the blocks before it under the outermost one; runs of equal number share
    fragments. The first fragment is the inline itself and keeps its id; if a block comes first, that takes the id where
    it has none of its own. The inline runs of a block that a link held are links too. Chains of inlines are followed
    inside a page, so pages go through whole, batch by batch, and there are no rounds.
    """
    w = Window.partitionBy("page_id").orderBy("at", "node")
    # the number is read, so that the window stays in the plan
    rows = tree.withColumn("_r", F.row_number().over(w)).select("page_id", F.when(F.col("_r") > 0, F.col("node")).alias("node"), *COLUMNS[2:], F.element_at("attrs", "id").alias("_id"), F.coalesce((F.col("tag") == "a") & F.element_at("attrs", "href").isNotNull(), F.lit(False)).alias("_link"))

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_pages(batches):
            lists = [t[c].to_pylist() for c in ("node", "parent", "tag", "_id", "_link")]
            ends = _page_ends(_page_numbers(t["page_id"].combine_chunks()))
            found: list[tuple] = []
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                names, parents = lists[0][a:b], lists[1][a:b]
                page = _lifted(names, parents, *(c[a:b] for c in lists[2:])) or ((k, names[k], parents[k], k, False, None, False) for k in range(b - a))
                found += [(k + a, name, parent, at + a, *rest) for k, name, parent, at, *rest in page]
            source, node, parent, at, bare, comes, made = zip(*found, strict=True)
            of = t.select(["page_id", "tag", "attrs", "text"]).take(pa.array(source, pa.int64()))
            columns = {
                "page_id": of["page_id"], "node": pa.array(node, pa.string()), "parent": pa.array(parent, pa.string()), "at": t["at"].take(pa.array(at, pa.int64())), "tag": of["tag"], "attrs": of["attrs"], "text": of["text"],
                "_bare": pa.array(bare, pa.bool_()), "_comes": pa.array(comes, pa.string()), "_made": pa.array(made, pa.bool_()),
            }
            yield from pa.table(columns).to_batches()

    flags = [StructField("_bare", BooleanType()), StructField("_comes", StringType()), StructField("_made", BooleanType())]
    found = rows.mapInArrow(lift, StructType([*(tree.schema[c] for c in COLUMNS), *flags]))
    attrs = F.when(F.col("_bare"), F.map_filter("attrs", lambda k, v: k != "id")).when(F.col("_comes").isNotNull(), F.map_concat(F.coalesce("attrs", F.create_map().cast("map<string,string>")), F.create_map(F.lit("id"), F.col("_comes")))).otherwise(F.col("attrs"))
    return found.select("page_id", "node", "parent", "at", "tag", attrs.alias("attrs"), F.when(F.col("_made"), F.lit("")).otherwise(F.col("text")).alias("text"))


def wrapped_runs(tree: DataFrame, box: str = "div") -> DataFrame:
    """Where inlines and blocks stand side by side, each run of inlines gets a box."""
    child = F.col("_side") == 1
    inline = child & F.col("tag").isin(*INLINE)
    # a host meets its children
    rows = tree.withColumn("_side", F.explode(F.when(F.col("tag").isin(*MIXED), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    rows = rows.withColumn("_key", F.when(child, F.col("parent")).otherwise(F.col("node")))
    kin = Window.partitionBy("page_id", "_key")
    w = kin.orderBy("_side", "at", "node")
    starts = inline & ~F.coalesce(F.lag(inline).over(w), F.lit(False))
    rows = rows.withColumn("_starts", starts).withColumn("_first", F.last(F.when(F.col("_starts"), F.struct("at", "node")), ignorenulls=True).over(w))
    rows = rows.withColumn("_mixed", F.col("_key").isNotNull() & F.bool_or(~child).over(kin) & F.bool_or(inline).over(kin) & F.bool_or(child & ~F.col("tag").isin(*INLINE)).over(kin))
    rows = rows.where(child).withColumn("_in", inline & F.col("_mixed"))
    name = F.concat("_first.node", F.lit("/box"))
    # the first of a run brings its box along
    rows = rows.withColumn("_box", F.explode(F.when(F.col("_in") & F.col("_starts"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    made = F.col("_box")
    return rows.select(
        "page_id", F.when(made, name).otherwise(F.col("node")).alias("node"), F.when(F.col("_in") & ~made, name).otherwise(F.col("parent")).alias("parent"), "at", F.when(made, F.lit(box)).otherwise(F.col("tag")).alias("tag"),
        F.when(made, F.create_map().cast("map<string,string>")).otherwise(F.col("attrs")).alias("attrs"), F.when(made, F.lit("")).otherwise(F.col("text")).alias("text"),
    )


def _longer(at: pa.ListArray, rows: np.ndarray, last: np.ndarray, some: np.ndarray) -> pa.ListArray:
    """The lists of rows, with one more value, `last`, where `some` holds."""
    lists = at.take(pa.array(rows))
    size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    values = np.insert(pc.list_flatten(lists).to_numpy(zero_copy_only=False), np.cumsum(size)[some], last[some])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size + some)], pa.int32()), pa.array(values, at.type.value_type), type=at.type)


def table_sections(t: pa.Table) -> pa.Table:
    """What normal_tables() makes of whole pages."""
    if not len(t):
        return t
    _, _, up = _kin(t)
    node, parent, at, tag, attrs, text = (t[c].combine_chunks() for c in COLUMNS[1:])
    among = lambda *tags: pc.is_in(tag, pa.array(tags, tag.type)).to_numpy(zero_copy_only=False)
    table, group, cell = among("table"), among("colgroup"), among("td", "th")
    held = up >= 0

    def over(rows: np.ndarray) -> np.ndarray:
        """Whether a node is the parent of one of rows."""
        found = np.zeros(len(t), bool)
        found[up[rows & held]] = True
        return found

    inside = held & table[up]
    row = ~group & inside & ~over(among("thead", "tbody", "tfoot"))[up]
    head = row & over(cell) & ~over(cell & ~among("th"))
    # a column group in a section asks for the table around that
    above = np.where(held, up[up], -1)
    into = np.where(row | (group & inside), up, np.where(group & (above >= 0) & table[above], above, -1))
    asks = np.flatnonzero(into >= 0)
    key = 3 * into[asks] + np.where(group, 0, 1 + head)[asks]
    order = _ordered([key], at.take(pa.array(asks)), node.take(pa.array(asks)))
    key = key[order]
    first = np.zeros(len(t), bool)
    first[asks[order[np.r_[True, key[1:] != key[:-1]][: len(key)]]]] = True
    leads, opens = group & first, row & first
    # the first row of a section brings it along, and a table without rows its body
    bare = table & ~over(~group) & ~opens
    by = np.r_[np.flatnonzero(opens), np.flatnonzero(bare)]
    of, thead = np.where(opens, into, np.arange(len(t)))[by], head[by]
    name = lambda rows, heads: pc.binary_join_element_wise(node.take(rows), pa.array(np.where(heads, "/head", "/body"), node.type), "")
    table_row = pa.array(into, pa.int64(), mask=into < 0)
    own = pc.if_else(pa.array(leads), node.take(table_row), pc.if_else(pa.array(row), name(table_row, head), parent))
    rows = np.r_[np.where(leads, into, np.arange(len(t))), of]
    lists = _longer(at, rows, np.r_[np.full(len(t), -2), np.where(thead, -1, 0)], np.r_[leads, np.ones(len(of), bool)])
    both = lambda a, b: pa.concat_arrays([a, pa.array(b, a.type)])
    columns = [
        pa.concat_arrays([node, name(pa.array(of), thead)]), pa.concat_arrays([own, node.take(pa.array(of))]), lists, both(tag, np.where(thead, "thead", "tbody").tolist()), both(attrs, [[]] * len(of)), both(text, [""] * len(of)),
    ]
    # what is made stands with its page
    rest = np.argsort(np.r_[np.arange(len(t)), by], kind="stable")
    page = t["page_id"].take(pa.array(np.r_[np.arange(len(t)), by]))
    return pa.table([page, *columns], names=COLUMNS).take(pa.array(rest))


def normal_tables(tree: DataFrame) -> DataFrame:
    """Tables get their sections: rows of header cells alone go to a head, the others to a body; the column group stands first."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_pages(batches):
            yield from table_sections(t).to_batches()

    return _together(tree.select(*COLUMNS)).mapInArrow(go, StructType([tree.schema[c] for c in COLUMNS]))


def pruned(tree: DataFrame) -> DataFrame:
    """Without boxes that nothing stands in; what has an id, a source, a class or a style stays. Rows that no root leads to are left out."""
    holds = reduce(lambda a, b: a | b, (F.element_at("attrs", k).isNotNull() for k in KEEPS))
    stays = ~F.col("tag").isin(*PRUNED) | (F.coalesce(F.length("text"), F.lit(0)) > 0) | F.coalesce(holds, F.lit(False))
    return _placed(tree, COLUMNS, stays).where("said > 0").select(*COLUMNS)


def optimized(nodes: DataFrame) -> DataFrame:
    """All passes in order, over node rows with runs; node rows again."""
    tree = opened(nodes)
    for step in (merged_runs, fused_lists, lifted_blocks, wrapped_runs, normal_tables, pruned):
        tree = step(tree)
    return numbered(tree)
