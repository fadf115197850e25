"""Sections with their bodies, from node rows with runs of text: headings nest by level, blocks belong to the heading before them.

Elements that only hold others are transparent; every other one is a block, a heading or nothing, and what stands inside
it is its own. Whether a node stands inside an opaque one is told by one sweep in document order: nested intervals that
begin before a node and end behind it are those whose greatest end lies behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexlake.operators.documents import TEXT

#: Elements that are looked through, what other elements are as blocks, parts that no text comes from.
TRANSPARENT = ("html", "body", "div", "section", "article", "main", "header", "footer", "nav", "figure", TEXT)
KINDS = {"p": "paragraph", "figcaption": "paragraph", "caption": "paragraph", "pre": "code", "blockquote": "quote", "aside": "quote", "ol": "ordered", "ul": "list", "dl": "list", "table": "table", "img": "image", "hr": "rule"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
ITEMS = ("li", "dt", "dd", "tr")
#: White space that markup may break lines with; blanks, as Unicode counts them, that no text begins or ends with.
SPACE, BLANKS = r"[ \t\n\f\r]+", " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def inside(opaque: Column) -> Column:
    """Whether a node row stands inside one that is opaque; node rows of a page in document order."""
    return F.coalesce(F.max(F.when(opaque, F.col("post"))).over(Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)) > F.col("pre"), F.lit(False))


def innermost(marked: Column, nodes: DataFrame, name: str, *more: str) -> DataFrame:
    """nodes with `name`: pre and `more` of the marked node that holds a node or is it; marked nodes don't hold one another."""
    last = F.last(F.when(marked, F.struct("pre", "post", *more)), ignorenulls=True).over(Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0))
    return nodes.withColumn("_last", last).withColumn(name, F.when(F.col("_last.post") >= F.col("post"), F.struct(*(F.col(f"_last.{c}") for c in ("pre", *more))))).drop("_last")


def said(parts: Column) -> Column:
    """Text of (pre, tag, text) parts in order: a break is a blank, white space runs are one, blanks at the ends are cut off."""
    joined = F.array_join(F.transform(F.array_sort(parts), lambda x: F.when(x["tag"] == "br", " ").otherwise(x["text"])), "")
    return F.trim(F.regexp_replace(joined, SPACE, " "), F.lit(BLANKS))


def blocks(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, number, kind, level, text, items): headings (kind heading) and content blocks, those without content aside.

    number: the block's number among the page's elements, from 0. items: the texts of a list's items or definitions, and
    of a table's rows with a bar between cells. Nodes are exchanged once, by page; all else is windows and groupings in it.
    """
    tag = F.col("tag")
    kind_of = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    rows = nodes.select("page_id", "pre", "post", "tag", F.coalesce("text", F.lit("")).alias("text"), F.element_at("attrs", "src").alias("src"))
    rows = rows.withColumn("number", (F.count_if(tag != TEXT).over(Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    rows = rows.where(~tag.isin("head", "script", "style", "title", "meta", "link") | tag.isNull())
    rows = rows.withColumn("_in", inside(~tag.isin(*TRANSPARENT)))
    rows = rows.withColumn("_block", ~F.col("_in") & (tag.isin(*HEADINGS) | kind_of[tag].isNotNull()))
    rows = innermost(F.col("_block"), rows, "_of", "tag", "src", "number").where("_of IS NOT NULL").withColumn("_at", F.col("_of.pre"))
    # the block's own item that a node stands in: the first li, dt, dd or tr on the way down to it
    first = tag.isin(*ITEMS)
    w = Window.partitionBy("page_id", "_at").orderBy("pre")
    outer = F.max(F.when(first, F.col("post"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_starts", first & F.coalesce(outer < F.col("pre"), F.lit(True)))
    rows = rows.withColumn("_item", F.last(F.when(F.col("_starts"), F.struct("pre", "post")), ignorenulls=True).over(w))
    # a text is an item's in blocks that list items, else the block's
    rows = rows.withColumn("_listed", F.coalesce(kind_of[F.col("_of.tag")].isin("ordered", "list", "table"), F.lit(False))).where("NOT _listed OR _item.post >= post")
    celled = tag.isin("td", "th")
    # a cell's beginning is marked, so that cells can be told apart in the row's text
    part = F.struct("pre", "tag", F.when(F.col("_listed") & celled, F.concat(F.lit("\x1f"), "text")).otherwise(F.col("text")).alias("text"))
    units = rows.groupBy("page_id", "_at", F.when(F.col("_listed"), F.col("_item.pre")).alias("_unit")).agg(F.first("_of").alias("_of"), said(F.collect_list(part)).alias("text"), F.max(celled).alias("celled"))
    cells = F.array_join(F.transform(F.split(F.regexp_replace("text", "^ ?\x1f", ""), "\x1f"), F.trim), " | ")
    units = units.withColumn("_item", F.when(F.col("celled"), cells).otherwise(F.col("text")))
    listed = F.collect_list(F.when(F.col("_unit").isNotNull() & (F.col("_item") != ""), F.struct("_unit", "_item")))
    out = units.groupBy("page_id", F.col("_at").alias("pre")).agg(F.first("_of").alias("_of"), F.max(F.when(F.col("_unit").isNull(), F.col("text"))).alias("text"), F.transform(F.array_sort(listed), lambda x: x["_item"]).alias("items"))
    tag = F.col("_of.tag")
    kind = F.when(tag.isin(*HEADINGS), "heading").otherwise(kind_of[tag])
    out = out.select("page_id", "pre", F.col("_of.number").alias("number"), kind.alias("kind"), F.when(tag.isin(*HEADINGS), F.substring(tag, 2, 1).cast("int")).alias("level"), F.when(tag == "img", F.coalesce("_of.src", F.lit(""))).otherwise(F.col("text")).alias("text"), F.when(F.size("items") > 0, F.col("items")).alias("items"))
    return out.where((F.col("kind") == "rule") | F.col("items").isNotNull() | (F.col("text") != ""))


def section_bodies(nodes: DataFrame) -> DataFrame:
    """(page_id, section, number, parent, level, title, place, kind, text, items): a row for each block in its section, and a row (place 0) for each section.

    section and parent are the pre of headings, number is the heading's among the page's elements; blocks before the
    first heading have section null. A heading's parent is the nearest one before it of a lower level.
    """
    w = Window.partitionBy("page_id").orderBy("pre")
    above = lambda k: F.last(F.when(F.col("level") == k, F.col("pre")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    body = blocks(nodes).withColumn("parent", F.greatest(*(F.when(F.col("level") > k, above(k)) for k in range(1, len(HEADINGS)))))
    head = F.when(F.col("kind") == "heading", F.struct(F.col("pre").alias("section"), "number", "parent", "level", F.col("text").alias("title")))
    body = body.withColumn("_head", F.last(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = body.select("page_id", "pre", "_head.*", "kind", "text", "items")
    place = F.row_number().over(Window.partitionBy("page_id", "section").orderBy("pre")) - F.when(F.col("section").isNull(), 0).otherwise(1)
    return body.select("page_id", "section", "number", "parent", "level", "title", place.alias("place"), "kind", "text", "items")
