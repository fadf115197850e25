"""Pages and books: links and their targets, summaries, collected text, search with places, repaired contents, rescaled positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexlake.functions.names import front_matter
from codexlake.functions.text import resolve_path
from codexlake.operators import positions as ps
from codexlake.operators import sequence as sq
from codexlake.operators.graph import _kept

#: How many links make a contents page, and how many indented labels are evidence of levels.
MIN_CHAPTER_LINKS, MIN_INDENTED = 3, 3
#: Line ends, which are neither a character nor a blank of a chapter's text.
_LINE_ENDS = "[\n\r\u2028\u2029]"


def resolved_links(links: DataFrame, targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """links (page_id, path, ord, href) with kind (external, internal, chapter, broken) and target.

    targets (target_path, target): the documents there are; anchors (target, id): their ids. A reference without a path
    points into its own page; with a fragment that its target has it is internal, with another one broken.
    """
    href = F.col("href")
    out = links.withColumn("_external", href.rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:|//)"))
    bare = F.regexp_replace(F.substring_index(href, "#", 1), r"\?.*$", "")
    out = out.withColumn("_path", F.when(bare == "", F.col("path")).otherwise(resolve_path(F.col("path"), bare))).withColumn("_id", F.nullif(F.regexp_extract(href, "#(.*)$", 1), F.lit("")))
    out = out.join(targets.select(F.col("target_path").alias("_path"), "target"), "_path", "left")
    known = anchors.select("target", F.col("id").alias("_id")).distinct().withColumn("_has", F.lit(True))
    out = out.join(known, ["target", "_id"], "left")
    kind = F.when(F.col("_external"), "external").when(F.col("target").isNull(), "broken").when(F.col("_id").isNull(), "chapter").when(F.col("_has"), "internal").otherwise("broken")
    return out.withColumn("kind", kind).select("page_id", "ord", "href", "kind", F.when(F.col("kind").isin("chapter", "internal"), F.col("target")).alias("target"))


def _without(html: Column, *tags: str) -> Column:
    for t in tags:
        html = F.regexp_replace(html, rf"(?is)<{t}\b.*?</{t}\s*>", "")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def summary(html: Column) -> dict[str, Column]:
    """text_chars (white space collapsed, ruby readings aside), has_image, image_only, images (distinct, in order) of a chapter's source."""
    text = F.regexp_replace(_without(html, "script", "style", "head", "rt", "rp"), r"(?s)<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    size = F.length(F.trim(F.regexp_replace(F.regexp_replace(text, _LINE_ENDS, ""), r"[\s ]+", " ")))
    images = F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?is)<(?:img|image)\b[^>]*?\b(?:src|href)\s*=\s*["']([^"']*)["']"""), F.lit(1)))
    return {"text_chars": size, "has_image": F.size(images) > 0, "image_only": (size == 0) & (F.size(images) > 0), "images": images}


def collected_text(html: Column, skip: tuple[str, ...] = ("aside", "footer")) -> Column:
    """The running text of a source: without the skipped parts, a break as a blank, white space collapsed."""
    text = F.regexp_replace(_without(html, "script", "style", "head", *skip), r"(?i)<br\b[^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", ""), r"\s+", " "))


def find(texts: DataFrame, needle: str, id_col: str, text_col: str, around: int = 32) -> DataFrame:
    """(id, hit, at, before, found, after): non-overlapping hits whatever the case, places in the text as it is, surroundings cut at the line.

    Letters are folded one by one, so that places in the folded text are places in the text; the one letter whose lower
    case is longer is folded to its base.
    """
    fold = lambda c: F.lower(F.translate(c, "İ", "I"))
    folded, asked, size = fold(F.col(text_col)), needle.replace("İ", "I").lower(), len(needle)
    pieces = F.split(folded, "\\Q" + asked.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    starts = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.length(x))
    # places by a running sum in the row: the hits of a text never leave it
    step = lambda a, x: F.struct((a["at"] + x + size).alias("at"), F.concat(a["all"], F.array(a["at"] + x + 1)).alias("all"))
    places = F.aggregate(starts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), step, lambda a: a["all"])
    rows = texts.where(folded.contains(asked)).select(id_col, text_col, F.posexplode(places).alias("hit", "at"))
    text, at = F.col(text_col), F.col("at")
    left, right = F.substring(text, F.lit(1), at - 1), F.substring(text, at + size, F.length(text))
    return rows.select(id_col, "hit", "at", F.regexp_extract(left, rf"[^\n]{{0,{around}}}\z", 0).alias("before"), F.substring(text, at, F.lit(size)).alias("found"), F.regexp_extract(right, rf"\A[^\n]{{0,{around}}}", 0).alias("after"))


# -- contents --------------------------------------------------------------------------------------------------------


def nested_by_indent(rows: DataFrame, group: str, order: str, label: str, least: int = MIN_INDENTED) -> DataFrame:
    """rows with parent (the order of the nearest earlier row of a smaller indent) and the label without its indent.

    Only groups with `least` rows deeper than the shallowest have levels; the others stay flat.
    """
    indent = F.length(label) - F.length(F.regexp_replace(label, r"^[\s　]+", ""))
    out = rows.withColumn("_indent", indent)
    w = Window.partitionBy(group)
    out = out.withColumn("_least", F.min("_indent").over(w)).withColumn("_deep", F.sum((F.col("_indent") > F.col("_least")).cast("int")).over(w))
    out = sq.parents_by_level(out, group, order, "_indent", order)
    nested = F.col("_deep") >= least
    return out.withColumn("parent", F.when(nested, F.col("parent"))).withColumn(label, F.when(nested, F.regexp_replace(label, r"^[\s　]+", "")).otherwise(F.col(label))).drop("_indent", "_least", "_deep")


def repaired_contents(declared: DataFrame, linked: DataFrame, headed: DataFrame, places: DataFrame, book: str) -> DataFrame:
    """(book, place, label, target, side, parent): the declared contents with what the book itself evidences, in document order.

    declared, linked and headed: book, ord, label, target; places: book, target, pos. What is derived are the links of
    the contents page if there are three or more; else, unless three declared entries are chapters, the headings if there
    are three or more. Declared entries all stay, ahead of derived ones at their place; derived ones whose target is
    declared go. Labels that keep their indent get their levels back.
    """
    count = lambda d, name, cond: d.groupBy(book).agg(F.count_if(cond).alias(name))
    true = F.lit(True)
    n = places.select(book).distinct()
    for d, name, cond in ((linked, "_linked", true), (declared, "_chapters", ~front_matter(F.col("label"))), (headed, "_headed", true), (declared, "_declared", true)):
        n = n.join(count(d, name, cond), book, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    use = F.when(zero("_linked") >= MIN_CHAPTER_LINKS, "linked").when(zero("_chapters") >= MIN_CHAPTER_LINKS, "none").when(zero("_headed") >= MIN_CHAPTER_LINKS, "headed").otherwise("none")
    n = n.select(book, use.alias("_use"))
    derived = linked.withColumn("_from", F.lit("linked")).unionByName(headed.withColumn("_from", F.lit("headed"))).join(n, book).where("_from = _use").select(*linked.columns)
    derived = derived.join(declared.select(book, "target"), [book, "target"], "left_anti")
    at = F.coalesce(F.last("pos", ignorenulls=True).over(Window.partitionBy(book, "side").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    both = declared.withColumn("side", F.lit(0)).unionByName(derived.withColumn("side", F.lit(1))).join(places, [book, "target"], "left").withColumn("_at", at)
    placed = both.withColumn("place", F.row_number().over(Window.partitionBy(book).orderBy("_at", "side", "ord")))
    return nested_by_indent(placed.select(book, "place", "label", "target", "side"), book, "place", "label")


def depth_and_count(entries: DataFrame, book: str, entry: str, parent: str) -> DataFrame:
    """(book, n, depth) of contents given as entries with parents. A round for each level there is, its entries checkpointed; entries on a cycle count, but have no depth."""
    links = _kept(entries.select(book, F.col(entry).alias("_next"), F.col(parent).alias("_id")))
    level, depths = _kept(links.where("_id IS NULL").select(book, F.col("_next").alias("_id"))), []
    while not level.isEmpty():
        depths.append(level.groupBy(book).agg(F.lit(len(depths) + 1).alias("_d")))
        level = _kept(links.join(level, [book, "_id"]).select(book, F.col("_next").alias("_id")))
    deep = reduce(DataFrame.unionByName, depths or [level.groupBy(book).agg(F.lit(0).alias("_d"))]).groupBy(book).agg(F.max("_d").cast("long").alias("depth"))
    return entries.groupBy(book).agg(F.count("*").alias("n")).join(deep, book, "left")


# -- positions -------------------------------------------------------------------------------------------------------


def rescaled(saved: DataFrame, before: DataFrame, after: DataFrame, starts_before: DataFrame, starts_after: DataFrame, book: str) -> DataFrame:
    """saved (book, id, eid, off, to_eid, to_off, linear_pos) with linear_pos moved to the new build on the scale it was written on.

    before and after: (book, eid, pid), where each element begins; starts: (book, at), where locations begin. A value that
    is neither the old location nor the old position is kept.
    """
    x = saved.join(before.select(book, "eid", F.col("pid").alias("_p0")), [book, "eid"], "left").join(after.select(book, F.col("eid").alias("to_eid"), F.col("pid").alias("_p1")), [book, "to_eid"], "left")
    x = x.withColumn("_old", F.col("_p0") + F.col("off")).withColumn("_new", F.col("_p1") + F.col("to_off"))

    def location(position: str, starts: DataFrame, name: str) -> DataFrame:
        rows = x.where(F.col(position).isNotNull()).select(book, "id", F.col(position).alias("at"))
        return sq.location_of(rows, starts.select(book, "at"), book, "at").select(book, "id", F.col("location").alias(name))

    x = x.join(location("_old", starts_before, "_l0"), [book, "id"], "left").join(location("_new", starts_after, "_l1"), [book, "id"], "left")
    moved = F.when(F.col("linear_pos") == F.col("_l0"), F.col("_l1")).when(F.col("linear_pos") == F.col("_old"), F.col("_new"))
    return x.select(book, "id", F.coalesce(moved, "linear_pos").alias("linear_pos"))


def annotation_text(elements: DataFrame, notes: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """notes (key, id, kind, a, off_a, b, off_b) with text: spans end with their last character, points show their element, ink has none."""
    ends = (F.col("a") == F.col("b")) & (F.col("off_a") == F.col("off_b"))
    spans = notes.where(F.col("kind").isin("highlight", "note") & ~ends)
    said = ps.span_text(elements, spans.select(key, "a", "off_a", "b", (F.col("off_b") + 1).alias("off_b")).distinct(), key, order, text, keep=True)
    whole = elements.select(key, F.col(order).alias("a"), F.col(text).alias("_whole"))
    out = notes.join(said.select(key, "a", "off_a", "b", (F.col("off_b") - 1).alias("off_b"), F.col(text).alias("_said")), [key, "a", "off_a", "b", "off_b"], "left").join(whole, [key, "a"], "left")
    text_of = F.when(F.col("kind") == "bookmark", F.coalesce("_whole", F.lit(""))).when(F.col("kind").isin("highlight", "note") & ~ends, F.coalesce("_said", F.lit(""))).otherwise("")
    return out.select(key, "id", "kind", text_of.alias("text"))


def monotone(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, n, ordered): whether values never fall in order."""
    kept = F.coalesce(F.col(value) >= F.lag(value).over(Window.partitionBy(group).orderBy(order)), F.lit(True))
    return rows.select(group, kept.alias("_kept")).groupBy(group).agg(F.count("*").alias("n"), F.bool_and("_kept").alias("ordered"))


def unused_rules(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """rules (page_id, selector, name) whose class no element of the page has."""
    return rules.join(classes.select("page_id", "name").distinct(), ["page_id", "name"], "left_anti").select("page_id", "selector")


# -- comparisons of sequences ----------------------------------------------------------------------------------------


def compared(left: Column, right: Column, op: str, general: bool = True) -> Column:
    """left and right (arrays of texts) compared: general holds if any pair does, a value comparison looks at the first of each.

    = and != compare as numbers where both are numbers, else as texts; the orders always as numbers.
    """
    def holds(a: Column, b: Column) -> Column:
        x, y = a.try_cast("double"), b.try_cast("double")
        same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a == b)
        order = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}
        return F.coalesce({"=": same, "!=": ~same}.get(op, order.get(op)), F.lit(False))

    if not general:
        return F.coalesce(holds(F.get(left, 0), F.get(right, 0)) & (F.size(left) > 0) & (F.size(right) > 0), F.lit(False))
    return F.exists(left, lambda a: F.exists(right, lambda b: holds(a, b)))
