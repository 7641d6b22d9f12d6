"""Style sheets with what they refer to inlined, from the leaves of the reference graph up.

Sheets refer to images and fonts (``url()``) and to each other (``@import``), relative to themselves. Assets and imported sheets
become data URLs, imported ones with their own references inlined first. References between sheets of one cycle stay as they
are, and so do those whose resource isn't in the cache or would go beyond a sheet's budget of bytes; they are listed as gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylens.functions.urls import normalize_url, resolve_ref
from waylens.plans.scratch import cut

URL = r"(?i)url\(\s*[\"']?([^\"')\s]+)[\"']?\s*\)"
IMPORT = r"(?i)@import\s+(?:url\(\s*)?[\"']?([^\"')\s;]+)"
#: Bytes of data URLs that one sheet, or page, takes in.
BUDGET = 16 << 20


def data_url_size(size: Column) -> Column:
    """Bytes of the base64 of so many bytes, about what a data URL adds."""
    return (F.floor((size + 2) / 3) * 4).cast("long")


def base64(body: Column | str) -> Column:
    """Base64 in one line."""
    return F.translate(F.base64(body), "\r\n", "")


def within_budget(refs: DataFrame, by: str, budget: int) -> DataFrame:
    """Adds ``fits``: whether the references of a row's ``by`` up to and with it, in the order of ``at``, stay within ``budget``.
    References come from one text, so a window holds no more than a text names."""
    before = Window.partitionBy(by).orderBy("at", "ref").rowsBetween(Window.unboundedPreceding, 0)
    return refs.withColumn("fits", F.sum(data_url_size(F.col("size"))).over(before) <= budget)


def replaced(text: Column, taken: Column) -> Column:
    """The text with each ``ref`` of the structs ``taken``, in quotes or brackets, replaced by its ``data``."""
    def put(out: Column, x: Column) -> Column:
        for a, b in (('"', '"'), ("'", "'"), ("(", ")")):
            out = F.replace(out, F.concat(F.lit(a), x["ref"], F.lit(b)), F.concat(F.lit(a), x["data"], F.lit(b)))
        return out

    return F.aggregate(taken, text, put)


def is_sheet(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).startswith("text/css"), F.lit(False))


def sheet_references(sheets: DataFrame) -> DataFrame:
    """``sheet, at, ref, url, key``: what each sheet (``key, url, text``) refers to, once each, with its place and absolute URL."""
    found = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(IMPORT), F.lit(1)), F.regexp_extract_all("text", F.lit(URL), F.lit(1))))
    rows = sheets.select(F.col("key").alias("sheet"), "url", "text", F.explode(found).alias("ref")).where("ref <> '' AND NOT startswith(ref, 'data:') AND NOT startswith(ref, '#')")
    rows = rows.select("sheet", F.instr("text", F.col("ref")).alias("at"), "ref", resolve_ref(F.col("url"), F.col("ref")).alias("url"))
    return rows.withColumn("key", normalize_url(F.col("url")))


def layers(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, layer`` of the sources of ``a, b`` edges that lead to no cycle, one layer above the highest of their targets (those
    without edges of their own are layer 0), and the edges of the others. A round is one written table."""
    left, done, layer = edges.select("a", "b").distinct(), None, 0
    while True:
        layer += 1
        # whoever has an edge to a node with edges waits
        waiting = left.select(F.col("a").alias("b")).distinct().withColumn("held", F.lit(True))
        held = left.join(waiting, "b", "left").groupBy("a").agg(F.coalesce(F.bool_or("held"), F.lit(False)).alias("held"))
        state = cut(left.join(held, "a").select("a", "b", "held"), "edges")
        ready = state.where("NOT held").select(F.col("a").alias("node"), F.lit(layer).alias("layer")).distinct()
        left = state.where("held").select("a", "b")
        if ready.isEmpty():
            return ready if done is None else done, left
        done = ready if done is None else done.unionByName(ready)


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """The edges ``a, b`` inside strongly connected components, by colouring: the smallest node that reaches another one colours it,
    and what of a colour leads back to that node is its component. Each round takes out at least one component a colour."""
    left, found = cut(edges.select("a", "b").distinct(), "edges"), edges.limit(0).select("a", "b")
    while not left.isEmpty():
        colours = cut(left.select(F.explode(F.array("a", "b")).alias("n")).distinct().withColumn("c", F.col("n")), "colours")
        while True:
            came = left.join(colours.select(F.col("n").alias("a"), F.col("c").alias("from")), "a").groupBy(F.col("b").alias("n")).agg(F.min("from").alias("from"))
            new = cut(colours.join(came, "n", "left").select("n", F.least("c", F.coalesce("from", "c")).alias("c"), (F.col("from") < F.col("c")).alias("changed")), "colours")
            colours = new.select("n", "c")
            if new.where("changed").isEmpty():
                break
        inside = left.join(colours.select(F.col("n").alias("a"), F.col("c").alias("ca")), "a").join(colours.select(F.col("n").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b")
        inside = cut(inside, "inside")
        back = cut(colours.where("n = c").select("n"), "back")
        size = back.count()
        while True:
            back = cut(back.union(inside.join(back.select(F.col("n").alias("b")), "b").select("a")).distinct(), "back")
            if back.count() == size:
                break
            size = back.count()
        # a component's nodes share a colour, and one colour has one component in a round
        own = inside.join(back.select(F.col("n").alias("a")), "a", "left_semi").join(back.select(F.col("n").alias("b")), "b", "left_semi")
        found = found.union(own.select("a", "b"))
        left = cut(left.join(back.select(F.col("n").alias("a")), "a", "left_anti").join(back.select(F.col("n").alias("b")), "b", "left_anti"), "edges")
    return found


def inlined_sheets(resources: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Sheets with their references inlined, as ``key, text``, and the gaps ``sheet, ref, url, reason`` (``missing``, ``cycle``, ``budget``).

    ``resources`` (``key, url, content_type, body``) are one a key, as ``cache.resource_index`` gives them. Sheets are done in layers:
    first those that import none, then those whose imports are done, so that a chain of n sheets takes n rounds and a
    reference that several sheets share is inlined once. A sheet with a null body is empty.
    """
    sheets = cut(resources.where(is_sheet(F.col("content_type"))).select("key", "url", F.coalesce(F.make_valid_utf8("body"), F.lit("")).alias("text")), "sheets")
    refs = cut(sheet_references(sheets), "references")
    held = resources.select("key", is_sheet(F.col("content_type")).alias("css"), F.octet_length("body").cast("long").alias("size"), F.coalesce("content_type", F.lit("application/octet-stream")).alias("type"))
    refs = cut(refs.join(held, "key", "left"), "known-references")
    gaps = refs.where("type IS NULL").select("sheet", "ref", "url", F.lit("missing").alias("reason"))

    edges = refs.where("css").select(F.col("sheet").alias("a"), F.col("key").alias("b"))
    above, stuck = layers(edges)
    above = cut(above, "above")
    if not stuck.isEmpty():
        cyclic = cut(cyclic_edges(stuck), "cyclic")
        below = above.agg(F.max("layer")).first()[0] or 0
        others, _ = layers(stuck.join(cyclic, ["a", "b"], "left_anti"))
        # what leads into cycles comes after everything that doesn't
        late = stuck.select(F.col("a").alias("node")).distinct().join(others, "node", "left").select("node", (F.lit(below + 1) + F.coalesce("layer", F.lit(0))).alias("layer"))
        above = cut(above.unionByName(late), "above")
        cyclic = cyclic.select(F.col("a").alias("sheet"), F.col("b").alias("key"))
        gaps = gaps.unionByName(refs.join(cyclic, ["sheet", "key"], "left_semi").select("sheet", "ref", "url", F.lit("cycle").alias("reason")))
        refs = cut(refs.join(cyclic, ["sheet", "key"], "left_anti"), "open-references")
    refs = refs.where("type IS NOT NULL")
    levels = cut(sheets.select("key").join(above.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("layer", F.lit(0)).alias("layer")), "layers")
    assets = resources.where(~is_sheet(F.col("content_type"))).select("key", base64("body").alias("encoded"))

    done = None
    for layer in range((levels.agg(F.max("layer")).first()[0] or 0) + 1):
        own = sheets.join(levels.where(F.col("layer") == layer).select("key"), "key", "left_semi")
        asked = refs.join(own.select(F.col("key").alias("sheet")), "sheet", "left_semi")
        if done is not None:  # sheets have the size of what they became
            asked = asked.join(done.select("key", F.octet_length("text").cast("long").alias("grown")), "key", "left").withColumn("size", F.coalesce("grown", "size")).drop("grown")
        judged = within_budget(asked, "sheet", budget)
        gaps = gaps.unionByName(judged.where("NOT fits").select("sheet", "ref", "url", F.lit("budget").alias("reason")))
        bodies = assets if done is None else assets.unionByName(done.select("key", base64(F.col("text").cast("binary")).alias("encoded")))
        data = F.concat(F.lit("data:"), F.col("type"), F.lit(";base64,"), F.col("encoded"))
        taken = judged.where("fits").join(bodies, "key").groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("at", "ref", data.alias("data")))).alias("taken"))
        new = own.join(taken.withColumnRenamed("sheet", "key"), "key", "left")
        new = cut(new.select("key", F.when(F.col("taken").isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col("taken"))).alias("text")), "inlined")
        done = new if done is None else done.unionByName(new)
    return done, gaps
