"""Page files larger than a task: one file is read by many tasks, by byte ranges.

Spark cuts text files at line ends; here a line ends with a closing brace, so a file of
one endless line is cut anywhere between two braces. What a range means depends on
whether it begins inside a text, and how deep; so a first pass says, for either case,
how each range leaves things (a row a range), these are put together per file, and a
second pass cuts the objects of the outermost arrays (products, or whole pages) out of
each range. An object that runs over a range's end is put together from its pieces.
What is left of a file, with a number in place of each object, is its outline: small, and
parsed by itself; it says on which page and place each object stands.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.session import written

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_MARK = re.compile(r'"(?:[^"\\]|\\.)*("?)|[{\[\]]', re.DOTALL)
_REST = re.compile(r'(?:[^"\\]|\\.)*("?)', re.DOTALL)


def passed(value: str, inside: bool) -> tuple[bool, int]:
    """Whether a text is open after a stretch, and by how much the depth has changed; the brace that ends the stretch is not counted."""
    parts = (_ESCAPED.sub("", value) if "\\" in value else value).split('"')
    out = parts[1::2] if inside else parts[0::2]
    return inside ^ (len(parts) % 2 == 0), sum(p.count("{") + p.count("[") - p.count("]") for p in out)


def _fragments(batches):
    """(file, block, value) in order."""
    for batch in batches:
        yield from zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)], strict=True)


def _summarize(batches):
    """Per range: whether a text is open and how deep it is at its end, had it begun outside or inside a text; and its first character."""
    names = ["file", "block", "out_inside", "out_depth", "in_inside", "in_depth", "first"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
    now, state = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*now, *state], kinds, strict=True)], names)

    for file, block, value in _fragments(batches):
        if (file, block) != now:
            if now:
                yield row()
            now, state = (file, block), [False, 0, True, 0, value.lstrip("﻿ \t\r\n")[:1]]
        for k in (0, 2):
            state[k], step = passed(value, state[k])
            state[k + 1] += step - (not state[k])
    if now:
        yield row()


def _begins(batches):
    """Ranges in order of file and block: how each begins, inside a text or not, how deep; and at which depth the file's objects are cut."""
    names, kinds = ["file", "block", "inside", "depth", "cut"], [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int32()]
    now = None
    for batch in batches:
        rows = []
        for file, block, out_inside, out_depth, in_inside, in_depth, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if file != now:
                now, inside, depth, cut = file, False, 0, 1 if first == "[" else 2
            rows.append((file, block, inside, depth, cut))
            inside, depth = (in_inside, depth + in_depth) if inside else (out_inside, depth + out_depth)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def outside(value: str, inside: bool, depth: int, cut: int) -> tuple[int, bool, int]:
    """From a place that is in no object: where an object of the cut depth begins (-1: nowhere), and text and depth there or at the end."""
    at = 0
    if inside:
        m = _REST.match(value)
        if not m.group(1):
            return -1, True, depth
        at = m.end()
    for m in _MARK.finditer(value, at):
        c = value[m.start()]
        if c == '"':
            if not m.group(1):
                return -1, True, depth
        elif c == "{" and depth == cut:
            return m.start(), False, depth
        else:
            depth += 1 if c in "[{" else -1
    return -1, False, depth


def _pieces(batches):
    """Rows ``file, block, kind, id, closed, text``: outlines (kind o), objects that begin here (kind b), pieces of one that began before (kind c)."""
    names, kinds = ["file", "block", "kind", "id", "closed", "text"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
    now, rows = None, []

    def flush():
        if outline:
            rows.append((*now, "o", count, True, "".join(outline)))
        if held:
            rows.append((*now, "b" if own is not None else "c", own, False, "".join(held)))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    outline, held, own, count = [], [], None, 0
    for file, block, value, inside0, depth0, cut in _fragments(batches):
        if (file, block) != now:
            if now:
                flush()
            now, outline, held, own, count = (file, block), [], [], None, 0
            inside, depth = inside0, depth0
            within = depth > cut
        if not within:
            at, inside, depth = outside(value.lstrip("﻿") if block == 0 and not count else value, inside, depth, cut)
            value = value.lstrip("﻿") if block == 0 and not count else value
            if at < 0:
                brace = not inside and depth > 0
                depth -= brace
                outline.append(value + "}" if inside or brace else value)
                count += 1
                continue
            own = block + count
            count += 1
            outline += [value[:at], str(own)]
            value, within = value[at:], True
        inside, step = passed(value, inside)
        depth += step - (not inside)
        held.append(value + "}")
        if depth == cut and not inside:
            rows.append((*now, "b" if own is not None else "c", own, True, "".join(held)))
            held, own, within = [], None, False
        if len(outline) >= 1 << 16:
            rows.append((*now, "o", count, True, "".join(outline)))
            outline = []
        if len(rows) >= 4096:
            yield batch_of(rows)
            rows = []
    if now:
        flush()
    if rows:
        yield batch_of(rows)


def objects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(``file, id, text`` of every object of the outermost arrays, ``file, outline``)."""
    lines = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    ends = lines.mapInArrow(_summarize, "file string, block bigint, out_inside boolean, out_depth bigint, in_inside boolean, in_depth bigint, first string")
    # files stream through their task in order; a group of its own for each file cost some 8 ms a file
    begins = ends.repartition("file").sortWithinPartitions("file", "block").mapInArrow(_begins, "file string, block bigint, inside boolean, depth bigint, cut int")
    # a row a range: some 100 bytes for each 128 MB; a broadcast keeps the lines' order
    met = lines.join(F.broadcast(begins.withColumnsRenamed({"file": "_f", "block": "_b"})), (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    pieces = met.select("file", "block", "value", "inside", "depth", "cut").mapInArrow(_pieces, "file string, block bigint, kind string, id bigint, closed boolean, text string")
    pieces = written(pieces)
    whole = pieces.where("kind = 'b' AND closed").select("file", "id", "text")
    broken = pieces.where("kind = 'c' OR (kind = 'b' AND NOT closed)")  # at most two a range
    owner = F.last("id", ignorenulls=True).over(Window.partitionBy("file").orderBy("block", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    order = F.struct("block", F.col("kind") == "b", "text")
    joined = broken.withColumn("id", owner).groupBy("file", "id").agg(F.array_sort(F.collect_list(order)).alias("p")).select("file", "id", F.array_join("p.text", "").alias("text"))
    parts = pieces.where("kind = 'o'").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "id", "text"))).alias("p"))
    return whole.unionByName(joined), parts.select("file", F.array_join("p.text", "").alias("outline"))


def read_large_pages(spark: SparkSession, path: str, product: T.StructType) -> DataFrame:
    """The rows of :func:`souk.sources.pages.read_pages`, of files of any size; of a file of pages, a page has to fit a task."""
    found, outlines = objects(spark, path)
    ids = T.ArrayType(T.LongType())
    one = T.StructType([T.StructField("pages", ids), T.StructField("products", ids), T.StructField("cursor", T.StringType())])
    bare = F.btrim("outline", F.lit(" \t\r\n")).startswith("[")
    known = outlines.select("file", F.when(bare, F.from_json("outline", ids)).alias("rows"), F.when(~bare, F.from_json("outline", one)).alias("doc"))
    products = known.select("file", F.lit(1).alias("page_no"), F.col("doc.cursor").alias("cursor"), F.posexplode(F.when(F.col("doc.pages").isNull(), F.coalesce("rows", "doc.products"))).alias("pos", "id"))
    paged = known.select("file", F.posexplode("doc.pages").alias("page_no", "id"))
    page = T.StructType([T.StructField("products", T.ArrayType(product)), T.StructField("cursor", T.StringType())])
    single = products.join(found, ["file", "id"]).select("file", "page_no", "pos", "cursor", F.from_json("text", product).alias("p"))
    many = paged.join(found, ["file", "id"]).select("file", (F.col("page_no") + 1).alias("page_no"), F.from_json("text", page).alias("page")).select("file", "page_no", F.col("page.cursor").alias("cursor"), F.posexplode("page.products").alias("pos", "p"))
    return single.unionByName(many).select("file", "page_no", "pos", "cursor", "p.*")
