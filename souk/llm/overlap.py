"""SimHash near-copies verified, and made complete, by the overlap of word shingles.

Two texts link when their sets of ``shingle``-word shingles have a Jaccard
similarity of at least ``alike``; the links' connected components are the groups.

Search. Texts with equal sets are one class. Fingerprints within 2 bits come from
the generalised pigeonhole search of :mod:`souk.llm.simhash`; what they name is
verified on the sets. At a similarity of 0.8 two fingerprints of 64 bits differ
in some 10 bits, which no pigeonhole search over them can tell from chance, so
the other links come from the sets' heads: every set is sorted by one fixed
order of shingles, by hash, but the ``COMMON`` commonest last. Two sets
x, y that link share at least alike |x| and alike |y| shingles, so their heads, the
first |x| - alike |x| + 1 of x and as many of y, have one in common, whatever the
order. Classes that meet at such a shingle are candidates; how many shingles of
their heads they share bounds how many they share at all, which rules out most
that cannot link, and the sets themselves decide. One pass over the texts makes
fingerprint, class and head; sets are made again only for candidates.

Crowded shingles. Where more than ``crowd`` classes meet, all are first held
against one of them, that with the fewest uncrowded shingles in its head: of edited
copies the least edited. If they do not form one component then, those outside the
crowd's largest component are compared with all, in pairs of blocks, which give only
links between different components. A block is bounded by rows and by shingles. So no
link between components is lost, and copies that the first step has joined meet
each block of outsiders once, never each other; the comparisons, and the rows dealt
beyond a block of outsiders, in a crowd that does not hang together grow with its square.

Texts. Sets and copies are joined with the texts only where a table of at most
``WORDS`` times 64 bits says that a text's hash may be asked for; all other texts
stay where they are read. The joins decide.

Edge cases: texts of fewer words than a shingle have their words as the only
shingle; null and empty texts are equal to each other; a null id is larger than
any other; rows that repeat count as copies of each other; extra columns of any
name stay with their rows; an empty table has no groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm import simhash
from souk.llm.common import Workspace, by_text, components
from souk.llm.simhash import SEED, _hashes, fold

SHARE = 0.2  # of the texts, by a hash, tell which shingles are common
COMMON = 1 << 18  # of these at most so many, the commonest, are sent to the tasks: 2 MB
WORDS = 1 << 18  # rows of 64 bits at most that tell which texts may be asked for
SHINGLES = 1 << 18  # of a block's sets, together


def distinct(blocks: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct hashes as signed longs; one 0 for a text without words."""
    return np.unique(np.concatenate(blocks).view(np.int64)) if blocks else np.zeros(1, dtype=np.int64)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    return distinct(list(_hashes(text, shingle)))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)))


def _sets(shingle: int, below: float = 1.0):
    """The set of a text's shingles, or of those in the first part ``below`` of all hashes, as a column function."""
    end = int(-(1 << 63) + below * (1 << 64))

    def each(texts):
        got = [shingles(t, shingle) for t in texts]
        return _lists(got if below >= 1 else [h[: np.searchsorted(h, end)] for h in got])

    return by_text(each, "array<bigint>")


def _marks(shingle: int, alike: float, common: np.ndarray):
    """``sig`` (a hash of the set), ``fp`` (the fingerprint), ``n`` (the set's size) and ``head`` (its first shingles) as a column function."""

    def each(texts):
        sig, fp, n, head = [], [], [], []
        for t in texts:
            got = list(_hashes(t, shingle))
            h = distinct(got)
            late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h if len(common) else np.zeros(len(h), dtype=bool)
            sig.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
            fp.append(fold(got))
            n.append(len(h))
            head.append(np.concatenate([h[~late], h[late]])[: len(h) - int(least_shared(len(h), alike)) + 1])
        fields = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (sig, fp)]
        return pa.StructArray.from_arrays([*fields, pa.array(n, pa.int32()), _lists(head)], ["sig", "fp", "n", "head"])

    return by_text(each, "struct<sig:bigint,fp:bigint,n:int,head:array<bigint>>")


def least_shared(n, part: float):
    """The least whole number of at least part of n; safe against rounding upwards."""
    return np.ceil(np.asarray(n) * part - 1e-9).astype(np.int64)


def row_key(id_col: Column, text_col: Column) -> list[Column]:
    """``d``, ``h``: what tells a row of the texts' table; rows equal in both have equal texts."""
    return [id_col.cast("long").alias("d"), F.xxhash64(text_col).alias("h")]


def may_hold(rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, Column]:
    """rows, and a condition on their ``h`` that is true for every ``h`` of asked, seldom for others, and never null."""
    word, bit = F.pmod("h", F.lit(WORDS)), F.expr("shiftleft(1L, cast(pmod(shiftright(h, 18), 64) as int))")
    bits = asked.groupBy(word.alias("_w")).agg(F.bit_or(bit).alias("_bits"))
    return rows.join(F.broadcast(bits), word == F.col("_w"), "left"), F.coalesce("_bits", F.lit(0)).bitwiseAND(bit) != 0


def read(ws: Workspace, docs: DataFrame, id_col: str, text_col: str, shingle: int, alike: float) -> DataFrame:
    """``d, h, sig, fp, n, head`` per row of docs, written."""
    ids, text = docs[id_col], docs[text_col]
    # heads seldom reach beyond the first 0.35 of the order; what is crowded there goes last
    some = docs.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(SHARE * (1 << 30))).select(F.explode(_sets(shingle, 0.35)(text)).alias("s"))
    known = some.groupBy("s").count().where(F.col("count") >= 5).orderBy(F.desc("count"), "s").limit(COMMON).collect()
    common = np.array(sorted(r["s"] for r in known), dtype=np.int64)
    each = docs.select(*row_key(ids, text), _marks(shingle, alike, common)(text).alias("m"))
    return ws.cut(each.select("d", "h", "m.*"), "each")


def forest(sets: list[np.ndarray], roots: np.ndarray, alike: float) -> list[tuple[int, int]]:
    """Pairs of row numbers that link, enough of them to join what links between different roots."""
    if not len(sets):
        return []
    # rows of the commonest root go last: they need no comparison with each other
    _, at, often = np.unique(roots, return_inverse=True, return_counts=True)
    order = np.argsort(at == often.argmax(), kind="stable")
    sets, roots, others = [sets[i] for i in order], np.asarray(roots)[order], len(roots) - int(often.max())
    sizes = np.array([len(h) for h in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    group, mark, out = np.unique(roots, return_inverse=True)[1], np.zeros(len(names), dtype=np.int32), []
    for i in range(min(len(sets) - 1, others)):
        mine = flat[starts[i] : starts[i + 1]]
        mark[mine] = 1
        both = np.add.reduceat(mark[flat[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1])
        mark[mine] = 0
        js = np.flatnonzero(both >= alike * (sizes[i] + sizes[i + 1 :] - both) - 1e-9) + i + 1
        while len(js := js[group[js] != group[i]]):
            out.append((int(order[i]), int(order[js[0]])))
            group[group == group[js[0]]] = group[i]
    return out


def pigeonholed(ws: Workspace, each: DataFrame) -> DataFrame:
    """Candidates ``a``, ``b`` among the values ``sig``: equal fingerprints, and those within 2 bits."""
    leads = ws.cut(each.groupBy("fp").agg(F.min("sig").alias("lead"), F.max("sig").alias("last")), "fingerprints")
    same = each.select("fp", "sig").join(leads.where("lead <> last"), "fp").where("sig <> lead").select(F.col("lead").alias("a"), F.col("sig").alias("b"))
    met = simhash.links(ws, leads.select("fp"))
    one, two = (leads.select(F.col("fp").alias(k), F.col("lead").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return same.unionByName(met.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def links(ws: Workspace, docs: DataFrame, each: DataFrame, id_col: str, text_col: str, shingle: int, alike: float, crowd: int = 32, block: int = 2048) -> DataFrame:
    """Verified links ``a``, ``b`` between the values ``sig`` of texts' sets that keep every component whole."""
    part = alike / (1 + alike)
    heads = each.select("sig", F.explode("head").alias("s")).repartition("s").distinct()
    often = heads.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select(F.col("s").alias("t"), "c")
    live = ws.cut(heads.join(often, F.col("s") == F.col("t")).select("s", "sig", "c"), "live")
    # per class: its size, what stands after its head, how many shingles of its head are crowded
    sizes = each.groupBy("sig").agg(F.first("n").alias("n"), (F.first("n") - F.first(F.size("head"))).alias("tail"))
    packed = live.where(F.col("c") > crowd).groupBy("sig").agg(F.count("*").alias("crowded")).withColumnRenamed("sig", "of")
    sizes = ws.cut(sizes.join(packed, F.col("sig") == F.col("of"), "left").select("sig", "n", "tail", F.coalesce("crowded", F.lit(0)).alias("crowded")), "sizes")

    def sized(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes allow a link."""
        for k in "ab":
            pairs = pairs.join(sizes.select(F.col("sig").alias(k), *[F.col(c).alias(k + c) for c in ("n", "tail", "crowded")]), k)
        return pairs.where(F.least("an", "bn") >= F.greatest("an", "bn") * alike - 1e-9)

    few = live.where(F.col("c") <= crowd)
    met = few.select("s", F.col("sig").alias("a")).join(few.select("s", F.col("sig").alias("b")), "s").where("a < b")
    # both heads are initial in one order, so what two sets share beyond them lies in one's tail
    bound = F.col("shared") + F.least("acrowded", "bcrowded") + F.greatest("atail", "btail")
    near = sized(met.groupBy("a", "b").agg(F.count("*").alias("shared"))).where(bound >= (F.col("an") + F.col("bn")) * part - 1e-9).select("a", "b")
    own = (F.col("n") - F.col("tail") - F.col("crowded")).alias("own")  # uncrowded shingles of the head
    many = live.where(F.col("c") > crowd).join(sizes.select(F.col("sig").alias("of"), "n", own), F.col("sig") == F.col("of"))
    many = ws.cut(many.select("s", "sig", "n", "own"), "many")
    lead = many.groupBy("s").agg(F.min(F.struct("own", F.xxhash64("sig"), "sig")).alias("l")).select("s", F.col("l.sig").alias("lead"))
    star = many.join(lead, "s").where("sig <> lead").select(F.least("lead", "sig").alias("a"), F.greatest("lead", "sig").alias("b")).distinct()
    star = sized(star).select("a", "b")
    pairs = ws.cut(near.unionByName(star).unionByName(pigeonholed(ws, each)).distinct(), "pairs")
    rows = docs.select(*row_key(docs[id_col], docs[text_col]), docs[text_col].alias("text"))

    def whole(sigs: DataFrame) -> DataFrame:
        """One set for each of the given values sig, from the text of its first row."""
        first = each.join(sigs.distinct(), "sig", "left_semi").groupBy("sig").agg(F.min(F.struct("d", "h")).alias("r"))
        first = ws.cut(first.select("sig", F.col("r.d").alias("fd"), F.col("r.h").alias("fh")), "firsts")
        mine, may = may_hold(rows, first.select(F.col("fh").alias("h")))
        met = mine.where(may).join(first, (F.col("h") == F.col("fh")) & F.col("d").eqNullSafe(F.col("fd"))).dropDuplicates(["sig"])
        return met.select("sig", _sets(shingle)("text").alias("hs"))

    asked = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig")))
    held = ws.cut(whole(asked), "held")
    left_sets, right_sets = held.select(F.col("sig").alias("a"), F.col("hs").alias("ah")), held.select(F.col("sig").alias("b"), F.col("hs").alias("bh"))
    both = F.size(F.array_intersect("ah", "bh"))
    checked = pairs.join(left_sets, "a").join(right_sets, "b").where(both >= (F.size("ah") + F.size("bh") - both) * alike - 1e-9)
    found = ws.cut(checked.select("a", "b"), "links")
    ws.drop(held, pairs)
    if not many.limit(1).count():
        return found

    roots = ws.cut(components(ws, found), "roots").select(F.col("node").alias("sig"), "root")
    rest = ws.cut(many.join(roots, "sig", "left").select("s", "sig", "n", F.coalesce("root", "sig").alias("root")), "crowded")
    # per crowd: its largest component, rows and shingles of that and of the others
    each_root = rest.groupBy("s", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    main = each_root.groupBy("s").agg(F.max(F.struct("c", "root", "w")).alias("m"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count("*").alias("roots")).where("roots > 1")
    cuts = lambda c, w: F.ceil(F.greatest(c / block, w / SHINGLES)).cast("int")
    small = cuts(F.col("c"), F.col("w")) == 1  # all in one block
    main = main.select("s", F.when(~small, F.col("m.root")).alias("main"), F.when(small, 1).otherwise(cuts(F.col("c") - F.col("m.c"), F.col("w") - F.col("m.w"))).alias("out"), cuts(F.col("m.c"), F.col("m.w")).alias("in"))
    rest = rest.join(main, "s").withColumn("in", F.when(F.col("main").isNull(), 0).otherwise(F.col("in"))).withColumn("outside", ~F.col("root").eqNullSafe(F.col("main")))
    # blocks of the others are numbered first; they meet each other and the largest component's
    rest = rest.withColumn("own", F.pmod(F.xxhash64("sig"), F.when(F.col("outside"), F.col("out")).otherwise(F.col("in"))).cast("int") + F.when(F.col("outside"), 0).otherwise(F.col("out")))
    far = F.when(F.col("outside"), F.col("out") + F.col("in")).otherwise(F.col("out"))
    pair = F.transform(F.sequence(F.lit(0), far - 1), lambda i: F.struct(F.least("own", i).alias("i"), F.greatest("own", i).alias("j")))
    rest = ws.cut(rest.select("s", "sig", "root", F.explode(pair).alias("e")).select("s", "e.i", "e.j", "sig", "root"), "blocks")
    if not rest.limit(1).count():
        return found

    def compare(own):
        got = forest(list(own["hs"]), own["root"].to_numpy(), alike)
        sig = own["sig"].to_numpy()
        return pd.DataFrame({"a": [sig[i] for i, _ in got], "b": [sig[j] for _, j in got]}, dtype=np.int64)

    more = rest.join(whole(rest.select("sig")), "sig").groupBy("s", "i", "j").applyInPandas(compare, "a long, b long")
    return found.unionByName(ws.cut(more, "more"))


def grouped(ws: Workspace, docs: DataFrame, id_col: str, text_col: str, shingle: int, alike: float, **how) -> DataFrame:
    """``d, h, root`` per row of docs; the rows of a group share their root."""
    each = read(ws, docs, id_col, text_col, shingle, alike)
    found = components(ws, links(ws, docs, each, id_col, text_col, shingle, alike, **how))
    return ws.cut(each.join(found, F.col("sig") == F.col("node"), "left").select("d", "h", F.coalesce("root", "sig").alias("root")), "roots")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, alike: float = 0.8, **how) -> DataFrame:
    """``doc_id``, ``component_id`` (smallest id reachable), one row per row of docs."""
    joined = grouped(Workspace(docs.sparkSession), docs, id_col, text_col, shingle, alike, **how)
    least = joined.groupBy("root").agg(F.min("d").alias("component_id"))
    return joined.join(least, "root").select(F.col("d").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, alike: float = 0.8, **how) -> DataFrame:
    """One row of docs for each group: that with the smallest id, of equal ids that with the smallest hash of its text.

    Of rows equal in id and text any one stays.
    """
    ws, work = Workspace(docs.sparkSession), Workspace(docs.sparkSession)
    rows = grouped(work, docs, id_col, text_col, shingle, alike, **how).groupBy("root", "d", "h").agg(F.count("*").alias("c"))
    best = F.min(F.struct(F.col("d").isNull().alias("none"), "d", "h")).alias("best")
    rows = rows.join(rows.groupBy("root").agg(best).select(F.col("root").alias("r"), "best"), F.col("root") == F.col("r"))
    stays = F.col("d").eqNullSafe(F.col("best.d")) & (F.col("h") == F.col("best.h"))
    odd = ws.cut(rows.where(~stays | (F.col("c") > 1)).select("d", "h", stays.alias("several")), "copies")
    work.close()
    # docs' columns travel in a struct of their own, so names never clash
    laid = docs.select(*row_key(docs[id_col], docs[text_col]), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    laid, may = may_hold(laid, odd)

    def met(marks: DataFrame, how: str) -> DataFrame:
        marks = marks.select(F.col("d").alias("od"), F.col("h").alias("oh"))
        return laid.where(may).join(marks, (F.col("h") == F.col("oh")) & F.col("d").eqNullSafe(F.col("od")), how)

    single, several = laid.where(~may).select("doc.*").unionByName(met(odd, "left_anti").select("doc.*")), odd.where("several")
    if several.isEmpty():
        return single
    return single.unionByName(met(several, "left_semi").dropDuplicates(["d", "h"]).select("doc.*"))
