"""Best-fit packing of pieces into sequences, in bulk-synchronous supersteps.

Pieces are range-sorted by length once and carry their rank among equal ones.
A superstep takes the pieces of one length band, longest band first:

1. the open sequences are range-sorted by gap and ranked among equal gaps;
2. a successor sweep over the two lists of size classes (at most ``capacity``
   each, longest pieces first) gives each class of pieces the smallest gaps
   that hold it; a class that finds no gap opens new sequences;
3. pieces that want the same gap class are told apart by rank: the j-th of them
   takes the gap of rank j div k, as its (j mod k)-th guest, where k of them fit;
4. pieces join ranked gaps on (gap class, rank), which gives sequence and
   offset; gaps shrink by what they took; and the next band follows.

Within a band the sweep lets later classes use what earlier ones left over, so
the result is that of sequential best-fit decreasing on the whole table, while
only counts per size class meet on the driver, whose number the capacity bounds.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Workspace
from souk.llm.ranks import Intervals, ranked, with_columns
from souk.llm.tokens import pieces as token_pieces

NEW = 0  # gap class of sequences that a superstep opens itself


def sweep(lengths: dict[int, int], gaps: dict[int, int], capacity: int) -> tuple[list[tuple], list[tuple], int]:
    """Best fit of size classes, longest first.

    lengths, gaps: size -> how many. Returns matches (length, first rank of the
    pieces, pieces per gap, gap class, first rank of the gaps, room used before),
    what is left (gap class, first rank, count, gap now), and how many sequences
    were opened.

    Bound. A match ends a class of pieces or uses up a list of equal gaps. Ending a
    class leaves at most three lists where one was. Using one up leaves it with gap
    mod length, less than half of the gap, so that happens at most log2(capacity) times
    to a list. So a sweep has at most 13 (gap classes + 3 piece classes) matches for a
    capacity of 4096: some 200,000 rows of six numbers, however many documents there are.
    """
    segments = defaultdict(list)
    for g, n in gaps.items():
        segments[g].append((g, 0, n, 0))
    keys, opened, matches = sorted(segments), 0, []

    def put(gap: int, seg: tuple) -> None:
        if gap not in segments or not segments[gap]:
            bisect.insort(keys, gap)
        segments[gap].append(seg)

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            at = bisect.bisect_left(keys, length)
            if at == len(keys):
                n = -(-left // (capacity // length))
                put(capacity, (NEW, opened, n, 0))
                opened += n
                continue
            gap = keys[at]
            cls, first, n, used = segments[gap].pop()
            if not segments[gap]:
                keys.pop(at)
            k = gap // length
            full = min(n, left // k)
            if full:
                matches.append((length, rank, k, cls, first, used))
                put(gap - k * length, (cls, first, full, used + k * length))
                rank, left, first, n = rank + full * k, left - full * k, first + full, n - full
            if n and left:  # fewer than k remain
                matches.append((length, rank, left, cls, first, used))
                put(gap - left * length, (cls, first, 1, used + left * length))
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n:
                put(gap, (cls, first, n, used))
    return matches, [(cls, first, n, gap) for gap, all_ in segments.items() for cls, first, n, _ in all_], opened


def bands(capacity: int) -> list[tuple[int, int]]:
    """(low, high] length bands, longest first."""
    edges = [capacity, capacity // 2, capacity // 4, capacity // 8, capacity // 32, 0]
    return [(lo, hi) for hi, lo in zip(edges[:-1], edges[1:], strict=True) if hi > lo]


def pack(df: DataFrame, capacity: int = 4096, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """df with ``sequence_id`` and ``offset``; lengths from 1 to capacity, others are an error.

    Rows of equal length go by ``order`` (nulls first); rows that repeat are packed
    each; an empty table has no sequences.
    """
    ws = Workspace(df.sparkSession)
    spark = ws.spark
    base, total = ranked(ws, df, length, list(order), capacity)
    if total and not 1 <= min(total) <= max(total) <= capacity:
        raise ValueError(f"{length} must lie between 1 and {capacity}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    names, out, sequences, opened_before = df.columns, [], None, 0
    for low, high in bands(capacity):
        lengths = {v: n for v, n in total.items() if low < v <= high}
        if not lengths:
            continue
        gaps: dict[int, int] = {}
        if sequences is not None:
            laid, gaps = ranked(ws, sequences, "gap", ["sequence_id"], capacity)
        matches, left, opened = sweep(lengths, gaps, capacity)
        plan, rest, first_new = spark.sparkContext.broadcast(Intervals(matches)), spark.sparkContext.broadcast(Intervals(left)), opened_before

        def place(frames, plan=plan):
            for x in frames:
                rank = x["rank"].to_numpy()
                m = plan.value.table[plan.value.find(x[length].to_numpy(), rank)]
                j = rank - m[:, 1]
                yield with_columns(x.select(names), cls=pa.array(m[:, 3]), at=pa.array(m[:, 4] + j // m[:, 2]), used=pa.array(m[:, 5] + (j % m[:, 2]) * m[:, 0]))

        def left_over(ids, gap):
            on = gap > 0
            return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(gap[on])], ["sequence_id", "gap"])

        def shrink(frames, rest=rest):
            for x in frames:
                m = rest.value.table[rest.value.find(x["gap"].to_numpy(), x["rank"].to_numpy())]
                yield left_over(x["sequence_id"].to_numpy(), m[:, 3])

        def begin(frames, rest=rest, first_new=first_new):
            for x in frames:
                n = x["id"].to_numpy()
                m = rest.value.table[rest.value.find(np.full(len(n), NEW), n)]
                yield left_over(n + first_new, m[:, 3])

        placed = base.where((F.col(length) > low) & (F.col(length) <= high)).mapInArrow(place, schema + ", cls long, at long, used long")
        fresh = placed.where(F.col("cls") == NEW).select(*df.columns, (F.col("at") + first_new).alias("sequence_id"), F.col("used").alias("offset"))
        nxt = spark.range(opened).mapInArrow(begin, "sequence_id long, gap long") if opened else spark.createDataFrame([], "sequence_id long, gap long")
        if gaps:
            at_gap = laid.select(F.col("gap").alias("_cls"), F.col("rank").alias("_at"), F.col("sequence_id"))
            met = placed.where(F.col("cls") != NEW).join(at_gap, (F.col("cls") == F.col("_cls")) & (F.col("at") == F.col("_at")))
            fresh = fresh.unionByName(met.select(*df.columns, "sequence_id", (F.lit(capacity) - F.col("cls") + F.col("used")).alias("offset")))
            nxt = nxt.unionByName(laid.select("sequence_id", "gap", "rank").mapInArrow(shrink, "sequence_id long, gap long"))
        out.append(fresh)
        sequences = ws.cut(nxt, "gaps")
        opened_before += opened
    if not out:
        return df.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenize whole documents and pack them.

    Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``
    (and ``ids``). Null texts count as empty: their end id alone. Null ids keep
    their rows; extra columns are left behind.
    """
    ws = Workspace(docs.sparkSession)
    return pack(ws.cut(token_pieces(docs, id_col, text_col, capacity, path, with_ids=with_ids), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """Whole sequences from placed pieces with ``ids``: ``sequence_id``, ``ids``; each holds at most capacity ids."""
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
