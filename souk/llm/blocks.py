"""Documents times corpus-wide values, by blocks: sums over each document's keys of a number that only the whole corpus knows.

A row a document and key would be shuffled twice. So documents are laid in blocks
of some ``BLOCK_BYTES`` of text: a block has the list of its distinct keys, and its
documents say which places of that list they hold, how often, in a few bytes each.
Only a row a block and key is exchanged, to be joined with the keys' values; a key
stands once in a block, so no key is hot, whatever texts hold. The values come back to
the block as a list, and each document's sums are taken there.

A block is bounded by ``BLOCK_BYTES`` and one text (the longest that a task reads).
It is written before it is used, so that a task that runs again changes no block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import by_columns

BLOCK_BYTES = 24 << 20
KINDS = {"string": pa.string(), "bigint": pa.int64()}


def narrow(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in as few bytes as their largest takes."""
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


WIDE = 0xFFFF


def packed(step: np.ndarray) -> tuple[bytes, bytes]:
    """Steps in two bytes each, and the few that need more, in order, in four."""
    return np.minimum(step, WIDE).astype("<u2").tobytes(), step[step >= WIDE].astype("<u4").tobytes()


def unpacked(short: bytes, wide: bytes) -> np.ndarray:
    out = np.frombuffer(short, "<u2").astype(np.int64)
    out[out == WIDE] = np.frombuffer(wide, "<u4")
    return out


class _Block:
    def __init__(self) -> None:
        self.ids, self.facts, self.at, self.n, self.places, self.size = [], [], [], [], {}, 0

    def add(self, doc_id, n_bytes: int, facts: tuple, keys, times) -> None:
        """keys: distinct texts (a list) or rising numbers (an array); times: how often each stands in the document."""
        times = np.asarray(times, dtype=np.int32)
        if isinstance(keys, list):
            place = self.places
            keys = np.fromiter((place.setdefault(k, len(place)) for k in keys), dtype=np.int32, count=len(keys))
            order = np.argsort(keys)
            keys, times = np.diff(keys[order], prepend=0), times[order]
        self.ids.append(doc_id)
        self.facts.append(facts)
        self.at.append(keys)
        self.n.append(narrow(times))
        self.size += n_bytes

    def row(self, number: int, key: str, facts: list[tuple[str, str]], totals: bool) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, self.n), dtype=np.int64, count=len(self.n))
        step, n = np.concatenate(self.at), np.concatenate(self.n)
        values = {"block": pa.array([number], pa.int64())}
        if key == "string":
            keys = pa.array(list(self.places), pa.string())
        else:
            own, at = np.unique(step, return_inverse=True)
            keys, first = pa.array(own, KINDS[key]), (np.cumsum(sizes) - sizes)[sizes > 0]
            step = np.diff(at, prepend=0)
            step[first] = at[first]
        # places rise within a document, and only the steps between them are kept
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        values["keys"] = whole(keys)
        if totals:
            values["totals"] = whole(pa.array(np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)))
        values["doc_id"] = whole(pa.array(self.ids, pa.int64()))
        values |= {name: whole(pa.array([f[i] for f in self.facts], KINDS[kind])) for i, (name, kind) in enumerate(facts)}
        short, wide = packed(step)
        values |= {"sizes": whole(pa.array(sizes, pa.int32())), "steps": pa.array([short], pa.binary()), "wide": pa.array([wide], pa.binary()), "times": pa.array([n.tobytes()], pa.binary()), "width": pa.array([n.itemsize], pa.int32())}
        return pa.RecordBatch.from_arrays(list(values.values()), list(values))


def lay(docs: DataFrame, reading: Callable, key: str, facts: dict[str, str], block_bytes: int | None = None) -> DataFrame:
    """Blocks of docs (``doc_id``, ``text``): distinct ``keys`` and their ``totals``; per document its id, facts and places. To be written before use.

    reading(): called once a task; gives a function text or None -> (facts, distinct
    keys, how often each). key and facts: string or bigint; ``totals`` are kept for bigint.
    """
    kinds, limit, totals = list(facts.items()), block_bytes or BLOCK_BYTES, key == "bigint"

    def run(batches):
        read, part, done, block = reading(), TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(doc_id, len(text or ""), *read(text))
                if block.size >= limit or len(block.ids) >= 1 << 18:
                    yield block.row((part << 32) + done, key, kinds, totals)
                    done, block = done + 1, _Block()
        if block.ids:
            yield block.row((part << 32) + done, key, kinds, totals)

    spelled = ", ".join(f"{n} array<{k}>" for n, k in kinds)
    return docs.select("doc_id", "text").mapInArrow(run, f"block bigint, keys array<{key}>, {'totals array<bigint>, ' if totals else ''}doc_id array<bigint>, {spelled}, sizes array<int>, steps binary, wide binary, times binary, width int")


def asked(blocks: DataFrame) -> DataFrame:
    """A row a block and key: ``block, pos, key`` and, where blocks have it, ``total``."""
    if "totals" not in blocks.columns:
        return blocks.select("block", F.posexplode("keys").alias("pos", "key"))
    return blocks.select("block", F.posexplode(F.arrays_zip("keys", "totals")).alias("pos", "e")).select("block", "pos", F.col("e.keys").alias("key"), F.col("e.totals").alias("total"))


def summed(blocks: DataFrame, answers: DataFrame, names: list[str], facts: list[str], small: bool = False) -> DataFrame:
    """A row a document: ``doc_id``, facts, and for each name the sum over its keys of how often times the key's value.

    answers: ``block, pos`` and the named values (bigint), for every key of every block.
    small: there is one name, and its values are below 2^31, so that they travel beside the place in one number.
    """
    if small:
        one = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col(names[0]))
    else:
        one = F.struct("pos", *names)
    back = answers.groupBy(F.col("block").alias("_b")).agg(F.array_sort(F.collect_list(one)).alias("v"))  # as many as the block has keys
    met = blocks.select("block", "doc_id", *facts, "sizes", "steps", "wide", "times", "width").join(back, F.col("block") == F.col("_b"), "left")

    def total(v, sizes, steps, wide, times, width):
        out, ends = {n: [] for n in names}, [0]
        for mine, size, step, far, n, w in zip(v, sizes, steps.to_pylist(), wide.to_pylist(), times.to_pylist(), width.to_pylist(), strict=True):
            size = size.values.to_numpy().astype(np.int64)
            at = np.cumsum(unpacked(step, far))
            n = np.frombuffer(n, f"<u{w}").astype(np.int64)
            stop = np.cumsum(size)
            base = np.concatenate([[0], at])[stop - size]
            at -= np.repeat(base, size)
            for name in names:
                if not mine.is_valid:
                    values = np.zeros(0, dtype=np.int64)
                else:
                    values = mine.values.to_numpy() & 0xFFFFFFFF if small else mine.values.field(name).to_numpy()
                run = np.concatenate([[0], np.cumsum(values[at] * n)])
                out[name].append(run[stop] - run[stop - size])
            ends.append(ends[-1] + len(size))
        joined = [pa.array(np.concatenate([np.zeros(0, np.int64), *out[n]]), pa.int64()) for n in names]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(joined, names))

    sums = by_columns(total, "array<struct<" + ",".join(f"{n}:bigint" for n in names) + ">>")("v", "sizes", "steps", "wide", "times", "width")
    each = met.select("doc_id", *facts, sums.alias("s")).select(F.explode(F.arrays_zip("doc_id", *facts, "s")).alias("e"))
    return each.select("e.doc_id", *[f"e.{f}" for f in facts], "e.s.*")
