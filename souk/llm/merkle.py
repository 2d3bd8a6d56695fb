"""Document fingerprints as Merkle trees over sections, paragraphs and phrases.

A text is cut at ``\\n\\n`` into sections, these at ``\\n`` into paragraphs, and
these at a blank after one of ``.,;:!?|dns`` into phrases. A phrase of more than
``PHRASE`` bytes (text without such blanks) is cut further where a hash of four
neighbouring bytes says so, and after ``CHUNK`` bytes at the latest; phrases and
such chunks are the leaves. Every cut drops one fixed separator or nothing, so the
tree gives the text back and equal roots mean equal texts (up to a hash collision). Where roots differ, equal branches
are passed over and the differing ones lead to the edited phrases. Cuts depend
on nearby characters alone: an edit changes its own branch.

Likeness of two trees: twice the UTF-8 bytes in branches that both have (whole
sections first, then paragraphs of the others, then phrases, then chunks), over the bytes of
both; 1 for equal roots.

Edge cases: a null text counts as empty; an empty text has a tree of one empty
phrase; null ids come first in the order of ids, rows with equal ids go by
their text's hash; after the last row comes the first, which for a single row
is itself; extra columns are left behind.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import by_text, small_batches

CUT = re.compile(rb"(?<=[.,;:!?|dns]) ")


#: Phrases up to so many bytes are leaves; a chunk of a longer one has CHUNK bytes at most, some SPREAD in the mean.
PHRASE, CHUNK, SPREAD = 96, 256, 24


class Node(NamedTuple):
    digest: bytes
    weight: int
    below: tuple


def _node(level: bytes, below: list[Node]) -> Node:
    return Node(hashlib.blake2b(level + b"".join([x.digest for x in below]), digest_size=16).digest(), sum([x.weight for x in below]), tuple(below))


def chunks(x: bytes) -> list[bytes]:
    """Content-defined pieces of a long phrase; an edit changes those it touches and the cuts around them."""
    b = np.frombuffer(x, dtype=np.uint8).astype(np.uint32)
    h = (b[3:] * np.uint32(0x9E3779B1) + b[2:-1] * np.uint32(0x85EBCA77) + b[1:-2] * np.uint32(0xC2B2AE3D) + b[:-3] * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    out, at = [], 0
    for cut in [*(np.flatnonzero(h % SPREAD == 0) + 4).tolist(), len(x)]:
        while cut - at > CHUNK:
            out.append(x[at : at + CHUNK])
            at += CHUNK
        if cut > at:
            out.append(x[at:cut])
            at = cut
    return out


def _phrase(x: bytes) -> Node:
    if len(x) <= PHRASE:
        return Node(hashlib.blake2b(b"L" + x, digest_size=16).digest(), len(x), ())
    return _node(b"C", [Node(hashlib.blake2b(b"L" + c, digest_size=16).digest(), len(c), ()) for c in chunks(x)])


def tree(text: str | None) -> Node:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return _node(b"T", [_node(b"S", [_node(b"P", [_phrase(x) for x in CUT.split(p)]) for p in s.split(b"\n")]) for s in raw.split(b"\n\n")])


def likeness(a: Node, b: Node) -> float:
    if a.digest == b.digest:
        return 1.0
    total, both = a.weight + b.weight, 0
    left, right = a.below, b.below
    while left and right:
        have = Counter([x.digest for x in right])
        rest = []
        for x in left:
            if have.get(x.digest, 0):
                have[x.digest] -= 1
                both += x.weight
            else:
                rest.append(x)
        other = []
        for x in right:
            if have.get(x.digest, 0) > 0:
                have[x.digest] -= 1
                other.append(x)
        left = [y for x in rest for y in x.below]
        right = [y for x in other for y in x.below]
    return 2 * both / total if total else 0.0


def edits(a: Node, b: Node) -> list[tuple[int, int, int]]:
    """(section, paragraph, phrase) places of a whose phrases are not at that place in b; -1: the whole branch."""
    out: list[tuple[int, int, int]] = []

    def walk(x: Node, y: Node | None, at: tuple) -> None:
        if y is not None and x.digest == y.digest:
            return
        if not x.below or y is None or len(at) == 3:
            out.append((*at, -1, -1, -1)[:3])
            return
        for i, c in enumerate(x.below):
            walk(c, y.below[i] if i < len(y.below) else None, (*at, i))

    walk(a, b, ())
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (the root), and ``sections``: per section its digest and its paragraphs' digests."""

    def each(texts):
        trees = [tree(t) for t in texts]
        sections = [[{"digest": s.digest.hex(), "paragraphs": [p.digest.hex() for p in s.below]} for s in t.below] for t in trees]
        kind = pa.list_(pa.struct([("digest", pa.string()), ("paragraphs", pa.list_(pa.string()))]))
        return pa.StructArray.from_arrays([pa.array([t.digest.hex() for t in trees], pa.string()), pa.array(sections, kind)], ["fingerprint", "sections"])

    found = by_text(each, "struct<fingerprint:string,sections:array<struct<digest:string,paragraphs:array<string>>>>")(docs[text_col])
    return docs.select(docs[id_col].cast("long").alias("doc_id"), found.alias("m")).select("doc_id", "m.*")


def real(ids: DataFrame, bounds: list[int]) -> list[int]:
    """The smallest id at or above each bound and below the next; quantiles are doubles, which need not be ids."""

    def each(frames):
        cuts = np.array(sorted(set(bounds)), dtype=np.int64)
        for x in frames:
            d = x["doc_id"].to_numpy(np.int64)
            yield pd.DataFrame({"b": np.searchsorted(cuts, d, side="right"), "doc_id": d})

    of = ids.where("doc_id is not null").mapInPandas(each, "b int, doc_id long")
    return sorted(r["m"] for r in of.where("b > 0").groupBy("b").agg(F.min("doc_id").alias("m")).collect())


def with_next(docs: DataFrame, id_col: str, text_col: str, visit, schema: str) -> DataFrame:
    """Call ``visit(doc_id, text, next_text)`` for each row in order of id; the last row's next is the first row.

    Ids are cut near their quantiles into more buckets than partitions. The rows
    that open a bucket are sent to the one before as well, so each bucket is one
    sorted pass that keeps two texts at a time; texts travel compressed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    only = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    ids = only.select("doc_id")
    least, nulls = ids.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({int(q) for q in ids.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts))}) if least is not None else []
    bounds = real(ids, [min(b, (1 << 63) - 1) for b in bounds if b > least]) if bounds else []

    def deal(frames):
        z, cuts, opens = zstandard.ZstdCompressor(level=1), np.array(bounds, dtype=np.int64), {b: i for i, b in enumerate(bounds)}
        for x in frames:
            rows = []
            for d, null, h, t in zip(x["doc_id"], x["none"], x["h"], x["text"], strict=True):
                body = z.compress(t.encode("utf-8", "surrogatepass"))
                rows.append((0 if null else int(np.searchsorted(cuts, d, side="right")), 0, null, d, h, body))
                if not null and int(d) in opens:
                    rows.append((opens[int(d)], 1, null, d, h, body))
                if null if nulls else d == least:
                    rows.append((len(bounds), 1, null, d, h, body))
            yield pd.DataFrame(rows, columns=["bucket", "guest", "none", "doc_id", "h", "z"])

    def passes(frames):
        unzip, held = zstandard.ZstdDecompressor(), None
        out = []
        for x in frames:
            for b, guest, none, d, body in zip(x["bucket"], x["guest"], x["none"], x["doc_id"], x["z"], strict=True):
                now = (b, guest, pd.NA if none else d, unzip.decompress(body).decode("utf-8", "surrogatepass"))
                if held is not None and held[0] == b and not held[1]:
                    out.append((held[2], *visit(held[3], now[3])))
                held = now
            if out:
                y = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
                y["doc_id"] = pd.array([r[0] for r in out], dtype="Int64")
                yield y
                out = []

    # pandas would read a column of longs with nulls as doubles
    whole = only.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("h"), "text")
    dealt = whole.mapInPandas(deal, "bucket int, guest int, none boolean, doc_id long, h long, z binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("none"), "doc_id", "h").mapInPandas(passes, schema)


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its root, the root of its text with the last half replaced by the next row's beginning, and both likenesses."""
    kept: dict[str, Node] = {}

    def visit(text, nxt):
        own = kept.get(text) or tree(text)
        after = own if nxt == text else tree(nxt)
        kept.clear()
        kept[nxt] = after  # the next row's own tree
        half = len(text) // 2
        new = text[: len(text) - half] + nxt[:half]
        changed = tree(new)
        return len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.digest.hex(), changed.digest.hex(), likeness(own, changed), likeness(own, after)

    return with_next(docs, id_col, text_col, visit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
