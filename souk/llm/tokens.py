"""Token ids of whole texts by a public tokenizer file, one row per piece of at most ``capacity`` ids.

BPE files that drop white space (``word_bpe_49k.json``) never make a token
across a space or a line break, so a text's ids are those of its blank-separated
chunks in turn. Chunks repeat far more than texts; each worker keeps the ids of
those it has met (at most ``CACHE_BYTES`` of them, the frequent ones come first;
a chunk over ``LONG`` characters is never kept) and only asks the tokenizer about
new ones, many at a time. What is kept changes the speed, never the ids.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import by_text, listed, small_batches

CACHE_BYTES = 48 << 20
LONG = 64
ENTRY = 200  # bytes an entry takes besides its characters and ids
TAIL = ",.!*%&$#?;:|"
_known: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _state(path: str) -> tuple:
    """(tokenizer, chunk or word -> ids, [bytes kept]); ids as little-endian unsigned 32-bit bytes."""
    if path not in _known:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        norms = [n["type"] for n in (kind["normalizer"] or {}).get("normalizers", [])]
        cuts = [(p["type"], p.get("behavior"), p.get("invert")) for p in (kind["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if "Lowercase" not in norms or cuts[:1] != [("Split", "Removed", True)]:
            raise ValueError(f"{path}: chunks are only those of a file that lowers case and drops white space")
        _known[path] = (Tokenizer.from_file(path), {"": b""}, [0])
    return _known[path]


def _ask(tokenizer, texts: list[str]) -> list[bytes]:
    """Ids of blank-free texts, asked as one blank-separated text and told apart by their places."""
    if len(texts) < 3:
        return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    e = tokenizer.encode(" ".join(texts), add_special_tokens=False)
    ids = np.array(e.ids, dtype="<u4").tobytes()
    first = np.fromiter((a for a, _ in e.offsets), dtype=np.int64, count=len(e.ids))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    cuts = 4 * np.searchsorted(first, begins)
    return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def encode(text: str, path: str) -> bytes:
    """Ids of a whole text, as bytes."""
    tokenizer, known, kept = _state(path)
    parts = text.replace("\n", " ").split(" ")
    got = list(map(known.get, parts))
    try:
        return b"".join(got)
    except TypeError:  # some are new
        new = {p for p, ids in zip(parts, got, strict=True) if ids is None}
    split, ask = {}, {}
    for p in new:
        base = p.rstrip(TAIL)
        if base.isalpha() and base.isascii():  # letters and a tail are tokens of their own, and case is dropped
            split[p] = base.lower(), p[len(base) :]
            ask.update((x, None) for x in split[p] if x not in known)
        else:
            ask[p] = None
    fresh = dict(zip(ask, _ask(tokenizer, list(ask)), strict=True))
    fresh.update([(p, b"".join([known[x] if x in known else fresh[x] for x in s])) for p, s in split.items()])
    if kept[0] < CACHE_BYTES:
        keep = {p: ids for p, ids in fresh.items() if len(p) <= LONG}
        known.update(keep)
        kept[0] += sum([len(p) + len(ids) + ENTRY for p, ids in keep.items()])
    return b"".join([fresh[p] if ids is None else ids for p, ids in zip(parts, got, strict=True)])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, path: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids`` (array<int>).

    A document is its text's ids (null: none), then ``end_id``; longer ones are cut every ``capacity`` ids.
    """
    path = path or default_tokenizer()
    small_batches(docs.sparkSession)
    last = np.array([end_id], dtype="<u4").tobytes()
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(texts):
        ends, rows, ids = [0], [], []
        for t in texts:
            raw = (encode(t, path) if t else b"") + last
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                rows.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
                if with_ids:
                    ids.append(part)
            ends.append(len(rows))
        table = np.array(rows, dtype=np.int64).reshape(-1, 4)
        fields = [pa.array(table[:, 0].astype(np.int32)), *[pa.array(table[:, i]) for i in (1, 2, 3)]]
        if with_ids:
            each = np.concatenate([[0], np.cumsum(table[:, 2])]).astype(np.int32)
            fields.append(pa.ListArray.from_arrays(pa.array(each), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
        return listed(ends, **dict(zip(names, fields, strict=True)))

    kind = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint" + (",ids:array<int>" if with_ids else "") + ">>"
    cuts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.explode(by_text(cut, kind)(docs[text_col])).alias("p"))
    return cuts.select("doc_id", "p.*")
