"""Alignment of two tokenizers' tokens over the same bytes, and how well each link agrees with the corpus.

Each text is encoded by tokenizer A (byte-level BPE, with a blank before the text)
and by tokenizer B (sentencepiece, which adds the blank). Token bytes give each
side an array of end places. *Diagonal run skipping*: with i tokens of A and j of B
behind, and both at the same byte, the arrays are compared at the shift j - i over
stretches of 1, 2, 4, ... tokens; where a stretch differs the last step is halved
until the first difference is found. So stretches of one-to-one tokens are jumped.
An irregular group after it is resolved by advancing the side that is behind until
both end at one byte, which sets the new shift.

Links are all pairs of an A and a B token whose byte ranges overlap. How many
links of the corpus join a pair of ids is counted over all documents; per document
come the links whose count is the highest of their B id, and the sum of counts.

Counts: a row a block and pair of ids is exchanged (:mod:`souk.llm.blocks`), never
one a link. The highest count per B id has at most as many rows as B has ids.

Edge cases: texts that are null, empty, or whose tokens' bytes are not the text's
(either side) have no tokens: zeros and an empty string. Repeated rows count each; a
null id keeps its row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm import blocks, pretokens
from souk.llm.common import Workspace

#: Ids of at most about so many bytes of words are kept by a worker; an entry takes ``ENTRY`` besides its characters and ids.
WORD_BYTES, ENTRY = 96 << 20, 300
#: A blank beside white space on both sides, or beside another blank.
BETWEEN = re.compile(r"\s \s|  ")
FACTS = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups_sha256": "string"}


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


SMALL = 16  # stretches up to here are compared as lists, longer ones as bytes


def runs(ea: np.ndarray, eb: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]], list[int], list[int]]:
    """One-to-one stretches (i, j, length), irregular groups (i, i past, j, j past) and their links' places, of two rising arrays with the same last end."""
    n, m = len(ea), len(eb)
    a, b = ea.tolist(), eb.tolist()
    wide_a, wide_b = ea.astype(np.int64).tobytes(), eb.astype(np.int64).tobytes()
    straight, irregular, li, lj = [], [], [], []
    i = j = 0

    while i < n and j < m:
        most, k, step = min(n - i, m - j), 0, 1
        # forth by doubled steps, back by halved ones
        while k < most:
            w, p, q = min(step, most - k), i + k, j + k
            if a[p : p + w] == b[q : q + w] if w <= SMALL else wide_a[8 * p : 8 * (p + w)] == wide_b[8 * q : 8 * (q + w)]:
                k, step = k + w, step * 2
                continue
            while w > 1:
                half = w // 2
                if a[p : p + half] == b[q : q + half]:
                    p, q, w = p + half, q + half, w - half
                else:
                    w = half
            k = p - i
            break
        if k:
            straight.append((i, j, k))
            i, j = i + k, j + k
            if i >= n or j >= m:
                break
        i0, j0 = i, j
        p, q = a[i], b[j]
        li.append(i)
        lj.append(j)
        while p != q:
            if p < q:
                i += 1
                p = a[i]
            else:
                j += 1
                q = b[j]
            li.append(i)
            lj.append(j)
        i, j = i + 1, j + 1
        irregular.append((i0, i, j0, j))
    return straight, irregular, li, lj


def stretched(straight) -> tuple[np.ndarray, np.ndarray]:
    """Places of A and of B tokens in one-to-one stretches, in order."""
    s = np.array(straight, dtype=np.int64).reshape(-1, 3)
    size = s[:, 2]
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(s[:, 0], size) + step, np.repeat(s[:, 1], size) + step


class _Spelled(dict):
    """Pair of ids (A's in the upper 32 bits) -> ``a|b``; at most so many are kept."""

    def __missing__(self, pair: int) -> str:
        said = f"{pair >> 32}|{pair & 0xFFFFFFFF}"
        if len(self) < 1 << 18:
            self[pair] = said
        return said


NUMBERS = list(map(str, range(1 << 17)))


def spelled(a: np.ndarray, b: np.ndarray, pairs: np.ndarray, straight, irregular, names: dict) -> str:
    """``a1,a2|b1;a3|b2,b3``: ids by group, in order. pairs: those of the one-to-one stretches."""
    single = list(map(names.__getitem__, pairs.tolist()))
    a, b = a.tolist(), b.tolist()
    said = NUMBERS.__getitem__ if max(a + b) < len(NUMBERS) else str
    out, at = [], 0
    ahead = iter(straight)
    p, _, k = next(ahead, (len(a), 0, 0))
    for i, i1, j, j1 in irregular:
        while p < i:
            out += single[at : at + k]
            at += k
            p, _, k = next(ahead, (len(a), 0, 0))
        left = said(a[i]) if i1 - i == 1 else ",".join(map(said, a[i:i1]))
        out.append(f"{left}|{said(b[j]) if j1 - j == 1 else ','.join(map(said, b[j:j1]))}")
    out += single[at:]
    return ";".join(out)


class Aligner:
    """Facts and id pairs of one text; a worker keeps what it has met of both sides' ids, within bounds.

    Both tokenizers cut before a blank that stands between a letter or mark and anything
    but white space; so where every blank is such a one, ids are kept by word, both
    sides' together, and bytes are compared when a word is first met.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = (pretokens.Ids(pretokens.reader(p, specials=False)) for p in (path_a, path_b))
        self.bytes_a, self.bytes_b = self.a.of.token_bytes(), self.b.of.token_bytes()
        self.size_a, self.size_b = (np.array([len(x) for x in y], dtype=np.int64) for y in (self.bytes_a, self.bytes_b))
        self.names, self.known, self.kept = _Spelled(), {}, 0

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of both sides of a blank and a text, and whether both sides' bytes are those."""
        a, b = self.a.ids(" " + text), self.b.ids(text)
        raw = (" " + text).encode("utf-8", "surrogatepass")
        same = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == raw
        return a, b, same

    def _learn(self, words: list[str]) -> dict[str, tuple[bytes, bytes]] | None:
        """Both sides' ids of words with a blank before each, asked as one text; None where bytes differ for any."""
        odd = [w for w in words if not w or w[0].isspace() or w[-1].isspace()]  # not beside others
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        fresh = {}
        for some in ([plain] if plain else []) + [[w] for w in odd]:
            text = " ".join(some)
            parts, b = self.a.of.pretokens(" " + text)[0], np.array(self.b.of.model.encode(text) if text else [self.b.of.blank], dtype=np.int32)
            ids = self.a.pieces(parts)
            a = np.frombuffer(b"".join(ids), dtype=np.int32)
            raw = (" " + text).encode("utf-8", "surrogatepass")
            if not b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw == b"".join(map(self.bytes_b.__getitem__, b.tolist())):
                return None
            if len(some) == 1:
                fresh[some[0]] = a.tobytes(), b.tobytes()
                continue
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            begins_a = (np.cumsum(size) - size)[[p[0] == " " for p in parts]].tolist()
            begins_b = (4 * np.flatnonzero(self.b.of.begins[b])).tolist()
            raw_a, raw_b = a.tobytes(), b.tobytes()
            both = zip(some, begins_a, [*begins_a[1:], len(raw_a)], begins_b, [*begins_b[1:], len(raw_b)], strict=True)
            fresh.update([(w, (raw_a[p:q], raw_b[s:t])) for w, p, q, s, t in both])
        return fresh

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides, none where either's bytes are not those of the blank and the text."""
        none = np.zeros(0, dtype=np.int32)
        if not text:
            return none, none
        if text[0] == " " or text[-1] == " " or pretokens.BLANK in text or BETWEEN.search(text):
            a, b, same = self._whole(text)
            return (a, b) if same else (none, none)
        words = text.split(" ")
        got = list(map(self.known.get, words))
        if None in got:
            fresh = self._learn(list({w for w, x in zip(words, got, strict=True) if x is None}))
            if fresh is None:
                return none, none
            got = [fresh[w] if x is None else x for w, x in zip(words, got, strict=True)]
            if self.kept < WORD_BYTES:
                keep = {w: x for w, x in fresh.items() if len(w) <= pretokens.LONG}
                self.known.update(keep)
                self.kept += sum(len(w) + len(x) + len(y) + ENTRY for w, (x, y) in keep.items())
        return tuple(np.frombuffer(b"".join([x[side] for x in got]), dtype=np.int32) for side in (0, 1))

    def read(self, text: str | None) -> tuple[tuple, np.ndarray, np.ndarray]:
        """Facts, distinct id pairs and how often each is linked."""
        a, b = self.tokens(text)
        if not len(a):
            return (0, 0, 0, 0, ""), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        straight, irregular, li, lj = runs(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        i, j = stretched(straight)
        wide = a.astype(np.int64) << 32
        single = wide[i] | b[j]
        pairs, times = np.unique(np.concatenate([single, wide[li] | b[lj]]) if li else single, return_counts=True)
        said = spelled(a, b, single, straight, irregular, self.names)
        return (len(a), len(b), len(single) + len(irregular), len(single) + len(li), hashlib.sha256(said.encode()).hexdigest()), pairs, times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """A worker opens each pair of files once."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of docs."""
    if path_a is None or path_b is None:
        path_a, path_b = default_tokenizers()
    ws = Workspace(docs.sparkSession)
    only = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    laid = ws.cut(blocks.lay(only, lambda: aligner(path_a, path_b).read, "bigint", FACTS), "blocks", "zstd")
    asked = blocks.asked(laid)
    values = pair_values(ws, asked)
    answers = asked.join(values, F.col("key") == F.col("_k")).select("block", "pos", "best", "count")
    sums = blocks.summed(laid, answers, ["best", "count"], list(FACTS))
    return sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("best").alias("n_best"), F.col("count").alias("count_sum"), "groups_sha256")


def pair_values(ws: Workspace, asked: DataFrame) -> DataFrame:
    """Per id pair (``_k``: A's id, B's id in 32 bits each): its corpus-wide ``count``, and ``best``, 1 where no pair of its B id has more."""
    b = F.col("_k").bitwiseAND(F.lit(0xFFFFFFFF))
    counted = ws.cut(asked.groupBy(F.col("key").alias("_k")).agg(F.sum("total").alias("count")), "pairs")
    highest = F.broadcast(counted.groupBy(b.alias("_b")).agg(F.max("count").alias("most")))  # at most B's ids
    return counted.join(highest, b == F.col("_b")).select("_k", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
