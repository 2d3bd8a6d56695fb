"""Substring deduplication by recompression: remove words of long passages that stand earlier in the corpus.

A window is ``window`` consecutive words of one document. A word goes if some
window that covers it also starts earlier: in a smaller document id, or earlier
in the same document. Windows are judged on the input.

1. *Recompression.* A document is a string of word symbols. A first round names
   maximal runs of one symbol; each further round cuts the alphabet in two by a
   bit of the symbols' hashes and names each left-right pair. A name is a 64-bit
   hash of what it stands for, so every task gives equal substrings the same
   names without exchanging dictionaries. Each symbol carries the range of words
   that decided it; inside any copy of that range the same symbol appears. (Runs
   of later symbols are left alone: telling where such a run ends needs context
   that a window seldom holds.)
2. *Anchors.* Among the symbols whose deciding range lies in a window, its
   highest one (most words, then smallest name, then leftmost) is its anchor;
   equal windows have equal anchors at equal places. Neighbouring windows share
   one, so a row stands for some ten windows: anchor name, a hash of the whole
   context its windows cover, document, first window, number of windows. A
   window without such a symbol is its own anchor.
3. *Reveal.* Only anchors named more than once in the corpus can stand for
   repeats; the others' rows go no further.
4. *Verify.* Rows equal in anchor and context, two independent hashes of 64 bits
   each, the latter of all words that their windows cover, repeat each other
   wholly: all but the first go. Where an anchor meets several contexts (the ends of a repeated
   passage, edited copies), the windows of each context's first row are compared
   one by one, by anchor and a 64-bit hash of the window's words, on the texts.

Skew: every grouping is a count or a minimum that combines before the shuffle,
and every way back to the rows is a plain join of
written tables, which Spark splits where a key is hot. Nothing but row counts reaches
the driver. No task runs two Python functions.

Edge cases: a null text has no words; a document without words keeps the digest
of the empty string; rows that repeat an id are told apart by their text, and
equal (id, text) rows share one result; null ids sort first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Workspace, by_columns, by_text, listed, words

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
BASE = 0xD6E8FEB86659FD93
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
BATCH_WORDS = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * K2
    x = (x ^ (x >> np.uint64(29))) * K3
    return x ^ (x >> np.uint64(32))


def symbols(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))


def recompress(word: np.ndarray, gap: np.ndarray, rounds: int) -> tuple[np.ndarray, ...]:
    """Names, first words, one past the last words, and deciding ranges [lo, hi) after the rounds.

    word: symbols of all documents in turn, with one slot where ``gap`` is true
    before, between and after them; such a slot joins nothing.
    """
    n = len(word)
    # runs of one token
    new = np.ones(n, dtype=bool)
    new[1:] = (word[1:] != word[:-1]) | gap[1:] | gap[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    size = end - start
    name = word[start]
    name = np.where(size > 1, mix(name * K1 + size.astype(np.uint64)), name)
    edge = gap[start]
    lo, hi = np.maximum(start - 1, 0), np.minimum(end + 1, n)  # one word on either side shows that the run ends
    for r in range(rounds):
        salt = np.uint64((r + 1) * int(K1) & 0xFFFFFFFFFFFFFFFF)
        left = (mix(name + salt) & np.uint64(1)).astype(bool) & ~edge
        right = ~left & ~edge
        pair = np.zeros(len(name), dtype=bool)
        pair[:-1] = left[:-1] & right[1:]
        second = np.zeros(len(name), dtype=bool)
        second[1:] = pair[:-1]
        # a left symbol looks at its right neighbour, a right one at its left
        nlo, nhi = lo.copy(), hi.copy()
        nhi[:-1] = np.where(left[:-1], np.maximum(hi[:-1], hi[1:]), hi[:-1])
        nlo[:-1] = np.where(left[:-1], np.minimum(lo[:-1], lo[1:]), lo[:-1])
        nlo[1:] = np.where(right[1:], np.minimum(nlo[1:], lo[:-1]), nlo[1:])
        nhi[1:] = np.where(right[1:], np.maximum(nhi[1:], hi[:-1]), nhi[1:])
        keep = ~second
        at = np.flatnonzero(keep)
        p = pair[at]
        nxt = np.minimum(at + 1, len(name) - 1)
        name, end2 = np.where(p, mix(mix(name[at] * K1 + np.uint64(r)) + name[nxt] * K3), name[at]), np.where(p, end[nxt], end[at])
        start, end, lo, hi, edge = start[at], end2, nlo[at], nhi[at], edge[at]
    return name, start, end, lo, hi


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, np.uint64(BASE))
    down = np.full(n, np.uint64(pow(BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sums(word: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(word) + 1, dtype=np.uint64)
    np.cumsum(word * up[: len(word)], dtype=np.uint64, out=out[1:])
    return out


def anchors(word: np.ndarray, gap: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """Per anchor place: name, context hash, first window, number of windows (places in ``word``)."""
    n = len(word)
    name, start, end, lo, hi = recompress(word, gap, rounds)
    size = end - start
    fits = (hi - lo <= window) & ~gap[start]
    # keys ordered by size (longest first), then by name
    key = np.full(n, NONE)
    key[start[fits]] = ((np.uint64(63) - np.minimum(size[fits], 62).astype(np.uint64)) << np.uint64(58)) | (name[fits] >> np.uint64(6))
    low, high = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    low[start], high[start] = lo, hi
    total = np.zeros(n, dtype=np.uint64)
    total[start] = name
    free = np.concatenate(([0], np.cumsum(gap)))
    m = n - window + 1
    if m <= 0:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    s = np.arange(m)
    best, where = np.full(m, NONE), np.full(m, -1, dtype=np.int64)
    for j in range(window):
        k = key[j : j + m]
        better = (k < best) & (low[j : j + m] >= s) & (high[j : j + m] <= s + window)
        best[better] = k[better]
        where[better] = s[better] + j
    ok = free[window:] == free[:m]  # no slot between documents inside
    s, where = s[ok], where[ok]
    up, down = _powers(n + 1)
    sums = _sums(word, up)
    alone = where < 0
    where = np.where(alone, -1 - s, where)
    new = np.ones(len(s), dtype=bool)
    new[1:] = (where[1:] != where[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    s0, at = s[first], where[first]
    own = at < 0
    span = mix((sums[s0 + count + window - 1] - sums[s0]) * down[s0])
    a = np.where(own, mix(span), total[np.maximum(at, 0)])
    c = mix(span + mix(np.where(own, 0, at - s0).astype(np.uint64) * K1 + count.astype(np.uint64)))
    return a, c, s0, count


def _row_key() -> F.Column:
    return F.xxhash64("doc_id", "text")


def _lay(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words' symbols with slots around each document, the slots, and each document's first place."""
    n = sum(map(len, texts)) + len(texts) + 1
    word, gap, begin, at = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool), [], 0
    for w in texts:
        gap[at] = True
        begin.append(at + 1)
        word[at + 1 : at + 1 + len(w)] = symbols(w)
        at += len(w) + 1
    gap[at] = True
    return word, gap, np.array(begin, dtype=np.int64)


def _anchor_rows(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """``doc_id, k, a, c, s, n`` per anchor place; texts are laid together some ``BATCH_WORDS`` words at a time."""

    def each(texts):
        ends, parts = np.zeros(len(texts) + 1, dtype=np.int64), []
        rows, held, n = [], [], 0

        def some():
            word, gap, begin = _lay(held)
            a, c, s0, count = anchors(word, gap, window, rounds)
            d = np.searchsorted(begin, s0, side="right") - 1
            np.add.at(ends, np.array(rows, dtype=np.int64)[d] + 1, 1)
            parts.append((a.view(np.int64), c.view(np.int64), (s0 - begin[d]).astype(np.int32), count.astype(np.int8)))

        for i, t in enumerate(texts):
            w = words(t)
            if len(w) < window:
                continue
            rows.append(i)
            held.append(w)
            n += len(w)
            if n >= BATCH_WORDS:
                some()
                rows, held, n = [], [], 0
        if held:
            some()
        a, c, s, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=k) for k in (np.int64, np.int64, np.int32, np.int8))
        return listed(np.cumsum(ends), a=pa.array(a), c=pa.array(c), s=pa.array(s), n=pa.array(n))

    found = by_text(each, "array<struct<a:bigint,c:bigint,s:int,n:tinyint>>")("text")
    return docs.select("doc_id", _row_key().alias("k"), F.explode(found).alias("e")).select("e.a", "e.c", "doc_id", "k", "e.s", "e.n")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, row key and text."""
    return docs.select("doc_id", _row_key().alias("k"), "text")


def _dealt(df: DataFrame, *names: str) -> DataFrame:
    """df's ``names`` beside ``rk, rd, rn``, which tell a row of docs and are never null: grouping and joining by these deals rows out once."""
    return df.select(F.col("k").alias("rk"), F.coalesce("doc_id", F.lit(0)).alias("rd"), F.col("doc_id").isNull().alias("rn"), *names)


def _with_text(texts: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    return texts.join(marks, (texts["k"] == marks["mk"]) & texts["doc_id"].eqNullSafe(marks["md"]), how)


def repeated(docs: DataFrame, window: int = 20, rounds: int = 4, ws: Workspace | None = None) -> DataFrame:
    """Non-first windows: ``doc_id``, row key ``k``, first window ``s``, number of windows ``n`` from there on.

    Equal rows of docs give equal rows here: marks are to be gathered as a set.
    """
    ws = ws or Workspace(docs.sparkSession)
    rows = _anchor_rows(docs, window, rounds)
    every = rows = ws.cut(rows, "anchors")
    shared = rows.groupBy("a").agg(F.count("*").alias("m")).where("m > 1").select(F.col("a").alias("sa"))
    shared = ws.cut(shared, "names")
    rows = ws.cut(rows.join(shared, rows["a"] == F.col("sa"), "left_semi"), "shared")
    ws.drop(every, shared)  # written on as far as they matter
    place = F.struct("doc_id", "k", "s")
    classes = ws.cut(rows.groupBy("a", "c").agg(F.min(F.struct("doc_id", "k", "s", "n")).alias("f")), "contexts")
    heads = classes.select(F.col("a").alias("ha"), F.col("c").alias("hc"), F.struct("f.doc_id", "f.k", "f.s").alias("head"))
    later = rows.join(heads, (rows["a"] == F.col("ha")) & (rows["c"] == F.col("hc"))).where(~place.eqNullSafe(F.col("head"))).select("doc_id", "k", "s", "n")
    later = ws.cut(later, "later")
    ws.drop(rows)
    several = classes.groupBy("a").agg(F.count("*").alias("m")).where("m > 1").select(F.col("a").alias("sa"))
    several = ws.cut(several, "several")
    firsts = classes.join(several, classes["a"] == F.col("sa"), "left_semi").select("a", "f.*")
    asked = _dealt(firsts, "a", "s", "n").groupBy("rk", "rd", "rn").agg(F.collect_list(F.struct("a", "s", "n")).alias("asks"))
    asked = asked.select("rk", "rd", "rn", F.col("asks.a").alias("aa"), F.col("asks.s").alias("ss"), F.col("asks.n").cast("array<int>").alias("nn"))

    def compare(text, aa, ss, nn):
        ends, out = [0], []
        for t, names, starts, sizes in zip(text.to_pylist(), aa.to_pylist(), ss.to_pylist(), nn.to_pylist(), strict=True):
            word = symbols(words(t))
            up, down = _powers(len(word) + 1)
            sums = _sums(word, up)
            n = np.asarray(sizes, dtype=np.int64)
            s = np.repeat(np.asarray(starts, dtype=np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = mix((sums[s + window] - sums[s]) * down[s]).view(np.int64)
            out.append((np.repeat(np.asarray(names, dtype=np.int64), n), w, s.astype(np.int32)))
            ends.append(ends[-1] + len(s))
        a, w, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=k) for k in (np.int64, np.int64, np.int32))
        return listed(ends, a=pa.array(a), w=pa.array(w), s=pa.array(s))

    found = by_columns(compare, "array<struct<a:bigint,w:bigint,s:int>>")("text", "aa", "ss", "nn")
    # the texts move once: repeated rows go where they are read or where their copies meet, and the join needs no other place
    met = _dealt(_texts(docs), "doc_id", "text").dropDuplicates(["rk", "rd", "rn"]).join(asked, ["rk", "rd", "rn"])
    single = met.select("doc_id", F.col("rk").alias("k"), F.explode(found).alias("e")).select("e.a", "e.w", "doc_id", "k", "e.s")
    single = ws.cut(single, "windows")
    ws.drop(several)
    least = single.groupBy("a", "w").agg(F.min(place).alias("head"), F.count("*").alias("m")).where("m > 1").select(F.col("a").alias("ha"), F.col("w").alias("hw"), "head")
    least = ws.cut(least, "least")
    more = single.join(least, (single["a"] == F.col("ha")) & (single["w"] == F.col("hw"))).where(~place.eqNullSafe(F.col("head"))).select("doc_id", "k", "s", F.lit(1).cast("byte").alias("n"))
    return later.unionByName(more)


def _marks(docs: DataFrame, window: int, rounds: int = 4) -> DataFrame:
    """``md, mk, ss, nn``: per row of docs with non-first windows, their places and numbers; the only table left of the search."""
    ws, work = Workspace(docs.sparkSession), Workspace(docs.sparkSession)
    marks = repeated(docs, window, rounds, work).groupBy(F.col("doc_id").alias("md"), F.col("k").alias("mk")).agg(F.collect_set(F.struct("s", "n")).alias("p"))
    marks = ws.cut(marks.select("md", "mk", F.col("p.s").alias("ss"), F.col("p.n").cast("array<int>").alias("nn")), "marks")
    work.close()
    return marks


def cover(n_words: int, starts, sizes, window: int) -> np.ndarray:
    """True for each word that a marked window covers; starts: None where there is none."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    if starts is not None:
        s = np.asarray(starts, dtype=np.int64)
        np.add.at(step, s, 1)
        np.add.at(step, s + np.asarray(sizes, dtype=np.int64) + window - 1, -1)
    return np.cumsum(step[:-1]) > 0


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, rounds: int = 4, output: str = "digest") -> DataFrame:
    """Per row of docs: ``doc_id, n_words, n_removed`` and the kept words.

    output: ``digest`` adds ``kept_sha256`` of the kept words joined by a space;
    ``text`` adds ``kept_text``, where removed words go with the white space
    before them and the rest of the text stays as it is (a null text stays null).
    """
    only = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    marks = _marks(only, window, rounds)

    def finish(text, ss, nn):
        out = []
        for t, starts, sizes in zip(text.to_pylist(), ss.to_pylist(), nn.to_pylist(), strict=True):
            raw = (t or "").encode("utf-8", "surrogatepass")
            w = raw.split()
            gone = cover(len(w), starts, sizes, window)
            if output == "digest":
                kept = hashlib.sha256(b" ".join([v for v, g in zip(w, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(w)).hexdigest()
            else:
                kept = without(raw, w, gone).decode("utf-8", "surrogatepass")
            out.append((len(w), int(gone.sum()), kept))
        n, gone, kept = zip(*out, strict=True) if out else ((),) * 3
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])

    done = by_columns(finish, "struct<n_words:bigint,n_removed:bigint,kept:string>")("text", "ss", "nn")
    kept = _with_text(_texts(only), marks, "left").select("doc_id", done.alias("m")).select("doc_id", "m.*")
    return kept.withColumnRenamed("kept", "kept_sha256" if output == "digest" else "kept_text")


def without(raw: bytes, w: list[bytes], gone: np.ndarray) -> bytes:
    """raw without the marked words and the white space before each; untouched where none is marked."""
    if not gone.any():
        return raw
    out, at, held = [], 0, 0
    for v, g in zip(w, gone.tolist(), strict=True):
        begin = raw.index(v, at)
        if g:
            out.append(raw[held:at])
            held = begin + len(v)
        at = begin + len(v)
    out.append(raw[held:])
    kept = b"".join(out)
    return kept.lstrip() if gone[0] else kept


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """docs with removed words taken out of the text; rows left without a word go, unless they had none before.

    Edge cases are those of the module; all columns, of any name, stay as they are but for the text.
    """
    only = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    marks = _marks(only, window)

    def finish(text, ss, nn):
        out = []
        for t, starts, sizes in zip(text.to_pylist(), ss.to_pylist(), nn.to_pylist(), strict=True):
            if starts is None or t is None:
                out.append((t, True))
                continue
            raw = t.encode("utf-8", "surrogatepass")
            w = raw.split()
            gone = cover(len(w), starts, sizes, window)
            out.append((without(raw, w, gone).decode("utf-8", "surrogatepass"), not gone.all()))
        return pa.StructArray.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([k for _, k in out], pa.bool_())], ["text", "keep"])

    # docs' columns travel in a struct of their own, so names never clash
    laid = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), only_key(docs, id_col, text_col).alias("k"), docs[id_col].cast("long").alias("d"))
    met = laid.join(marks, (F.col("k") == F.col("mk")) & F.col("d").eqNullSafe(F.col("md")), "left")
    text = F.col("doc").getField(text_col)
    # said to be nondeterministic, as the filter on ``keep`` would otherwise be pushed below and call it twice
    new = by_columns(finish, "struct<text:string,keep:boolean>").asNondeterministic()(text, "ss", "nn")
    columns = lambda t: [t.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns]
    whole = met.where("ss is not null").select("doc", new.alias("new")).where("new.keep").select(*columns(F.col("new.text")))
    return met.where("ss is null").select("doc.*").unionByName(whole)


def only_key(docs: DataFrame, id_col: str, text_col: str) -> F.Column:
    """:func:`_row_key` under docs' own names."""
    return F.xxhash64(docs[id_col].cast("long"), docs[text_col])
