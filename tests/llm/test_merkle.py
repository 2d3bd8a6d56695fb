from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from souk.llm import merkle


def slow_tree(text):
    """The tree as nested lists of (digest, bytes, children), written apart from the library."""
    new = lambda kind, body: hashlib.blake2b(kind + body, digest_size=16).digest()

    def up(kind, below):
        return new(kind, b"".join(d for d, _, _ in below)), sum(n for _, n, _ in below), below

    def leaf(x):
        if len(x) <= 96:
            return new(b"L", x), len(x), []
        parts, at = [], 0
        for i in range(1, len(x) + 1):
            h = 0
            if i >= 4:
                for byte, k in zip(x[i - 4 : i], (0x27D4EB2F, 0xC2B2AE3D, 0x85EBCA77, 0x9E3779B1)):
                    h = (h + byte * k) & 0xFFFFFFFF
            if i == len(x) or i - at == 256 or (i >= 4 and (h >> 16) % 24 == 0):
                parts.append(x[at:i])
                at = i
        return up(b"C", [(new(b"L", c), len(c), []) for c in parts])

    raw = (text or "").encode()
    return up(b"T", [up(b"S", [up(b"P", [leaf(x) for x in re.split(rb"(?<=[.,;:!?|dns]) ", p)]) for p in sec.split(b"\n")]) for sec in raw.split(b"\n\n")])


def slow_likeness(a, b):
    """Twice the bytes of branches in both, level by level, over the bytes of both."""
    if a[0] == b[0]:
        return 1.0
    both, left, right = 0, a[2], b[2]
    while left and right:
        common = Counter(d for d, _, _ in left) & Counter(d for d, _, _ in right)
        size = {d: n for d, n, _ in left}
        both += sum(size[d] * k for d, k in common.items())

        def rest(nodes):
            have, out = Counter(common), []
            for d, _, below in nodes:
                if have[d]:
                    have[d] -= 1
                else:
                    out += below
            return out

        left, right = rest(left), rest(right)
    return 2 * both / (a[1] + b[1]) if a[1] + b[1] else 0.0


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        a, b, c = slow_tree(t), slow_tree(e), slow_tree(nxt)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a[0].hex(), b[0].hex(), slow_likeness(a, b), slow_likeness(a, c)))
    return out


def got(df):
    return sorted((tuple(r) for r in merkle.edited_and_next(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = got(docs)
    assert rows == brute([(r.doc_id, r.text) for r in docs.collect()])
    longer = [r for r in rows if r[1] > 400]
    assert sum(r[5] > 0.35 for r in longer) > 0.95 * len(longer) and sum(r[5] > r[6] for r in longer) > 0.9 * len(longer)


@pytest.mark.parametrize("n", [0, 1, 2, 30])
def test_edges(spark, n):
    texts = ["", None, "é" * 5, "a. b\n\nc\nd", "a. b\n\nc\nd", "x" * 100_000]
    rows = [(None if i == 7 else 3 * i, texts[i % 6]) for i in range(n)]
    df = spark.createDataFrame([(d, t, 1, b"") for d, t in rows], "doc_id long, text string, bucket int, z binary").repartition(5)
    assert got(df) == brute(rows)


def test_repeated_ids_do_not_lose_rows(spark):
    df = spark.createDataFrame([(i // 3, "t") for i in range(60)], "doc_id long, text string")
    assert len(got(df)) == 60


def test_roots_and_edits():
    a, b = "one. two\nthree\n\nfour. five", "one. two\nthree\n\nfour. six"
    x, y = merkle.tree(a), merkle.tree(b)
    assert x.digest != y.digest and merkle.tree(a).digest == x.digest
    assert merkle.edits(x, y) == [(1, 0, 1)] and merkle.edits(x, x) == []
    assert merkle.edits(x, merkle.tree("one. two\nthree")) == [(1, -1, -1)]
    assert merkle.likeness(x, x) == 1 and 0.7 < merkle.likeness(x, y) < 1
    assert merkle.likeness(merkle.tree(""), merkle.tree("a")) == 0
    assert merkle.tree("a\n\nb").digest != merkle.tree("a\n b").digest != merkle.tree("a b").digest


def test_tree_columns(spark):
    r = merkle.fingerprints(spark.createDataFrame([(1, "a\nb\n\nc")], "doc_id long, text string")).first()
    assert r.fingerprint == merkle.tree("a\nb\n\nc").digest.hex() and [len(s.paragraphs) for s in r.sections] == [2, 1]


@pytest.mark.parametrize("start", [1 << 60, (1 << 63) - 700])
def test_large_ids_keep_every_row(spark, start):
    rows = [(start + 7 * i, f"text {i}. more") for i in range(100)] + [(None, "no id")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_text_without_blanks_has_likeness_too():
    rng = random.Random(3)
    t = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(1000))
    other = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(500))
    one, half = merkle.tree(t[:400] + "x" + t[401:]), merkle.tree(t[:500] + other)
    assert merkle.likeness(merkle.tree(t), one) > 0.9 and merkle.likeness(merkle.tree(t), half) > 0.4
    assert b"".join(merkle.chunks(t.encode())) == t.encode() and max(map(len, merkle.chunks(b"y" * 9999))) <= merkle.CHUNK


def test_ids_beyond_doubles_stay_beside_nulls(spark):
    ids = [(1 << 53) + 1, (1 << 53) + 3, None]
    df = spark.createDataFrame([(d, f"t {d}") for d in ids], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in merkle.fingerprints(df).collect()} == set(ids) == {r[0] for r in got(df)}
