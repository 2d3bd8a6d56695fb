from __future__ import annotations

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from souk.llm import packing, tokens


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_sweep_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(30):
        lengths = [rng.choice([rng.randint(1, 100), 37, rng.randint(1, 12)]) for _ in range(rng.randint(0, 400))]
        count = {n: lengths.count(n) for n in set(lengths)}
        matches, left, opened = packing.sweep(count, {}, 100)
        assert opened == best_fit_decreasing(lengths, 100)
        assert sum(100 * n - g * n for _, _, n, g in left) == sum(lengths)


def test_supersteps_match_sequential(spark):
    rng = random.Random(2)
    lengths = [rng.choice([64, rng.randint(1, 64), rng.randint(1, 9), 7]) for _ in range(600)]
    df = spark.createDataFrame([(i // 2, i % 2, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    rows = packing.pack(df, 64).collect()
    assert len(rows) == 600 and check(rows, 64) == best_fit_decreasing(lengths, 64)


def test_whole_table_and_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(docs, with_ids=True).collect()
    t = Tokenizer.from_file(tokens.default_tokenizer())
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    for r in rows:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and r.ids == part
        assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    assert check(rows, 4096) == best_fit_decreasing([r.length for r in rows if r.length < 4096], 4096) + sum(r.length == 4096 for r in rows)


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    got = packing.sequences(packing.pack_documents(df, with_ids=True)).collect()
    assert len(got) == 1 and len(got[0].ids) == 6 and got[0].ids.count(1) == 2


def test_edges(spark):
    odd = "Don't <|endoftext|>x y\tz\u0085 é́ Σας 12 a\rb  \n\n,,. é \x1c Ω."
    rows = [(1, None), (2, ""), (3, odd), (3, odd), (None, "w " * 9000)]
    df = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, length int")
    got = packing.pack_documents(df).collect()
    assert check(got, 4096) == 3
    t = Tokenizer.from_file(tokens.default_tokenizer())
    assert {r.length for r in got if r.doc_id == 3} == {len(t.encode(odd, add_special_tokens=False).ids) + 1}
    assert np.frombuffer(tokens.encode(odd, tokens.default_tokenizer()), "<u4").tolist() == t.encode(odd, add_special_tokens=False).ids
    assert sorted(r.length for r in got if r.doc_id is None) == [809, 4096, 4096]
    assert packing.pack_documents(df.limit(0)).collect() == []


def distributed_sweep(lengths, capacity=4096):
    """(rounds, sequences) of a sweep in which every gap takes one guest a round: what range-partitioned tasks could do.

    Longest first, each piece takes the least gap that holds it and is not taken yet in
    this round; where there is none but a taken one would do, it waits; else it opens a sequence.
    """
    import bisect

    left, gaps, rounds = sorted(lengths, reverse=True), [], 0
    while left:
        rounds += 1
        free, taken, wait = gaps, [], []
        for n in left:
            at = bisect.bisect_left(free, n)
            if at < len(free):
                bisect.insort(taken, free.pop(at) - n)
            elif taken and taken[-1] >= n:
                wait.append(n)
            else:
                bisect.insort(taken, capacity - n)
        gaps, left = sorted(free + taken), wait
    return rounds, len(gaps)


def test_a_sweep_in_tasks_takes_many_rounds(spark):
    """Why the classes' sweep is not distributed: as few sequences, but dozens of rounds of several jobs each."""
    from souk.llm import tokens

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lengths = [r.length for r in tokens.pieces(docs).select("length").collect()]
    rounds, sequences = distributed_sweep(lengths)
    own = packing.pack_documents(docs).select("sequence_id").distinct().count()
    assert rounds > 20 and own <= sequences


def test_the_plan_is_bounded_by_classes():
    """The worst of many random tables stays far below the bound that ``sweep`` states."""
    import random

    dice = random.Random(1)
    for _ in range(20):
        lengths = {n: dice.randint(1, 10**6) for n in dice.sample(range(1, 513), 400)}
        gaps = {n: dice.randint(1, 10**6) for n in dice.sample(range(1, 4097), 3000)}
        matches, _, _ = packing.sweep(lengths, gaps, 4096)
        assert len(matches) <= 13 * (len(gaps) + 3 * len(lengths))


def test_other_tokenizer_files_are_refused(spark):
    import public_tokenizers
    import pytest

    from souk.llm import tokens

    with pytest.raises(ValueError):
        tokens.encode("Some Text", public_tokenizers.path("byte_bpe_50k.json"))
