"""Token alignment against byte ranges compared one by one."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from souk.llm import align, blocks, pretokens, queries

from .test_counts import ODD


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60).flatmap(lambda n: st.tuples(st.sets(st.integers(1, n)), st.sets(st.integers(1, n)), st.just(n))))
def test_runs_and_groups_of_any_arrays(case):
    a, b, n = case
    ea, eb = (np.array(sorted(x | {n})) for x in (a, b))
    check_runs(ea, eb)


def check_runs(ea, eb):
    straight, irregular, oi, oj = align.runs(ea, eb)
    common = sorted(set(ea.tolist()) & set(eb.tolist()))
    groups = [(i + k + 1, j + k + 1) for i, j, n in straight for k in range(n)] + [(i1, j1) for _, i1, _, j1 in irregular]
    assert sorted(int(ea[i - 1]) for i, _ in groups) == common == sorted(int(eb[j - 1]) for _, j in groups)
    li, lj = (np.concatenate([x, np.array(y, dtype=np.int64)]).tolist() for x, y in zip(align.stretched(straight), (oi, oj)))
    sa, sb = np.append(0, ea[:-1]), np.append(0, eb[:-1])
    want = {(i, j) for i in range(len(ea)) for j in range(len(eb)) if max(sa[i], sb[j]) < min(ea[i], eb[j])}
    assert len(li) == len(want) and set(zip(li, lj)) == want


def test_long_stretches_with_a_difference_anywhere():
    for n in (1, 2, 3, 63, 64, 65, 300):
        for at in {0, min(1, n - 1), n // 2, n - 1}:
            ends = np.arange(1, n + 1) * 3
            check_runs(ends, ends)
            check_runs(np.sort(np.append(ends, at * 3 + 1)), ends)
            check_runs(np.sort(np.append(ends, at * 3 + 1)), np.sort(np.append(ends, at * 3 + 2)))


def test_ids_by_word_are_the_ids_of_the_text():
    """Texts of all sorts of blanks, whole and word by word."""
    import random

    dice, al = random.Random(8), align.Aligner(*align.default_tokenizers())
    bits = ["it's", "a", " ", " ", " ", "\n", "\t", "x1.", "...", "é", "\u00a0", "\u3000", "\r\n", "4", "'", "日本", "▁"]
    for _ in range(1500):
        text = "".join(dice.choice(bits) for _ in range(dice.randint(1, 12)))
        a, b, same = al._whole(text)
        got = al.tokens(text)
        assert (got[0].tolist(), got[1].tolist()) == ((a.tolist(), b.tolist()) if same else ([], [])), repr(text)


def brute(docs):
    """The contract over (doc_id, text): every A token against every B token that can overlap."""
    path_a, path_b = align.default_tokenizers()
    ta, tb = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    ta.encode_special_tokens = True
    chars = pretokens.byte_of()
    per, counts = [], Counter()
    for doc_id, text in docs:
        a, b, ends = [], [], ([], [])
        if text:
            a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            va = [bytes(chars[c] for c in ta.id_to_token(i)) for i in a]
            vb = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(va) == b"".join(vb) == (" " + text).encode():
                a, b = [], []
            else:
                ends = tuple(np.cumsum([len(x) for x in v]).tolist() for v in (va, vb))
        links, groups, ga, gb, j0 = [], [], [], [], 0
        common = set(ends[0]) & set(ends[1])
        start = 0
        for i, e in enumerate(ends[0]):
            j = j0
            while j < len(b) and (ends[1][j - 1] if j else 0) < e:
                if ends[1][j] > start:
                    links.append((a[i], b[j]))
                if ends[1][j] <= e:
                    j0 = j + 1
                j += 1
            start = e
        ga = [[]]
        for i, e in zip(a, ends[0]):
            ga[-1].append(str(i))
            if e in common:
                ga.append([])
        gb = [[]]
        for i, e in zip(b, ends[1]):
            gb[-1].append(str(i))
            if e in common:
                gb.append([])
        groups = ";".join(",".join(x) + "|" + ",".join(y) for x, y in zip(ga[:-1], gb[:-1]))
        per.append((doc_id, len(a), len(b), len(common), links, hashlib.sha256(groups.encode()).hexdigest() if a else ""))
        counts.update(links)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(((d, na, nb, ng, len(ls), sum(counts[l] == most[l[1]] for l in ls), sum(counts[l] for l in ls), sha) for d, na, nb, ng, ls, sha in per), key=str)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.queries()["op12_token_alignment"](spark, sf).select(*NAMES).collect()), key=str)
    assert got == brute(docs)


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 40)
    docs = [(i, t) for i, t in ODD if i != 10] + [(20, "it's <0x41> <s> </s> it's"), (21, "ab" * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, n_a string")
    assert sorted((tuple(r) for r in align.aligned(df).select(*NAMES).collect()), key=str) == brute(docs)
    assert align.aligned(df.limit(0)).count() == 0


def test_groups_are_spelled_in_order_and_ids_come_as_bytes():
    a, b = align.np.arange(10, 17), align.np.arange(20, 28)
    straight, irregular = [(1, 2, 2), (5, 5, 1)], [(0, 1, 0, 2), (3, 5, 4, 5), (6, 7, 6, 8)]
    pairs = align.np.array([11 << 32 | 22, 12 << 32 | 23, 15 << 32 | 25])
    assert align.spelled(a, b, pairs, straight, irregular, align._Spelled()) == "10|20,21;11|22;12|23;13,14|24;15|25;16|26,27"
    for path in align.default_tokenizers():
        of = align.pretokens.reader(path)
        parts = [" word", " zzzqé中"]
        assert of.raw(parts) == [x.tobytes() for x in of.encode(parts)]
