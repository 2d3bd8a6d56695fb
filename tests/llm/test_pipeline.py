from __future__ import annotations

import os
import zlib
from collections import Counter

import corpus_pipeline
from souk.llm import mixing, tokens, toxicity
from souk.llm.common import Workspace
from tests.llm.test_overlap import brute as brute_overlap
from tests.llm.test_packing import check
from tests.llm.test_substring import brute as brute_windows


def test_stages_on_the_smallest_table(spark, sf):
    docs, ws = spark.read.parquet(f"{sf}/documents.parquet"), Workspace(spark)
    names, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = ws.cut(stage(spark, docs, sf), "x")
        out[name] = (before, docs)
        assert name == "best-fit packing" or docs.columns == names
    before, after = out["toxicity"]
    kept = {r.doc_id for r in toxicity.toxic(before, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 0").collect()}
    assert {r.doc_id for r in after.collect()} == kept
    before, after = out["simhash near-dedup"]
    assert {r.doc_id for r in after.collect()} == {d for d, c in brute_overlap([(r.doc_id, r.text) for r in before.collect()]) if d == c}
    before, after = out["substring dedup"]
    want = {d: n - gone for d, n, gone, _ in brute_windows([(r.doc_id, r.text) for r in before.collect()]) if n > gone or not n}
    assert {r.doc_id: len((r.text or "").encode().split()) for r in after.collect()} == want
    before, after = out["mixing to targets"]
    copies = {r.doc_id: r.copies for r in mixing.rates(before, spark.read.parquet(f"{sf}/labels.parquet"), least=1.0).collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter(copies) and min(copies.values()) >= 1
    assert {r.doc_id for r in before.collect()} == set(copies)
    before, after = out["best-fit packing"]
    rows = after.collect()
    check(rows, 4096)
    texts = before.collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in texts)
    crc = {}
    for r in texts:
        ids = tokens.encode(r.text or "", tokens.default_tokenizer()) + b"\1\0\0\0"
        crc[r.doc_id] = [zlib.crc32(ids[4 * at : 4 * at + 4 * 4096]) for at in range(0, len(ids) // 4, 4096)]
    assert all(r.ids_crc32 == crc[r.doc_id][r.piece] for r in rows)


def test_stages_on_odd_tables(spark, sf, tmp_path):
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = ["", None, " \n", "a b c d e f", "a b c d e f", long, long + " end", "é ñ 中文", "x" * 50_000]
    rows = [(i if t != "é ñ 中文" else None, t, "en" if i % 2 else None, "s", 1) for i, t in enumerate(texts)] + [(5, long, "en", "s", 1)] * 2 + [((1 << 53) + 1, "big id", "fr", None, None)]
    docs = spark.createDataFrame([(*r, "_", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _gone string, doc int")
    spark.createDataFrame([(4, 1, 0), (5, 0, 0), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        ws, now = Workspace(spark), table
        for name, stage in corpus_pipeline.STAGES:
            now = ws.cut(stage(spark, now, str(tmp_path)), "x")
            assert name == "best-fit packing" or now.columns == docs.columns
        got = now.collect()
        assert not table.count() or {(1 << 53) + 1, None} <= {r.doc_id for r in got}
        check(got, 4096)


def test_run_gives_the_last_stage_and_leaves_one_table(spark, sf):
    from souk.llm import common

    mark = common.opened()
    rows = corpus_pipeline.run(spark, sf).collect()
    check(rows, 4096)
    assert len(rows) > 100 and common.opened() == mark + 1
    root = common._opened[-1].removeprefix("file://")
    assert [p for p in os.listdir(root) if "." not in p] == ["005-best-fit-packing"]
