"""Token counts against the libraries themselves."""

from __future__ import annotations

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from souk.llm import blocks, counts, pretokens, queries

ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n\n  x\n\n"), (5, "it's we'll I'M 'S ''s"), (6, "a<|endoftext|> b <|endoftext|><|endoftext|>"), (7, "<|endoftext"),
    (8, "é é ½ ４２ 日本語のテキスト \U0001F600\U0001F468‍\U0001F469"), (9, "՘a\U00018D10b \U00032400 ꟎x  y"), (10, "x" * 70_000), (11, " " * 5000 + "end"),
    (12, "　a  b c\x85d\x1ce"), (13, "a\x00b\tc\r\nd"), (None, "no id"), (3, " "), (14, "▁a ▁▁ b▁"), (15, "12345 6a7 ...!? (x)"), (16, "tail "),
]


def direct(texts, path):
    if path.endswith(".model"):
        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])]
    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, len(r.text.encode()), n, n > 1024) for r, n in zip(docs, direct([r.text for r in docs], counts.default_tokenizer()))}
    got = [tuple(r) for r in queries.queries()["op11_token_counts"](spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    assert len(got) == len(docs) and set(got) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_odd_texts(spark, name, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 40)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id bigint, text string, pieces string, block int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in counts.token_counts(df, path=P.path(name)).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(ODD, direct([t for _, t in ODD], P.path(name)))), key=str)
    assert got == want
    assert counts.token_counts(df.limit(0), path=P.path(name)).count() == 0


def test_pieces_are_counted_once_per_pretoken(spark, tmp_path):
    """Whatever the documents, a distinct pre-token is encoded once: the reader writes down what it is asked."""
    df = spark.createDataFrame([(i, f"same words here {i % 7}") for i in range(300)], "doc_id bigint, text string")
    laid = blocks.lay(df.repartition(6), lambda: lambda t: ((0,), list(dict.fromkeys(t.split(" "))), [1] * len(set(t.split(" ")))), "string", {"f": "bigint"})
    asked = blocks.asked(laid).cache()
    assert asked.count() == 6 * 10
    where = str(tmp_path)

    class Written:
        def encode(self, parts):
            import uuid

            with open(f"{where}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(parts))
            return [[0] * len(p) for p in parts]

    class Tokens:
        reader = staticmethod(lambda path: Written())

    keep, counts.pretokens = counts.pretokens, Tokens
    try:
        got = counts.counted(asked, "any").collect()
    finally:
        counts.pretokens = keep
    said = [w for f in tmp_path.iterdir() for w in f.read_text().split("\n")]
    assert sorted(said) == sorted({"same", "words", "here", *map(str, range(7))})
    keys = {(r.block, r.pos): r.key for r in asked.collect()}
    assert len(got) == len(keys) and all(r.pieces == len(keys[r.block, r.pos]) for r in got)


def test_a_file_of_another_kind_is_refused():
    with pytest.raises(ValueError):
        pretokens.reader(P.path("word_bpe_49k.json"))


def test_classes_of_characters_are_the_librarys():
    """Every code point between letters, digits and blanks: split as the library splits."""
    of = pretokens.ByteLevel(P.path("byte_bpe_50k.json"))
    for lo in range(0, 0x110000, 1 << 14):
        if 0xD800 <= lo < 0xE000 or lo >= 0x40000 and lo not in (0xE0000, 0x10C000):
            continue
        cs = [c for c in map(chr, range(lo, lo + (1 << 14))) if not 0xD800 <= ord(c) < 0xE000 and c not in of.odd]
        t = "".join(f"a{c}1{c}! {c}\n{c}" for c in cs)
        assert of.split(t) == [t[a:b] for _, (a, b) in of.tokenizer.pre_tokenizer.pre_tokenize_str(t)], hex(lo)


def test_steps_of_any_size():
    import numpy as np

    for steps in ([], [0, 1, 65534, 65535, 65536, 4_000_000_000, 3], [65535] * 3, list(range(65530, 65540))):
        assert blocks.unpacked(*blocks.packed(np.array(steps, dtype=np.int64))).tolist() == steps
