"""Token counts of whole texts, without their ids: pieces are counted once per distinct pre-token.

1. Per document, how often each of its pre-tokens stands in it (:mod:`souk.llm.blocks`).
2. Each distinct pre-token of the corpus is encoded once, and only the number of its pieces is kept: the
   blocks' pre-tokens are dealt by their text and sorted, so that equal ones stand together. They are as
   many rows as blocks have different pre-tokens, of which none is hot.
3. The numbers go with these rows, so that the join needs no exchange of its own, back to the documents'
   frequencies, and are summed.

The counts are those of the library: tokenizers for ``.json``, sentencepiece for
``.model``, special tokens' strings in a text as its default has them, nothing added.

Edge cases: null and empty texts have no tokens; rows that repeat are counted each;
a null id keeps its row; very long texts and pre-tokens are counted whole; an empty
table gives no rows; of docs only the two named columns are read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm import blocks, pretokens
from souk.llm.common import Workspace


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def counted(asked: DataFrame, path: str) -> DataFrame:
    """``block, pos, pieces`` of ``block, pos, key``: equal keys meet in one task, in a row, and are encoded once there."""

    def run(batches):
        of, last, n = pretokens.reader(path), None, 0
        for batch in batches:
            keys = batch.column(2).to_pylist()
            new = [k for k, before in zip(keys, [last, *keys[:-1]], strict=True) if k != before]
            found = iter([len(ids) for ids in of.encode(new)] if new else [])
            out = []
            for k in keys:
                if k != last:
                    last, n = k, next(found)
                out.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["block", "pos", "pieces"])

    return asked.repartition("key").sortWithinPartitions("key").select("block", "pos", "key").mapInArrow(run, "block bigint, pos int, pieces bigint")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of docs."""
    path = path or default_tokenizer()
    ws = Workspace(docs.sparkSession)

    def reading():
        of = pretokens.reader(path)

        def read(text):
            parts, specials = of.pretokens(text) if text else ([], 0)
            n = Counter(parts)
            return (len(text.encode("utf-8", "surrogatepass")) if text else 0, specials), list(n), list(n.values())

        return read

    laid = ws.cut(blocks.lay(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), reading, "string", {"n_bytes": "bigint", "specials": "bigint"}), "blocks", "zstd")
    sums = blocks.summed(laid, counted(blocks.asked(laid), path), ["pieces"], ["n_bytes", "specials"], small=True)
    n = F.col("pieces") + F.col("specials")
    return sums.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
