"""Token counts: batch encoding in Arrow functions which return lengths only.

Batches are balanced by bytes, not rows, and a long text is split at safe boundaries first, so one very long
document neither forms one huge call nor changes its count.

Defined cases: null text is empty; an empty text has 0 tokens; repeated rows are counted each; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 19
SPLIT_BYTES = 1 << 15

#: A cut before white space that follows an ASCII letter or digit, and before a non-space, lies between two
#: pre-tokens, on whatever side one looks: no pre-token has a space behind its first character, and a run of
#: white space is judged by what follows it alone.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z0-9])")
_CACHE: dict = {}


def safe_pieces(text: str, most: int = SPLIT_BYTES) -> list[str]:
    """The text in pieces of about ``most`` characters whose token counts add up to the text's."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        m = _SAFE.search(text, at + most)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def tokenizer(path: str):
    """One per Python worker.  .json: tokenizers; .model: sentencepiece.  Returns texts -> counts."""
    if path not in _CACHE:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _CACHE[path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _CACHE[path] = lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    return _CACHE[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of docs."""
    split = path.endswith(".json")

    def run(batches):
        count = tokenizer(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            totals, held, owner, size = [0] * len(texts), [], [], 0

            def flush(totals=totals):
                for k, n in zip(owner, count(held), strict=True):
                    totals[k] += n
                held.clear()
                owner.clear()

            for k, t in enumerate(texts):
                for piece in safe_pieces(t) if split else [t]:
                    held.append(piece)
                    owner.append(k)
                    size += len(piece.encode())
                    if size >= BATCH_BYTES:
                        flush()
                        size = 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
