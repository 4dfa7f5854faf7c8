"""Operator 5, token counts: batch encoding in Arrow functions that return lengths alone."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.tokens import by_bytes, load_tokenizer, tokenizer_path
from lattica.session import table

#: Bytes of text in one call of the tokenizer; a text that is longer makes a call of its own, in parts.
BATCH_BYTES = 1 << 20
#: Characters from which on a text is split.
LONG_CHARS = 1 << 16
#: Tokens from which on a document is over the limit.
LIMIT = 512

#: A single space between ASCII letters. The vocabulary's splitter always starts a word at
#: such a space, merges never cross words, and its added token holds no space, so the ids of
#: both sides stand alone.
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def split_long(text: str, chars: int = LONG_CHARS) -> list[str]:
    """Parts of at most about `chars` characters, cut at safe boundaries only; where none comes, a part stays long."""
    parts, at = [], 0
    while len(text) - at > chars:
        found = _SAFE.search(text, at + chars - 1)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of docs (doc_id, text).

    Rows come one for one: null ids and repeated rows stay, a null text counts as
    empty, an empty table gives none, other columns are left behind. Nothing is
    truncated; the added token's string in a text counts as that token. Batches
    hold about equal bytes, so no call grows with a long text's neighbours.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer)
        for batch in by_bytes(batches, BATCH_BYTES):
            parts: list[str] = []
            owner: list[int] = []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for part in split_long(text or ""):
                    parts.append(part)
                    owner.append(k)
            n = [0] * batch.num_rows
            for k, e in zip(owner, tok.encode_batch_fast(parts, add_special_tokens=False)):
                n[k] += len(e)
            tokens = pa.array(n, pa.int64())
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), sizes, tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select("doc_id", "text").mapInArrow(counts, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
