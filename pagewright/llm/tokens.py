"""Encoding and decoding of whole corpora with public byte-level tokenizers, in Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter of every function here.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Characters encoded at a time.
CHUNK = 1_000_000


@lru_cache(maxsize=2)
def tokenizer(folder: str, name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
    t.encode_special_tokens = True  # the names of special tokens are ordinary text
    t.no_padding()
    t.no_truncation()
    return t


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 bytes are themselves, the others follow from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {chr(b): b for b in own}
    table.update({chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(own))})
    return table


@lru_cache(maxsize=2)
def token_bytes(folder: str, name: str) -> dict[int, bytes]:
    """id -> bytes, by the reversed byte table."""
    table = byte_characters()
    return {i: bytes(table[c] for c in token) if all(c in table for c in token) else token.encode() for token, i in tokenizer(folder, name).get_vocab(with_added_tokens=True).items()}


def decode(ids: list[int], folder: str = VOCABULARIES, name: str = "byte_bpe_50k") -> str:
    """Text of a list of ids. A character may be split over ids, so bytes are joined before they are decoded; a character cut
    off at either end becomes U+FFFD."""
    table = token_bytes(folder, name)
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def offsets(text: str, ids: list[int], folder: str = VOCABULARIES, name: str = "byte_bpe_50k") -> list[tuple[int, int]]:
    """Characters [start, end) each id touches. Ids that share a split character touch the same one."""
    table = token_bytes(folder, name)
    owner = [n for n, c in enumerate(text) for _ in c.encode()]
    out, at = [], 0
    for i in ids:
        end = at + len(table[i])
        out.append((owner[at], owner[end - 1] + 1))
        at = end
    return out


def encode(df: DataFrame, ident: str, text: str, folder: str = VOCABULARIES, name: str = "byte_bpe_50k") -> DataFrame:
    """(ident, ids array<int>): the ids of every text without special tokens. Null and empty texts give an empty list; a text
    of any length is encoded whole; repeated rows stay repeated."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = tokenizer(folder, name)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids: list = []
            start = size = 0
            for i, x in enumerate(texts):
                size += len(x)
                if size >= CHUNK or i == len(texts) - 1:
                    ids += [e.ids for e in t.encode_batch_fast(texts[start : i + 1], add_special_tokens=False)]
                    start, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("ident"), pa.array(ids, pa.list_(pa.int32()))], names=["ident", "ids"])

    kind = df.schema[ident].dataType.simpleString()
    return df.selectExpr(f"`{ident}` as ident", f"`{text}` as text").mapInArrow(run, f"ident {kind}, ids array<int>").withColumnRenamed("ident", ident)


def decode_column(df: DataFrame, ids: str, out: str, folder: str = VOCABULARIES, name: str = "byte_bpe_50k") -> DataFrame:
    """`df` with a column `out` of decoded texts; null ids give null."""

    @F.pandas_udf("string")
    def run(column):  # noqa: ANN001, ANN202
        return column.map(lambda x: None if x is None else decode(list(x), folder, name))

    made: Column = run(F.col(ids))
    return df.withColumn(out, made)
