"""Token ids as Parquet list columns that allow selective reads, and the digests read back from them."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.common import chunks, mapped, prefix_sums
from passagework.session import materialise

#: Encoded chunks that a Python worker remembers (about 200 bytes each); frequent words come early.
CACHE_ENTRIES = 700_000


#: Latin letters, then anything that begins with another ASCII character.
LETTERS_THEN_SIGN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-@\[-`{-~].*)", re.S)


class CachedEncoder:
    """Encodes with the tokenizers library, remembering the ids of blank-free chunks.

    Valid for tokenizers that split at every blank before merging, as those with an inverted word
    pattern do: then the ids of a text are those of its chunks in order. Line feeds and tabs count as
    blanks for that pattern; other white space stays inside a chunk and is left to the library.
    Ids are kept as bytes of 32-bit integers, so a text is one join.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.entries, self.known = entries, {"": b""}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of 32-bit integers."""
        split = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        known = self.known
        new = [c for c in set().union(*split) if c not in known]
        known.update(self._encode(new))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        if len(known) > self.entries:
            for c in new:
                del known[c]
        return out

    def _encode(self, new: list[str]) -> dict[str, bytes]:
        # A run of letters before an ASCII sign is always a word of its own.
        split = {c: m.groups() for c in new if (m := LETTERS_THEN_SIGN.fullmatch(c))}
        known = self.known
        need = {x for c in new for x in split.get(c, (c,)) if x not in known}
        words = [c for c in need if c.isalpha()]
        done = self._encode_words(words)
        rest = [c for c in need if c not in done]
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            done[c] = np.array(e.ids, dtype="<i4").tobytes()
        for c, (a, b) in split.items():
            done[c] = (done[a] if a in done else known[a]) + (done[b] if b in done else known[b])
        return {c: done[c] for c in new}

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters in one call: each ends at its only word-final token, or none is taken."""
        if not words:
            return {}
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<i4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            return {}
        raw, cuts = ids.tobytes(), [0, *(ends * 4).tolist()]
        return {w: raw[s:e] for w, s, e in zip(words, cuts[:-1], cuts[1:], strict=True)}


@functools.cache
def _encoder(path: str) -> CachedEncoder:
    return CachedEncoder(path)


def encode_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """doc_id, n_tokens, ids of every whole text, `end_id` last.

    Null and empty texts give `end_id` alone; very long texts are encoded whole; repeated rows repeat; an empty table
    gives no rows; columns other than doc_id and text are not read, whatever their names.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        end = np.array([end_id], dtype="<i4").tobytes()
        for b in chunks(batches):
            parts = [x + end for x in encoder.ids([t or "" for t in b.column("text").to_pylist()])]
            lens = np.array([len(x) // 4 for x in parts], dtype=np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lens), ids], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").transform(mapped, encode, "doc_id long, n_tokens long, ids array<int>")


def write_tokens(tokens: DataFrame, path: str, *, row_group_bytes: int = 16 << 20, page_rows: int = 256, delta: bool = False) -> None:
    """Write (doc_id, n_tokens, ids) as Parquet files in ascending doc_id order.

    Small pages of a bounded number of rows and their page index let a reader of some doc_ids skip
    the pages of all others, and metadata reads leave the ids column alone. Ids are dictionary
    encoded; `delta` writes them delta encoded instead (Parquet 2 pages, no dictionary).
    """
    (
        tokens.sortWithinPartitions("doc_id")
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", str(not delta).lower())
        .option("parquet.writer.version", "PARQUET_2_0" if delta else "PARQUET_1_0")
        .parquet(path)
    )


def write_documents(docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int = 1, **layout) -> None:
    """Encode `docs` and write them in global doc_id order.

    Texts are dealt into ranges before they are encoded, so that the sampling of ranges doesn't encode twice. Null
    doc_ids come first, rows of one doc_id stand next to each other, an empty table gives files without rows. For
    null and long texts and further columns see `encode_tokens`.
    """
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id")
    write_tokens(encode_tokens(dealt, tokenizer_path, end_id), path, **layout)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Some columns of some doc_ids; both are pushed into the scan."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.filter(F.col("doc_id") >= first)
    if last is not None:
        df = df.filter(F.col("doc_id") <= last)
    return df.select(*(columns or df.columns))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    `start` counts the ids of all documents before it (null doc_ids first, repeated ids in a fixed order). Every
    row of the files has its row, a document without words too; files without rows give none.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "n_tokens", "ids_crc32"],
            )

    digests = spark.read.parquet(path).select("doc_id", "ids").transform(mapped, digest, "doc_id long, n_tokens long, ids_crc32 long")
    narrow = digests.withColumn("row", F.monotonically_increasing_id())
    summed = prefix_sums(materialise(narrow), ["doc_id", "row"], {"start": "n_tokens"})
    return summed.select("doc_id", "start", "n_tokens", "ids_crc32")
