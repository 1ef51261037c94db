"""Offset-preserving encoding with a sentencepiece model, and decoding.

The text is normalised here, by longest prefix through the model's compiled character map, and every
normalised byte keeps the original byte it came from. The library then cuts the text into pieces, and
the pieces' lengths in normalised bytes project each one to a span of original bytes.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import chunks, mapped

#: The library's white-space sign, U+2581.
BLANK = "▁".encode()


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message: integers, 4 or 8 raw bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, blob[at : at + size]
        at += size


class CharacterMap:
    """The compiled map of a model: a double-array trie of prefixes and the strings they become."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of text[at:] and what it becomes."""
        if not self.units:
            return None
        found = None
        node = self._child(0, self.units[0])
        for n in range(at, len(text)):
            node ^= text[n]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[n]:
                break
            node = self._child(node, unit)
            if unit >> 8 & 1:
                found = (n + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 512) >> 6))


class PieceModel:
    """A model's normaliser settings, piece lengths and the library's processor."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            blob = f.read()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=blob)
        lengths, spec = [], {}
        for number, value in _fields(blob):
            if number == 1:
                piece = dict(_fields(value))
                lengths.append({6: 1, 3: 0, 2: -1}.get(piece.get(3, 1), len(piece[1])))  # byte, control, unknown, other
            elif number == 3:
                spec = dict(_fields(value))
        self.lengths = np.array(lengths, dtype=np.int64)
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix, self.trim, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end the original byte it came from."""
        raw = text.encode()
        blank = BLANK if self.escape else b" "
        if not raw:
            return b"", np.zeros(1, dtype=np.int64)
        if not self.map.units and not self.trim:
            widths = np.where(np.frombuffer(raw, dtype=np.uint8) == 32, len(blank), 1)
            source = np.repeat(np.arange(len(raw)), widths)
            head = blank if self.dummy_prefix else b""
            return head + raw.replace(b" ", blank), np.concatenate([np.zeros(len(head), np.int64), source, [len(raw)]])
        out, source = [], []

        def put(piece: bytes, at: int) -> None:
            out.append(piece)
            source.extend([at] * len(piece))

        at, open_blank = 0, True  # open_blank: a blank here would lead or repeat
        while at < len(raw):
            taken = self.map.longest(raw, at)
            if taken is None:
                n = 1
                while at + n < len(raw) and raw[at + n] & 0xC0 == 0x80:
                    n += 1
                taken = n, raw[at : at + n]
            width, becomes = taken
            for k in range(len(becomes)):
                sign = becomes[k : k + 1]
                if sign == b" ":
                    if not (self.trim and open_blank):
                        put(blank, at)
                    open_blank = True
                else:
                    if not out and self.dummy_prefix:
                        put(blank, at)
                    put(sign, at)
                    open_blank = False
            at += width
        end = len(raw)
        while self.trim and out and out[-1] == blank:
            out.pop()
            end = source[-len(blank)]
            del source[-len(blank) :]
        if out and self.dummy_prefix and not self.trim and raw[:1] == b" ":
            out.insert(0, blank)
            source[:0] = [0] * len(blank)
        return b"".join(out), np.array([*source, end], dtype=np.int64)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last original byte of each id's piece; control ids have empty spans at the end."""
        normal, source = self.normalise(text)
        widths = self.lengths[ids]
        if (widths < 0).any():
            surfaces = self.processor.encode(text, out_type=str)
            widths = np.array([len(s.encode()) for s in surfaces] + [0] * (len(ids) - len(surfaces)))
        ends = np.cumsum(widths)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        return source[ends - widths], source[ends]


@functools.cache
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode_pieces(docs: DataFrame, model_path: str, *, end: bool = True, decode: bool = False) -> DataFrame:
    """doc_id, ids, span_starts, span_ends of every whole text (null: empty), end id last.

    With `decode`, decoded is added, the library's text of the ids, in the same pass over the tokens.

    Spans are original UTF-8 byte offsets, end exclusive; an id that stands for no text has an empty span
    at the end. Rows are independent: repeated rows repeat, an empty table stays empty, further columns
    are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for b in chunks(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = [np.array(x, dtype=np.int64) for x in model.processor.encode(texts, num_threads=1, add_bos=False, add_eos=end)]
            spans = [model.spans(t, x) for t, x in zip(texts, ids, strict=True)]
            columns = [b.column("doc_id"), _lists(ids), _lists([s for s, _ in spans]), _lists([e for _, e in spans])]
            if decode:
                columns.append(pa.array([model.processor.decode(x.tolist()) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ["doc_id long", "ids array<int>", "span_starts array<int>", "span_ends array<int>", *["decoded string"] * decode]
    names = [k.split()[0] for k in kinds]
    return docs.select("doc_id", "text").transform(mapped, encode, ", ".join(kinds))


def decode_pieces(tokens: DataFrame, model_path: str) -> DataFrame:
    """`tokens` (doc_id, ids, span_starts, span_ends) with decoded, the library's text of each row's ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                texts = model.processor.decode(part.column("ids").to_pylist(), num_threads=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    columns = ["doc_id", "ids", "span_starts", "span_ends"]
    return tokens.select(*columns).transform(
        mapped, decode, "doc_id long, ids array<int>, span_starts array<int>, span_ends array<int>, decoded string"
    )


def piece_digests(tokens: DataFrame) -> DataFrame:
    """Per row of decoded tokens: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes (of the text that the spans cover)."""
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("span_ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),
    )
