import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from passagework.llm.pieces import CharacterMap, PieceModel, decode_pieces, encode_pieces
from passagework.llm.token_files import CachedEncoder, read_tokens, token_digests, write_documents

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    "", " ", "  two  blanks ", "I'll we're 's. ÀÉ né, a.b, x... <|endoftext|>", "Σας ΣΑΣ İstanbul", "é ́x", "a\x0bq\x1cz y　w", "tab\tline\nfeed\r\n",
    "9 99 abc9def", "你好 мир 🙂🙂", "&&& ###word", "word### word&&& word.", "▁ literal ▁", "\x00\x01",
]


def test_cached_encoder_is_exact(rows):
    texts = HARD + [t or "" for _, t, _ in rows]
    for entries in (10, 100_000):
        encoder = CachedEncoder(WORDS, entries)
        for _ in range(2):
            got = [np.frombuffer(x, dtype="<i4").tolist() for x in encoder.ids(texts)]
            assert got == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("delta", [False, True])
def test_token_files(spark, docs, rows, tmp_path, delta):
    path = str(tmp_path / "tokens")
    write_documents(docs, WORDS, path, page_rows=8, delta=delta)
    tokenizer = Tokenizer.from_file(WORDS)
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t, _ in rows]
    got = token_digests(spark, path).collect()
    want = [(i, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for (i, _, _), x in zip(rows, ids, strict=True)]
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=repr) == sorted(want, key=repr)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])[:-1]]).tolist()
    assert [-(2**63) if r.doc_id is None else r.doc_id for r in ordered] == sorted(-(2**63) if r.doc_id is None else r.doc_id for r in ordered)
    assert {r.doc_id for r in read_tokens(spark, path, ["doc_id", "n_tokens"], 20, 25).collect()} == set(range(20, 26))
    last = None
    for file in sorted((tmp_path / "tokens").glob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            column = meta.row_group(g).column(2)
            assert column.has_offset_index and ("DELTA_BINARY_PACKED" if delta else "PLAIN_DICTIONARY") in column.encodings
        own = [x for x in pq.read_table(file, columns=["doc_id"]).column(0).to_pylist() if x is not None]
        assert own == sorted(own) and (last is None or not own or last <= own[0])
        last = own[-1] if own else last


def test_token_files_of_nothing(spark, empty, tmp_path):
    write_documents(empty, WORDS, str(tmp_path / "t"))
    assert token_digests(spark, str(tmp_path / "t")).count() == 0


def test_pieces_are_the_librarys(docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = decode_pieces(encode_pieces(docs, PIECES), PIECES).collect()
    want = [(i, library.encode(t or "", add_eos=True)) for i, t, _ in rows]
    assert sorted([(r.doc_id, r.ids) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.decoded == library.decode(r.ids) for r in got)
    assert sorted(map(tuple, encode_pieces(docs, PIECES, decode=True).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_spans_cover_the_text():
    model = PieceModel(PIECES)
    for text in HARD + ["plain text"]:
        ids = np.array(model.processor.encode(text, add_eos=True))
        starts, ends = model.spans(text, ids)
        raw = text.encode()
        assert starts[0] == 0 and ends[-1] == len(raw) and (starts[1:] == ends[:-1]).all()
        for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            piece = model.processor.id_to_piece(int(ids[k]))
            if model.lengths[ids[k]] == 1 and piece.startswith("<0x"):
                continue
            if piece != "</s>":
                assert piece.replace("▁", " ").encode().lstrip() == raw[s:e].replace("▁".encode(), b" ").lstrip()


def compiled(pairs: dict[bytes, bytes]) -> bytes:
    """A character map in the compiled format, placed by first fit."""
    strings, at = b"", {}
    for k, v in pairs.items():
        at[k] = len(strings)
        strings += v + b"\0"
    units, used = [0] * 4096, {0}

    def place(node: int, prefix: bytes) -> None:
        labels = sorted({k[len(prefix)] for k in pairs if k.startswith(prefix) and len(k) > len(prefix)})
        ends = prefix in pairs
        for offset in range(1, 2048):
            spots = [(node ^ offset) ^ c for c in labels] + ([node ^ offset] if ends else [])
            if not used & set(spots) and max(spots) < 4096:
                break
        used.update(spots)
        units[node] |= offset << 10 | ends << 8
        if ends:
            units[node ^ offset] = 1 << 31 | at[prefix]
        for c in labels:
            units[node ^ offset ^ c] = c
            place(node ^ offset ^ c, prefix + bytes([c]))

    place(0, b"")
    trie = struct.pack("<4096I", *units)
    return struct.pack("<I", len(trie)) + trie + strings


def test_longest_prefix_normalisation():
    model = PieceModel(PIECES)
    model.map = CharacterMap(compiled({b"\xef\xac\x81": b"fi", b"ab": b"X", b"abc": b"YZ", b"\t": b" "}))
    assert model.map.longest(b"zabcd", 1) == (3, b"YZ") and model.map.longest(b"abd", 0) == (2, b"X")
    assert model.map.longest(b"a", 0) is None
    normal, source = model.normalise("abcd ﬁab")
    assert normal == "▁YZd▁fiX".encode()
    assert source.tolist() == [0, 0, 0, 0, 0, 3, 4, 4, 4, 5, 5, 8, 10]
    model.trim = True
    normal, source = model.normalise("  ab \t d  ")
    assert normal == "▁X▁d".encode() and source[-1] == 8 and len(source) == len(normal) + 1
