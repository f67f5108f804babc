"""Simple-8b coding, the file format, and the files as a whole."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from papyra.llm import queries, token_files
from papyra.llm.common import drop_kept

from ..conftest import SF_SMALL
from . import edges

PATH = P.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1),
                          st.sampled_from([2**60 - 1, 2**60, 2**53 - 1, 2**32, 0])), max_size=1200))
def test_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, offsets = token_files.pack(ids)
    assert (token_files.unpack(words) == ids).all()
    for k in range(len(offsets)):
        block = slice(k * token_files.BLOCK, (k + 1) * token_files.BLOCK)
        assert (token_files.unpack_block(words, offsets, k) == ids[block]).all()


def test_small_ids_take_little_room():
    assert len(token_files.pack(np.ones(512, np.uint64))[0]) <= 10
    assert len(token_files.pack(np.full(512, 2**63, np.uint64))[0]) == 1024


def test_file_bytes():
    ids = np.arange(1000, dtype=np.uint64) * 50
    blob = token_files.to_bytes([5, None, 7], [400, 0, 600], ids)
    doc_ids, sizes, offsets, words = token_files.from_bytes(blob)
    assert doc_ids == [5, None, 7] and sizes.tolist() == [400, 0, 600] and len(offsets) == 2
    assert (token_files.unpack(words) == ids).all()
    with pytest.raises(ValueError):
        token_files.from_bytes(b"x" + blob[1:])


def test_byte_characters_are_the_library_s():
    tok = Tokenizer.from_file(PATH)
    table = token_files.byte_characters()
    for text in ("a é ß", "中文 ü"):
        mine = text.encode().decode("latin-1").translate(table)
        assert mine == "".join(x for x, _ in tok.pre_tokenizer.pre_tokenize_str(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "Zu", " ", "  ", "\n", " ", "é", "中", "🙂", "'s", "12", ".", ",", "!!",
                                 "<|endoftext|>", "\x1c"]), max_size=30).map("".join))
def test_words_apart_encode_as_the_whole(text):
    with open(PATH, "rb") as f:
        encode = token_files._tokenizer(f.read())
    assert np.frombuffer(encode(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def _check(got, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [i for i, _ in rows]
    assert [r.start for r in by_start] == np.cumsum([0] + [r.n_tokens for r in by_start])[:-1].tolist()
    expected = []
    for i, t in rows:
        ids = WHOLE.encode(t or "", add_special_tokens=False).ids + [0]
        expected.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert edges.bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == edges.bag(expected)


def test_edge_rows_in_many_files(spark):
    path = token_files.write_token_files(edges.frame(spark), PATH, file_ids=500)
    got = token_files.token_index(spark, path).collect()
    assert len({r.file for r in got}) > 3
    _check(got, edges.ROWS)
    path = token_files.write_token_files(edges.frame(spark, []), PATH)
    assert token_files.token_index(spark, path).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    _check(queries.QUERIES["op5_token_files"](spark, SF_SMALL).collect(), docs)


def test_marks_lines_and_spaces_against_the_library():
    """Texts of words, marks, contractions, newlines and other white space in
    any order are cut where the library cuts them."""
    with open(PATH, "rb") as f:
        encode = token_files._tokenizer(f.read())
    rng = random.Random(5)
    bits = ["a", "the", "é", "1", "22", ".", "&&&", "'", "'s", "\n", "\n\n", " ", "  ", "\t", "\r\n", "$$", "-", "_", "word", "\xa0", "中", "!"]
    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert np.frombuffer(encode(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids, text


def test_new_words_need_no_whole_encoding(monkeypatch):
    """Words that were not met yet, also those that begin a line or carry
    marks, go to the merge model; the library's whole encoding, several times
    dearer, is left the marks, the newline and what is no word."""
    calls = []

    class Counted:
        def __init__(self, tok):
            self.tok, self.model, self.get_added_tokens_decoder = tok, tok.model, tok.get_added_tokens_decoder

        def encode(self, text, **how):
            calls.append(text)
            return self.tok.encode(text, **how)

    class Maker:
        @staticmethod
        def from_buffer(blob):
            return Counted(Tokenizer.from_buffer(blob))

    with open(PATH, "rb") as f:
        blob = f.read()
    with monkeypatch.context() as m:
        m.setattr("tokenizers.Tokenizer", Maker)
        drop_kept()
        encode = token_files._tokenizer(blob)
    words = [f"{a}{b}{c}" for a in "ABÉ" for b in ("ou", "ßi", "中") for c in "klmnop"]
    text = "\n".join(f"{w} x{w}, y{w}!!" for w in words) + "\n"
    got = np.frombuffer(encode(text), "<u4").tolist()
    assert got == WHOLE.encode(text, add_special_tokens=False).ids
    assert len(calls) <= 5, calls
    for odd in ("a \nb\nc", "a\n b", " \na", "a \n", "\na", "a\n\nb c\nd \n e", "'s\n's"):
        assert np.frombuffer(encode(odd), "<u4").tolist() == WHOLE.encode(odd, add_special_tokens=False).ids, odd
    drop_kept()
