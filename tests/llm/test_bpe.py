"""Byte-level BPE against tiktoken, and its digests."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.llm import bpe, queries

from ..conftest import SF_SMALL
from . import edges

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return bpe.BytePairEncoder(bpe.read_ranks(f.read()), P.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    ranks = {t: r for r, t in encoder.bytes_of.items()}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "bc", "the", "ing", "Zu", " ", "  ", "\n", "\t", " ", "\x1c", "\x85", "é", "ß", "中", "🙂", "'s", "'",
         "12", ".", ",", "!!", "́", "aaaaaaaa", "ß,", "<|endoftext|>"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=40).map("".join)))
def test_same_ids_as_library(encoder, library, text):
    text = text.encode("utf-8", "replace").decode()
    ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
    assert ids == library.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_long_piece_without_breaks(encoder, library):
    text = "ab" * 20_000 + "中" * 5_000 + "x" * 30_001
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_tokens_fit_exactly_when_their_bytes_merge_back(encoder, library):
    some = np.random.default_rng(1).integers(0, 50_000, (3_000, 2)).tolist()
    for a, b in some:
        both = encoder.bytes_of[a] + encoder.bytes_of[b]
        plain = list(encoder.bytes_of[a] + encoder.bytes_of[b])
        parts = [bytes([x]) for x in plain]
        ranks = library._mergeable_ranks
        while len(parts) > 1:
            r, k = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if r == 1 << 60:
                break
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        assert encoder.fits[(a + 1) << 32 | b] == ([ranks[p] for p in parts] == [a, b]), both


def test_memo_keeps_results_when_full():
    m = bpe.Memo(lambda k: k * 2, limit=3)
    assert [m[k % 7] for k in range(100)] == [k % 7 * 2 for k in range(100)]
    assert len(m) <= 3 and len(m.old) <= 3


def _expected(library, text):
    ids = library.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_edge_rows(spark, library):
    got = bpe.encode_documents(edges.frame(spark), PATH, P.PATTERN).collect()
    assert edges.bag((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == \
        edges.bag((i, *_expected(library, t)) for i, t in edges.ROWS)
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode_documents(edges.frame(spark, []), PATH, P.PATTERN).count() == 0


def test_query_against_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op1_bpe"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _expected(library, docs[r.doc_id])
