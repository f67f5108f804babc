"""Byte-level BPE encoding and decoding.

Every match of the split pattern is encoded on its own. Its bytes, mapped to
Latin-1, are looked up in a pyahocorasick trie that gives the longest token
starting at a place. Encoding takes the longest token that may follow the
one before, tries the next shorter prefix token when two tokens do not fit,
and steps back when none is left, closing that place for good; so each place
is left open or closed once and the work is linear in the length. Two adjacent
tokens fit when merging their joint bytes by rank would give back the two
tokens; the answer is memoised. A sequence whose neighbours all fit is what
the merges by rank produce.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text, kept_alone

# Entries a worker's memo may hold before it starts anew; results do not depend on it.
MEMO = 250_000
# Longer keys (base64, addresses) seldom come again and are not kept, so a memo is bounded in bytes too.
MEMO_KEY = 64
# Rows of an Arrow batch that are Python objects at a time.
SLICE = 256
NEVER = 1 << 62
# A space between two white-space characters (or before the end) belongs to a
# run that the pattern splits as a whole.
_IN_RUN = re.compile(r" (?!\S)(?<=\s )")


class Memo(dict):
    """Bounded memo of ``fn`` in two generations: when the young one is full it
    becomes the old one, from which entries in use move up again. Texts of more
    than ``longest`` characters are computed each time (None: any key is kept)."""

    def __init__(self, fn, limit: int = MEMO, longest: int | None = None):
        super().__init__()
        self.fn, self.limit, self.longest, self.old = fn, limit, longest, {}

    def __missing__(self, key):
        if self.longest and len(key) > self.longest:
            return self.fn(key)
        value = self.old.pop(key, None)
        if value is None:
            value = self.fn(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def word_parts(text: str) -> list[str] | None:
    """The text cut before its spaces, or None where such a cut may fall
    inside a match of the pattern. A space starts the match of the word after
    it, so ``" " + part`` can be encoded alone for every part but the first."""
    return None if _IN_RUN.search(text) else text.split(" ")


# Marks that make a match of their own after a word of letters.
MARKS = frozenset(".,;:!?")


def is_marked_word(part: str) -> bool:
    """Letters and one mark, as "word,": two matches of the pattern."""
    return part[-1:] in MARKS and part[:-1].isalpha()


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, blob.splitlines())}


class BytePairEncoder:
    """Tokens are held as Latin-1 strings, one character per byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.most = max(map(len, self.ranks))
        self.pattern = regex.compile(pattern)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for token in self.ranks:
            self.trie.add_word(token)
        self.halves = Memo(self._halves)
        self.fits = Memo(self._fits, 2 * MEMO)
        self.shorter = Memo(self._shorter)
        self.after_space = Memo(self._after_space, longest=MEMO_KEY)
        self.after_word = Memo(self._packed, longest=MEMO_KEY)

    def _halves(self, token: int) -> tuple[int, int] | None | bool:
        """The two tokens whose merge makes ``token``; None for a single byte,
        False if merging its bytes by rank does not arrive at it."""
        parts = list(self.tokens[token])
        made = None
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                return False
            made = self.ranks[parts[at]], self.ranks[parts[at + 1]]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return made

    def _fits(self, pair: int) -> bool:
        """``pair``: the left token plus 1 (0: none) in the high bits, the right
        one in the low 32. Whether the bytes of two tokens merge back into them: going back
        through the merges on both sides of the seam, latest first, no pair
        that met at the seam may have had a merge that came earlier than the
        one which took it away (on a tie the one further left came first)."""
        left, right = (pair >> 32) - 1, pair & 0xFFFFFFFF
        tokens, ranks, halves = self.tokens, self.ranks, self.halves
        if halves[right] is False:
            return False
        if left < 0:
            return True
        until = NEVER  # nothing merges at the end: the two tokens themselves must not
        while ranks.get(tokens[left] + tokens[right], NEVER) >= until:
            of_left, of_right = halves[left], halves[right]
            if of_right is None and of_left is None:
                return True
            if of_right is None or (of_left is not None and left > right):
                until, left = left, of_left[1]
            else:
                until, right = right + 1, of_right[0]
        return False

    def _shorter(self, token: int) -> int:
        """Length of the longest token that is a proper prefix (0: none)."""
        b = self.tokens[token]
        return next((k for k in range(len(b) - 1, 0, -1) if b[:k] in self.ranks), 0)

    def encode_piece(self, piece: str) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        tokens, fits, most, deepest = self.tokens, self.fits, self.most, self.trie.longest_prefix
        n = len(piece)
        closed: set[int] = set()
        out: list[int] = []
        pos = left = length = 0
        while pos < n:
            if not length:  # longest token here: down from the deepest trie node on the path
                length = deepest(piece[pos:pos + most])
                while (token := ranks.get(piece[pos:pos + length])) is None:
                    length -= 1
            if pos + length not in closed and fits[left << 32 | token]:
                out.append(token)
                left = token + 1
                pos += length
                length = 0
                continue
            length = self.shorter[token]
            while not length:  # nothing may start here: never come back, change the token before
                closed.add(pos)
                last = out.pop()
                left = out[-1] + 1 if out else 0
                pos -= len(tokens[last])
                length = self.shorter[last]
            token = ranks[piece[pos:pos + length]]
        return out

    def _after_space(self, part: str) -> bytes:
        if part.isalpha():
            ids = self.encode_piece((" " + part).encode().decode("latin-1"))
            return struct.pack(f"<{len(ids)}I", *ids)
        if is_marked_word(part):
            return self.after_space[part[:-1]] + self.after_word[part[-1]]
        return self._packed(" " + part)

    def _packed(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += self.encode_piece(piece.encode().decode("latin-1"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        parts = word_parts(text)
        if parts is None:
            return self._packed(text)
        return self._packed(parts[0]) + b"".join(map(self.after_space.__getitem__, parts[1:]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@kept_alone
def _encoder(blob: bytes, pattern: str) -> BytePairEncoder:
    return BytePairEncoder(read_ranks(blob), pattern)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text encoded, and decoded again from its ids: ``doc_id,
    n_tokens, ids_sha256, decoded_sha256`` and, ``with_ids``, the ``ids``.

    The vocabulary file is read once by the driver and broadcast (its size
    does not grow with the data). One narrow ``mapInArrow`` over the two
    columns it needs: no shuffle, and memory is one Arrow batch plus bounded
    memos. Null text counts as empty (no ids); null and repeated ids pass
    through; an empty table gives no rows; extra columns are not read.
    """
    blob = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(blob.value, pattern)
        for batch in batches:
            for part in _slices(batch):
                counts, ids_sha, text_sha, all_ids = [], [], [], []
                for text in part.column(1).to_pylist():
                    packed = encoder.encode(text or "")
                    ids = np.frombuffer(packed, "<u4")
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(packed).hexdigest())
                    text_sha.append(hashlib.sha256(encoder.decode(ids.tolist())).hexdigest())
                    if with_ids:
                        all_ids.append(ids.astype(np.int32))
                out = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                       pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.cumsum([0, *counts]).astype(np.int32)
                    flat = np.concatenate(all_ids) if all_ids else np.empty(0, np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    base = id_text(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return base.mapInArrow(rows, schema + (", ids array<int>" if with_ids else ""))


def _slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of a few rows, so few Python texts live at a time."""
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)
