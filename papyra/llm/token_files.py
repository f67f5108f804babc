"""Token ids in binary files, packed with Simple-8b.

A 64-bit word holds a 4-bit selector and 60 bits: selector s > 0 packs
COUNTS[s-1] ids of 60 // count bits each. Selector 0 is an escape: the next
word is one id of 60 bits or more as it is (its top four bits are not all 0,
so it cannot be taken for an escape). Ids are packed in blocks of BLOCK; the
offsets of the blocks allow decoding any of them alone, and packing all of
them side by side in numpy.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import MEMO, MEMO_KEY, Memo, _slices, word_parts
from .common import id_text, kept_alone, shared_path

# Fixed values of the format.
MAGIC = b"PAPYRA8B"
BLOCK = 512
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
BITS = 60 // COUNTS
NEAR = 8  # counts 1..8 are found in one look, longer runs of small ids in a second

_NEWLINES = re.compile("(\n+)")
_OTHER_SPACE = re.compile(r"[^\S\n]")
_LONE_NEWLINE = re.compile(r"\n(?<=\S\n)(?=\S)")
# ASCII marks; the apostrophe, which may begin a match of letters, is not one.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 1 at least (exact: halves of 32 bits fit a float)."""
    w = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    high = ids >> np.uint64(32)
    if high.any():
        w = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], w)
    return np.maximum(w, 1).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and, for each block of ids, the place of its first word.

    How many of the next 8 ids fit a word is found for all places at once;
    the blocks then step from word to word side by side, looking further only
    where 8 ids fit; the words are filled selector by selector."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    width = np.r_[_widths(ids), np.full(60, 99, np.uint8)]
    widest = width[:n]
    near = (widest <= 60).astype(np.uint8)
    for k in range(1, NEAR):
        widest = np.maximum(widest, width[k:n + k])
        near += widest <= BITS[k]
    pos = np.arange(-(-n // BLOCK), dtype=np.int64) * BLOCK
    end = np.minimum(pos + BLOCK, n)
    active = np.arange(len(pos))
    blocks, places, selectors = [], [], []
    while len(active):
        p, left = pos[active], (end - pos)[active]
        sel = np.minimum(near[p], left)  # ids taken; 0: escape
        for s in range(NEAR + 1, len(COUNTS) + 1):
            more = np.flatnonzero((sel == s - 1) & (left >= COUNTS[s - 1]))
            if not len(more):
                break
            fits = width[p[more][:, None] + np.arange(COUNTS[s - 1])].max(axis=1) <= BITS[s - 1]
            sel[more[fits]] = s
        blocks.append(active)
        places.append(p)
        selectors.append(sel)
        pos[active] += np.where(sel > 0, COUNTS[np.maximum(sel, 1) - 1], 1)
        active = active[pos[active] < end[active]]
    block, place, sel = np.concatenate(blocks), np.concatenate(places), np.concatenate(selectors)
    by = np.argsort(place, kind="stable")
    block, place, sel = block[by], place[by], sel[by]
    word = sel.astype(np.uint64) << np.uint64(60)
    for s in range(1, len(COUNTS) + 1):
        at = np.flatnonzero(sel == s)
        for j in range(COUNTS[s - 1] if len(at) else 0):
            word[at] |= ids[place[at] + j] << np.uint64(j * BITS[s - 1])
    sizes = 1 + (sel == 0)
    first = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    out[first] = word
    out[first[sel == 0] + 1] = ids[place[sel == 0]]
    return out, first[np.r_[True, block[1:] != block[:-1]]]


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of consecutive whole blocks, decoded selector by selector."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    escapes = np.flatnonzero(sel == 0)
    sel[escapes + 1] = 0  # ids as they are, not selectors
    takes = np.where(sel > 0, COUNTS[np.maximum(sel, 1) - 1], 1)
    takes[escapes + 1] = 0
    starts = np.cumsum(takes) - takes
    out = np.empty(int(takes.sum()), np.uint64)
    out[starts[escapes]] = words[escapes + 1]
    for s in range(1, len(COUNTS) + 1):
        at = np.flatnonzero(sel == s)
        if len(at):
            count, bits = int(COUNTS[s - 1]), int(BITS[s - 1])
            shifts = (np.arange(count) * bits).astype(np.uint64)
            got = (words[at][:, None] >> shifts) & np.uint64((1 << bits) - 1)
            out[starts[at][:, None] + np.arange(count)] = got
    return out


def unpack_block(words: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Block ``k`` alone."""
    return unpack(words[offsets[k]:offsets[k + 1] if k + 1 < len(offsets) else len(words)])


def to_bytes(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """One file: magic, counts, document ids (a byte each marks nulls), tokens
    per document, block offsets, words; all little-endian."""
    words, offsets = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(offsets), len(words)], "<u8").tobytes()
    return b"".join([MAGIC, head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
                     np.array([d is None for d in doc_ids], "u1").tobytes(), np.array(sizes, "<i8").tobytes(),
                     offsets.astype("<i8").tobytes(), words.astype("<u8").tobytes()])


def from_bytes(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, tokens per document, block offsets and words of a file."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_ids, n_blocks, n_words = np.frombuffer(blob, "<u8", 4, 8).astype(int).tolist()
    at = 40
    doc_ids = np.frombuffer(blob, "<i8", n_docs, at)
    null = np.frombuffer(blob, "u1", n_docs, at := at + 8 * n_docs)
    sizes = np.frombuffer(blob, "<i8", n_docs, at := at + n_docs)
    offsets = np.frombuffer(blob, "<i8", n_blocks, at := at + 8 * n_docs)
    words = np.frombuffer(blob, "<u8", n_words, at + 8 * n_blocks)
    return [None if z else d for d, z in zip(doc_ids.tolist(), null.tolist(), strict=True)], sizes, offsets, words


def byte_characters() -> dict[int, str]:
    """Characters that byte-level tokenizer files write for bytes: printable
    Latin-1 stands for itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


@kept_alone
def _tokenizer(blob: bytes):
    """``encode(text)``: ids of a whole text as little-endian 32-bit integers.

    A byte-level tokenizer with the usual pattern and no normaliser cuts a
    text before the space of each word, and beside a newline between two words,
    so parts can be encoded alone: words of letters by the library's merge
    model, marks and lines apart, the rest by its ``encode``, all memoised. Any
    other tokenizer, and texts with a special token or with runs of white space
    that straddle a cut, are encoded in one call."""
    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_buffer(blob)
    file = json.loads(blob)
    specials = [t.content for t in tok.get_added_tokens_decoder().values()]
    cut = file.get("pre_tokenizer") or {}
    by_words = (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex"), file.get("normalizer"),
                file["model"].get("type"), file["model"].get("dropout")) == ("ByteLevel", False, True, None, "BPE", None)
    character = byte_characters()
    if by_words:
        tok.model._resize_cache(0)  # words are memoised here: its own cache would only be searched in vain
    merge, space = tok.model.tokenize, character[32]

    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids_of(text: str) -> bytes:
        return packed(tok.encode(text, add_special_tokens=False).ids)

    def match(lead: str, letters: str) -> bytes:
        """A match of letters, after the character of a space or none."""
        shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(character)
        return packed([t.id for t in merge(lead + shown)])

    def word(part: str) -> bytes:
        if part.isalpha():
            return match(space, part)
        if part[:1] == "\n":  # in place of the space
            return after_word["\n"] + after_word[part[1:]]
        got = pieces(after_space, part)
        return ids_of(" " + part) if got is None else got

    def first(part: str) -> bytes:
        if part.isalpha():
            return match("", part)
        got = pieces(after_word, part)
        return ids_of(part) if got is None else got

    def pieces(of: Memo, part: str) -> bytes | None:
        """A word and a run of marks, or lines of words: neither the place
        between letters and marks nor that beside a newline is inside a match."""
        letters = part.rstrip(_MARKS)
        if letters != part and letters.isalpha():
            return of[letters] + after_word[part[len(letters):]]
        lines = _NEWLINES.split(part)
        if len(lines) == 1 or not lines[0] or not lines[-1] or _OTHER_SPACE.search(part):
            return None
        rest = ((after_word["\n" * (len(x) - 1)] if len(x) > 1 else b"") + after_word["\n"] if x[0] == "\n" else after_word[x]
                for x in lines[1:])
        return of[lines[0]] + b"".join(rest)

    after_space, after_word = Memo(word, 2 * MEMO, MEMO_KEY), Memo(first, 2 * MEMO, MEMO_KEY)

    def encode(text: str) -> bytes:
        if not by_words or any(s in text for s in specials):
            return ids_of(text)
        spaced = " \n" in text  # a part that begins with a newline follows a space there
        parts = word_parts(text if spaced else _LONE_NEWLINE.sub(" \n", text))
        if parts is None:
            return ids_of(text)
        rest = [ids_of(" " + p) if p[:1] == "\n" else after_space[p] for p in parts[1:]] if spaced else \
            map(after_space.__getitem__, parts[1:])
        return after_word[parts[0]] + b"".join(rest)

    return encode


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 0,
                      file_ids: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every whole text, append ``end_id`` to each, and write files
    ``part-PPPPPPP-KKKKK.s8b`` whose names, and the rows inside, follow
    ascending document id (null first). Returns the folder, which also gets
    the Parquet table ``manifest`` (file, n_docs, n_ids).

    Documents are range-partitioned by (id, text hash) and sorted inside each
    partition by Spark (both spill); a task holds at most ``file_ids`` ids
    beside one text. A file is written under a name of its own and renamed
    when complete, so a task that is run again leaves the same files. Null
    text: only the end id. Rows that repeat an id are all written. An empty
    table writes no file.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    with open(tokenizer_path, "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _tokenizer(blob.value), np.array([end_id], "<u4").tobytes()
        store, folder = pafs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        part, doc_ids, packed, n, k = TaskContext.get().partitionId(), [], [], 0, 0

        def flush():
            nonlocal doc_ids, packed, n, k
            name = f"part-{part:07d}-{k:05d}.s8b"
            sizes = [len(b) // 4 for b in packed]
            own = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(to_bytes(doc_ids, sizes, np.frombuffer(b"".join(packed), "<u4")))
            store.move(own, f"{folder}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(sizes)], "n_ids": [n]})
            doc_ids, packed, n, k = [], [], 0, k + 1
            return row

        for batch in batches:
            for some in _slices(batch):
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    b = encode(text or "") + end
                    if n and n + len(b) // 4 > file_ids:
                        yield flush()
                    doc_ids.append(doc_id)
                    packed.append(b)
                    n += len(b) // 4
        if doc_ids:
            yield flush()

    tie = F.xxhash64("text")
    ordered = (id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
               .repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie))
    (ordered.mapInArrow(rows, "file string, n_docs long, n_ids long")
     .write.parquet(f"{path.rstrip('/')}/manifest"))
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: ``file, doc_id, place`` (ids before it in its
    file), ``n_tokens, ids_crc32``. Files are read by Spark and decoded one at
    a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids, sizes, _, words = from_bytes(content.as_buffer())
                ids = unpack(words).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[4 * (e - s):4 * e]) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([os.path.basename(name.as_py())] * len(sizes), pa.string()), pa.array(doc_ids, pa.int64()),
                     pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    ["file", "doc_id", "place", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(path).select("path", "content")
    return files.mapInArrow(rows, "file string, doc_id long, place long, n_tokens long, ids_crc32 long")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``read_token_files`` with ``start``: the ids of all documents before,
    from a running sum over the manifest (one row per file)."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = (spark.read.schema("file string, n_docs long, n_ids long").parquet(f"{path.rstrip('/')}/manifest")
              .select(F.col("file").alias("in_file"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before")))
    got = read_token_files(spark, path)
    return (got.join(starts, got["file"] == starts["in_file"])
            .select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "file"))
