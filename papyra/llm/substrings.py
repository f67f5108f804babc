"""Exact removal of long repeated byte strings by bucket-pointer refinement.

The suffixes that start a window of ``length`` bytes are put into buckets by a
q-gram: of the q-grams inside the window, the one with the smallest hash. Equal
windows share it, and neighbouring windows mostly do too, so a text falls into
runs of windows with one bucket. Buckets with a single run are done. Runs with
equal bytes are counted once as a whole. What is left is refined: every place
points to the bucket of its next q bytes, and buckets are split by sorting on
the pointers at the place and at a later offset, which doubles the width; the
new pointers are used again for the next doubling, places that are alone in
their bucket leave, until the buckets hold windows of the full length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _slices
from .common import id_text, stored

Q = 32
# Window starts of a text handled in one array pass.
BLOCK = 1 << 18
# Different runs of a bucket that one task refines in memory; larger buckets
# are refined by window with distributed counts.
BUCKET_RUNS = 1024
# Bytes of slices refined in one array pass.
WAVE_BYTES = 1 << 20

_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes at every place, by doubling."""
    h, width = _BYTE[b], 1
    while width < Q:
        x = (h[:-width] * _A + h[width:]) * _B
        h = x ^ (x >> np.uint64(32))
        width *= 2
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours: from prefix and suffix minima of
    blocks, linear in all."""
    n = len(h) - width + 1
    rows = np.r_[h, np.full(-len(h) % width, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, width)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1:width - 1 + n])


def text_runs(text: bytes, length: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """Runs (first start, starts, bucket, hash of the slice, whether the
    bucket's q-gram comes twice in it) that hold every window of a text once.
    One occurrence of a q-gram gives at most ``width`` neighbouring windows;
    longer runs, where it is repeated, are cut to that, so slices stay short."""
    width = length - Q + 1
    for at in range(0, max(0, len(text) - length + 1), BLOCK):
        b = np.frombuffer(text, np.uint8, min(BLOCK + length - 1, len(text) - at), at)
        h = gram_hashes(b)
        least = sliding_min(h, width)
        begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        sizes = np.diff(np.r_[begin, len(least)])
        if (sizes > width).any():
            parts = -(-sizes // width)
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin, sizes = np.repeat(begin, parts) + width * k, np.minimum(np.repeat(sizes, parts) - width * k, width)
        for p, n, v in zip(begin.tolist(), sizes.tolist(), least[begin], strict=True):
            twice = np.count_nonzero(h[p:p + n + width - 1] == v) > 1
            yield at + p, n, int(v), xxhash.xxh3_64_intdigest(text[at + p:at + p + n + length - 1]), twice


def refine(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Bucket pointers of the ``length`` bytes at each of ``starts`` in
    ``data`` (all inside it): equal exactly for equal strings.

    Pointers of 8 bytes are the bytes as numbers; a doubling sorts the pairs
    of pointers at a place and ``width`` later. A place that is alone keeps a
    pointer of its own and is not sorted again. The last step overlaps."""
    n = len(data) - 7
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | data[k:k + n]
    pointer, alone = _rename(word)
    width = 8
    while width < length:
        step = min(width, length - width)
        m = len(pointer) - step
        one, two = pointer[:m], pointer[step:]
        new = np.arange(m, dtype=np.int64) + 2 * len(data)  # alone: a pointer of its own
        single = alone[:m] | alone[step:]
        live = np.flatnonzero(~single)
        ids, lone = _rename(one[live] * np.int64(3 * len(data) + 1) + two[live])
        new[live] = ids
        single[live] = lone
        pointer, alone, width = new, single, width + step
    return pointer[starts]


def _rename(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense number of each key in sorted order, and which keys come once."""
    by = np.argsort(key, kind="stable")
    s = key[by]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.empty(0, bool)
    number = np.empty(len(key), np.int64)
    number[by] = np.cumsum(new) - 1
    lone = np.empty(len(key), bool)
    lone[by] = new & np.r_[new[1:], True] if len(s) else new
    return number, lone


def repeated_starts(slices: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each slice, which of its first ``counts`` windows come again there
    or in another slice."""
    data = np.frombuffer(b"".join(slices), np.uint8)
    counts_, sizes = np.array(counts), np.array([len(s) for s in slices])
    begin = np.cumsum(sizes) - sizes
    offset = np.arange(counts_.sum()) - np.repeat(np.cumsum(counts_) - counts_, counts_)
    pointer = refine(data, np.repeat(begin, counts_) + offset, length)
    _, inverse, times = np.unique(pointer, return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    return np.split(again, np.cumsum(counts_)[:-1])


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of each run of true."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edge[::2], edge[1::2] - edge[::2]


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, key``: key tells rows apart by id and text (rows equal
    in both have the same runs and so the same result)."""
    return id_text(docs, id_col, text_col).withColumn("key", F.xxhash64("doc_id", "text"))


def _runs(base: DataFrame, length: int, counted_only: bool) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 64):
                keys, found = [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    got = list(text_runs((text or "").encode(), length))
                    keys += [key] * len(got)
                    found += got
                start, n, bucket, content, twice = zip(*found, strict=True) if found else ((),) * 5
                bucket = pa.array(np.array(bucket, np.uint64).view(np.int64))
                twice = pa.array(twice, pa.bool_())
                if counted_only:
                    yield pa.RecordBatch.from_arrays([bucket, twice], ["bucket", "twice"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [bucket, pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(keys, pa.int64()),
                         pa.array(start, pa.int64()), pa.array(n, pa.int32()), twice],
                        ["bucket", "content", "key", "start", "n", "twice"])

    read = base.select("key", "text")
    if counted_only:
        return read.mapInArrow(rows, "bucket long, twice boolean")
    return read.mapInArrow(rows, "bucket long, content long, key long, start long, n int, twice boolean")


def _packed(base: DataFrame) -> DataFrame:
    """``doc_id, key, packed``: texts as zstd bytes, to shuffle less."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in _slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.array([press.compress((t or "").encode()) for t in part.column(2).to_pylist()], pa.binary())],
                    ["doc_id", "key", "packed"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.select("doc_id", "key", "text").mapInArrow(rows, f"doc_id {kind}, key long, packed binary")


def _cut_slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (packed, list of runs) to one row per run with its bytes."""
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        for part in _slices(batch):
            out: dict[str, list] = {k: [] for k in ("bucket", "runs", "times", "key", "start", "n", "slice")}
            for key, packed, want in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                text = unpress.decompress(packed)
                for r in want:
                    for k in ("bucket", "runs", "times", "start", "n"):
                        out[k].append(r[k])
                    out["key"].append(key)
                    out["slice"].append(text[r["start"]:r["start"] + r["n"] + length - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[k], t) for k, t in (("bucket", pa.int64()), ("runs", pa.int64()), ("times", pa.int64()),
                                                  ("key", pa.int64()), ("start", pa.int64()), ("n", pa.int32()),
                                                  ("slice", pa.binary()))], list(out))


def _refine_buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to the spans of starts that come again, of the
    runs whose bytes come once. Whole buckets are gathered to a wave."""
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated_starts([r[5] for r in rows], [r[4] for r in rows], length)
        key, start, n = [], [], []
        for r, f in zip(rows, flags, strict=True):
            if r[1] == 1 and f.any():
                first, size = spans(f)
                key += [r[2]] * len(first)
                start += (first + r[3]).tolist()
                n += size.tolist()
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int32())],
                                          ["key", "start", "n"])

    wave, size, last = [], 0, None  # last: bucket and place of the row before
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            place = (row[0], row[2], row[3])
            if place == last:
                continue
            if wave and row[0] != last[0] and size > WAVE_BYTES:
                yield solve(wave)
                wave, size = [], 0
            last = place
            wave.append(row)
            size += len(row[5])
    if wave:
        yield solve(wave)


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every window of a run with its 128-bit hash (as two numbers)."""
    for batch in batches:
        for part in _slices(batch, 512):
            keys, starts, one, two, times = [], [], [], [], []
            for time, key, start, n, piece in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                for j in range(n):
                    h = xxhash.xxh3_128_intdigest(piece[j:j + length])
                    one.append(h >> 64)
                    two.append(h & 0xFFFFFFFFFFFFFFFF)
                keys += [key] * n
                times += [time] * n
                starts += range(start, start + n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)),
                 pa.array(times, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64())],
                ["h1", "h2", "times", "key", "start"])


def _dealt(keys: DataFrame) -> DataFrame:
    """A grouped table dealt anew, so that the join on its key shuffles both
    sides and AQE can split the hot keys of the other one."""
    return keys.hint("rebalance")


def repeated_spans(base: DataFrame, length: int, bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """``key, start, n``: the starts of all windows of ``length`` bytes that
    come again, as spans of consecutive starts.

    1. Runs are counted by bucket (partial counts first); only those of
       buckets that can repeat are kept, by an equi-join whose hot buckets AQE
       splits, and stored. Only what is read more than once is stored.
    2. Equal runs are counted; those found twice repeat as a whole, and one of
       them stands for all in the refinement.
    3. Buckets of several different runs are refined: their bytes are cut from
       the texts, buckets of up to ``bucket_runs`` runs go to one task each;
       larger ones (a common line in a third of all documents) are split by
       window: hashes are counted, and met again by an equi-join.
    """
    counted = (_runs(base, length, True).groupBy("bucket")
               .agg(F.count("*").alias("all_runs"), F.max("twice").alias("within"))
               .filter("all_runs > 1 OR within"))
    runs = stored(_runs(base, length, False).join(_dealt(counted.select("bucket")), "bucket"), "runs")
    different = stored(runs.groupBy("bucket", "content").agg(
        F.count("*").alias("times"), F.max("twice").alias("within"), F.min(F.struct("key", "start", "n")).alias("one")), "contents")
    whole = (runs.join(different.filter("times > 1").select("bucket", "content"), ["bucket", "content"])
             .select("key", "start", "n"))

    crowded = (different.groupBy("bucket").agg(F.count("*").alias("runs"), F.max("within").alias("within"))
               .filter("runs > 1 OR within").select("bucket", "runs"))
    wanted = (different.join(_dealt(crowded), "bucket")
              .groupBy(F.col("one.key").alias("in_key"))
              .agg(F.collect_list(F.struct("bucket", "runs", "times", F.col("one.start").alias("start"),
                                           F.col("one.n").alias("n"))).alias("want")))
    texts = _packed(base).select("key", "packed")  # texts repeated with their id give their pieces again
    pieces = stored(texts.join(_dealt(wanted), F.col("key") == F.col("in_key")).select("key", "packed", "want")
                    .mapInArrow(lambda b: _cut_slices(b, length),
                                "bucket long, runs long, times long, key long, start long, n int, slice binary"), "pieces")
    small = (pieces.filter(F.col("runs") <= bucket_runs).select("bucket", "times", "key", "start", "n", "slice")
             .repartition("bucket").sortWithinPartitions("bucket", "key", "start")
             .mapInArrow(lambda b: _refine_buckets(b, length), "key long, start long, n int"))
    large = stored(pieces.filter(F.col("runs") > bucket_runs).select("times", "key", "start", "n", "slice")
                   .mapInArrow(lambda b: _windows(b, length), "h1 long, h2 long, times long, key long, start long"), "windows")
    place = F.struct("key", "start")
    again = (large.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("z"))
             .filter("a <> z").select("h1", "h2"))
    found = large.filter("times = 1").join(_dealt(again), ["h1", "h2"]).select("key", "start", F.lit(1).alias("n"))
    return whole.unionByName(small).unionByName(found)


def remove_repeats(docs: DataFrame, length: int = 200, with_text: bool = True,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per input row and,
    ``with_text``, the removed ``spans`` (first byte, bytes) and ``kept``: the
    UTF-8 bytes of the text without every byte covered by a string of
    ``length`` bytes that starts anywhere else too, in the same text or
    another; matches never cross texts and are judged on the input.

    The texts are shuffled twice, compressed, by a hash of id and text; all
    other steps move runs, of which there is about one per 85 bytes. Spans are
    gathered per text, no more than the text is long.

    Null or empty text: no bytes. Texts shorter than ``length`` stay whole.
    Rows that repeat id and text count as two texts, so all their windows come
    again; null ids are allowed. An empty table gives no rows.
    """
    if length < 128:
        raise ValueError("windows must be of 128 bytes at least")
    base = _base(docs, id_col, text_col)
    hits = repeated_spans(base, length)
    by_text = hits.groupBy(F.col("key").alias("in_key")).agg(F.collect_list(F.struct("start", "n")).alias("hits"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in _slices(batch):
                out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
                for packed, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    text = unpress.decompress(packed)
                    first, size = _union(found or [], length, len(text))
                    kept, at = [], 0
                    for f, s in zip(first, size, strict=True):
                        kept.append(text[at:f])
                        at = f + s
                    kept = b"".join([*kept, text[at:]])
                    for k, v in (("n_bytes", len(text)), ("n_removed", len(text) - len(kept)), ("n_spans", len(first)),
                                 ("kept_sha256", hashlib.sha256(kept).hexdigest()),
                                 ("spans", [{"first": f, "bytes": s} for f, s in zip(first, size, strict=True)]),
                                 ("kept", kept)):
                        out[k].append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(),
                         pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())])), pa.binary()]
                keep = 6 if with_text else 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(v, t) for v, t in list(zip(out.values(), kinds, strict=True))[:keep]]],
                    ["doc_id", *list(out)[:keep]])

    packed = _packed(base)
    joined = packed.join(_dealt(by_text), F.col("key") == F.col("in_key"), "left").select("doc_id", "packed", "hits")
    kind = base.schema["doc_id"].dataType.simpleString()
    more = ", spans array<struct<first:long,bytes:long>>, kept binary" if with_text else ""
    return joined.mapInArrow(rows, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")


def _union(found: list[dict], length: int, n: int) -> tuple[list[int], list[int]]:
    """Maximal removed spans (first byte, bytes) of spans of window starts."""
    first, size = [], []
    for h in sorted(found, key=lambda h: h["start"]):
        a, z = h["start"], h["start"] + h["n"] + length - 1
        if first and a <= first[-1] + size[-1]:
            size[-1] = max(size[-1], z - first[-1])
        else:
            first.append(a)
            size.append(z - a)
    return first, size
