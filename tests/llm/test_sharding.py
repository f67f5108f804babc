"""Two-pass shuffle: every record once, gapless slots, even counts, seeded."""

import zlib
from collections import Counter

from papyra.llm import queries, sharding

from ..conftest import SF_SMALL
from . import edges


def _check(got, rows, n_shards=16):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(n_shards)}
    assert all(v == list(range(len(v))) for v in slots.values())
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def test_edge_rows(spark):
    for bucket_bytes in (100, 1 << 20):
        _check(sharding.shard_digest(edges.frame(spark), bucket_bytes=bucket_bytes).collect(), edges.ROWS)
    assert sharding.shard_digest(edges.frame(spark, [])).count() == 0


def test_every_column_is_written(spark):
    df = edges.frame(spark)
    back = sharding.read_shards(spark, sharding.write_shards(df, n_shards=3), df.schema).select("record.*")
    assert back.columns == df.columns
    assert edges.bag(tuple(r) for r in back.collect()) == edges.bag(tuple(r) for r in df.collect())


def test_query_and_seed(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = queries.QUERIES["op8_shuffle_shards"](spark, SF_SMALL).collect()
    _check(got, docs)
    frame = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    place = {seed: {r.doc_id: (r.shard, r.slot) for r in sharding.shard_digest(frame, seed=seed).collect()} for seed in (42, 43)}
    assert place[42] == {r.doc_id: (r.shard, r.slot) for r in got} != place[43]
    order = [d for d, _ in sorted(place[42].items(), key=lambda x: x[1])]
    assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:], strict=False)) < len(order) // 10


def test_places_depend_on_the_seed_alone(spark):
    frame = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    was, places = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 9):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = sharding.shard_digest(frame.repartition(n), bucket_bytes=5000).collect()
            places.append({r.doc_id: (r.shard, r.slot) for r in got})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert places[0] == places[1]
