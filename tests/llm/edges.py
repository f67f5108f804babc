"""Documents with every awkward case, and extra columns whose names clash with
those the operators use inside."""

from pyspark.sql import types as T

EXTRA = ("key", "hash", "score", "bucket", "line", "pos", "record", "shard", "slot", "fp", "root", "n", "kept",
         "text_hash", "seed", "window", "item_id", "label", "hits", "packed", "row_key", "dropped", "component_id",
         "_kept_id", "_kept_hash", "_leaky_id", "_leaky_hash", "_hits", "_new", "_hit_id", "prefix", "mask", "part", "n_docs")

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
LINE = "This common line is long enough to count as boilerplate text."
PASSAGE = "".join(chr(97 + (i * i + 7 * i) % 26) for i in range(260))

ROWS = [
    (0, None), (1, ""), (2, " \t\n \r"), (3, "one"), (4, LONG), (5, "\n".join([LINE, "a b c d e", LINE])),
    (6, LINE.upper() + "\nq"), (7, "  " + LINE + "\t"), (8, "x\n" + LINE), (9, LINE), (10, LINE + "\n"),
    (11, "A" * 900), (12, "tie one two three four five"), (13, "tie one two three four five"),
    (14, "é ß 中文 🙂 naïve\x0b\x0cend x \x1c y"), (15, PASSAGE + " left"), (16, "right " + PASSAGE),
    (17, "repeat " * 400), (18, "row twice"), (18, "row twice"), (19, "same id"), (19, "another text"),
    (None, "no id"), (None, "no id"), (None, None), (2**53, "big id"), (-5, "negative id"), (20, "a  b   c \n\n d "),
]


def frame(spark, rows=ROWS, partitions=3):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()),
                           *[T.StructField(c, T.StringType()) for c in EXTRA]])
    data = [(i, t, None if k % 2 else "en", len(t or ""), *[None if k % 3 else "x" for _ in EXTRA])
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema).repartition(partitions)


def bag(rows):
    """Rows as a sorted list, for comparison without order."""
    return sorted(rows, key=repr)
