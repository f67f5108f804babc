"""Names that contain one another, found through an inverted q-gram index.

If one name contains another, every q-gram of the shorter one occurs in the
longer one; in particular its rarest. So the shorter name is looked up by its
rarest gram alone (grams of the indexed side are counted per key first), and
only those candidates are compared. Names shorter than q are their own gram.
No join has a key coarser than (key, gram), so a tenant with very many names is
spread over as many keys as its names have grams.

A key with few names on the indexed side (``FEW``) needs no index: they travel
as one bounded array, to which each name of the other side is compared. Its
names are spread over ``SLICES`` join keys.

Every join is a sort-merge join by hint: the planner takes an exploded side for
as small as its file and would send it whole through the driver. AQE still
splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Q = 3
# Names of a key that are compared without an index (about as many as a name has grams); join keys of such a key.
FEW = 32
SLICES = 4


def grams(name: Column, q: int) -> Column:
    """Distinct substrings of length ``q``; none of a shorter text."""
    places = F.sequence(F.lit(1), F.length(name) - q + 1)
    return F.when(F.length(name) >= q, F.array_distinct(F.transform(places, lambda i: F.substring(name, i, F.lit(q))))).otherwise(
        F.array().cast("array<string>"))


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast."""
    return df.hint("merge")


def _postings(side: DataFrame, key: str, name: str, upto: int = Q) -> DataFrame:
    every = F.concat(*[grams(F.col(name), q) for q in range(1, upto + 1)])
    return side.select(key, name, F.explode(every).alias("_g"))


def _own_grams(side: DataFrame, key: str, name: str) -> DataFrame:
    """The grams a name can be looked up by: its q-grams, or itself."""
    own = F.when(F.length(name) >= Q, grams(F.col(name), Q)).otherwise(F.array(name))
    return side.select(key, name, F.explode(own).alias("_g"))


def _indexed_pairs(one: DataFrame, two: DataFrame, key: str, a: str, b: str) -> DataFrame:
    index = _postings(two, key, b)
    counts = index.groupBy(key, "_g").agg(F.count(F.lit(1)).alias("_n"))
    rarest = F.min(F.struct("_n", "_g")).alias("_r")
    # a inside b: a gram of a that no b has rules a out
    held = _own_grams(one, key, a).join(merged(counts), [key, "_g"], "left")
    short = held.groupBy(key, a).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_g")).alias("_r")).filter("_r._n > 0")
    inside = short.select(key, a, F.col("_r._g").alias("_g")).join(merged(index), [key, "_g"]).filter(F.col(b).contains(F.col(a)))
    # b inside a: each b stands under its rarest gram only
    signs = _own_grams(two, key, b).join(merged(counts), [key, "_g"]).groupBy(key, b).agg(rarest).select(key, b, F.col("_r._g").alias("_g"))
    around = _postings(one, key, a).join(merged(signs), [key, "_g"]).filter(F.col(a).contains(F.col(b)))
    return inside.select(key, a, b).unionByName(around.select(key, a, b))


def containment_pairs(one: DataFrame, two: DataFrame, key: str = "_u", a: str = "_a", b: str = "_b", few: int = FEW) -> DataFrame:
    """(key, a, b), distinct, for names a of ``one`` and b of ``two`` with the
    same key of which one contains the other. Empty and null names are none.
    Keys with more than ``few`` names in ``two`` go through the index."""
    one = one.select(key, a).filter(F.col(a) != "").distinct()
    two = two.select(key, b).filter(F.col(b) != "").distinct()
    # the first few names of a key and one more, which tells that there are others
    first = two.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(b))).filter(F.col("_at") <= few + 1)
    held = first.groupBy(key).agg(F.collect_list(b).alias("_bs"))
    held = held.select(key, F.when(F.size("_bs") <= few, F.col("_bs")).alias("_bs"), F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("_slice"))

    def sized(side: DataFrame, name: str) -> DataFrame:
        return side.withColumn("_slice", F.pmod(F.xxhash64(name), F.lit(SLICES)).cast("int")).join(merged(held), [key, "_slice"])

    near = F.filter("_bs", lambda x: x.contains(F.col(a)) | F.col(a).contains(x))
    direct = sized(one, a).select(key, a, F.explode(near).alias(b))
    many = [sized(side, name).filter("_bs IS NULL").select(key, name) for side, name in ((one, a), (two, b))]
    return direct.unionByName(_indexed_pairs(*many, key, a, b).distinct())
