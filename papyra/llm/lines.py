"""Line deduplication across documents: explode normalised lines, hash them,
count distinct documents per hash, drop frequent lines, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, free_name, id_text


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hits(base: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``hit_id, hit_row, dropped``: per document (id and hash of its text) the
    positions of the lines to drop.

    Lines are explode-hashed to 128 bits; (hash, id) pairs are pre-aggregated,
    so a line held by a third of all documents is spread by id first and
    reaches the per-hash count as one partial row per task. The hit lines come
    from an equi-join on the hash (AQE splits a hot hash) and return to their
    document as a list of positions no longer than the document."""
    long_lines = (base.select("doc_id", F.xxhash64("text").alias("row_key"),
                              F.posexplode(F.transform(F.split("text", "\n", -1), _key)).alias("pos", "key"))
                  .filter(F.length("key") >= min_chars)
                  .select("doc_id", "row_key", "pos", F.xxhash64("key").alias("h1"),
                          F.xxhash64(F.lit("line"), "key").alias("h2"), F.length("key").alias("size")))
    common = (long_lines.groupBy("h1", "h2", "doc_id").agg(F.max("size").alias("size"))
              .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"),
                                       F.max("size").alias("size"))
              .filter(F.col("n_docs") >= min_docs))
    # the size in the key makes both sides be dealt anew, so that AQE may split a hot line
    return (long_lines.join(common, ["h1", "h2", "size"])
            .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .groupBy(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_row"))
            .agg(F.collect_set("pos").alias("dropped")))


def _kept(text: Column, dropped: Column) -> Column:
    """The text without the lines at the dropped positions."""
    line = F.split(text, "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(line) - 1), dropped)
    return F.array_join(F.transform(places, lambda p: line[p]), "\n")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, text, n_lines, n_dropped, kept_text``.

    A line's key is the line stripped of ASCII white space and with A-Z
    lower-cased. Lines whose key has at least ``min_chars`` code points and is
    found in at least ``min_docs`` distinct documents go everywhere but in the
    largest id that holds the key; the others stay in order.

    Null or empty text: one empty line. Null id: counts as one document that
    is smaller than all others. Rows repeated with the same id and text get
    the same result each; rows with one id and different texts are one
    document for the count and are cleaned separately. An empty table gives
    no rows.
    """
    base = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    hits = _hits(base, min_chars, min_docs)
    joined = base.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_row")), "left")
    return joined.select(
        "doc_id", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(_kept(F.col("text"), F.col("dropped"))).alias("kept_text"))


def clean_documents(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Pipeline form: the input's columns with frequent lines dropped from
    ``text`` (null stays null where nothing was dropped) and ``n_chars``, if
    there is one, set to the new length of changed texts.

    Positions are joined by (id, text), so extra columns pass through whatever
    their names; rows that repeat id and text are cleaned alike.
    """
    base = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    hit_id, hit_row, dropped = (free_name(docs, c) for c in ("_hit_id", "_hit_row", "_dropped"))
    hits = _hits(base, min_chars, min_docs).toDF(hit_id, hit_row, dropped)
    joined = docs.join(hits, docs["doc_id"].eqNullSafe(F.col(hit_id))
                       & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(hit_row)), "left")
    changed = F.when(F.col(dropped).isNotNull(), _kept(docs["text"], F.col(dropped)))
    new = {"text": F.coalesce(changed, docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length(changed).cast(docs.schema["n_chars"].dataType), docs["n_chars"])
    return joined.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])
