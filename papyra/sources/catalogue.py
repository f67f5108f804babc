"""A9 load_type_catalogue: pasted tab-separated field definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Type words accepted in a pasted row (Spanish and English).
PASTE_TYPES = {"numero": "number", "number": "number", "fecha": "date", "date": "date",
               "booleano": "boolean", "boolean": "boolean", "lista": "array", "array": "array",
               "texto": "string", "string": "string"}
REQUIRED_WORDS = ("si", "sí", "true", "1")


def _js_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_catalogue(pastes: DataFrame, type_col="type_name", text_col="text") -> DataFrame:
    """One pasted text per type → one row per field, in paste order:
    name, label (default name), type (synonyms, default string), required
    (si/sí/true/1) and description. Blank rows are dropped."""
    rows = pastes.select(type_col, F.posexplode(F.split(text_col, "\n", -1)).alias("row_no", "row"))
    rows = rows.filter(_js_trim(F.col("row")) != "")
    cols = F.split("row", "\t", -1)

    def col(i):
        return _js_trim(F.get(cols, i))

    tmap = F.create_map(*[F.lit(x) for kv in PASTE_TYPES.items() for x in kv])
    name = F.coalesce(col(0), F.lit(""))
    label = F.coalesce(F.nullif(col(1), F.lit("")), F.nullif(col(0), F.lit("")), F.lit(""))
    ftype = F.coalesce(F.element_at(tmap, F.lower(col(2))), F.lit("string"))
    required = F.coalesce(F.lower(col(3)).isin(*REQUIRED_WORDS), F.lit(False))
    desc = F.coalesce(F.nullif(col(4), F.lit("")), F.lit(""))
    w = F.row_number().over(Window.partitionBy(type_col).orderBy("row_no"))
    return rows.select(type_col, "row_no", name.alias("name"), label.alias("label"), ftype.alias("type"),
                       required.alias("required"), desc.alias("description")).withColumn("position", w).drop("row_no")


def field_schema(fields: DataFrame, type_col="type_name") -> DataFrame:
    """Fields grouped into one ``field_schema`` struct per type, in order
    (a type's schema is a pasted block: bounded by what one paste holds)."""
    return fields.groupBy(type_col).agg(F.struct(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "name", "type", "label", "required", "description"))),
        lambda s: F.struct(s["name"].alias("name"), s["type"].alias("type"), s["label"].alias("label"),
                           s["required"].alias("required"), s["description"].alias("description"))
    ).alias("fields")).alias("field_schema"))


def read_catalogue_files(spark: SparkSession, root: str) -> DataFrame:
    """Pasted schemas stored one per file (file name = type name)."""
    df = spark.read.text(root, wholetext=True)
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    return parse_catalogue(df.select(name.alias("type_name"), F.col("value").alias("text")))
