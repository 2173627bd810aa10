"""Readers and writers: text tables, JSON documents, lines of JSON, and the stores that a long run resumes from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank, strip


def missing(df: DataFrame, wanted: Sequence[str]) -> None:
    absent = [c for c in wanted if c not in df.columns]
    if absent:
        raise ValueError(f"columns are missing: {', '.join(absent)}; there are {', '.join(df.columns)}")


def read_captions(spark: SparkSession, path: str, text: str, required: Sequence[str] = (), *, drop_blank: bool = True) -> DataFrame:
    """A table of texts, in Parquet or in CSV with a header, whose columns are strings. A null text becomes empty; blank ones go unless kept."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing(df, [text, *required])
    df = df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    return df.where(~is_blank(text)) if drop_blank else df


def read_matrix(spark: SparkSession, path: str, meta: Sequence[str]) -> DataFrame:
    """A feature matrix from CSV: the columns `meta` are strings, the others states; what isn't a number is unknown."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    states = [F.coalesce(F.expr(f"try_cast(`{c}` as tinyint)"), F.lit(2).cast("tinyint")).alias(c) for c in df.columns if c not in meta]
    return df.select(*(c for c in df.columns if c in meta), *states)


def read_pairs(spark: SparkSession, path: str | None, default: Sequence[tuple[str, str]]) -> DataFrame:
    """(true_label, confused_with): the default pairs and the file's, trimmed; rows with a blank are dropped."""
    own = spark.createDataFrame(list(default), "true_label string, confused_with string")
    if path is None:
        return own
    df = spark.read.csv(path, header=True)
    missing(df, ["true_label", "confused_with"])
    more = df.select(strip("true_label").alias("true_label"), strip("confused_with").alias("confused_with"))
    return own.unionByName(more.where("true_label <> '' and confused_with <> ''"))


def read_tags(df: DataFrame, text: str, tags: str, order: str) -> DataFrame:
    """(text, tags array<string>), a row a text, of its first row; what isn't a JSON array of strings counts as none."""
    parsed = F.coalesce(F.from_json(tags, "array<string>"), F.array().cast("array<string>"))
    return df.groupBy(strip(text).alias("text")).agg(F.min_by(parsed, order).alias("tags"))


SCHEMA_DOCUMENT = T.StructType([T.StructField("feature_categories", T.ArrayType(T.StructType([T.StructField("category", T.StringType()), T.StructField("description", T.StringType()), T.StructField("features", T.ArrayType(T.StringType())), T.StructField("comparable_features", T.ArrayType(T.StringType()))])))])


def read_schema(spark: SparkSession, path: str) -> DataFrame:
    """(category, value, feature_idx) of a schema document, in its order."""
    doc = spark.read.schema(SCHEMA_DOCUMENT).json(path, multiLine=True)
    rows = doc.select(F.posexplode("feature_categories").alias("c", "k")).select("c", "k.category", F.posexplode("k.features").alias("f", "value"))
    return rows.where(~is_blank("value")).orderBy("c", "f").select("category", "value", (F.col("c") * 100_000 + F.col("f")).alias("feature_idx"))


def write_lines(lines: DataFrame, path: str) -> None:
    """(line) as text; the write is whole or not there."""
    lines.select("line").write.mode("errorifexists").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


class Checkpoint:
    """A table of done texts that a run appends to and resumes from. States are kept by feature's name, so that a schema in another order doesn't mix them up."""

    SCHEMA = "text string, status string, states map<string,tinyint>"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def add(self, done: DataFrame) -> None:
        done.select("text", "status", "states").write.mode("append").parquet(self.path)

    def load(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def remaining(self, texts: DataFrame) -> DataFrame:
        """Those of texts (text) that aren't done, or failed and weren't done since."""
        return texts.join(self.load().where("status <> 'failed'").select("text"), "text", "left_anti")

    def vectors(self, features: Sequence[str]) -> DataFrame:
        """(text, one column a feature); a feature that wasn't known then is unknown."""
        states = [F.coalesce(F.element_at("states", F.lit(f)), F.lit(2).cast("tinyint")).alias(f) for f in features]
        return self.load().where("status <> 'failed'").dropDuplicates(["text"]).select("text", *states)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A result as parquet, csv or json."""
    writer = df.write.mode("errorifexists")
    {"parquet": writer.parquet, "json": writer.json, "csv": lambda p: writer.csv(p, header=True)}[kind](path)
