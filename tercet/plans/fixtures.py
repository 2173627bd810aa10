"""The feature tables that the registered queries are run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tristate

LEXICON = {
    "lex_a": {"the": ["the"], "ing": ["ing"], "she": ["she"], "red": ["red"]},
    "lex_b": {"der": ["der"], "und": ["und"]},
    "lex_c": {"que": ["que"], "los": ["los"]},
    "lex_d": {"hand": ["hand"], "ring": ["ring"], "arm": ["arm"]},
    "lex_e": {"license": ["license"], "at": ["@"]},
}
FEATURES = tristate.features_of(LEXICON)
CATEGORIES = tristate.categories_of(LEXICON)
MAPPING = {"lex_a_the": "quality", "lex_b_und": "toxic", "lex_c_que": "quality", "lex_d_hand": "nowhere"}
ORDER_FEATURES = ["returnflag_R", "returnflag_A", "returnflag_N", "linestatus_O", "linestatus_F", "qty_low", "qty_mid", "qty_high", "disc_none", "disc_low", "disc_high"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a matrix: is a term part of the text?"""
    return tristate.keyword_matrix(table(spark, sf_dir, "documents"), "text", LEXICON, ["doc_id", "lang", "source"])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a matrix, with the priority as label; the quantity is unknown where there is no tax."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    rows = li.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    q, d = F.col("l_quantity"), F.col("l_discount")
    flags = tristate.scoped({f"returnflag_{v}": F.col("l_returnflag") == v for v in "RAN"}) | tristate.scoped({f"linestatus_{v}": F.col("l_linestatus") == v for v in "OF"})
    taxed = F.col("l_tax") != 0
    amounts = tristate.scoped({"qty_low": taxed & (q < 17), "qty_mid": taxed & (q >= 17) & (q < 34), "qty_high": taxed & (q >= 34)})
    off = tristate.scoped({"disc_none": d == 0, "disc_low": (d > 0) & (d < 0.05), "disc_high": d >= 0.05})
    return rows.select(F.col("o_orderpriority").alias("priority"), *(c.alias(n) for n, c in (flags | amounts | off).items()))


def questionnaire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' labels as a questionnaire of strings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    said = lambda c: F.when(F.col(c) == 1, "YES").when(F.col(c) == 0, "NO").alias(c)
    return rows.select("doc_id", "lang", "source", said("quality"), said("toxic"))


def subset(df: DataFrame) -> DataFrame:
    """The other data set for comparisons: documents of the sources with an odd number."""
    return df.where(F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 1)
