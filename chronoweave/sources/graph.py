"""Facts of a temporal knowledge graph: scans, endpoints, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import dates, text

COLUMNS = ["s", "p", "o", "ts"]


def parse_lines(lines: DataFrame, value: str = "value", strip_all: bool = True) -> DataFrame:
    """Facts of tab-separated lines; blank lines and lines without exactly four fields are dropped, repeats are kept.

    With `strip_all` white space at the ends goes first, so a line with an empty last field has three;
    otherwise only the line feed goes."""
    line = text.strip(F.col(value)) if strip_all else F.regexp_replace(F.col(value), r"\n$", "")
    fields = F.split(line, "\t")
    return lines.where(line != "").select(fields.alias("f")).where(F.size("f") == 4).select(*[F.col("f")[i].alias(c) for i, c in enumerate(COLUMNS)])


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def dated(facts: DataFrame) -> DataFrame:
    """`facts` with their date `d`; facts with a `ts_end` have the one in the middle."""
    return facts.withColumn("d", dates.fact_date(F.col("ts"), F.col("ts_end") if "ts_end" in facts.columns else None))


def endpoints(facts: DataFrame, loops_twice: bool = True) -> DataFrame:
    """Each fact under its subject and its object as `e`; a self-loop twice, or once if only membership counts.

    Joins on one of two columns become one equi-join on `e`, which hashes and shuffles instead of comparing all pairs."""
    both = F.array("s", "o")
    return facts.select(F.explode(both if loops_twice else F.array_distinct(both)).alias("e"), *facts.columns)


def entities(facts: DataFrame) -> DataFrame:
    return facts.select(F.explode(F.array("s", "o")).alias("entity")).distinct()


def relations(facts: DataFrame) -> DataFrame:
    return facts.select(F.col("p").alias("relation")).distinct()


def relation_ids(spark: SparkSession, path: str) -> DataFrame:
    """Relations from a JSON object whose keys they are."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,long>").alias("m"))
    return parsed.select(F.explode(F.map_keys("m")).alias("relation"))
