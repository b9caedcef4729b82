"""Questions in one schema from two source schemas, and sample manifests."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.sources.tables import write_text

COLUMNS = ("qid", "question_vi", "question_en", "answers", "answer_type", "qtype", "qlabel", "qgroup", "time_level")
POINT, INTERVAL = "point", "interval"
SIMPLE_TYPES = ("simple_entity", "simple_time")  # fixed values of the interval corpus


def _or_empty(df: DataFrame, name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def adapt(records: DataFrame, dataset: str) -> DataFrame:
    """Records of the point or the interval corpus as questions; an unknown corpus raises."""
    if dataset == POINT:
        qid, qtype, qlabel, qgroup, level = F.col("quid"), F.col("qtype"), F.col("qlabel"), F.col("qlabel"), _or_empty(records, "time_level")
    elif dataset == INTERVAL:
        simple = F.col("type").isin(*SIMPLE_TYPES)
        qid, qtype, level = F.col("uniq_id"), F.col("type"), F.lit("")
        qlabel, qgroup = F.when(simple, "Single").otherwise("Multiple"), F.when(simple, "Simple").otherwise("Complex")
    else:
        raise ValueError(f"unknown corpus {dataset!r}; there are {POINT!r} and {INTERVAL!r}")
    columns = qid.cast("string"), F.col("question"), _or_empty(records, "question_en"), F.col("answers").cast("array<string>"), F.col("answer_type"), qtype, qlabel, qgroup, level
    return records.select(*[c.alias(n) for c, n in zip(columns, COLUMNS, strict=True)])


def base_folder(explicit: str | None, variable: str, default: str) -> str:
    """Where question files are: what the caller says, else the environment, else the default."""
    return explicit or os.environ.get(variable) or default


def read_json(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """A JSON array of records; any file system or HTTP location that Spark's readers open."""
    return adapt(spark.read.json(path, multiLine=True), dataset)


def in_language(lang, vi: str = "question_vi", en: str = "question_en"):
    """The English text for `en`, the Vietnamese one otherwise."""
    return F.when(F.lit(lang) == "en", F.col(en)).otherwise(F.col(vi))


def head(df: DataFrame, n: int, position: str = "pos") -> DataFrame:
    """The first n rows of a file's order."""
    return df.orderBy(position).limit(n)


def write_manifest(path: str, sample: DataFrame, dataset: str, split: str, n: int, seed: int) -> dict:
    """A sample's ids in order with counts of strata, as one JSON file. `sample` is at most `n` rows, which the manifest names."""
    rows = sample.select("pos", "qid", "stratum").orderBy("pos").limit(n).collect()
    strata: dict[str, int] = {}
    for r in rows:
        strata[r["stratum"]] = strata.get(r["stratum"], 0) + 1
    out = {"sample_id": f"{dataset}_n{n}_seed{seed}", "dataset": dataset, "split": split, "n": len(rows), "seed": seed, "strata": dict(sorted(strata.items())), "quids": [r["qid"] for r in rows]}
    write_text(sample.sparkSession, path, json.dumps(out, ensure_ascii=False, indent=1))
    return out


def read_manifest(spark: SparkSession, path_or_name: str, folder: str = ".") -> DataFrame:
    """(sample_id, pos, qid) of a manifest, by path or by name in a folder."""
    path = path_or_name if "/" in path_or_name or path_or_name.endswith(".json") else f"{folder}/{path_or_name}.json"
    schema = "sample_id string, quids array<string>"
    return spark.read.schema(schema).json(path, multiLine=True).select("sample_id", F.posexplode("quids").alias("pos", "qid"))


def select_in_order(questions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Questions of a manifest with its positions; ids without a question fall away."""
    return manifest.select("pos", "qid").join(questions, "qid")
