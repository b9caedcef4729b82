"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the workers
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(DATA).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows, columns) -> list[tuple]:
    """Rows in one order and form, whichever engine they are from."""

    def cell(x):
        if x is None or x != x or str(x) == "<NA>":
            return None
        if isinstance(x, float):
            return f"{x:.9g}"
        return tuple(map(cell, x)) if isinstance(x, list | tuple) or hasattr(x, "tolist") and getattr(x, "ndim", 0) else str(x)

    return sorted((tuple(cell(r[c]) for c in sorted(columns)) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, data, duck):
    """Holds a registered query against its SQL."""

    def check(name: str) -> int:
        import __spark_entry__ as entry

        df = entry.queries()[name](spark, data)
        got = plain([r.asDict() for r in df.collect()], df.columns)
        frame = duck.execute(entry.oracle_sql()[name]).df()
        want = plain(frame.to_dict("records"), list(frame.columns))
        assert sorted(df.columns) == sorted(frame.columns)
        assert got == want
        return len(got)

    return check
