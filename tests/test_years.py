"""Queries over users whose numbers look like years, against their SQL: before, "User 1234" named the year 1234."""

from pathlib import Path

import duckdb
import pytest

from tests.conftest import DATA, plain


@pytest.fixture(scope="module")
def years(tmp_path_factory):
    """The smallest tables with 1,200 added to the users' numbers, and DuckDB's views of them."""
    folder, con = tmp_path_factory.mktemp("years"), duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        if p.stem != "events":
            (folder / p.name).symlink_to(p)
    con.execute(f"COPY (SELECT * REPLACE (user_id + 1200 AS user_id) FROM '{DATA}/events.parquet') TO '{folder}/events.parquet'")
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return str(folder), con


NAMES = [
    "d9_gold_anchors",
    "h5_ordered_dates",
    "answer_pipeline",
    "answer_pipeline_vi",
    "b8_reasoning_prompt",
    "b6_evidence",
    "d6_temporal_knn",
    "e1_min_distance",
    "e14_chain_recall",
    "g2_proximity_order",
    "g7_seeded_shuffle",
    "g6_semantic_chain",
]


@pytest.mark.parametrize("name", NAMES)
def test_numbers_of_users_are_no_years(spark, years, name):
    import __spark_entry__ as entry

    folder, con = years
    df = entry.queries()[name](spark, folder)
    frame = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(df.columns) == sorted(frame.columns)
    got = plain([r.asDict() for r in df.collect()], df.columns)
    assert got == plain(frame.to_dict("records"), list(frame.columns)) and got
