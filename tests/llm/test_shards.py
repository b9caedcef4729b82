"""Shards: sizes, numbers, links kept, hot groups, planted communities."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import shards


def check(placed, rows, n):
    """Every row placed once, counts one apart at most, slots gapless, sizes and checksums right."""
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in placed) == want
    slots = defaultdict(list)
    for r in placed:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(n)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(slots[s]) == list(range(len(slots[s]))) for s in range(n))


def test_query(spark, data):
    import __spark_entry__ as entry

    df = entry.queries()["op11_sharding"](spark, data)
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    placed = df.collect()
    check(placed, docs, 16)
    found = shards.cut_links(df).first()
    assert found["links"] > 0 and found["cut"] == 0


def test_sf001(spark):
    """All equal texts of a larger table share a shard."""
    import __spark_entry__ as entry

    found = shards.cut_links(entry.queries()["op11_sharding"](spark, "/root/testdata/sf0.01")).first()
    assert found["links"] > 50 and found["cut"] == 0


@pytest.mark.parametrize("hot", [0.34, 0.9])
def test_hot_group_fills_whole_shards(spark, hot):
    """A group with a third (and nine tenths) of all rows is in few shards more than it needs; the others stay whole."""
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < hot else f"t{i // 3}") for i in range(6000)]
    df = shards.assign(spark.createDataFrame(rows, "doc_id long, text string"))
    placed = df.collect()
    check(placed, rows, 16)
    per = Counter(r["shard"] for r in placed if r["size"] == 4 and r["text_crc32"] == zlib.crc32(b"hot"))
    need = -(-sum(per.values()) // 375)
    assert need <= len(per) <= need + 2
    others = shards.cut_links(df.where(F.col("text_crc32") != zlib.crc32(b"hot"))).first()
    assert others["cut"] <= 0.1 * others["links"]


def test_all_rows_have_copies(spark):
    """Without any row to spare, groups change places: few are cut."""
    rows = [(i, f"t{i % 1500}") for i in range(6000)]
    df = shards.assign(spark.createDataFrame(rows, "doc_id long, text string"))
    check(df.collect(), rows, 16)
    found = shards.cut_links(df).first()
    assert found["links"] == 9000 and found["cut"] < 0.15 * 9000


def test_links_between_texts(spark):
    """Chains of linked documents, each text its own, gather: far fewer links are cut than by chance."""
    rng = random.Random(3)
    rows = [(i, f"text {i}") for i in range(1200)]
    links = [(c * 12 + a, c * 12 + b) for c in range(100) for a in range(12) for b in range(a) if rng.random() < 0.5]
    df = shards.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=4, links=spark.createDataFrame([*links, (5, 5), (7, 99999), (None, 3)], "x long, y long"))
    placed = df.collect()
    check(placed, rows, 4)
    at = {r["doc_id"]: r["shard"] for r in placed}
    assert sum(at[a] != at[b] for a, b in links) < 0.3 * len(links)  # by chance: three quarters


def test_edges(spark):
    """Nulls, repeated rows and ids, empty texts, clashing names, an empty table, fewer rows than shards."""
    rows = [(None, None, 1), (None, "", 1), (3, "é" * 40_000, 2), (3, "é" * 40_000, 2), (3, "x", 9), (4, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    placed = shards.assign(df).collect()
    check(placed, rows, 16)
    check(shards.assign(df, shards=2).collect(), rows, 2)
    check(shards.assign(df, shards=1).collect(), rows, 1)
    assert shards.assign(df.limit(0)).count() == 0
