"""Balanced label propagation: documents are dealt over shards of equal size so that few links are cut.

Documents with equal texts are linked; `links` may add pairs of ids.  Rows of a group (one text) are dealt over `UNITS`
units by the hash of their row, so that a group with a third of all rows is many units; a unit moves as a whole.  Groups that would fill a quarter of a
shard or more (so few that the driver packs them) begin in as few shards as they need, all other units by their hash in what room that leaves.  In each round a group's shards get votes: the rows that it has there and those of its neighbours, a join and a
sum.  A unit wants into the shard with most votes (in every second round: among those with room), if these are more than its own shard's.
Of what wants from one shard into another, as much may go as wants the other way, and what the room there adds: a share that is drawn by
the group's hash (by the unit's where a group is larger than the room).  With further links half of the groups may move in a round, or two
neighbours would change places for ever.  Rounds end when no unit wants to move, or none may.

The law is `rows`: the sizes of shards differ by one row at most.  Rows are numbered in each shard, linked ones first, group
by group; those past the shard's number of rows go to the free places of the others.  Rows without links are last, so they
fill what linked rows leave.  Numbers are sums over blocks of rows of bounded size, so no window holds a shard.  What the driver gets is one row for
each pair of shards.

All of it is DataFrame functions.  Null texts count as empty ones.  Repeated rows and rows without ids are rows like others;
further columns have no effect; an empty table gives an empty result.  Links of ids that no row has, or from a text to itself, have no effect.
Texts whose 64-bit hashes, sizes and checksums all agree are taken for equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.util import Rounds, _q, cut

#: Units of a group at most; rounds at most; rows of a block that is numbered at once.
UNITS, ROUNDS, BLOCK = 256, 12, 1 << 16
#: Rows of a group that are numbered in one block at most.
LARGE = 1024
#: What linked rows may fill of a shard in the rounds: past its size, whole groups go on to the free places of others in the end.
FILL = 1.05
_DRAWS = 1 << 20


def rows_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """no (of the row), doc_id, size, text_crc32, g (the text's group) and unit of every row, written: row numbers hold from then on."""
    body = F.coalesce(F.col(_q(text)), F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("no"),
        F.col(_q(doc_id)).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("h"),
    )
    found = found.select("no", "doc_id", "size", "text_crc32", F.xxhash64("h", "size", "text_crc32").alias("g"), F.pmod(F.xxhash64("no", F.lit(11)), F.lit(UNITS)).cast("int").alias("unit"))
    return cut(found, docs.sparkSession)


def _packed(totals: dict[int, int], shards: int, capacity: float) -> tuple[list[tuple[int, int, int]], list[float]]:
    """(g, unit, shard) of large groups, each in the emptiest shards one after the other, and the room that they leave."""
    room, out = [capacity] * shards, []
    for g, total in sorted(totals.items(), key=lambda x: (-x[1], x[0])):
        unit = 0
        while unit < UNITS:
            s = max(range(shards), key=lambda k: (room[k], -k))
            here = min(UNITS - unit, max(1, round(room[s] * UNITS / total)))
            out += [(g, u, s) for u in range(unit, unit + here)]
            unit, room[s] = unit + here, room[s] - here * total / UNITS
    return out, room


def _start(room: list[float]) -> Column:
    """The shard in which a row begins: a draw by its unit, in proportion to the room of each."""
    weights = [max(r, 0.0) for r in room] if max(room) > 0 else [1.0] * len(room)
    bounds = [round(_DRAWS * sum(weights[: k + 1]) / sum(weights)) for k in range(len(room) - 1)]
    draw = F.pmod(F.xxhash64("g", "unit"), F.lit(_DRAWS))
    return F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda b: b <= draw)) if bounds else F.lit(0)


def _edges(rows: DataFrame, links: DataFrame) -> DataFrame:
    """g, other, weight of the links between texts, in both directions."""
    one, two = links.columns[:2]
    at = lambda side: rows.where("doc_id is not null").select(F.col("doc_id").cast("string").alias(side), F.col("g").alias(f"g_{side}")).distinct()
    pairs = links.select(F.col(_q(one)).cast("string").alias("a"), F.col(_q(two)).cast("string").alias("b")).join(at("a"), "a").join(at("b"), "b").where("g_a <> g_b")
    both = pairs.select(F.explode(F.array(F.struct(F.col("g_a").alias("g"), F.col("g_b").alias("other")), F.struct(F.col("g_b").alias("g"), F.col("g_a").alias("other")))).alias("e"))
    return both.select("e.g", "e.other").groupBy("g", "other").agg(F.count("*").alias("weight"))


def _wishes(units: DataFrame, edges: DataFrame | None, room: list[float], closed: bool) -> DataFrame:
    """`units` (g, unit, n, total, shard) with `wish`, the shard that each wants into, or its own; `closed`: only shards with room count."""
    held = units.groupBy("g", "shard").agg(F.sum("n").alias("votes"))
    if edges is not None:
        beside = edges.join(held.withColumnRenamed("g", "other"), "other").select("g", "shard", (F.col("weight") * F.col("votes")).alias("votes"))
        held = held.unionByName(beside).groupBy("g", "shard").agg(F.sum("votes").alias("votes"))
    # At most one entry for each shard, whatever a group's size.
    entry = F.struct("votes", F.pmod(F.xxhash64("g", "shard"), F.lit(1 << 30)).alias("tie"), "shard")
    seen = held.groupBy("g").agg(F.collect_list(entry).alias("seen"))
    has_room = F.array(*[F.lit(not closed or r >= 1) for r in room])
    best = F.array_max(F.filter("seen", lambda x: F.get(has_room, x["shard"])))
    own = F.array_max(F.filter("seen", lambda x: x["shard"] == F.col("shard")))
    joined = units.join(seen, "g").withColumn("best", best).withColumn("own", own)
    more = (F.col("best.votes") > F.col("own.votes")) | ((F.col("best.votes") == F.col("own.votes")) & (F.col("best.tie") > F.col("own.tie")))
    return joined.select("g", "unit", "n", "total", "shard", F.when(more, F.col("best.shard")).otherwise(F.col("shard")).alias("wish"))


def _quotas(wanted: dict[tuple[int, int], int], room: list[float]) -> list[tuple[int, int, float, float]]:
    """shard, wish, share that may go, room: what changes places, and each pair's part of the room."""
    rest = {(s, t): n - min(n, wanted.get((t, s), 0)) for (s, t), n in wanted.items()}
    into = [sum(n for (_, t), n in rest.items() if t == shard) for shard in range(len(room))]
    return [(s, t, (n - rest[s, t] + min(rest[s, t], max(0.0, room[t]) * rest[s, t] / max(into[t], 1))) / n, float(room[t])) for (s, t), n in wanted.items()]


def _moved(wishes: DataFrame, quotas: list[tuple[int, int, float, float]], round_: int, halves: bool) -> DataFrame:
    """Units after a round: in the shard of their wish, where the draw falls into the share that may go there."""
    shares = wishes.sparkSession.createDataFrame(quotas, "shard int, wish int, share double, room double")  # at most one row for two shards
    draw = F.when(F.col("total") <= F.col("room") / 16, F.xxhash64("g", F.lit(round_))).otherwise(F.xxhash64("g", "unit", F.lit(round_)))
    moves = F.pmod(draw, F.lit(_DRAWS)) < F.col("share") * _DRAWS
    if halves:
        moves &= F.pmod(F.xxhash64("g", F.lit(-1 - round_)), F.lit(2)) == 0
    return wishes.join(shares, ["shard", "wish"], "left").select("g", "unit", "n", "total", F.when(moves, F.col("wish")).otherwise(F.col("shard")).alias("shard"))


def propagated(rows: DataFrame, links: DataFrame | None, shards: int, rounds: int = ROUNDS) -> tuple[DataFrame, Column]:
    """g, unit, total, shard of every unit that has links, after the rounds; and where other rows begin."""
    spark = rows.sparkSession
    edges = None if links is None else cut(_edges(rows, links), spark)
    units = rows.groupBy("g", "unit").agg(F.count("*").alias("n"))
    totals = units.groupBy("g").agg(F.sum("n").alias("total"))
    linked = totals.where("total > 1")
    if edges is not None:
        linked = totals.join(edges.select("g").distinct().withColumn("_edge", F.lit(True)), "g", "left").where("total > 1 or _edge").drop("_edge")
    number, tables, idle = rows.count(), Rounds(spark), 0
    capacity = FILL * number / shards
    units = tables.keep("first", units.join(linked, "g"))
    large = units.where(F.col("total") * 4 >= number / shards).where("total > 1").select("g", "total").distinct().collect()  # at most four for each shard
    packed, left = _packed(dict(map(tuple, large)), shards, number / shards)
    begun = spark.createDataFrame(packed, "g long, unit int, packed int")
    units = tables.keep("units", units.join(begun, ["g", "unit"], "left").withColumn("shard", F.coalesce("packed", _start(left))).drop("packed"))
    tables.drop("first")
    for k in range(rounds):
        held = {r["shard"]: r["n"] for r in units.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        room = [capacity - held.get(s, 0) for s in range(shards)]
        wishes = tables.keep("wishes", _wishes(units, edges, room, closed=k % 2 == 1))
        flows = wishes.where("wish <> shard").groupBy("shard", "wish").agg(F.sum("n").alias("n")).collect()  # one row for two shards
        quotas = _quotas({(r["shard"], r["wish"]): r["n"] for r in flows}, room)
        idle = 0 if sum(share * r["n"] for r, (_, _, share, _) in zip(flows, quotas, strict=True)) >= 1 else idle + 1
        if idle == 2 or not flows and k % 2 == 0:
            break
        if flows:
            units = tables.keep("units", _moved(wishes, quotas, k, edges is not None))
    tables.drop("wishes")
    return units.select("g", "unit", "total", "shard"), _start(left)


def _numbered(rows: DataFrame, shards: int, number: int) -> tuple[DataFrame, list[int]]:
    """`rows` (with shard and total, the size of a linked group) and slot: numbers from 0 in each shard, linked rows first,
    group by group; and the number of rows of each shard."""
    blocks = max(64, number // (shards * BLOCK))
    # A large group is a block for each of its units.
    key = {"single": F.isnull("total"), "b": F.pmod(F.xxhash64("g", F.lit(3)), F.lit(blocks)), "part": F.when(F.col("total") > LARGE, F.col("unit")).otherwise(-1)}
    rows = cut(rows.withColumns(key), rows.sparkSession)
    sizes = rows.groupBy("shard", *key).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy(*key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("before", before).drop("n")
    inside = F.row_number().over(W.partitionBy("shard", *key).orderBy("g", "no"))
    held = {r["shard"]: r["n"] for r in sizes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    numbered = rows.withColumn("inside", inside).join(offsets, ["shard", *key]).withColumn("slot", F.col("before") + F.col("inside") - 1)
    return numbered, [held.get(s, 0) for s in range(shards)]


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shards: int = 16, links: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row of `docs`.

    `links`: pairs of ids in its first two columns."""
    rows = rows_of(docs, doc_id, text)
    number = rows.count()
    units, start = propagated(rows, links, shards, rounds)
    placed = rows.join(units, ["g", "unit"], "left").withColumn("shard", F.coalesce("shard", start))
    placed, held = _numbered(placed, shards, number)
    quota = [number // shards + (s < number % shards) for s in range(shards)]
    past, free, end = [0], [], 0
    for s in range(shards):
        past.append(past[-1] + max(0, held[s] - quota[s]))
        if quota[s] > held[s]:
            free.append((s, end, end := end + quota[s] - held[s]))
    each = lambda values: F.array(*[F.lit(v).cast("long") for v in values])[F.col("shard")]
    # The k-th row past its shard's number takes the k-th free place.
    place = F.when(F.col("slot") >= each(quota), F.col("slot") - each(quota) + each(past[:-1]))
    shard, slot = F.col("shard"), F.col("slot")
    for s, first, last in free:
        here = (F.col("place") >= first) & (F.col("place") < last)
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, F.col("place") - first + held[s]).otherwise(slot)
    return placed.withColumn("place", place).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(rows: DataFrame, group: str = "text_crc32", shard: str = "shard") -> DataFrame:
    """groups, spread (shards that groups are in beyond one each), links and links cut, of placed rows with equal `group`."""
    per = rows.groupBy(group, shard).agg(F.count("*").alias("n")).groupBy(group).agg(F.sum("n").alias("total"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside"), F.count("*").alias("parts"))
    pairs = F.sum(F.col("total") * (F.col("total") - 1) / 2)
    return per.agg(F.count("*").alias("groups"), F.sum(F.col("parts") - 1).alias("spread"), pairs.cast("long").alias("links"), (pairs - F.sum("inside")).cast("long").alias("cut"))
