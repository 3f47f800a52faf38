"""Sharding by balanced label propagation.

Documents with equal texts are linked through their common text. Each starts in a shard
by its id. In every round, the rows of a link that are in a shard are counted; each link
prefers the shard where most of its rows are, and its rows elsewhere ask to move there.
Requests are summed by pair of shards; granted are those that fit in the room of a shard
and exchanges, where as many rows go round a cycle of shards, so full shards take part.
Every other round, links prefer among the shards with room only. Within a pair of shards
requests are granted in the order of bins of a hash, rows of a link together. Rounds go on
until neither kind moves anything; each move joins rows to as many or more of their link,
so they end. Documents without links then fill what is left, and rows beyond a quota, if
any, are moved on with them, link by link: at the end numbers of rows differ by one at most
(law `rows`).

Only groups larger than a shard's quota, however hot, have rows drawn one by one; others are
cut where a quota ends inside them. Ranks come from counts by bin and ranks inside bins; no
shard is sorted in one task.

A null text is empty; equal texts are linked whatever their ids, empty ones too. A row
that repeats is a row of its own. A null id is placed like any other.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from callbook.llm.common import settle

SHARDS, BINS = 8, 1024
#: Rows of a bin in which ranks are worked out, about.
RANK_ROWS = 4000


def _lookup(values: dict[int, float], key: Column) -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v)]
    return F.element_at(F.create_map(*pairs), key)


def ranked(rows: DataFrame, by: str, order: str, bins: int, name: str) -> DataFrame:
    """rows with their rank, from 0, within each value of `by`, along hashes of `order`."""
    hashed = rows.withColumn("_hash", F.xxhash64(order)).withColumn(
        "_bin", F.shiftright("_hash", 40) + F.lit(1 << 23)).withColumn(
        "_bin", F.floor(F.col("_bin") * bins / F.lit(1 << 24)).cast("int"))
    counts = hashed.groupBy(by, "_bin").agg(F.count("*").alias("_n"))
    before = W.partitionBy(by).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(by, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy(by, "_bin").orderBy("_hash", order)) - 1
    return hashed.withColumn("_in", inside).join(starts, [by, "_bin"]) \
        .withColumn(name, F.col("_start") + F.col("_in")).drop("_hash", "_bin", "_in", "_start")


def flows(wanted: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many of the wanted rows may go from shard to shard: into room, and round cycles of shards."""
    left, room, granted = {k: n for k, n in wanted.items() if n > 0}, dict(room), {}

    def push(path: list[tuple[int, int]], most: int) -> None:
        n = min(most, *(left[e] for e in path))
        for e in path:
            granted[e] = granted.get(e, 0) + n
            left[e] -= n
            if not left[e]:
                del left[e]
        if most != math.inf:
            room[path[0][0]] += n
            room[path[-1][1]] -= n

    def cycle(start: int) -> list[tuple[int, int]] | None:
        """The shortest cycle through a shard."""
        back, work = {}, deque([start])
        while work:
            a = work.popleft()
            for x, b in left:
                if x != a or b in back:
                    continue
                back[b] = a
                if b == start:
                    path, at = [], start
                    while not path or at != start:
                        path.append((back[at], at))
                        at = back[at]
                    return path[::-1]
                work.append(b)
        return None

    for shard in sorted(room):
        while path := cycle(shard):
            push(path, math.inf)
    # Without cycles left, rows that move into room leave room behind them.
    while fits := [e for e in sorted(left) if room[e[1]] > 0]:
        push(fits[:1], room[fits[0][1]])
    return granted


def propagate(state: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """state: row, link, shard of the linked rows; the same with the shards after the rounds."""
    largest, turn, still = max(quotas.values()), 0, 0
    while still < 2:
        blocks = settle(state.groupBy("link", "shard").agg(F.count("*").alias("n")))
        loads = {r[0]: r[1] for r in blocks.groupBy("shard").agg(F.sum("n")).collect()}       # one row per shard
        room = {s: q - loads.get(s, 0) for s, q in quotas.items()}
        target = F.struct("n", F.xxhash64("link", "shard", F.lit(turn)).alias("h"), "shard")
        open_blocks = blocks if turn % 2 == 0 else blocks.where(_lookup(room, F.col("shard")) > 0)
        best = open_blocks.groupBy("link").agg(F.max(target).alias("b"))
        sizes = blocks.groupBy("link").agg(F.sum("n").alias("all"))
        # Only to more rows of the link, or as many: else a round could undo another.
        asking = blocks.join(best, "link").join(sizes, "link").where(target < F.col("b")).select(
            "link", "shard", "n", (F.col("all") > largest).alias("large"), F.col("b.shard").alias("to"),
            F.xxhash64("link", F.lit(turn), F.lit(1)).alias("hash")).withColumn("bin", F.pmod("hash", F.lit(BINS)).cast("int"))
        asking = settle(asking)
        wanted = asking.groupBy("shard", "to", "bin").agg(F.sum("n").alias("n"))
        asked = {(r[0], r[1]): r[2] for r in wanted.groupBy("shard", "to").agg(F.sum("n")).collect()}   # pairs of shards
        granted = flows(asked, room)
        turn += 1
        if not granted:
            still += 1
            continue
        most = F.element_at(F.create_map(*(F.lit(x) for (a, b), n in granted.items() for x in (f"{a} {b}", n))),
                            F.concat_ws(" ", "shard", "to"))
        pair = W.partitionBy("shard", "to")
        upto = F.sum("n").over(pair.orderBy("bin"))
        bins = wanted.withColumn("left", most - upto + F.col("n")).where("left > 0") \
            .select("shard", "to", "bin", "left", (F.col("left") >= F.col("n")).alias("fits"))
        fine = asking.join(bins, ["shard", "to", "bin"])
        # Of the one bin of a pair that does not fit as a whole: links in order as long as they fit, large ones last.
        inside = fine.where("NOT fits").withColumn("upto", F.sum("n").over(
            pair.orderBy("large", "n", "hash", "link").rowsBetween(W.unboundedPreceding, 0)))
        share = F.when(F.col("upto") <= F.col("left"), F.lit(1.0)).when(
            F.col("large"), F.greatest(1 - (F.col("upto") - F.col("left")) / F.col("n"), F.lit(0.0)))
        moves = fine.where("fits").select("link", "shard", "to", F.lit(1.0).alias("share")).union(
            inside.select("link", "shard", "to", share.alias("share")).where("share > 0"))
        draw = (F.shiftright(F.xxhash64("row", F.lit(turn)), 40) + F.lit(1 << 23)) / F.lit(1 << 24)
        moving = F.coalesce((F.col("share") >= 1) | (draw < F.col("share")), F.lit(False))
        state = settle(state.join(moves, ["link", "shard"], "left").select(
            "row", "link", F.when(moving, F.col("to")).otherwise(F.col("shard")).alias("shard"), moving.alias("moved")))
        still = 0 if state.where("moved").limit(1).count() else still + 1
        state = state.drop("moved")
    return state


def grouped(rows: DataFrame, by: str, quota: int, bins: int, name: str) -> DataFrame:
    """rows (row, link, by) with their rank, from 0, within `by`: links together, those of more than a quota last."""
    blocks = rows.groupBy(by, "link").agg(F.count("*").alias("_n")).withColumn("_hash", F.xxhash64("link")).withColumn(
        "_bin", F.pmod("_hash", F.lit(bins)) + F.when(F.col("_n") > quota, F.lit(bins)).otherwise(F.lit(0)))
    before = W.partitionBy(by).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.groupBy(by, "_bin").agg(F.sum("_n").alias("_m")).select(
        by, "_bin", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    earlier = W.partitionBy(by, "_bin").orderBy("_hash", "link").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_in", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(starts, [by, "_bin"]) \
        .select(by, "link", (F.col("_start") + F.col("_in")).alias("_first"))
    keyed = rows.withColumn("_block", F.struct(by, "link"))
    return ranked(keyed, "_block", "row", bins, "_at").join(blocks, [by, "link"]) \
        .withColumn(name, F.col("_first") + F.col("_at")).drop("_first", "_at", "_block")


def place(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (bytes of the text plus one), text_crc32, shard, slot (gapless within the shard) of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = settle(docs.select(
        F.col(key).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.xxhash64(body, F.octet_length(body)).alias("link")).withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    quotas = {s: total // shards + (s < total % shards) for s in range(shards)}
    groups = rows.groupBy("link").agg(F.count("*").alias("n")).where("n > 1").select("link")
    start = F.pmod(F.xxhash64("id", "row"), F.lit(shards)).cast("int")
    linked = settle(rows.join(groups, "link", "left_semi").select("row", "link", start.alias("shard")))
    linked = propagate(linked, quotas)

    bins, quota = max(16, min(1 << 14, total // RANK_ROWS)), max(quotas.values())
    placed = settle(grouped(linked, "shard", quota, max(bins // shards, 4), "rank"))
    staying = placed.where(F.col("rank") < _lookup(quotas, F.col("shard"))).select("row", "shard")
    used = {r[0]: r[1] for r in staying.groupBy("shard").count().collect()}         # one row per shard
    # Linked rows beyond a quota come first, link by link, then the documents without links.
    beyond = settle(placed.where(F.col("rank") >= _lookup(quotas, F.col("shard"))).select("row", "link").withColumn("all", F.lit(0)))
    moved = beyond.count()
    filling = rows.join(linked, "row", "left_anti").select("row").withColumn("all", F.lit(0))
    ranks = ranked(filling, "all", "row", bins, "rank").select("row", (F.col("rank") + moved).alias("rank"))
    if moved:
        ranks = ranks.union(grouped(beyond, "all", quota, bins, "rank").select("row", "rank"))
    shard, upto = F.lit(shards - 1), sum(q - used.get(s, 0) for s, q in quotas.items())
    for s in range(shards - 1, -1, -1):     # the free rows of shard s begin at `upto`
        upto -= quotas[s] - used.get(s, 0)
        shard = F.when(F.col("rank") >= upto, F.lit(s)).otherwise(shard) if s == shards - 1 else \
            F.when((F.col("rank") >= upto) & (F.col("rank") < upto + quotas[s] - used.get(s, 0)), F.lit(s)).otherwise(shard)
    final = settle(staying.union(ranks.select("row", shard.cast("int").alias("shard"))))
    slots = ranked(final, "shard", "row", max(bins // shards, 4), "slot")
    return rows.join(slots, "row").select(F.col("id").alias(key), "size", "text_crc32", "link", "shard",
                                          F.col("slot").cast("long").alias("slot"))
