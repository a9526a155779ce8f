"""Even shards by balanced label propagation over documents that share a text. DataFrame operations only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import stage
from .layout import running, texts


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), index.cast("int") + 1)


def _interval(ends: list[int], value: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(int(e)).cast("long") for e in ends]), lambda e: e <= value)).cast("int")


def shards(docs: DataFrame, n_shards: int = 24, rounds: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): law ``rows``, every shard has as many rows as any other, or one more.

    Documents with equal texts (64-bit hash) are linked. Each starts in a shard by its hash; in each round a set of linked documents moves
    to the shard where most of its neighbours are, as far as quotas (the even size less what has settled) allow, in a hashed order by
    distributed running totals. Sets that find no room look for another shard in the next round. A set larger than half a
    shard moves in pieces, so that one text of a third of all rows is spread over as few shards as can hold it. Unlinked documents
    cost no edge anywhere and fill the shards up to their exact size. ``slot`` numbers the rows of a shard from 0.

    A null or empty text has size 8 and links like any other; repeated rows and null doc_ids are rows of their own; grown_shard is null under
    this law; an empty table gives an empty one."""
    plain = texts(docs, key, text)
    base = stage(plain.select("doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
                              F.xxhash64("text").alias("g"), F.monotonically_increasing_id().alias("rid")))
    total = base.count()
    cells = max(8, total // 20_000)
    cap = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    piece = max(1, total // n_shards // 2)
    groups = base.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    linked = base.select("rid", "doc_id", "g").join(groups, "g")
    large = running(linked.where(F.col("n") > piece), ["g"], ["rid"], F.lit(1), cells, "rank").withColumn("chunk", F.floor(F.col("rank") / piece)).drop("rank")
    linked = linked.where(F.col("n") <= piece).withColumn("chunk", F.lit(0).cast("long")).unionByName(large)
    linked = stage(linked.select("rid", "g", "chunk", F.pmod(F.xxhash64("doc_id", "rid"), F.lit(n_shards)).cast("int").alias("shard")))
    seats = stage(linked.groupBy("g", "chunk", "shard").agg(F.count(F.lit(1)).alias("n")))  # neighbours of each set by shard
    units = seats.groupBy("g", "chunk").agg(F.sum("n").alias("n"))
    settled, load = None, [0] * n_shards
    for turn in range(rounds):
        free = [c - used for c, used in zip(cap, load)]
        open_ = units if settled is None else units.join(settled.select("g", "chunk"), ["g", "chunk"], "left_anti")
        wish = seats.select("g", "chunk", "shard", "n")
        if settled is not None:
            wish = wish.unionByName(open_.select("g", "chunk").join(settled.groupBy("g", "shard").agg(F.sum("n").alias("n")), "g"))
        # any shard may be wished for, so that a set whose neighbours' shards are full can settle: the roomiest of three at random, with no gain
        draws = F.array(*[F.struct(_pick(free, F.pmod(F.xxhash64("g", "chunk", F.lit(turn), F.lit(i)), F.lit(n_shards))).alias("room"),
                                   F.pmod(F.xxhash64("g", "chunk", F.lit(turn), F.lit(i)), F.lit(n_shards)).cast("int").alias("shard")) for i in range(3)])
        wish = wish.unionByName(open_.select("g", "chunk", F.array_max(draws)["shard"].alias("shard"), F.lit(0).cast("long").alias("n")))
        best = (wish.groupBy("g", "chunk", "shard").agg(F.sum("n").alias("gain")).join(open_, ["g", "chunk"])
                .where(_pick(free, F.col("shard")) >= F.col("n"))
                .groupBy("g", "chunk", "n").agg(F.max(F.struct("gain", F.xxhash64("g", "chunk", "shard").alias("tie"), "shard")).alias("best"))
                .select("g", "chunk", "n", F.col("best.shard").alias("shard")))
        quota = running(best, ["shard"], ["g", "chunk"], F.col("n"), cells)
        moved = stage(quota.where(F.col("before") + F.col("n") <= _pick(free, F.col("shard"))).select("g", "chunk", "n", "shard"))
        gained = {r[0]: r[1] for r in moved.groupBy("shard").agg(F.sum("n")).collect()}
        load = [used + gained.get(s, 0) for s, used in enumerate(load)]
        settled = moved if settled is None else settled.unionByName(moved)
        if not gained:
            break
    home = linked.select("rid", "g", "chunk").join(settled.select("g", "chunk", F.col("shard").alias("home")), ["g", "chunk"]).select("rid", "home")
    placed = base.drop("g").join(home, "rid", "left")
    ends, at = [], 0
    for c, used in zip(cap, load):
        at += c - used
        ends.append(at)
    pool = running(placed.where("home is null"), [], ["rid"], F.lit(1), cells, "rank")
    rows = placed.where("home is not null").withColumnRenamed("home", "shard").unionByName(
        pool.withColumn("shard", _interval(ends, F.col("rank"))).drop("rank", "home"))
    return running(rows, ["shard"], ["doc_id", "rid"], F.lit(1), cells, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
