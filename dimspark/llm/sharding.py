"""Sharding by balanced label propagation.

Documents of equal text are linked through hubs, one for each group, or several for a group
above a shard's capacity (each for an even part of it, by a hash of the row). Labels are
shards. Documents begin at a hashed shard; in each round every hub without a place takes
the label that most of its documents, and of the placed hubs of its group, hold among the
shards with room for it. Under a quota for each shard, larger hubs come first, lot by lot, and
the lot that fits in part is taken hub by hub; those that don't fit propagate again, until none
that waits has a shard with room. Then every hub's documents move to its label. The other documents fill the shards to even counts: a shard keeps its first rows, linked ones
first, and hands the rest, one by one, to the shards that lack rows.

DataFrame functions only. State is one row for each hub; what the driver holds has one
entry for each shard. Ranks inside a shard come from counts of even hashed parts and a rank
inside each part, so no task takes a whole shard or a whole group.

Law `rows`: shards' row counts are at most one apart; slots run from 0 without a gap.

Defined results: a null text is an empty one, all such rows one group; repeated rows (of equal
id and text) are linked like copies, told apart by their place in the input, and may change
places with each other between runs; rows of null id are placed like any; an empty table gives no rows; only
doc_id and text are read.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimspark.llm.common import read_table, settle

N_SHARDS, ROUNDS = 40, 8
#: Rows of a shard that are ranked in one part, about.
PART_ROWS = 5_000
#: Parts of the hubs of a size class that are accepted together; hubs are ranked one by one in the first that doesn't fit.
LOTS = 64


def linked_members(docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """The rows of docs with group, hub (null: not linked), parts of the group and first label; and their number."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = settle(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.md5(body)).alias("grp")))
    total = rows.count()
    capacity = max(1, total // n_shards)
    groups = rows.groupBy("grp", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.sum("n").alias("n"), (F.max("n") > 1).alias("repeats")).where("n > 1")
    parts = F.when(F.col("n") <= capacity, 1).otherwise(F.ceil(2 * F.col("n") / capacity)).cast("int")
    groups = groups.select("grp", parts.alias("parts"), "repeats").hint("rebalance")  # dealt anew, so that the rows of one group can be split in the join
    number = F.when(F.col("repeats"), F.col("at"))  # tells repeated rows apart, in the order in which they are stored here
    joined = rows.withColumn("at", F.monotonically_increasing_id()).join(groups, "grp", "left").withColumn("mark", F.xxhash64("doc_id", "grp", number)).drop("at", "repeats")
    return settle(joined.withColumns({"hub": F.pmod("mark", F.col("parts")).cast("int"), "label": F.pmod(F.xxhash64("mark"), F.lit(n_shards)).cast("int")})), total


def propagate(members: DataFrame, total: int, n_shards: int, rounds: int = ROUNDS) -> DataFrame:
    """(grp, hub, label): the labels of the hubs that found a place under the quotas.

    Votes count in the first rounds; then a hub takes any shard with room. The rounds go on until
    no hub that waits has a shard with room: each places a hub at least at every label wished for.
    """
    votes = settle(members.where("hub is not null").groupBy("grp", "hub", "parts", "label").agg(F.count(F.lit(1)).alias("votes")))
    waiting = settle(votes.groupBy("grp", "hub", "parts").agg(F.sum("votes").alias("size")))
    placed = waiting.select("*", F.lit(0).alias("label")).limit(0)
    room = dict.fromkeys(range(n_shards), total // n_shards)
    for turn in count():
        if not (most := max(room.values())) or waiting.where(F.col("size") <= most).isEmpty():
            break
        rooms = F.array(*[F.struct(F.lit(s).alias("label"), F.lit(n).alias("room")) for s, n in room.items()])
        has_room = F.element_at(rooms, F.col("label") + 1)["room"] >= F.col("size")
        own = waiting.join(votes.select("grp", "hub", "label", "votes"), ["grp", "hub"]).select("grp", "hub", "size", "label", "votes")
        siblings = placed.where("parts > 1").groupBy("grp", "label").agg(F.sum("size").alias("votes")).join(waiting.where("parts > 1").select("grp", "hub", "size"), "grp").select("grp", "hub", "size", "label", "votes")
        heard = own.unionByName(siblings).where(has_room & F.lit(turn < rounds)).groupBy("grp", "hub", "label").agg(F.sum("votes").alias("votes"))
        best = heard.groupBy("grp", "hub").agg(F.max(F.struct("votes", F.xxhash64("grp", "hub", "label").alias("tie"), "label"))["label"].alias("best"))
        roomy = F.filter(rooms, lambda r: r["room"] >= F.col("size"))
        anywhere = F.get(roomy, F.pmod(F.xxhash64("grp", "hub", F.lit(turn)), F.greatest(F.size(roomy), F.lit(1))).cast("int"))["label"]
        wishes = waiting.join(best, ["grp", "hub"], "left").select("grp", "hub", "parts", "size", F.coalesce("best", anywhere).alias("label"), (F.floor(F.log2("size")) * -LOTS - F.pmod(F.xxhash64("grp", "hub"), F.lit(LOTS))).cast("int").alias("lot"))
        wishes = settle(wishes)
        sums = wishes.groupBy("label", "lot").agg(F.sum("size").alias("size"))
        reached = F.expr("sum(size) over (partition by label order by lot rows between unbounded preceding and current row)")
        limit = F.element_at(F.array(*[F.lit(room[s]) for s in range(n_shards)]), F.col("label") + 1)
        spare = limit - F.col("reached") + F.col("size")  # room that is left for the lot; one lot of a label at most fits in part
        lots = settle(sums.withColumn("reached", reached).where(spare >= 0).select("label", "lot", spare.alias("spare"), (F.col("reached") <= limit).alias("whole")))
        judged = wishes.join(lots, ["label", "lot"], "left")  # without a label: none has room
        ranked = F.expr("sum(size) over (partition by label, lot order by size desc, xxhash64(grp, hub), grp, hub rows between unbounded preceding and current row)")
        cut = judged.where("not whole").withColumn("fits", ranked <= F.col("spare"))
        judged = settle(judged.where("whole is null or whole").withColumn("fits", F.col("whole").isNotNull()).unionByName(cut))
        for r in judged.where("fits").groupBy("label").agg(F.sum("size").alias("n")).collect():
            room[r["label"]] -= int(r["n"])
        placed = settle(placed.unionByName(judged.where("fits").select("grp", "hub", "parts", "size", "label")))
        waiting = judged.where("not fits").select("grp", "hub", "parts", "size")
    return placed.select("grp", "hub", "label")


def even_out(rows: DataFrame, total: int, n_shards: int) -> DataFrame:
    """rows (label, loose, mark and others) with shard and slot, counts at most one apart."""
    n_parts = max(1, -(-total // (n_shards * PART_ROWS)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("mark", F.lit(1)), F.lit(n_parts)).cast("int"))
    counts = settle(rows.groupBy("label", "loose", "part").agg(F.count(F.lit(1)).alias("n")))
    held = {r["label"]: (int(r["n"]), int(r["fixed"])) for r in counts.groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("loose") == 0, F.col("n")).otherwise(0)).alias("fixed")).collect()}
    least, more = divmod(total, n_shards)
    order = sorted(range(n_shards), key=lambda s: (-held.get(s, (0, 0))[1], s))
    due = {s: least + (i < more) for i, s in enumerate(order)}
    surplus, given, gaps, taken = [], 0, [], 0
    for s in range(n_shards):
        have = held.get(s, (0, 0))[0]
        surplus.append(given - due[s])  # a row of rank r >= due goes out as number surplus + r
        given += max(0, have - due[s])
        if have < due[s]:
            gaps.append((taken, s, have))
            taken += due[s] - have
    begins = F.expr("sum(n) over (partition by label order by loose, part rows between unbounded preceding and current row) - n")
    offsets = counts.select("label", "loose", "part", begins.alias("begins"))
    number = F.expr("row_number() over (partition by label, loose, part order by mark) - 1")
    ranked = rows.withColumn("number", number).join(offsets, ["label", "loose", "part"]).withColumn("rank", F.col("begins") + F.col("number"))
    at = lambda values, i: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), i)
    stays = F.col("rank") < at([due[s] for s in range(n_shards)], F.col("label") + 1)
    if not gaps:
        return ranked.withColumns({"shard": F.col("label"), "slot": F.col("rank")})
    out = F.col("rank") + at(surplus, F.col("label") + 1)
    which = F.size(F.filter(F.array(*[F.lit(g[0]).cast("long") for g in gaps]), lambda b: b <= out))
    return ranked.withColumns({
        "shard": F.when(stays, F.col("label")).otherwise(at([g[1] for g in gaps], which)).cast("int"),
        "slot": F.when(stays, F.col("rank")).otherwise(out - at([g[0] for g in gaps], which) + at([g[2] for g in gaps], which)).cast("long"),
    })


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    members, total = linked_members(docs, n_shards, doc_id, text)
    homes = propagate(members, total, n_shards, rounds).withColumnRenamed("label", "home")
    moved = members.join(homes, ["grp", "hub"], "left")
    placed = settle(moved.select("doc_id", "size", "text_crc32", "mark", F.coalesce("home", "label").alias("label"), F.col("home").isNull().cast("int").alias("loose")))
    return even_out(placed, total, n_shards).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = shard_documents(read_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
