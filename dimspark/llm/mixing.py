"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every document has a seeded 64-bit rank; the documents of a source that share its top
bits are a block, so blocks come in permuted order and number at most 4096 a source. A
source's target makes its block quota: whole passes over its blocks and the blocks of a
last, partial pass. The quotas of all sources are shared out among the output shards by a
binary tree: at each node a multivariate hypergeometric draw decides how many blocks of each
source go left. A leaf walks from the root by itself, since every node seeds its own
generator; what it leaves to its left is where its own disjoint range of blocks begins. A
document is taken as often as shards drew its block; the last block of a quota is trimmed to
the target, at a rank that three histograms of finer and finer ranks find. Inside a shard
documents are ordered by another seeded rank.

Decisions are functions of a row and of a table with one row for each source, which the
driver holds (about 300 bytes each). Planning never moves texts; drawing the mix, in the
pipeline, moves each once for each time it is drawn.

Defined results: a null text has no words; a null source is a source, after all others;
a document without words takes part with none; where one rank holds many identical rows
and the target ends there, they share what is left evenly; an empty table gives no rows;
helper columns begin with "__mix", other names may clash with nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dimspark.llm.common import WORD, read_table, settle

#: Tables of sources and of their blocks are broadcast up to so many bytes, at ROW_BYTES a row; larger ones are joined by a shuffle.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 150
BITS = 12
BLOCKS = 1 << BITS
#: Rows of a shard that are sorted and written in one part, about.
PART_ROWS = 5_000


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def fill(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Targets by weight that sum to total, none above most times its size; the excess is shared again."""
    targets = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    left = min(total, most * sum(sizes[i] for i in open_))
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if level * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = level * weights[i]
            break
        for i in full:
            targets[i] = most * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def split_quotas(quotas: np.ndarray, n_shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block and the number of blocks that a shard gets of each source."""
    first, left, low, high, node = np.zeros_like(quotas), quotas.copy(), 0, n_shards, 1
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, node])
        count = int(left.sum()) * (mid - low) // (high - low)
        to_left = rng.multivariate_hypergeometric(left, count, method="marginals") if count else np.zeros_like(left)
        if shard < mid:
            left, high, node = to_left, mid, 2 * node
        else:
            first, left, low, node = first + to_left, left - to_left, mid, 2 * node + 1
    return first, left


def _ranked(df: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """df with its words, rank and the rank's two finest leading parts."""
    rank = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    df = df.withColumns({"__mix_size": words_in(text), "__mix_rank": rank, "__mix_source": F.col(source).cast("string")})
    return df.withColumns({"__mix_block": F.shiftrightunsigned("__mix_rank", 64 - BITS).cast("int"), "__mix_part": F.shiftrightunsigned(F.shiftleft("__mix_rank", BITS), 64 - BITS).cast("int")})


def low_bits() -> Column:
    """The bits of a rank after its block and part."""
    return F.shiftrightunsigned(F.shiftleft("__mix_rank", 2 * BITS), 2 * BITS)


def _join_sources(df: DataFrame, table: DataFrame, n: int) -> DataFrame:
    table = F.broadcast(table) if n * ROW_BYTES <= BROADCAST_BYTES else table
    return df.join(table, F.col("__mix_source").eqNullSafe(F.col("__mix_key")), "left").drop("__mix_key")


def _crossings(words: DataFrame, by: str, need: pd.DataFrame) -> pd.DataFrame:
    """Where the words of a source, summed in the order of by, pass what it still needs.

    words: __mix_id, by and words, at most 4096 rows (or those of one finest part) a source.
    """
    spark = words.sparkSession
    before = F.expr(f"sum(words) over (partition by __mix_id order by {by} rows between unbounded preceding and current row) - words")
    needs = spark.createDataFrame(need[["id", "rest"]], "__mix_nid int, rest long")
    found = words.withColumn("before", before).join(F.broadcast(needs), F.col("__mix_id") == F.col("__mix_nid")).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    return found.select(F.col("__mix_id").alias("id"), F.col(by).alias("at"), (F.col("rest") - F.col("before")).alias("left"), *([F.col("n")] if "n" in words.columns else [])).toPandas()


def plan_mix(docs: DataFrame, weight_of: Callable[[int, str | None], float], share: float = 1.5, most: float = 2.0, n_shards: int = 16, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs, all columns, with what the mix takes of each row.

    weight_of(i, name): the weight of the i-th source by code point, null last.
    Adds __mix_size, __mix_source_size, __mix_target, __mix_first and __mix_second (the words
    taken in either pass), __mix_shards (an array of two: the shard of either pass, or null)
    and __mix_order (the order inside a shard).
    """
    spark = docs.sparkSession
    ranked = settle(_ranked(docs.select(doc_id, text, source), doc_id, text, source, seed).select("__mix_source", "__mix_size", "__mix_rank", "__mix_block", "__mix_part"))
    rows = ranked.groupBy("__mix_source").agg(F.sum("__mix_size").alias("size")).collect()
    rows.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r["size"]) for r in rows]
    weights = [float(weight_of(i, r[0])) for i, r in enumerate(rows)]
    targets = fill(sizes, weights, share * sum(sizes), most)
    plan = pd.DataFrame({"key": [r[0] for r in rows], "id": range(len(rows)), "size": sizes, "target": targets}).astype({"id": "int32", "size": "int64", "target": "float64"})
    want = plan["target"].round().astype("int64")
    plan["full"] = np.where(plan["size"] > 0, want // plan["size"].clip(lower=1), 0).astype("int64")
    plan["rest"] = (want - plan["full"] * plan["size"]).astype("int64")
    ends = pd.DataFrame({"id": [], "at1": [], "at2": [], "at3": [], "partial": []}, dtype="int64")
    keyed = spark.createDataFrame([(r[0], i) for i, r in enumerate(rows)], "__mix_key string, __mix_id int")
    ranked = _join_sources(ranked, keyed, len(rows))
    blocks = settle(ranked.groupBy("__mix_id", "__mix_block").agg(F.sum("__mix_size").alias("words")))
    needing = plan[plan["rest"] > 0]
    if len(needing):
        one = _crossings(blocks, "__mix_block", needing)
        inside = ranked.join(F.broadcast(spark.createDataFrame(one[["id", "at"]], "__mix_nid int, at1 int")), (F.col("__mix_id") == F.col("__mix_nid")) & (F.col("__mix_block") == F.col("at1")))
        two = _crossings(inside.groupBy("__mix_id", "__mix_part").agg(F.sum("__mix_size").alias("words")), "__mix_part", one.rename(columns={"left": "rest"}))
        both = one[["id", "at"]].merge(two, on="id", suffixes=("1", "2"))
        finest = ranked.join(F.broadcast(spark.createDataFrame(both[["id", "at1", "at2"]], "__mix_nid int, at1 int, at2 int")), (F.col("__mix_id") == F.col("__mix_nid")) & (F.col("__mix_block") == F.col("at1")) & (F.col("__mix_part") == F.col("at2")))
        by_rank = finest.groupBy("__mix_id", low_bits().alias("low")).agg(F.sum("__mix_size").alias("words"), F.count(F.lit(1)).alias("n"))
        three = _crossings(by_rank, "low", two.rename(columns={"left": "rest"}))
        ends = both[["id", "at1", "at2"]].merge(three.rename(columns={"at": "at3"}), on="id")
        ends["partial"] = ends["left"] // ends["n"]
    plan = plan.merge(ends[["id", "at1", "at2", "at3", "partial"]], on="id", how="left")
    plan = plan.fillna({"at1": -1, "at2": -1, "at3": -1, "partial": 0}).astype(dict.fromkeys(("at1", "at2", "at3", "partial"), "int64"))
    table = spark.createDataFrame([(r.key if isinstance(r.key, str) else None, int(r.id), int(r.size), float(r.target), int(r.full), int(r.at1), int(r.at2), int(r.at3), int(r.partial)) for r in plan.itertuples()], "__mix_key string, __mix_id int, __mix_source_size long, __mix_target double, __mix_full long, __mix_at1 int, __mix_at2 int, __mix_at3 long, __mix_partial long")
    places = block_places(blocks, plan, n_shards, seed)
    mixed = _join_sources(_ranked(docs, doc_id, text, source, seed), table, len(rows))
    places = F.broadcast(places) if len(rows) * BLOCKS * ROW_BYTES <= BROADCAST_BYTES else places
    mixed = mixed.join(places, F.col("__mix_id").cast("long") * BLOCKS + F.col("__mix_block") == F.col("__mix_place"), "left")
    mixed = mixed.withColumn("__mix_shards", F.array("__mix_shard0", "__mix_shard1")).drop("__mix_place", "__mix_shard0", "__mix_shard1")
    low, part, c = low_bits(), F.col("__mix_part"), F.col
    earlier = (c("__mix_block") != c("__mix_at1")) | (part < c("__mix_at2")) | ((part == c("__mix_at2")) & (low < c("__mix_at3")))
    ends_here = (part == c("__mix_at2")) & (low == c("__mix_at3"))
    trimmed = F.when(earlier, c("__mix_size")).when(ends_here, F.least("__mix_size", "__mix_partial")).otherwise(F.lit(0))
    words = lambda k: F.when(c("__mix_shards")[k].isNull(), 0).when(c("__mix_full") > k, c("__mix_size")).otherwise(trimmed).cast("long")  # noqa: E731 - what a shard drew of pass k; the pass after the whole ones is trimmed
    return mixed.withColumns({"__mix_first": words(0), "__mix_second": words(1), "__mix_order": F.xxhash64(F.lit(seed + 1), "__mix_rank")})


def block_places(blocks: DataFrame, plan: pd.DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(__mix_place, __mix_shard0, __mix_shard1): the shard of each drawn block, in either pass; a place is source * BLOCKS + block."""
    spark = blocks.sparkSession
    ends = spark.createDataFrame([(int(r.id), int(r.full), int(r.at1)) for r in plan.itertuples()], "id int, full int, at1 int")
    ranked = settle(blocks.withColumn("rank", F.expr("row_number() over (partition by __mix_id order by __mix_block) - 1")).join(F.broadcast(ends), F.col("__mix_id") == F.col("id")).drop("id"))
    counts = {r[0]: (int(r[1]), int(r[2] or 0)) for r in ranked.groupBy("__mix_id").agg(F.count(F.lit(1)), F.sum((F.col("__mix_block") <= F.col("at1")).cast("int"))).collect()}
    quotas = np.array([min(2, int(r.full)) * counts[r.id][0] + (counts[r.id][1] if r.full < 2 else 0) for r in plan.itertuples()], np.int64)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard in part["id"]:
                first, count = split_quotas(quotas, n_shards, int(shard), seed)
                own = np.flatnonzero(count)
                yield pd.DataFrame({"shard": np.full(len(own), shard), "pid": own, "first": first[own], "count": count[own]})

    leaves = spark.range(n_shards).repartition(min(n_shards, 64)).mapInPandas(walk, "shard int, pid int, first long, count long")
    drawn = leaves.select("shard", "pid", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)).alias("draw"))
    totals = spark.createDataFrame([(k, v[0]) for k, v in counts.items()], "tid int, n long")
    drawn = drawn.join(F.broadcast(totals), F.col("pid") == F.col("tid")).select("shard", "pid", (F.col("draw") % F.col("n")).alias("drank"), F.floor(F.col("draw") / F.col("n")).cast("int").alias("pass"))
    placed = drawn.join(ranked, (F.col("pid") == F.col("__mix_id")) & (F.col("drank") == F.col("rank")))
    shard_in = lambda k: F.max(F.when(F.col("pass") == k, F.col("shard")))
    return settle(placed.groupBy((F.col("pid").cast("long") * BLOCKS + F.col("__mix_block")).alias("__mix_place")).agg(shard_in(0).cast("int").alias("__mix_shard0"), shard_in(1).cast("int").alias("__mix_shard1")))


def place(number: Column) -> Column:
    """A document's place, of 63 bits, in its shard's order in a pass."""
    return F.shiftrightunsigned(F.xxhash64("__mix_order", number), 1)


def rank_weights(i: int, name: str | None) -> float:
    return (3.0, 1.0, 2.0)[i % 3]


def deal(drawn: DataFrame, n_shards: int, n_docs: int) -> DataFrame:
    """drawn, with a struct d of shard and place: a partition holds an even part of a shard, in the order of places.

    A shard's parts follow each other in that order, as do the files when the rows are written.
    """
    parts = max(1, -(-2 * n_docs // (n_shards * PART_ROWS)))
    top = F.shiftright(F.col("d.place"), 32) * parts  # the part of a shard, times 2**31
    at = (F.col("d.shard") * parts + F.shiftright(top, 31)).cast("int")
    return drawn.repartitionById(n_shards * parts, at).sortWithinPartitions("d.place")


def mix_documents(docs: DataFrame, weight_of: Callable[[int, str | None], float] = rank_weights, n_shards: int = 16, **options) -> DataFrame:
    """docs, all columns, as the mix has them, dealt and in order: a row for each pass that takes at least half of its words."""
    own = docs.columns
    planned = plan_mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__own"), "doc_id", "text", "source"), weight_of, n_shards=n_shards, **options)
    half = lambda c: F.when(F.col("__mix_size") > 0, 2 * F.col(c) >= F.col("__mix_size")).otherwise(F.lit(c == "__mix_first"))
    shard = lambda k: F.coalesce(F.col("__mix_shards")[k], F.pmod("__mix_order", F.lit(n_shards))).cast("int")  # noqa: E731 - a document without words can be in a block that is not drawn
    passes = F.array(*[F.struct(half(c).alias("drawn"), shard(k).alias("shard"), place(F.lit(k)).alias("place")) for k, c in enumerate(("__mix_first", "__mix_second"))])
    return deal(planned.select("__own", F.explode(passes).alias("d")).where("d.drawn"), n_shards, docs.count()).select("__own.*")


def draw_mix(docs: DataFrame, weight_of: Callable[[int, str | None], float] = rank_weights, n_shards: int = 16, **options) -> DataFrame:
    """The mix itself, dealt and in order: docs' columns as a struct doc, with words (taken, from the text's start), pass, shard and place."""
    own = docs.columns
    planned = plan_mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc"), "doc_id", "text", "source"), weight_of, n_shards=n_shards, **options)
    passes = F.array(*[F.struct(F.lit(k).alias("pass"), F.col(c).alias("words"), F.col("__mix_shards")[k].alias("shard"), place(F.lit(k)).alias("place")) for k, c in enumerate(("__mix_first", "__mix_second"))])
    drawn = planned.select("doc", F.explode(passes).alias("d")).where("d.words > 0")
    return deal(drawn, n_shards, docs.count()).select("doc", "d.words", "d.pass", "d.shard", "d.place")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), rank_weights)
    shard = F.col("__mix_shards")
    taken = {"first": F.col("__mix_first"), "second": F.col("__mix_second")}
    return planned.select(
        "doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"),
        (taken["first"] + taken["second"]).alias("taken"),
        F.when(taken["first"] > 0, shard[0]).alias("first_shard"), F.when(taken["second"] > 0, shard[1]).alias("second_shard"),
    )
