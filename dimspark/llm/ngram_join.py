"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

A document's shingles are its runs of five words (all its words, if they are fewer),
hashed to 64 bits. Documents of equal shingle sets are one class. A class has a label in
each tree: `DEPTH` min-hashes of eight bits each in one long, so that labels in order are a
prefix trie, and the classes below a trie's node are those whose labels agree in their first
bytes. Matching begins at whole labels and shortens prefixes adaptively: a class alone below
the node at the least depth goes there at once; of its crowded subtrees it shortens the
thinnest first, byte by byte, until the chance that a pair at the threshold is met in some
tree reaches `recall`; in its most crowded subtrees the prefix stays as long as that allows.
All classes of a subtree take the least depth that one of them needs, so no class
falls short of its recall. Classes below one node of the forest so cut are candidates.

Candidates are verified on their whole shingle sets: pairs of small nodes one by one, large
nodes in blocks, by matrix products, without a row for each pair. A class's home is the
largest node above it. Two homes whose classes meet below some node are verified against
each other once, in blocks, however many trees they meet in.

The links of a document are all other documents at the threshold or above, copies
included; components join what is linked, directly or not.

Defined results: a text without words (null included) has no shingles and links to none;
repeated rows are copies of each other; a null doc_id counts as a document, and ranks
after others as a representative; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dimspark.llm.common import map_rows, read_table, release_memory, settle
from dimspark.llm.components import connected_components

WORDS, THRESHOLD = 5, 0.8
#: Min-hashes in a label, one byte each.
DEPTH = 8
TREES, RECALL = 32, 0.9999
#: Nodes of up to so many classes give pairs; larger ones are verified in blocks.
SMALL = 8
#: Classes, and bytes of shingles, in a side of a block, about.
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
#: Shingles that are multiplied at a time.
COLUMNS = 1 << 12


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The distinct hashed runs of n words of a text, in order."""
    words = text.encode().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(w))
    s = np.full(len(w) - width + 1, np.uint64(0x9E3779B97F4A7C15 + width), np.uint64)
    for k in range(width):
        s = (s ^ w[k : len(w) - width + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        s ^= s >> np.uint64(32)
    return np.unique(s)


def depth_for(recall: float, threshold: float, trees: int, max_depth: int = DEPTH) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree with the chance recall."""
    for depth in range(max_depth, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


@cache
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**32, count, np.uint32) | np.uint32(1), rng.integers(0, 2**32, count, np.uint32)


def tree_labels(found: np.ndarray, trees: int = TREES) -> np.ndarray:
    """The label in each tree, as a signed number."""
    a, b = _functions(trees * DEPTH)
    least = np.full(trees * DEPTH, np.uint32(2**32 - 1))
    x = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 512):
        hashed = x[at : at + 512, None] ^ b
        hashed *= a
        np.minimum(least, hashed.min(0), out=least)
    return (least & np.uint32(255)).astype(np.uint8).view(">i8").astype(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 0.0


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of left shares with each of right."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)

    def places(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(common, flat)
        at[at == len(common)] = 0
        held = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[held], at[held]

    (ra, ca), (rb, cb) = places(left, a), places(right, b)
    for low in range(0, len(common), COLUMNS):
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        mine, other = (ca >= low) & (ca < low + COLUMNS), (cb >= low) & (cb < low + COLUMNS)
        x[ra[mine], ca[mine] - low] = 1
        y[rb[other], cb[other] - low] = 1
        out += x @ y.T
    return out


def linked_in_block(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of left and right are at the threshold or above; slices of left by their bytes bound the working memory."""
    out = np.zeros((len(left), len(right)), bool)
    sizes = np.array([len(x) for x in right], np.float64)
    at = 0
    while at < len(left):
        end, held = at, 0
        while end < len(left) and (end == at or held + left[end].nbytes <= BLOCK_BYTES):
            held += left[end].nbytes
            end += 1
        own = np.array([len(x) for x in left[at:end]], np.float64)
        shared = shared_counts(left[at:end], right).astype(np.float64)
        out[at:end] = shared / np.maximum(own[:, None] + sizes[None, :] - shared, 1) >= threshold
        at = end
    return out


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n nodes."""
    label = np.arange(n)
    while len(left):
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def trie_node(depth: Column) -> Column:
    """A number for the node above a label at a depth of its tree; labels of two nodes that share a number are only verified in vain."""
    return F.xxhash64("tree", depth, F.call_function("shiftrightunsigned", F.col("label"), (F.lit(8) * (F.lit(DEPTH) - depth)).cast("int")))


def shortened(met: DataFrame, floor: int, threshold: float, trees: int, recall: float, small: int) -> DataFrame:
    """met (node, tree, label, top, n: the classes below its node at the least depth) with depth, where prefixes are cut.

    Every tree adds -ln(1 - threshold**depth) to a class's -ln(chance to miss a pair). All crowded
    subtrees begin at whole labels; from the thinnest on each is shortened, to floor or to where
    the sum suffices.
    """
    gain = {d: -math.log1p(-(threshold**d)) for d in range(floor, DEPTH + 1)}
    crowded = met.where(F.col("n") > small)
    of_class = "partition by node"
    lacking = F.lit(-math.log1p(-recall)) - (F.lit(trees) - F.expr(f"count(*) over ({of_class})")) * gain[floor] - F.expr(f"count(*) over ({of_class})") * gain[DEPTH]
    left = lacking - (F.expr(f"row_number() over ({of_class} order by n, tree)") - 1) * (gain[floor] - gain[DEPTH])
    depth = F.when(left <= 0, DEPTH)
    for d in range(DEPTH - 1, floor, -1):
        depth = depth.when(left <= gain[d] - gain[DEPTH], d)
    wished = crowded.withColumn("depth", depth.otherwise(floor))
    agreed = wished.groupBy("top").agg(F.min("depth").alias("depth")).hint("rebalance")
    return crowded.join(agreed, "top")


def forest_nodes(classes: DataFrame, threshold: float, trees: int, recall: float, small: int) -> DataFrame:
    """(node, n_shingles, key, n): the nodes of the cut forest above each class that are above n > 1 classes.

    Counts are dealt anew before they meet the labels, so that adaptive execution can split a hot node.
    """
    floor = max(1, depth_for(recall, threshold, trees) - 1)
    labels = classes.select("node", "n_shingles", F.posexplode("labels").alias("tree", "label")).withColumn("top", trie_node(F.lit(floor)))
    sizes = labels.groupBy("top").agg(F.count(F.lit(1)).alias("n")).where("n > 1").hint("rebalance")
    met = settle(labels.join(sizes, "top").select("node", "n_shingles", "tree", "label", "top", "n"))
    cut = settle(shortened(met, floor, threshold, trees, recall, small).select("node", "n_shingles", trie_node(F.col("depth")).alias("key")))
    counts = cut.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").hint("rebalance")
    crowded = cut.join(counts, "key").select("node", "n_shingles", "key", "n")
    return settle(met.where(F.col("n") <= small).select("node", "n_shingles", F.col("top").alias("key"), "n").unionByName(crowded))


def homes_of(nodes: DataFrame, small: int) -> DataFrame:
    """(node, n_shingles, home, others): the largest node above each class with a large one, and the homes, its own included, of classes that it meets below large ones."""
    large = nodes.where(F.col("n") > small)
    placed = settle(large.groupBy("node", "n_shingles").agg(F.max(F.struct("n", "key"))["key"].alias("home"), F.collect_list("key").alias("keys")))
    rows = placed.select("node", "n_shingles", "home", F.explode("keys").alias("key"))
    there = rows.groupBy("key").agg(F.sort_array(F.collect_set("home")).alias("others")).hint("rebalance")
    return settle(rows.join(there, "key").groupBy("node", "n_shingles", "home").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others")))


def block_rows_of(homes: DataFrame, block_rows: int) -> DataFrame:
    """(node, low, high, low_part, high_part, left): the blocks that a class takes part in, and on which side."""
    sides = homes.select("node", "n_shingles", "home", F.explode("others").alias("other"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int")
    dealt = settle(sides.groupBy("home", "other").agg(parts.alias("parts")))
    across = dealt.select(F.col("home").alias("other"), F.col("other").alias("home"), F.col("parts").alias("other_parts"))
    dealt = dealt.join(across, ["home", "other"]).hint("rebalance")
    rows = sides.join(dealt, ["home", "other"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.select("node", "home", "other", "part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)).alias("at"))
    own, first = F.col("home") == F.col("other"), F.col("home") < F.col("other")
    return rows.select(
        "node", F.least("home", "other").alias("low"), F.greatest("home", "other").alias("high"),
        F.when(own, F.least("part", "at")).when(first, F.col("part")).otherwise(F.col("at")).alias("low_part"),
        F.when(own, F.greatest("part", "at")).when(first, F.col("at")).otherwise(F.col("part")).alias("high_part"),
        F.when(own, F.col("part") <= F.col("at")).otherwise(first).alias("left"),
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, trees: int = TREES, recall: float = RECALL, small: int = SMALL, block_rows: int = BLOCK_ROWS, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership, links and edges of the classes of docs.

    Membership: doc_id and node of each row (null node: no words). Classes: node, rep_id (the
    least doc_id), n_copies and n_links (documents of other classes). Edges: pairs a, b of
    nodes that are linked; of a block only as many as connect it.
    """

    def describe(i, body):
        found = shingles(body, n)
        if not len(found):
            return i, None, 0, None
        return i, hashlib.blake2b(found.tobytes(), digest_size=16).digest(), len(found), tree_labels(found, trees).tolist()

    kind = docs.schema[doc_id].dataType.simpleString()
    described = settle(map_rows(docs, f"doc_id {kind}, node binary, n_shingles int, labels array<bigint>", describe, [doc_id, text], 500))
    classes = settle(described.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels")))
    nodes = forest_nodes(classes, threshold, trees, recall, small)
    homes = homes_of(nodes, small)
    wanted = classes.select("node", "rep_id", "n_copies").join(nodes.select("node").distinct(), "node").join(homes.select("node", "home", "others"), "node", "left")

    def resolve(body, node, copies, home, others):
        found = shingles(body, n)
        own = hashlib.blake2b(found.tobytes(), digest_size=16).digest() == bytes(node)
        return (node if own else None), copies, home, others, found.tobytes()

    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(wanted, F.col("__id").eqNullSafe(F.col("rep_id")))
    sets = settle(map_rows(texts, "node binary, n_copies long, home long, others array<bigint>, found binary", resolve, ["__text", "node", "n_copies", "home", "others"], 500).where("node is not null").dropDuplicates(["node"]))

    grouped = nodes.where(F.col("n") <= small).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "n_shingles"))).alias("c"))
    pairs = grouped.select(F.explode(F.expr("flatten(transform(sequence(0, size(c) - 2), i -> transform(slice(c, i + 2, size(c)), y -> struct(c[i].node as a, y.node as b, c[i].n_shingles as x, y.n_shingles as y))))")).alias("p")).select("p.*")
    pairs = pairs.where(F.least("x", "y") >= threshold * F.greatest("x", "y")).select("a", "b").distinct()
    side = lambda s: sets.select(F.col("node").alias(s), F.col("n_copies").alias(f"copies_{s}"), F.col("home").alias(f"home_{s}"), F.col("others").alias(f"others_{s}"), F.col("found").alias(f"found_{s}"))

    def verify(a, b, home_a, home_b, others_a, others_b, copies_a, copies_b, found_a, found_b):
        if home_a is not None and home_b is not None and home_b in others_a and home_a in others_b:
            return None, None, None, None  # they meet in a block
        if jaccard(np.frombuffer(found_a, np.uint64), np.frombuffer(found_b, np.uint64)) >= threshold:
            return a, b, copies_a, copies_b
        return None, None, None, None

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    columns = ["a", "b", "home_a", "home_b", "others_a", "others_b", "copies_a", "copies_b", "found_a", "found_b"]
    linked = settle(map_rows(joined, "a binary, b binary, copies_a long, copies_b long", verify, columns, 500).where("a is not null"))

    def verify_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        same = key[0] == key[1] and key[2] == key[3]
        left = rows[rows["left"]].reset_index(drop=True)
        right = left if same else rows[~rows["left"]].reset_index(drop=True)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "links_a": []})
        unpack = lambda side: [np.frombuffer(bytes(x), np.uint64) for x in side["found"]]
        sets_l = unpack(left)
        link = linked_in_block(sets_l, sets_l if same else unpack(right), threshold)
        copies_l, copies_r = left["n_copies"].to_numpy(np.int64), right["n_copies"].to_numpy(np.int64)
        if same:
            np.fill_diagonal(link, False)
        at_l, at_r = np.nonzero(link)
        if same:
            nodes, links, roots = left["node"], link @ copies_r, _roots(len(left), at_l, at_r)
        else:
            nodes = pd.concat([left["node"], right["node"]], ignore_index=True)
            links = np.concatenate([link @ copies_r, link.T @ copies_l])
            roots = _roots(len(nodes), at_l, at_r + len(left))
        some = np.flatnonzero(links > 0)
        del sets_l
        release_memory()
        return pd.DataFrame({"a": nodes.iloc[some].to_numpy(), "b": nodes.iloc[roots[some]].to_numpy(), "links_a": links[some]})

    blocks = block_rows_of(homes, block_rows).join(sets.select("node", "n_copies", "found"), "node").groupBy("low", "high", "low_part", "high_part")
    blocks = settle(blocks.applyInPandas(verify_block, "a binary, b binary, links_a long"))
    edges = linked.select("a", "b").union(blocks.where("a <> b").select("a", "b"))
    links = linked.select(F.col("a").alias("node"), F.col("copies_b").alias("k")).union(linked.select(F.col("b").alias("node"), F.col("copies_a").alias("k"))).union(blocks.select(F.col("a").alias("node"), F.col("links_a").alias("k")))
    links = links.groupBy("node").agg(F.sum("k").alias("n_links"))
    summary = classes.select("node", "rep_id", "n_copies").join(links, "node", "left").select("node", "rep_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return described.select("doc_id", "node"), summary, edges


def link_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least doc_id of its component), copy_of (of its equals), n_copies and n_links of each row."""
    membership, classes, edges = near_duplicates(docs, **options)
    components = settle(connected_components(edges).join(classes.select("node", "rep_id"), "node"))
    names = components.groupBy("component").agg(F.min("rep_id").alias("class_id"))
    named = components.join(names, "component").select("node", "class_id")
    full = classes.join(named, "node", "left").select("node", F.col("rep_id").alias("copy_of"), F.coalesce("class_id", "rep_id").alias("class_id"), "n_copies", (F.col("n_links") + F.col("n_copies") - 1).alias("n_links"))
    placed = membership.join(full.hint("rebalance"), "node", "left")  # dealt anew, so that the many rows of one node can be split
    own = F.col("node").isNull()
    return placed.select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with one row of each component: that of the least doc_id (null last), then text digest.

    Of repeated rows one stays; rows without words link to none and all stay.
    """
    key = lambda: F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    linked = link_documents(docs.select(key().alias("doc_id"), "text"), **options)
    kept = settle(linked.where(F.col("doc_id") == F.col("class_id")).groupBy(F.col("doc_id").alias("__kept")).agg(F.least(F.count(F.lit(1)), F.max("n_copies")).alias("n")))
    keyed = docs.withColumn("__key", key())
    once = keyed.join(kept.where("n = 1"), F.col("__key") == F.col("__kept"), "left_semi").drop("__key")
    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return once
    return once.unionByName(keyed.join(repeated, F.col("__key") == F.col("__kept"), "left_semi").dropDuplicates(["__key"]).drop("__key"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
