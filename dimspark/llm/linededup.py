"""Reversible line deduplication.

Exact reference counts (signed references of documents to line keys) say how many documents
hold a line; cuckoo filters, one for each shard of the key space, hold the keys that many
documents share. Lines meet the filter of their shard before the exact tables, so only those
that may be shared are looked up: shards and lines are dealt to the same partitions, shard by
shard, so no task and no broadcast holds more than the filter of one shard, whatever the size.
Documents can be inserted and deleted; a deletion takes back exactly what the document's
insertion added, in the references and in the filters.

A key is the 128-bit BLAKE2b digest of the line, stripped of blanks at both
ends and with A-Z in lower case; lines of under `min_chars` code points have no key.

Defined results: a null or empty text is one empty line; every row counts as a document
of its own, repeated rows and rows that share a doc_id included, and rows that share a doc_id
share its decisions; a null doc_id ranks below all others; where only null ids hold a line, rows
of null id keep it; an empty table gives no rows. Only the named columns are read, so others
may clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimspark.llm.common import read_table, release_memory, settle

BLANKS = b" \t\n\x0b\x0c\r"
#: Keys in a shard of the filter, about.
SHARD_KEYS = 200_000
#: Shards at most (the driver holds two numbers for each); beyond it shards grow.
MAX_SHARDS = 1 << 18


def line_key(line: bytes, min_chars: int = 20) -> bytes | None:
    """The digest of a line of UTF-8, or None if the line is too short to have one."""
    body = line.strip(BLANKS)
    if len(body) < min_chars or (len(body) < 4 * min_chars and len(body.decode()) < min_chars):
        return None
    return hashlib.blake2b(body.lower(), digest_size=16).digest()


class CuckooFilter:
    """16-bit fingerprints in buckets of four; supports insertion, deletion and vectorised look-up."""

    SLOTS = 4

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.85)))))
            table = np.zeros((buckets, self.SLOTS), np.uint16)
        self.table = table

    @property
    def mask(self) -> int:
        return len(self.table) - 1

    @staticmethod
    def _other(fp: int) -> int:
        return (fp * 0x5BD1E995 + 0x9E37) & 0xFFFFFFFF

    def places(self, key: bytes) -> tuple[int, int, int]:
        """Fingerprint and the two buckets of a key."""
        fp = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[:8], "little") & self.mask
        return fp, first, first ^ (self._other(fp) & self.mask)

    def insert(self, key: bytes) -> None:
        fp, a, b = self.places(key)
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = fp
                return
        at = b
        for kick in range(500):
            slot = (kick * 7 + fp) % self.SLOTS
            fp, self.table[at, slot] = int(self.table[at, slot]), fp
            at ^= self._other(fp) & self.mask
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = fp
                return
        raise OverflowError("the filter is full")

    def delete(self, key: bytes) -> bool:
        fp, a, b = self.places(key)
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == fp)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """keys: (n, 16) bytes."""
        words = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
        fp = (words[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        first = (words[:, 0] & np.uint64(self.mask)).astype(np.int64)
        other = first ^ (((fp.astype(np.int64) * 0x5BD1E995 + 0x9E37) & 0xFFFFFFFF) & self.mask)
        return (self.table[first] == fp[:, None]).any(1) | (self.table[other] == fp[:, None]).any(1)

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        room = len(keys)
        while True:
            made = cls(room)
            try:
                for key in keys:
                    made.insert(key)
                return made
            except OverflowError:
                room = 2 * max(1, room) + 64


def shards_for(n_keys: int) -> int:
    return max(1, min(MAX_SHARDS, -(-n_keys // SHARD_KEYS)))


def shard_of(n_shards: int):
    """The shard of the key column, from bytes that the filters don't use."""
    return F.pmod(F.conv(F.hex(F.substring("key", 13, 4)), 16, 10).cast("long"), F.lit(n_shards)).cast("int")


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20) -> DataFrame:
    """(key, doc_id): a row for each distinct line key of each row of docs."""
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys: list[bytes] = []
                rows: list[int] = []
                for i, body in enumerate(part.column(1).to_pylist()):
                    if body:
                        own = {k for line in body.encode().split(b"\n") if (k := line_key(line, min_chars)) is not None}
                        keys += own
                        rows += [i] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column(0).take(pa.array(rows, pa.int64()))], names=["key", "doc_id"])
        release_memory()

    from pyspark.sql.types import BinaryType, StructType

    return docs.select(doc_id, text).mapInArrow(run, StructType().add("key", BinaryType()).add("doc_id", kind))


def probe_shards(held: DataFrame, filters: DataFrame, n_shards: int, loads: DataFrame | None = None) -> DataFrame:
    """The postings whose keys may be in the filter (shard, filter) of their shard.

    loads: (shard, load), what is known of the postings of a shard; a shard with more than its
    share is dealt to several partitions, by document, each with the filter.
    """
    spark = held.sparkSession
    known = np.zeros(n_shards)
    if loads is not None:
        for r in loads.collect():
            known[r["shard"]] = r["load"]
    share = (known + max(1.0, known.mean())) / (known.sum() + n_shards * max(1.0, known.mean()))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = np.ceil(share * wanted).astype(int)
    first = np.concatenate([[0], np.cumsum(splits)])
    parts = int(first[-1])
    place = F.floor(F.col("part").cast("long") * min(parts, wanted) / parts).cast("int")  # several small shards to a partition, one after the other
    table = F.broadcast(spark.createDataFrame([(k, int(first[k]), int(splits[k])) for k in range(n_shards)], "shard int, first int, splits int"))
    rows = held.withColumn("shard", shard_of(n_shards)).join(table, "shard").select((F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("splits"))).cast("int").alias("part"), "key", "doc_id", F.lit(None).cast("binary").alias("filter"))
    kind = held.schema["doc_id"].dataType
    copies = filters.join(table, "shard").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("splits") - 1)).alias("part"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast(kind).alias("doc_id"), "filter")
    dealt = rows.unionByName(copies).repartitionById(min(parts, wanted), place).sortWithinPartitions("part", F.col("filter").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, of = None, -1
        for batch in batches:
            parts, is_filter = batch.column(0).to_numpy(), batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            breaks = np.flatnonzero(is_filter | (np.diff(parts, prepend=-1) != 0) | np.concatenate([[False], is_filter[:-1]])).tolist()
            for at, end in zip(breaks, [*breaks[1:], batch.num_rows]):
                if is_filter[at]:
                    of = parts[at]
                    table = CuckooFilter(0, np.frombuffer(batch.column(3)[at].as_py(), np.uint16).reshape(-1, CuckooFilter.SLOTS))
                elif of == parts[at]:  # a shard without a filter has no shared keys
                    part = batch.slice(at, end - at)
                    hit = table.contains(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, 16))
                    kept = part.filter(pa.array(hit))
                    yield pa.RecordBatch.from_arrays([kept.column(1), kept.column(2)], names=["key", "doc_id"])
        release_memory()

    from pyspark.sql.types import BinaryType, StructType

    return dealt.mapInArrow(run, StructType().add("key", BinaryType()).add("doc_id", kind))


def reference_counts(log: DataFrame) -> DataFrame:
    """(key, n_docs, last_doc) from postings; with a column sign, from a signed log."""
    if "sign" not in log.columns:
        return log.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
    net = log.groupBy("key", "doc_id").agg(F.sum("sign").alias("sign")).where("sign > 0")
    return net.groupBy("key").agg(F.sum("sign").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def build_filters(shared: DataFrame, n_shards: int) -> DataFrame:
    """(shard, filter): a cuckoo filter for each shard of the keys; a shard holds about SHARD_KEYS by the choice of n_shards."""

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "filter": [CuckooFilter.of([bytes(k) for k in part["key"]]).table.tobytes()]})

    return shared.select(shard_of(n_shards).alias("shard"), "key").groupBy("shard").applyInPandas(build, "shard int, filter binary")


def update_filters(filters: DataFrame, added: DataFrame, removed: DataFrame, n_shards: int) -> DataFrame:
    """(shard, filter) of the shards that change, after keys are added and removed; null for one that is full."""
    in_shard = lambda keys, sign: keys.select(shard_of(n_shards).alias("shard"), "key", F.lit(sign).alias("sign"))
    changes = in_shard(added, 1).unionByName(in_shard(removed, -1))

    def change(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if not len(new):
            return pd.DataFrame({"shard": [], "filter": []})
        base = np.frombuffer(bytes(old["filter"].iloc[0]), np.uint16).reshape(-1, CuckooFilter.SLOTS).copy() if len(old) else None
        made = CuckooFilter(2 * max(len(new), 512), base)
        try:
            for row in new[new["sign"] < 0]["key"]:
                made.delete(bytes(row))
            for row in new[new["sign"] > 0]["key"]:
                made.insert(bytes(row))
        except OverflowError:
            return pd.DataFrame({"shard": [key[0]], "filter": [None]})
        return pd.DataFrame({"shard": [key[0]], "filter": [made.table.tobytes()]})

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(change, "shard int, filter binary")


class LineIndex:
    """The persisted state, in a folder that the cluster shares.

    A batch is a run: signed references (+1 for documents that came, -1 for those that went) in a
    folder for each shard, and the filters of the shards that it changed. Runs of like sizes are
    merged, so k batches leave about log2(k) runs and each reference is rewritten about
    log2(k) times. A batch reads only the shards that its own keys fall in. It counts once its
    manifest is written: what a lost driver left half done is overwritten by the next batch. A
    key enters its shard's filter when its count reaches min_docs and leaves it when the count
    falls below, so a deletion undoes an insertion in references and filters alike. Shards
    follow the number of references: when they grow to twice SHARD_KEYS each, all is dealt anew.
    Ids are whole numbers. Folders of merged runs stay until someone removes them.
    """

    #: Shards in a batch up to this many are named to the scan; with more, it reads all.
    NAMED_SHARDS = 2_000
    SCHEMA = "key binary, doc_id long, sign long, shard int"

    def __init__(self, spark: SparkSession, path: str, min_docs: int = 3, min_chars: int = 20):
        self.spark, self.path, self.min_docs, self.min_chars = spark, path.rstrip("/"), min_docs, min_chars
        self.batch, self.n_shards, self.runs = 0, 0, []
        while self._is_whole(f"{self.path}/manifest/{self.batch + 1}"):
            self.batch += 1
        if self.batch:
            kept = spark.read.parquet(f"{self.path}/manifest/{self.batch}").first()
            self.n_shards, self.runs = kept["n_shards"], [(r["name"], r["n_rows"]) for r in kept["runs"]]

    def _is_whole(self, folder: str) -> bool:
        """Spark marks a written folder with _SUCCESS."""
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def insert(self, docs: DataFrame) -> None:
        self._apply(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        """Takes the rows of docs, by their ids and texts, out of the counts and the filters."""
        self._apply(docs, -1)

    def references(self, shards: list[int] | None = None, runs: list[tuple[str, int]] | None = None) -> DataFrame:
        """(shard, key, doc_id, sign) of the runs; with shards, of those alone."""
        runs = self.runs if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], self.SCHEMA)
        found = reduce(DataFrame.unionByName, [self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{name}/references") for name, _ in runs])
        return found.where(F.col("shard").isin(shards)) if shards is not None and len(shards) <= self.NAMED_SHARDS else found

    def filters(self, runs: list[tuple[str, int]] | None = None) -> DataFrame:
        """(shard, filter): the latest filter of each shard."""
        runs = self.runs if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], "shard int, filter binary")
        found = self.spark.read.parquet(*[f"{self.path}/{name}/filters" for name, _ in runs])
        return found.groupBy("shard").agg(F.max_by("filter", "version").alias("filter"))

    def counts(self) -> DataFrame:
        return reference_counts(self.references())

    def counts_of(self, keys: DataFrame) -> DataFrame:
        """(key, n_docs, last_doc) of the distinct keys that documents refer to."""
        return reference_counts(self.references(self._shards_of(keys)).join(keys, "key", "left_semi"))

    def _shards_of(self, keys: DataFrame) -> list[int]:
        return [r["shard"] for r in keys.select(shard_of(self.n_shards).alias("shard")).distinct().collect()]

    def _write(self, name: str, references: DataFrame, filters: DataFrame) -> int:
        placed = references.repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
        placed.write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/{name}/references")
        filters.withColumn("version", F.lit(self.batch + 1)).select("shard", "filter", "version").write.mode("overwrite").parquet(f"{self.path}/{name}/filters")
        return self.spark.read.parquet(f"{self.path}/{name}/references").count()

    def _apply(self, docs: DataFrame, sign: int) -> None:
        n = self.batch + 1
        fresh = settle(postings(docs, min_chars=self.min_chars).select("key", F.col("doc_id").cast("long").alias("doc_id"), F.lit(sign).cast("long").alias("sign")))
        total = fresh.count() + sum(rows for _, rows in self.runs)
        runs = list(self.runs)
        if not self.n_shards or total > 2 * SHARD_KEYS * self.n_shards and self.n_shards < MAX_SHARDS:
            self._deal(fresh, total, n)
            return
        batch = fresh.withColumn("shard", shard_of(self.n_shards))
        touched = settle(batch.select("key", "shard").distinct())
        old = self.references([r["shard"] for r in touched.select("shard").distinct().collect()]).join(touched.select("key"), "key", "left_semi")
        both = old.select("key", "doc_id", F.col("sign").alias("old"), F.lit(0).cast("long").alias("new")).unionByName(batch.select("key", "doc_id", F.lit(0).cast("long").alias("old"), F.col("sign").alias("new")))
        net = both.groupBy("key", "doc_id").agg(F.sum("old").alias("old"), F.sum(F.col("old") + F.col("new")).alias("now"))
        moved = settle(net.groupBy("key").agg(F.sum(F.greatest("old", F.lit(0))).alias("before"), F.sum(F.greatest("now", F.lit(0))).alias("after")))
        added = moved.where((F.col("before") < self.min_docs) & (F.col("after") >= self.min_docs)).select("key")
        removed = moved.where((F.col("before") >= self.min_docs) & (F.col("after") < self.min_docs)).select("key")
        changed = settle(update_filters(self.filters(), added, removed, self.n_shards))
        full = [r["shard"] for r in changed.where("filter is null").select("shard").collect()]
        if full:  # made anew, with room
            rows = self.references(full).unionByName(batch).where(F.col("shard").isin(full))
            changed = changed.where("filter is not null").unionByName(build_filters(reference_counts(rows).where(F.col("n_docs") >= self.min_docs), self.n_shards))
        runs.append((f"run-{n}-{n}", self._write(f"run-{n}-{n}", batch, changed)))
        while len(runs) > 1 and runs[-2][1] <= 2 * runs[-1][1]:
            pair = runs[-2:]
            name = f"run-{pair[0][0].split('-')[1]}-{n}"
            merged = self.references(runs=pair).groupBy("shard", "key", "doc_id").agg(F.sum("sign").alias("sign")).where("sign <> 0")
            runs[-2:] = [(name, self._write(name, merged, self.filters(runs=pair)))]
        self._commit(runs, n)

    def _deal(self, fresh: DataFrame, total: int, n: int) -> None:
        """All references and filters anew, in as many shards as they need."""
        rows = self.references().select("key", "doc_id", "sign").unionByName(fresh) if self.runs else fresh
        n_shards = shards_for(total)
        merged = rows.groupBy("key", "doc_id").agg(F.sum("sign").alias("sign")).where("sign <> 0").withColumn("shard", shard_of(n_shards))
        made = build_filters(reference_counts(merged).where(F.col("n_docs") >= self.min_docs), n_shards)
        rows = self._write(f"run-1-{n}", settle(merged), settle(made))
        self.n_shards = n_shards
        self._commit([(f"run-1-{n}", rows)], n)

    def _commit(self, runs: list[tuple[str, int]], n: int) -> None:
        self.spark.createDataFrame([(self.n_shards, runs)], "n_shards int, runs array<struct<name: string, n_rows: long>>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{n}")
        self.batch, self.runs = n, runs

    def dedup(self, docs: DataFrame) -> DataFrame:
        return dedup_lines(docs, self.min_docs, self.min_chars, index=self if self.batch else None)


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, keep: list[str] | None = None, index: LineIndex | None = None) -> DataFrame:
    """The rows of docs without lines that min_docs documents share, except in the last document that holds them.

    Returns the columns keep (doc_id, unless named), n_lines, n_dropped and kept_text.
    index: decides by its filters and references; otherwise docs decide by their own.
    """
    held = postings(docs, min_chars=min_chars)
    if index is not None:
        hits = settle(probe_shards(held, index.filters(), index.n_shards))
        shared = settle(index.counts_of(hits.select("key").distinct()).where(F.col("n_docs") >= min_docs))
    else:
        shared = settle(reference_counts(held).where(F.col("n_docs") >= min_docs))
        n_shards = shards_for(shared.count())
        loads = shared.groupBy(shard_of(n_shards).alias("shard")).agg(F.sum("n_docs").alias("load"))
        hits = probe_shards(held, build_filters(shared, n_shards), n_shards, loads)
    dropped = hits.join(shared, "key").where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).groupBy("doc_id").agg(F.collect_set("key").alias("__keys")).withColumnRenamed("doc_id", "__id")
    keep = keep or ["doc_id"]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__doc"), F.col("doc_id").alias("__doc_id"), F.col("text").alias("__text"))
    joined = held.join(dropped, F.col("__doc_id").eqNullSafe(F.col("__id")), "left")

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("n_lines long, n_dropped long, kept_text string")
    def rewrite(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for body, gone in zip(texts, keys):
            body = body or ""
            if gone is None or not len(gone):
                out.append((body.count("\n") + 1, 0, body))
                continue
            gone = {bytes(k) for k in gone}
            lines = body.encode().split(b"\n")
            left = [x for x in lines if line_key(x, min_chars) not in gone]
            out.append((len(lines), len(lines) - len(left), b"\n".join(left).decode()))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept_text"])

    return joined.select("__doc", rewrite("__text", "__keys").alias("__new")).select("__doc.*", "__new.*")


def rewrite_documents(docs: DataFrame) -> DataFrame:
    """docs, all columns, with repeated lines taken out of text and n_chars set anew."""
    own = docs.columns
    made = dedup_lines(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__own"), "doc_id", "text"), keep=["__own"])
    fields = {c: F.col("__own")[c] for c in own} | {"text": F.when(F.col("__own")["text"].isNotNull(), F.col("kept_text"))}
    if "n_chars" in own:
        fields["n_chars"] = F.length(fields["text"]).cast("long")
    return made.select(*[v.alias(k) for k, v in fields.items()])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dedup_lines(read_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH blanks AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS b),
parts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM parts),
keyed AS (SELECT r, doc_id, i, line, translate(trim(line, b), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines, blanks),
shared AS (SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3),
marked AS (SELECT keyed.*, shared.k IS NOT NULL AND last_doc IS DISTINCT FROM doc_id AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
