"""Packing of documents into token sequences by order-preserving dynamic programming.

Each partition's documents, in stored order, make one stream of ids, each document
followed by the end id. The stream is cut into windows of at most `size` ids. A window
costs its padding (none at a power of two) and a penalty for where it ends: nothing at
a document's end, a little at a sentence's end, more inside a sentence of over
`long_sentence` ids, the only ones that are cut inside. Least total cost is found from
left to right: padding is linear in the window's start, so the best start within reach
is the head of a monotone queue; starts at a power of two are looked up.

Nothing is shuffled: partitions are the scan's splits, so a lost executor's work is
redone alike and sequence ids (partition, then number) stay the same.

Defined results: a null or empty text is the end id alone; repeated rows and null ids
are packed like any; an empty table gives no rows. A text is never split between blocks
of work, so a block holds `block_tokens` ids and one whole text more at most.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, LongType, StructType

from dimspark.llm.common import read_table
from dimspark.llm.tokens import tokens

SIZE, END = 1024, 0
SENTENCE_PENALTY, INSIDE_PENALTY, WINDOW_COST = 4.0, 24.0, 1.0
LONG_SENTENCE, INSIDE_STEP = 128, 8
BLOCK_TOKENS = 1 << 20


def padding(length: int, size: int = SIZE) -> int:
    """Ids that pad a sequence: to size, but none at a power of two."""
    return 0 if length & (length - 1) == 0 else size - length


def cut_points(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, from 0 to total, and the penalty of each."""
    points = np.unique(np.concatenate([[0], sentence_ends, doc_ends, [total]]))
    gaps = np.diff(points)
    long = np.flatnonzero(gaps > min(LONG_SENTENCE, size))
    if len(long):
        step = min(INSIDE_STEP, size)
        points = np.unique(np.concatenate([points, *[np.arange(points[i] + step, points[i + 1], step) for i in long]]))
    cost = np.full(len(points), INSIDE_PENALTY)
    cost[np.searchsorted(points, sentence_ends)] = SENTENCE_PENALTY
    cost[np.searchsorted(points, np.concatenate([[0], doc_ends, [total]]))] = 0.0
    return points, cost


def best_windows(points: np.ndarray, cost: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The ends of the windows of least total cost; points begin with 0 and leave no gap above size."""
    m = len(points)
    index = np.full(int(points[-1]) + 1, -1, np.int64)
    index[points] = np.arange(m)
    ends, starts = [], []
    power = 1
    while power <= size:
        reach = np.flatnonzero(points >= power)
        came = index[points[reach] - power]
        ends.append(reach[came >= 0])
        starts.append(came[came >= 0])
        power *= 2
    at_end, from_start = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(at_end, kind="stable")
    at_end, exact = at_end[order], from_start[order].tolist()
    first = np.searchsorted(at_end, np.arange(m + 1)).tolist()
    place, extra = points.tolist(), (cost + WINDOW_COST).tolist()
    best, back = [0.0] * m, [0] * m
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # value + place, place, index; least value first
    for j in range(1, m):
        p = place[j]
        low = p - size
        while queue[0][1] < low:
            queue.popleft()
        head = queue[0]
        least, came = head[0] + size - p, head[2]
        for k in range(first[j], first[j + 1]):
            i = exact[k]
            if best[i] < least:
                least, came = best[i], i
        least += extra[j]
        best[j], back[j] = least, came
        key = least + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    cuts = []
    j = m - 1
    while j:
        cuts.append(place[j])
        j = back[j]
    return np.array(cuts[::-1], np.int64)


def pack_block(lengths: np.ndarray, sentence_ends: np.ndarray, size: int = SIZE) -> dict[str, np.ndarray]:
    """Pieces of one block: doc (its number in the block), at, start, length, window, offset."""
    doc_ends = np.cumsum(lengths)
    total = int(doc_ends[-1])
    windows = best_windows(*cut_points(doc_ends, sentence_ends, total, size), size)
    stops = np.union1d(doc_ends, windows)
    begins = np.concatenate([[0], stops[:-1]])
    doc = np.searchsorted(doc_ends, begins, "right")
    window = np.searchsorted(windows, begins, "right")
    return {"doc": doc, "at": begins, "start": begins - (doc_ends - lengths)[doc], "length": stops - begins, "window": window, "offset": begins - np.concatenate([[0], windows])[window]}


def pack(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, derive: dict[str, tuple[DataType, pa.DataType, Callable]] | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids.

    derive: instead of ids, columns {name: (type, Arrow type, function of the piece's ids)}.
    """
    kind = docs.schema[doc_id].dataType
    schema = StructType().add("doc_id", kind)
    for name in ("start", "length", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, LongType())
    if derive is None:
        from pyspark.sql.types import ArrayType, IntegerType

        derive = {"ids": (ArrayType(IntegerType()), pa.list_(pa.int32()), lambda ids: ids.astype(np.int32))}
    for name, (spark_type, _, _) in derive.items():
        schema = schema.add(name, spark_type)
    names, made = schema.names, derive

    def solve(held: list[tuple[pa.Array, list[bytes]]], base: int, tool) -> tuple[pa.RecordBatch, int]:
        owners = pa.concat_arrays([a for a, _ in held])
        bodies = [b for _, part in held for b in part]
        stream = np.frombuffer(b"".join(bodies), "<u4")
        lengths = np.array([len(b) // 4 for b in bodies], np.int64)
        pieces = pack_block(lengths, np.flatnonzero(tool.sentence_ends(stream)) + 1, size)
        spans = list(zip(pieces["at"].tolist(), (pieces["at"] + pieces["length"]).tolist()))
        extra = [pa.array([fn(stream[a:b]) for a, b in spans], t) for _, t, fn in made.values()]
        columns = [owners.take(pa.array(pieces["doc"])), pieces["start"], pieces["length"], lengths[pieces["doc"]], pieces["window"] + base, pieces["offset"]]
        return pa.RecordBatch.from_arrays([columns[0], *[pa.array(c, pa.int64()) for c in columns[1:]], *extra], names=names), base + int(pieces["window"][-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokens(tokenizer_path)
        end = np.array([END], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, list[bytes]]] = []
        count = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                bodies = [(tool.encode(t) if t else b"") + end for t in part.column(1).to_pylist()]
                held.append((part.column(0), bodies))
                count += sum(map(len, bodies)) // 4
                if count >= block_tokens:
                    out, base = solve(held, base, tool)
                    yield out
                    held, count = [], 0
        if held:
            yield solve(held, base, tool)[0]

    return docs.select(doc_id, text).mapInArrow(run, schema)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def pack_with_crc(docs: DataFrame) -> DataFrame:
    made = pack(docs, derive={"ids_crc32": (LongType(), pa.int64(), crc32_of)})
    return made.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_with_crc(read_table(spark, sf_dir, "documents"))
