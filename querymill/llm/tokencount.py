"""Token counts from flat token files by scanning for separators.

A file is nothing but token ids with an end-of-document id after each document, cut into blocks of
fixed size without regard to documents; no index says where a document begins. A scan looks for the separators
of each block at once. Blocks leave only counts: a prefix scan over the blocks of a file carries open
documents across block borders and numbers the documents.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querymill.session import scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
BLOCK = 65536
NAMES = 10_000
#: Fixed value: how byte-level BPE of this vocabulary cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "file int, block int, ids binary, names array<long>"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def packer(path: str, size: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) -> blocks of ids, and lists of doc_ids in the order of the file."""

    def row(file: int, block: int, ids: bytes | None, names: list | None) -> pa.RecordBatch:
        cells = [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([ids], pa.binary()), pa.array([names], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cells, ["file", "block", "ids", "names"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoder(path).encode_ordinary, TaskContext.get().partitionId()
        open_ids, held, block, names, listed = [], 0, 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end], np.uint16)
                open_ids.append(ids)
                held += len(ids)
                names.append(doc_id.as_py())
                if held >= size:
                    flat = np.concatenate(open_ids)
                    for k in range(0, held - size + 1, size):
                        yield row(file, block, flat[k : k + size].tobytes(), None)
                        block += 1
                    open_ids, held = [flat[held // size * size :]], held % size
                if len(names) >= NAMES:
                    yield row(file, listed, None, names)
                    listed, names = listed + len(names), []
        if held:
            yield row(file, block, np.concatenate(open_ids).tobytes(), None)
        if names:
            yield row(file, listed, None, names)

    return pack


def write_tokens(docs: DataFrame, path: str = VOCABULARY, size: int = BLOCK, end: int = END) -> DataFrame:
    """docs (doc_id, text) as flat token files: blocks (file, block, ids) and, apart, names (file, block: place of the first, names).

    Null texts are empty. Ids are two bytes each; ``end`` must be no id of the vocabulary.
    """
    target = scratch_path(docs.sparkSession, "tokens")
    packed = docs.select("doc_id", "text").mapInArrow(packer(path, size, end), SCHEMA)
    packed.write.option("compression", "zstd").parquet(target)
    return docs.sparkSession.read.schema(SCHEMA).parquet(target)


def scanner(end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks -> (file, block, ends, head, tail, inner): separators, ids before the first (all if none) and after the last, lengths between."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, head, tail, inner = [], [], [], []
            for cell in batch.column(2):
                ids = np.frombuffer(cell.as_buffer(), np.uint16)
                at = np.flatnonzero(ids == end)
                ends.append(len(at))
                head.append(int(at[0]) if len(at) else len(ids))
                tail.append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
                inner.append(np.diff(at) - 1)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ends, long), pa.array(head, long), pa.array(tail, long), pa.array(inner, pa.list_(long))],
                ["file", "block", "ends", "head", "tail", "inner"],
            )

    return scan


def count_tokens(files: DataFrame, end: int = END) -> DataFrame:
    """doc_id, n_tokens of the documents in flat token files. Repeated ids stay repeated; no files, no rows."""
    blocks = files.filter("ids IS NOT NULL").select("file", "block", "ids")
    seen = blocks.mapInArrow(scanner(end), "file int, block int, ends long, head long, tail long, inner array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = seen.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn("sum", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    # ids since the last separator: what all earlier blocks left open, less what was left open before the last block with one
    closed = F.last(F.when(F.col("ends") > 0, F.col("sum")), ignorenulls=True).over(before)
    carried = summed.withColumn("carry", F.col("sum") - F.coalesce(closed, F.lit(0))).filter("ends > 0")
    lengths = F.concat(F.array(F.col("carry") + F.col("head")), "inner")
    counts = carried.select("file", "first", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("first") + F.col("i")).alias("place"), "n_tokens")
    names = files.filter("names IS NOT NULL").select(F.col("file").alias("f"), "block", F.posexplode("names").alias("i", "doc_id"))
    named = names.select("f", (F.col("block") + F.col("i")).cast("long").alias("p"), "doc_id")
    return counts.join(named, (F.col("file") == F.col("f")) & (F.col("place") == F.col("p"))).select("doc_id", "n_tokens")
