"""Similarity join of texts by the Jaccard index of their word n-grams.

MinHash bands propose, full n-gram sets decide. Texts with equal words are one node. Signatures leave the
tasks as a few band hashes. A bucket of a band ties its nodes to its least node, so proposals are as many as
nodes times bands; components of these ties hold every proposed pair. Inside a component the full sets
are compared in blocks of bounded size, matrix by matrix, and only counts and a spanning forest leave a block:
no pair is ever a row, and every link between different texts counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.components import components
from querymill.llm.text import broadcast_if_small, packed, staged, words

N, THRESHOLD, ROWS, RECALL = 5, 0.8, 6, 0.999
#: Texts and n-grams of a block: a task compares two blocks at a time.
BLOCK_TEXTS, BLOCK_GRAMS = 256, 1_000_000
#: Odd multipliers that join the words of an n-gram.
STEPS = tuple((0x9E3779B97F4A7C15 * (2 * k + 3) | 1) % 2**64 for k in range(64))


def bands_for(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands needed so that a pair at the threshold shares one with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def word_key(w: Column) -> Column:
    """Sixteen bytes that stand for a sequence of words."""
    return F.unhex(F.md5(F.array_join(w, " ").cast("binary")))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams(values: np.ndarray, starts: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of many texts, and where each text begins in them. A shorter text is one gram."""
    sizes = np.diff(starts)
    counts = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(sizes.dtype))
    begin = np.concatenate([[0], np.cumsum(counts)])
    padded = np.concatenate([values, np.zeros(n, np.uint64)])
    at = np.repeat(starts[:-1], counts) + (np.arange(begin[-1]) - np.repeat(begin[:-1], counts))
    left = np.repeat(np.minimum(sizes, n), counts)
    out = np.zeros(begin[-1], np.uint64)
    for k in range(n):
        out += np.where(k < left, padded[at + k] * np.uint64(STEPS[k]), np.uint64(0))
    return _mixed(out + left.astype(np.uint64)), begin


def signer(bands: int, rows: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, key, hw: word hashes) -> (doc_id, key, grams, bands)."""
    factors = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, 1000):
                batch = whole.slice(part, 1000)
                column = batch.column(2)
                starts = np.asarray(column.offsets).astype(np.int64)
                values = np.asarray(column.values).view(np.uint64)[starts[0] : starts[-1]]
                g, begin = grams(values, starts - starts[0], n)
                used = np.flatnonzero(np.diff(begin) > 0)
                out = np.zeros((batch.num_rows, bands), np.uint64)
                if len(used):
                    room = np.empty_like(g)
                    for b in range(bands):
                        band = np.full(len(used), b + 1, np.uint64)
                        for r in range(rows):
                            np.multiply(g, factors[b * rows + r], out=room)
                            band = _mixed(band * np.uint64(STEPS[r]) + np.minimum.reduceat(room, begin[:-1][used]))
                        out[used, b] = band
                lengths = np.where(np.diff(begin) > 0, bands, 0)
                flat = pa.array(out[lengths > 0].reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(begin).astype(np.int64)), lists], ["doc_id", "key", "grams", "bands"])

    return sign


def _similar(sets: list[np.ndarray], threshold: float, width: int = 4096) -> np.ndarray:
    """Boolean matrix: Jaccard index of each pair of sets is at least the threshold. Exact, by blocks of grams."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(k), sizes)
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[gram] > 1
    column = np.cumsum(count > 1) - 1
    rows, cols = owner[shared], column[gram[shared]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    common = np.zeros((k, k))
    last = cols[-1] + 1 if len(cols) else 0
    for low in range(0, last, width):
        a, b = np.searchsorted(cols, [low, low + width])
        part = np.zeros((k, min(width, last - low)), np.float32)
        part[rows[a:b], cols[a:b] - low] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    # 1e-9 keeps pairs whose index equals the threshold
    return common >= threshold * union - 1e-9


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least index of each component of a symmetric boolean matrix."""
    root = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(reach, root[None, :], len(linked)).min(axis=1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verifier(threshold: float, n: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A group: the texts of two blocks (lo, hi) of a component -> (key, links, root) of those with a link."""

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key").reset_index(drop=True)
        values = [np.asarray(x, np.int64).view(np.uint64) for x in pdf["hw"]]
        sets = [np.unique(grams(v, np.array([0, len(v)]), n)[0]) for v in values]
        linked = _similar(sets, threshold)
        np.fill_diagonal(linked, False)
        if pdf["lo"][0] != pdf["hi"][0]:
            block = pdf["block"].to_numpy()
            linked &= block[:, None] != block[None, :]
        links, root = linked.sum(axis=1), _roots(linked)
        out = pd.DataFrame({"key": pdf["key"], "links": links.astype("int64"), "root": pdf["key"].to_numpy()[root], "comp": pdf["comp"], "many": pdf["many"]})
        return out[out["links"] > 0]

    return verify


def similar_texts(docs: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL, n: int = N) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of docs (doc_id, text).

    members: doc_id, key, grams: the node of every row. classes: key, first_id, copies, links, class_key for
    every node with words: rows of the node, nodes linked to it, least key of its class. Null texts and texts
    without words have grams 0 and no class: they are like nothing. Rows that repeat a doc_id are rows like any other.
    """
    bands = bands_for(threshold, rows, recall)
    w = docs.select("doc_id", words(F.col("text")).alias("w"))
    hashed = w.select("doc_id", word_key(F.col("w")).alias("key"), F.transform("w", lambda x: F.xxhash64(x)).alias("hw"))
    members = staged(hashed.mapInArrow(signer(bands, rows, n), "doc_id long, key binary, grams long, bands array<long>"), "signatures")
    nodes = members.filter("grams > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    nodes = staged(nodes, "nodes")
    ties = nodes.select(F.xxhash64("key").alias("node"), F.explode("bands").alias("band"))
    buckets = staged(ties.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("band", "least"), "buckets")
    edges = ties.join(broadcast_if_small(buckets), "band").select(F.col("node").alias("src"), F.col("least").alias("dst"))
    comps = components(edges, "proposals")
    inside = nodes.select("key", "first_id", "grams", F.xxhash64("key").alias("node")).join(broadcast_if_small(staged(comps, "proposed")), "node")
    inside = staged(inside.select("key", "first_id", "grams", F.col("root").alias("comp")), "candidates")
    size = inside.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("many"))
    placed = staged(inside.join(size, "comp").select("key", "first_id", "comp", "many", F.pmod(F.xxhash64(F.lit("block"), "key"), "many").cast("int").alias("block")), "blocks")
    texts = docs.select(F.col("doc_id").alias("d"), words(F.col("text")).alias("w")).withColumn("k", word_key(F.col("w")))
    found = texts.join(broadcast_if_small(placed), (F.col("k") == F.col("key")) & F.col("d").eqNullSafe(F.col("first_id")))
    single = found.groupBy("key", "comp", "many", "block").agg(F.first("w").alias("w")).withColumn("hw", F.transform("w", lambda x: F.xxhash64(x)))
    other = F.explode(F.sequence(F.lit(0), F.col("many") - 1))
    spread = single.select("key", "comp", "many", "block", "hw", other.alias("o")).select("key", "comp", "many", "block", "hw", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"))
    checked = spread.groupBy("comp", "lo", "hi").applyInPandas(verifier(threshold, n), "key binary, links long, root binary, comp long, many int")
    checked = staged(checked, "links")
    links = checked.groupBy("key").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.first("many").alias("many"))
    split = checked.filter("many > 1").select(F.col("key").alias("src"), F.col("root").alias("dst"))
    joined = components(split, "links-split").select(F.col("node").alias("key"), F.col("root").alias("joined"))
    named = links.join(joined, "key", "left").select("key", "links", F.coalesce("joined", "root").alias("class_key"))
    classes = nodes.select("key", "first_id", "copies").join(named, "key", "left").select("key", "first_id", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("class_key", "key").alias("class_key"))
    return members.select("doc_id", "key", "grams"), staged(classes, "classes")


def classed(docs: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL, n: int = N) -> DataFrame:
    """doc_id, key, class_id (least doc_id of the class), copies (rows with the same words), n_links (other texts it is similar to).

    Rows without words are a class each: class_id is their doc_id, copies 1, n_links 0.
    """
    members, classes = similar_texts(docs, threshold, rows, recall, n)
    ids = classes.groupBy("class_key").agg(F.min("first_id").alias("class_id"))
    known = classes.join(ids, "class_key").select(F.col("key").alias("k"), "class_id", "copies", "links")
    full = members.join(known, (F.col("key") == F.col("k")) & (F.col("grams") > 0), "left")
    alone = F.col("k").isNull()
    return full.select(
        "doc_id", "key", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 1).otherwise(F.col("copies")).cast("long").alias("copies"), F.when(alone, 0).otherwise(F.col("links")).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every class stays: that with the least doc_id. Rows without words stay.

    Of rows with equal doc_id and words one stays.
    """
    found = classed(docs.select("doc_id", "text")).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = staged(found.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.count("*").alias("_n")), "kept")
    rows = packed(docs).withColumn("_id", F.col("_row.doc_id")).withColumn("_key", word_key(words(F.col("_row.text"))))
    same = (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_d"))
    once = rows.join(broadcast_if_small(kept.filter("_n = 1")), same, "left_semi").select("_row.*")
    again = staged(kept.filter("_n > 1"), "kept-repeats")
    if again.isEmpty():
        return once
    repeats = rows.join(broadcast_if_small(again), same, "left_semi").groupBy("_id", "_key").agg(F.first("_row").alias("_row"))
    return once.unionByName(repeats.select("_row.*"))
