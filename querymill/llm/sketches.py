"""Near copies by bottom-k sketches.

One hash function orders all shingles; a text keeps its k smallest. Similar texts share most of what they keep, so
inverted lists over kept values propose pairs: rare values first, and only as many of a text's values as a
partner cannot avoid. Every list first ties its members to the text whose values are the most common in
the corpus, which joins a group of copies with as many comparisons as it has members; then what a list
still holds apart meets in blocks, inside a task: once by sketches, and what these leave by full sets. A block
gives back its members or one link a member, so no group's pairs are ever rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.components import components
from querymill.llm.jaccard import grams, word_key
from querymill.llm.runs import runs
from querymill.llm.spelling import lowered
from querymill.llm.text import broadcast_if_small, staged, words

N, PERCENT, KEPT, LOSS = 4, 80, 64, 1e-9
#: Texts of a list, and shingles of these, that a task compares with as many others at a time.
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000
BLOCK_ROWS = "v long, lo int, hi int, blk int, key binary, comp binary"


def least_shared(kept: int = KEPT, percent: int = PERCENT, loss: float = LOSS) -> int:
    """Values that two texts at the threshold share of the k least of their union, but for this probability."""
    p, below, c = percent / 100, 0.0, 0
    while True:
        below += math.comb(kept, c) * p**c * (1 - p) ** (kept - c)
        if below > loss:
            return c
        c += 1


def shingles(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Lists of word hashes -> the sorted different hashes of their shingles."""
    starts = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values).view(np.uint64)[starts[0] : starts[-1]]
    found, begin = grams(values, starts - starts[0], n)
    for low, high in zip(begin[:-1].tolist(), begin[1:].tolist()):
        yield np.unique(found[low:high])


def listed(sets: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    # hashes keep their order as signed numbers
    signed = (flat ^ np.uint64(1 << 63)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)), pa.array(signed, pa.int64()))


def sketcher(kept: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, key, hw: word hashes) -> (doc_id, key, size, kept: the least of its shingles)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, 1000):
                batch = whole.slice(part, 1000)
                sizes, least = [], []
                for found in shingles(batch.column(2), n):
                    sizes.append(len(found))
                    least.append(found[:kept])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), listed(least)], ["doc_id", "key", "size", "kept"])

    return sketch


def whole_sets(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, hw) -> (key, shingles)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, 200):
                batch = whole.slice(part, 200)
                yield pa.RecordBatch.from_arrays([batch.column(0), listed(list(shingles(batch.column(1), n)))], ["key", "shingles"])

    return make


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None, width: int = 4096) -> np.ndarray:
    """How many values each list of different values has in common with each of the other side, or of its own."""
    many, both = len(left), left + (right or [])
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, value = np.unique(np.concatenate(both), return_inverse=True)
    # a value that stands on one side only, or once, adds nothing
    seen = np.bincount(value[owner < many], minlength=len(value)), np.bincount(value[owner >= many], minlength=len(value))
    useful = (seen[0] > 1 if right is None else (seen[0] > 0) & (seen[1] > 0))[value]
    owner, value = owner[useful], value[useful]
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], np.unique(value, return_inverse=True)[1][order]
    out = np.zeros((many, len(both) - many if right is not None else many), np.float32)
    for low in range(0, int(value[-1]) + 1 if len(value) else 0, width):
        a, b = np.searchsorted(value, [low, low + width])
        part = np.zeros((len(both), width), np.float32)
        part[owner[a:b], value[a:b] - low] = 1
        out += part[:many] @ (part if right is None else part[many:]).T
    return out


def lists_of(column: pa.Array, rows: np.ndarray) -> list[np.ndarray]:
    offsets, values = np.asarray(column.offsets), np.asarray(column.values)
    return [values[offsets[i] : offsets[i + 1]] for i in rows.tolist()]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray | None]]]]:
    """Rows sorted by (v, lo, hi), then blk, key, comp -> rows, and of each block pair the row numbers of both sides; None if a block meets itself.

    Pairs of blocks that are one component as a whole are left out.
    """
    for rows, bounds in runs(batches, 3):
        lo, hi, blk = (np.asarray(rows.column(i)) for i in (1, 2, 3))
        comp = rows.column(5).dictionary_encode().indices.to_numpy()
        met = []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            at = np.arange(low, high)
            if len(at) > 1 and (comp[at] != comp[low]).any():
                x, y = at[blk[at] == lo[low]], at[blk[at] == hi[low]]
                if lo[low] == hi[low]:
                    met.append((x, None))
                elif len(x) and len(y):
                    met.append((x, y))
        yield rows, met


def _against(x: np.ndarray, y: np.ndarray | None, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Matrix of a test on two values, of all pairs of two lists."""
    return test(x[:, None], (x if y is None else y)[None, :])


def apart(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks (v, lo, hi, blk, key, comp, size, least, kept, before) -> the rows (v, lo, hi, blk, key, comp) that have a likely partner there.

    Likely: of another component and with values enough in common. A pair belongs to the first list that both texts are in, so to no list
    with a value ``before`` it in common.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, met in blocks(batches):
            comp = rows.column(5).dictionary_encode().indices.to_numpy()
            size, least = np.asarray(rows.column(6)), np.asarray(rows.column(7))
            found = np.zeros(rows.num_rows, bool)
            for x, y in met:
                other = x if y is None else y
                likely = _against(comp[x], None if y is None else comp[y], np.not_equal)
                likely &= _against(size[x], None if y is None else size[y], lambda a, b: 100 * np.minimum(a, b) >= percent * np.maximum(a, b))
                if likely.any():
                    likely &= shared_counts(*(lists_of(rows.column(8), s) for s in (x, y) if s is not None)) >= _against(least[x], None if y is None else least[y], np.maximum)
                if likely.any():
                    likely &= shared_counts(*(lists_of(rows.column(9), s) for s in (x, y) if s is not None)) == 0
                found[x[likely.any(axis=1)]] = True
                found[other[likely.any(axis=0)]] = True
            if found.any():
                yield rows.select(range(6)).filter(pa.array(found))

    return members


def least_roots(linked: np.ndarray) -> np.ndarray:
    """Least index of each component of a symmetric boolean matrix."""
    root, before = np.arange(len(linked)), None
    reach = linked | np.eye(len(linked), dtype=bool)
    while before is None or (root != before).any():
        before = root
        root = np.where(reach, root[None, :], len(linked)).min(axis=1)
        root = root[root]
    return root


def joiner(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks (v, lo, hi, blk, key, comp, shingles) -> links (a, b) that join all that is similar there: one a text at most."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, met in blocks(batches):
            firsts, seconds = [], []
            for x, y in met:
                sets = [lists_of(rows.column(6), s) for s in (x, y) if s is not None]
                size = [np.array([len(v) for v in side]) for side in sets]
                same = shared_counts(*sets)
                similar = 100 * same >= percent * (_against(size[0], None if y is None else size[1], np.add) - same)
                if y is not None:
                    whole = np.zeros((len(x) + len(y),) * 2, bool)
                    whole[: len(x), len(x) :] = similar
                    similar = whole | whole.T
                at = x if y is None else np.concatenate([x, y])
                root = least_roots(similar)
                moved = root != np.arange(len(at))
                firsts.append(at[moved])
                seconds.append(at[root[moved]])
            if firsts:
                yield pa.RecordBatch.from_arrays([rows.column(4).take(pa.array(np.concatenate(side))) for side in (firsts, seconds)], ["a", "b"])

    return join


def inverted(nodes: DataFrame, kept: int, percent: int) -> DataFrame:
    """nodes (key, size, kept) -> (key, size, least, weight, lists) of those that can have a partner.

    ``least``: values that any partner shares; ``lists``: the rarest of the node's values, so many that one of them is shared;
    ``weight``: how common its values are.
    """
    values = nodes.select("key", "size", F.explode("kept").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    # a text whose partners keep all their shingles too can be exact
    exact = F.ceil(F.col("size") * percent / 100)
    least = F.when(F.col("size") * 100 <= kept * percent, exact).otherwise(least_shared(kept, percent)).cast("int")
    found = values.join(common, "v").groupBy("key").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("f"), F.sum("df").alias("weight"))
    found = found.withColumn("least", least).filter(F.size("f") >= F.col("least"))
    return found.select("key", "size", "least", "weight", F.transform(F.slice("f", F.lit(1), F.size("f") - F.col("least") + 1), lambda x: x["v"]).alias("lists"))


def similar(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, kept: int, percent: int) -> DataFrame:
    """Pairs (a, b) of keys -> those whose union's sketch leaves it possible, by their full sets."""
    side = lambda table, name, k, v: table.select(F.col("key").alias(k), F.col(name).alias(v))
    told = pairs.join(side(nodes, "kept", "a", "ka"), "a").join(side(nodes, "kept", "b", "kb"), "b")
    union = F.slice(F.sort_array(F.array_union("ka", "kb")), 1, kept)
    both = F.size(F.array_intersect(F.array_intersect("ka", "kb"), union))
    enough = F.when(F.size(union) < kept, F.ceil(F.size(union) * percent / 100)).otherwise(least_shared(kept, percent))
    likely = told.filter(both >= enough).select("a", "b")
    full = likely.join(side(sets, "shingles", "a", "sa"), "a").join(side(sets, "shingles", "b", "sb"), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return full.withColumn("same", same).filter(100 * F.col("same") >= percent * (F.size("sa") + F.size("sb") - F.col("same"))).select("a", "b")


def linked(docs: DataFrame, percent: int = PERCENT, kept: int = KEPT, n: int = N, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, nodes, comps): members (doc_id, key, size), nodes (key, first_id) of texts with words, comps (node, root) of linked keys."""
    rows = docs.select("doc_id", words(lowered(F.col("text"))).alias("w"))
    hashed = rows.select("doc_id", word_key(F.col("w")).alias("key"), F.transform("w", lambda x: F.xxhash64(x)).alias("hw"))
    members = staged(hashed.mapInArrow(sketcher(kept, n), "doc_id long, key binary, size long, kept array<long>"), "sketches")
    nodes = members.filter("size > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("size").alias("size"), F.first("kept").alias("kept"))
    nodes = staged(nodes, "texts")
    found = staged(inverted(nodes, kept, percent), "inverted")
    lists = staged(found.select(F.posexplode("lists").alias("pos", "v"), "key", "size", "weight"), "lists")
    centers = lists.groupBy("v").agg(F.max(F.struct("weight", "key", "size")).alias("c"), F.count("*").alias("members")).filter("members > 1")
    tied = staged(centers.select(F.col("v").alias("at"), F.col("c.key").alias("center"), F.col("c.size").alias("center_size"), "members"), "centers")
    close = 100 * F.least("size", "center_size") >= percent * F.greatest("size", "center_size")
    met = lists.join(tied, F.col("v") == F.col("at")).filter(F.col("key") != F.col("center"))
    stars = staged(met.filter(close).select(F.col("key").alias("a"), F.col("center").alias("b")).distinct(), "stars")
    wanted = staged(met.select("key").union(met.select("center")).distinct(), "proposed")
    chosen = nodes.join(broadcast_if_small(wanted), "key").select("key", "first_id")
    # texts are cut into words again only where they are wanted
    again = docs.select(F.col("doc_id").alias("d"), "text").join(broadcast_if_small(staged(chosen, "proposed-texts")), F.col("d").eqNullSafe(F.col("first_id")))
    again = again.select("key", words(lowered(F.col("text"))).alias("w")).filter(word_key(F.col("w")) == F.col("key"))
    once = again.groupBy("key").agg(F.first("w").alias("w")).select("key", F.transform("w", lambda x: F.xxhash64(x)).alias("hw"))
    sets = staged(once.mapInArrow(whole_sets(n), "key binary, shingles array<long>"), "shingles")
    links = staged(similar(stars, nodes, sets, kept, percent), "links")
    first = staged(components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), "star-links"), "star-components")
    # what lists hold apart beside their centre, which has been compared with all of them
    rest = met.select("v", "pos", "key", "size").join(first.withColumnRenamed("node", "key"), "key", "left").select("v", "pos", "key", "size", F.coalesce("root", "key").alias("comp"))
    rest = staged(rest, "list-components")
    room = F.greatest(F.count("*") / block, F.sum("size") / BLOCK_SHINGLES)
    open_ = rest.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.ceil(room).cast("int").alias("many")).filter("x <> y").select(F.col("v").alias("at"), "many")
    placed = rest.join(open_, F.col("v") == F.col("at")).withColumn("blk", F.pmod(F.xxhash64("key"), "many").cast("int"))
    spread = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    spread = spread.select("v", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"), "blk", "key", "comp", "pos")
    carried = found.select("key", "size", "least", "lists").join(nodes.select("key", "kept"), "key")
    before = F.slice("lists", F.lit(1), F.col("pos")).alias("before")
    met_in = ["v", "lo", "hi"]
    sketched = spread.join(carried, "key").select(*met_in, "blk", "key", "comp", "size", "least", "kept", before)
    likely = staged(sketched.repartition(*met_in).sortWithinPartitions(*met_in).mapInArrow(apart(percent), BLOCK_ROWS), "apart")
    full = likely.join(sets, "key").select(*met_in, "blk", "key", "comp", "shingles")
    late = full.repartition(*met_in).sortWithinPartitions(*met_in).mapInArrow(joiner(percent), "a binary, b binary")
    ends = F.col("a").alias("src"), F.col("b").alias("dst")
    comps = components(late.select(*ends).union(first.select(F.col("node").alias("src"), F.col("root").alias("dst"))), "all-links")
    return members.select("doc_id", "key", "size"), nodes.select("key", "first_id"), comps


def components_of(docs: DataFrame, percent: int = PERCENT, kept: int = KEPT, n: int = N, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept, a row for every row of docs.

    Null texts and texts without words have no shingles and are linked with nothing. Texts with equal words are one node;
    null ids are no component's least id unless it has no other. Other columns do not matter; no rows, no rows.
    A link at the threshold is proposed but for a probability of LOSS; all else is exact, on 64-bit hashes of shingles.
    """
    members, nodes, comps = linked(docs, percent, kept, n, block)
    rooted = nodes.join(staged(comps, "components").withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = staged(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(ids, "root").select(F.col("key").alias("k"), "component_id")
    full = members.join(named, (F.col("key") == F.col("k")) & (F.col("size") > 0), "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return full.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
