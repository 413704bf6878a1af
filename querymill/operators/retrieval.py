"""Value index and exact nearest values."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querymill.session import cut_lineage

QUERY_ROWS = 8_192
INDEX_ROWS = 32_768
DISTANCE_DIGITS = 9
#: What rounding may add to a distance; bounds are widened by it.
SLACK = 1e-6
COLUMN = ["db_id", "table_name", "col_name"]


def build_value_index(values: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Attach one vector to every value; of several vectors of one value the least counts. See ``values_without_vector`` for the rest."""
    vectors = embeddings.groupBy("value").agg(F.min("embedding").alias("embedding"))
    return values.join(vectors, "value")


def values_without_vector(values: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Values that ``build_value_index`` leaves out."""
    return values.join(embeddings.select("value"), "value", "left_anti")


def write_value_index(index: DataFrame, path: str) -> None:
    """Parquet, one folder per database; a hot database is written by many tasks."""
    index.write.mode("overwrite").partitionBy("db_id").parquet(path)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    rows = len(flat)
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0)


def _assign(index: pa.Table, pivots: pa.Table) -> pa.Table:
    """Index rows of one column with the number of the nearest pivot and the distance to it."""
    kept = [*COLUMN, "value", "embedding"]
    if not index.num_rows:
        return pa.table({**{c: pa.array([], pa.string()) for c in kept[:-1]}, "embedding": pa.array([], pa.list_(pa.float64())), "cell": pa.array([], pa.int32()), "far": pa.array([], pa.float64())})
    v, centres = _matrix(index["embedding"]), _matrix(pivots["embedding"])
    centres = centres[np.lexsort(centres.T)]
    cell, far = np.zeros(len(v), np.int32), np.zeros(len(v))
    for low in range(0, len(v), 1024):
        d = _squared(v[low : low + 1024], centres)
        cell[low : low + 1024], far[low : low + 1024] = d.argmin(1), np.sqrt(d.min(1))
    return index.select(kept).append_column("cell", pa.array(cell)).append_column("far", pa.array(far))


def _plan(k: int):
    """Queries of a database and its cells -> per query and column the nearest cell, a bound of the k-th distance, and the cells that may lie within it."""
    schema = pa.schema([("dp_id", pa.int64()), *((c, pa.string()) for c in COLUMN), ("home", pa.int32()), ("bound", pa.float64()), ("cells", pa.list_(pa.int32())), ("least", pa.list_(pa.float64()))])

    def run(queries: pa.Table, cells: pa.Table) -> pa.Table:
        if not queries.num_rows or not cells.num_rows:
            return schema.empty_table()
        cells = cells.sort_by([("table_name", "ascending"), ("col_name", "ascending"), ("cell", "ascending")])
        q, ids = _matrix(queries["embedding"]), queries["dp_id"].to_pylist()
        names = list(zip(*(cells[c].to_pylist() for c in COLUMN)))
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        numbers, sizes, radius = (np.asarray(cells[c]) for c in ("cell", "n", "radius"))
        centres = _matrix(cells["centre"])
        out = {f.name: [] for f in schema}
        for low, high in zip(cuts, cuts[1:]):
            d = np.sqrt(_squared(q, centres[low:high]))
            reach = d + radius[low:high]
            order = np.argsort(reach, axis=1)
            held = np.cumsum(sizes[low:high][order], axis=1)
            # the cells that reach least far and hold k values together
            last = np.minimum((held < k).sum(axis=1), high - low - 1)
            bound = np.take_along_axis(reach, np.take_along_axis(order, last[:, None], 1), 1)[:, 0]
            least = np.maximum(d - radius[low:high], 0)
            home = d.argmin(axis=1)
            for i, dp in enumerate(ids):
                near = np.flatnonzero(least[i] <= bound[i] + SLACK)
                for name, x in zip(schema.names, (dp, *names[low], numbers[low + home[i]], bound[i], numbers[low:high][near], least[i][near])):
                    out[name].append(x)
        return pa.table([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def _top_k(k: int):
    schema = pa.schema([("dp_id", pa.int64()), *((c, pa.string()) for c in COLUMN), ("value", pa.string()), ("distance", pa.float64())])

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        """The k nearest values of one cell for each of the queries that visit it."""
        if not queries.num_rows or not index.num_rows:
            return schema.empty_table()
        ids = np.asarray(queries["dp_id"])
        q = _matrix(queries["embedding"])
        index = index.sort_by("value")
        v = _matrix(index["embedding"])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start in range(0, len(q), 256):
            d = _squared(q[start : start + 256], v).round(DISTANCE_DIGITS)
            kth = min(k, len(v)) - 1
            # everything up to the k-th distance, ties included, then the first k by (distance, value)
            row, col = np.nonzero(d <= np.partition(d, kth, axis=1)[:, kth : kth + 1])
            order = np.lexsort((col, d[row, col], row))
            row, col = row[order], col[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[place < k], col[place < k]
            found.append((start + row, col, d[row, col]))
        rows, cols, dist = (np.concatenate(x) for x in zip(*found))
        picked = index.select([*COLUMN, "value"]).take(pa.array(cols))
        return pa.table([pa.array(ids[rows]), *picked.columns, pa.array(dist)], schema=schema)

    return run


def _fresh(df: DataFrame) -> DataFrame:
    """New names for all columns: both sides of a cogroup may come from one frame."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def build_cells(index: DataFrame, rows: int = INDEX_ROWS) -> tuple[DataFrame, DataFrame]:
    """(placed, cells): the index by nearest pivot, a cell each, and what is known of every cell.

    ``placed(db_id, table_name, col_name, cell, part, value, embedding)``, ``cells(db_id, table_name, col_name, cell, n, parts, radius, centre)``.
    Values without a vector are left out. A column of n values has about n / ``rows`` pivots, drawn by hash; a cell of more than ``rows`` values
    lies in several parts. Rows meet the pivots of their column in bounded groups.
    """
    index = index.filter("embedding IS NOT NULL")
    h = F.xxhash64(F.lit("pivot"), "value", "embedding")
    counted = index.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("n"), F.min(h).alias("first")).withColumn("p", F.ceil(F.col("n") / rows).cast("int"))
    drawn = index.withColumn("h", h).join(counted, COLUMN)
    pivots = drawn.filter((F.col("h") == F.col("first")) | ((F.col("p") > 1) & (F.pmod("h", "n") < F.col("p")))).select(*COLUMN, "p", "value", "embedding").dropDuplicates([*COLUMN, "embedding"])
    keys = [*COLUMN, "shard"]
    sharded = drawn.select(*COLUMN, F.pmod(F.xxhash64("value"), "p").cast("int").alias("shard"), "value", F.col("embedding").cast("array<double>").alias("embedding"))
    spread = pivots.select(*COLUMN, F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("shard"), "value", "embedding")
    assigned = _fresh(sharded).groupBy(*keys).cogroup(_fresh(spread).groupBy(*keys)).applyInArrow(_assign, "db_id string, table_name string, col_name string, value string, embedding array<double>, cell int, far double")
    assigned = cut_lineage(assigned)
    centre = F.min_by("embedding", F.struct("far", "value"))
    measured = assigned.groupBy(*COLUMN, "cell").agg(F.count(F.lit(1)).alias("n"), centre.alias("centre"))
    cells = measured.withColumn("parts", F.ceil(F.col("n") / rows).cast("int"))
    placed = assigned.join(cells.select(*COLUMN, "cell", "parts"), [*COLUMN, "cell"])
    placed = placed.select(*COLUMN, "cell", F.pmod(F.xxhash64(F.lit("part"), "value"), "parts").cast("int").alias("part"), "value", "embedding", "far")
    radius = placed.groupBy(*COLUMN, "cell").agg(F.max("far").alias("radius"))
    return placed.drop("far"), cells.join(radius, [*COLUMN, "cell"])


def _visits(asked: DataFrame, queries: DataFrame, placed: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """k nearest values of each visited cell part for ``asked(dp_id, column, cell)``: visitors of a cell come in bounded blocks."""
    key = [*COLUMN, "cell"]
    blocks = asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("many"))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    coming = asked.join(blocks, key).join(cells.select(*key, "parts"), key).join(queries.select("dp_id", F.col("db_id"), "embedding"), ["dp_id", "db_id"])
    coming = coming.select(*key, every("parts", "part"), F.pmod(F.xxhash64("dp_id"), "many").cast("int").alias("block"), "dp_id", "embedding")
    there = placed.join(blocks, key).select(*key, "part", every("many", "block"), "value", "embedding")
    full = [*key, "part", "block"]
    return _fresh(coming).groupBy(*full).cogroup(_fresh(there).groupBy(*full)).applyInArrow(_top_k(k), "dp_id long, db_id string, table_name string, col_name string, value string, distance double")


def nearest_values(queries: DataFrame, index: DataFrame, k: int = 3, rows: int = INDEX_ROWS, visits: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """The ``k`` values nearest to each question *per column* of its database, exact squared L2.

    ``queries(dp_id, db_id, embedding)``, ``index(db_id, table_name, col_name, value, embedding)``. Builds the cells of the index
    and searches them; callers with many batches of questions write the result of ``build_cells`` once and call ``search_cells``.
    """
    placed, cells = build_cells(index, rows)
    return search_cells(queries, placed, cut_lineage(cells), k, visits)


def search_cells(queries: DataFrame, placed: DataFrame, cells: DataFrame, k: int = 3, visits: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """As ``nearest_values``, over the two tables of ``build_cells``.

    A question first visits the cell nearest to it, which bounds its k-th distance; then only cells that reach into that
    bound, by the triangle inequality. Visits of a cell are groups of bounded size that work on matrices and give back k values
    per question; pairs are never rows. ``visits`` gets the table of all visits, for tests and tuning.
    """
    asking = queries.select(F.col("dp_id").cast("long").alias("dp_id"), "db_id", "embedding").filter("embedding IS NOT NULL")
    w = W.partitionBy("dp_id", *COLUMN).orderBy("distance", "value")
    nearest = lambda found: found.withColumn("rn", F.row_number().over(w).cast("long")).filter(F.col("rn") <= k).drop("db_id")
    if cells.groupBy(*COLUMN).count().filter("count > 1").isEmpty():
        # one cell a column: there is nothing to spare
        every_cell = asking.select("dp_id", "db_id").join(cells.select(*COLUMN, "cell"), "db_id")
        return nearest(_visits(every_cell, asking, placed, cells, k))
    blocks = asking.groupBy("db_id").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("many"))
    keys = ["db_id", "block"]
    some = asking.join(blocks, "db_id").select("db_id", F.pmod(F.xxhash64("dp_id"), "many").cast("int").alias("block"), "dp_id", "embedding")
    shown = cells.join(blocks, "db_id").select("db_id", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("block"), "table_name", "col_name", "cell", "n", "radius", "centre")
    planned = _fresh(some).groupBy(*keys).cogroup(_fresh(shown).groupBy(*keys)).applyInArrow(_plan(k), "dp_id long, db_id string, table_name string, col_name string, home int, bound double, cells array<int>, least array<double>")
    planned = cut_lineage(planned)
    first = cut_lineage(_visits(planned.select("dp_id", *COLUMN, F.col("home").alias("cell")), asking, placed, cells, k))
    kth = first.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == k).select("dp_id", *COLUMN, F.sqrt("distance").alias("kth"))
    left = planned.filter(F.size("cells") > 1).join(kth, ["dp_id", *COLUMN], "left").withColumn("bound", F.least("bound", F.coalesce("kth", "bound")) + SLACK)
    again = left.select("dp_id", *COLUMN, "home", "bound", F.explode(F.arrays_zip("cells", "least")).alias("c")).filter((F.col("c.least") <= F.col("bound")) & (F.col("c.cells") != F.col("home")))
    again = cut_lineage(again.select("dp_id", *COLUMN, F.col("c.cells").alias("cell")))
    if visits is not None:
        visits(planned.select("dp_id", *COLUMN, F.col("home").alias("cell")).union(again))
    return nearest(first.union(_visits(again, asking, placed, cells, k)))
