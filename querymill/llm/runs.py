"""Groups of sorted rows inside a task, without a pandas frame for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by their first ``keys`` columns -> (rows, bounds): run i is rows[bounds[i] : bounds[i + 1]], always whole.

    Keys must not be null. What is held at a time is one batch and one run.
    """
    held = None
    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        if rows.num_rows == 0:
            continue
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for k in range(keys):
            column = rows.column(k)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
        bounds = np.flatnonzero(new)
        held = rows.slice(int(bounds[-1]))
        if len(bounds) > 1:
            yield rows, bounds
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])
