"""Cosine top-k between chunks of a vector table and blocks of queries: one small matrix product per pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# bounds the distance matrix of a chunk to its rows * 256
_QUERY_BLOCK = 256


def unit_rows(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the rows that have a direction: no null, empty or zero vector, nor a shorter one."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero((sizes > 0) & (sizes == sizes.max(initial=0)))
    if not len(at):
        return at, np.empty((0, 0))
    rows = values.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
    norms = np.linalg.norm(rows, axis=1)
    good = norms > 0
    return at[good], rows[good] / norms[good, None]


def nearest(k: int, max_distance: float | None):
    """Cogroup function: rows (id, vec) of a chunk and queries (query_id, row, vector) to each query's best ``k`` of it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at, rows = unit_rows(left.column("vec"))
        asked, queries = unit_rows(right.column("vector"))
        ids = left.column("id").combine_chunks()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(at) and len(asked):
            # ties are broken by id: rows in order of id, and a stable sort by distance
            by_id = np.argsort(np.array(ids.take(pa.array(at)).to_pylist(), dtype=object), kind="stable")
            at, rows = at[by_id], rows[by_id]
            for first in range(0, len(asked), _QUERY_BLOCK):
                distance = np.round(1.0 - queries[first : first + _QUERY_BLOCK] @ rows.T, 9)
                for j, d in enumerate(distance):
                    ok = d <= np.partition(d, k - 1)[k - 1] if len(d) > k else np.ones(len(d), bool)
                    if max_distance is not None:
                        ok &= d < max_distance
                    best = np.flatnonzero(ok)
                    best = best[np.argsort(d[best], kind="stable")[:k]]
                    found.append((np.full(len(best), asked[first + j]), at[best], d[best]))
        q, i, d = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        return pa.table({
            "query_id": right.column("query_id").combine_chunks().take(pa.array(q)), "row": right.column("row").combine_chunks().take(pa.array(q)),
            "id": ids.take(pa.array(i)), "distance": pa.array(d, pa.float64()),
        })

    return run
