"""Groups of rows in Arrow batches: partitioned and sorted by key, then read in one stream.

A task sees its groups one after the other and holds one at a time, so thousands
of small groups cost one pass instead of one call each.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

FLUSH_ROWS = 20_000


def map_groups(df: DataFrame, keys: list[str], order: list[str], f: Callable[[list[dict]], list[tuple]], schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """Keys and rows of f(group as dicts in order) of every group."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        held: list[dict] = []
        key, out = None, []
        key_types: list[pa.DataType] = []

        def made():
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns, [*key_types, *types], strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, [*keys, *names])

        def close():
            out.extend((*key, *row) for row in f(held))
            held.clear()

        for batch in batches:
            key_types[:] = [batch.schema.field(k).type for k in keys]
            names_in = batch.schema.names
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names_in, values, strict=True))
                own = tuple(row[k] for k in keys)
                if own != key:
                    if held:
                        close()
                    key = own
                    if len(out) > FLUSH_ROWS:
                        yield made()
                held.append(row)
        if held:
            close()
        if out:
            yield made()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{kinds}, {schema}")
