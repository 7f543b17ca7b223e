"""Kernels that need all rows of a group in order, many small groups to a call."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def per_group(df: DataFrame, key: str, order: list[str], schema: str, kernel: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``kernel`` of each group's rows, in ``order``; what it returns, {column: values}, gets the group's ``key``.

    Rows are dealt out and sorted by Spark; a task passes on Arrow batches and
    cuts them where the key changes, so small groups cost no frame each. A group
    is held whole, as a grouped function would.
    """
    made = T.StructType.fromDDL(schema)
    out_type = T.StructType([T.StructField(key, df.schema[key].dataType), *made.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out, held = to_arrow_schema(out_type), []

        def results(groups: list[pa.RecordBatch]):
            got = [(g, kernel(g)) for g in groups]
            if not got:
                return
            sizes = [len(next(iter(x.values()))) for _, x in got]
            keys = pa.concat_arrays([g.column(0)[:1] for g, _ in got]).take(pa.array(np.repeat(np.arange(len(got)), sizes)))
            cols = [np.concatenate([np.asarray(x[f.name]) for _, x in got]) for f in made.fields]
            yield pa.RecordBatch.from_arrays([keys.cast(out.field(0).type), *(pa.array(c, out.field(k + 1).type, from_pandas=True) for k, c in enumerate(cols))], schema=out)

        def joined() -> list[pa.RecordBatch]:
            return pa.Table.from_batches(held).combine_chunks().to_batches() if held else []

        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.flatnonzero(_differs(batch.column(0).to_numpy(zero_copy_only=False))) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            parts = [batch.slice(a, b - a) for a, b in zip(edges[:-1], edges[1:])]
            if held and held[-1].column(0)[-1].as_py() != parts[0].column(0)[0].as_py():
                yield from results(joined())
                held = []
            held.append(parts[0])
            if len(parts) > 1:
                yield from results([*joined(), *parts[1:-1]])
                held = [parts[-1]]
        yield from results(joined())

    cols = [key, *(c for c in df.columns if c != key)]
    return df.select(*cols).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out_type)


def _differs(values: np.ndarray) -> np.ndarray:
    """Where a value isn't the one before; unknown ones are alike."""
    a, b = values[1:], values[:-1]
    same = a == b
    if values.dtype.kind == "f":
        same |= np.isnan(a) & np.isnan(b)
    return ~same.astype(bool)
