"""Lines of text by measured widths (survey X10): greedy, and split at hyphens only where a word is too wide."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def pieces(word: str) -> list[str]:
    """A word's parts, each but the last with its hyphen; hyphens at either end don't split."""
    cuts = [k + 1 for k in range(1, len(word) - 1) if word[k] == "-"]
    return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)]) if a < b]


def wrapped(text: str, width: float, measure: Callable[[str], float] = len) -> list[str] | None:
    """Lines of at most ``width``; line breaks of the text stay, empty lines don't. None if a piece is too wide."""
    lines: list[str] = []
    for paragraph in text.split("\n"):
        line = None
        for word in paragraph.split():
            parts = [word] if measure(word) <= width else pieces(word)
            if any(measure(p) > width for p in parts):
                return None
            for k, part in enumerate(parts):
                longer = part if line is None else line + ("" if k else " ") + part
                if line is not None and measure(longer) > width:
                    lines.append(line)
                    longer = part
                line = longer
        if line is not None:
            lines.append(line)
    return lines


def wrap_texts(texts: DataFrame, key: str, width: int) -> DataFrame:
    """key, n_lines, widest of each row (key, text), in characters; nulls where a word can't be fitted. No shuffle."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), *T.StructType.fromDDL("n_lines int, widest int")])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        for b in batches:
            found = [wrapped(t or "", width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if f is None else len(f) for f in found], pa.int32()), pa.array([None if f is None else max(map(len, f), default=0) for f in found], pa.int32())], schema=to_arrow_schema(schema))

    return texts.select(key, "text").mapInArrow(run, schema)
