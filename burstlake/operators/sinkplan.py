"""Destinations that don't collide (survey K5, P10): three policies, each in input order and whatever case."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import per_group


def numbered(stem: str, suffix: str, src: str) -> Iterator[str]:
    """stem, stem_2, stem_3 ..."""
    yield stem + suffix
    for k in itertools.count(2):
        yield f"{stem}_{k}{suffix}"


def telling(stem: str, suffix: str, src: str) -> Iterator[str]:
    """stem, then with the source's folder, then up to _999, then with a digest of the source, which can be counted on."""
    folder = src.rpartition("/")[0].rpartition("/")[2]
    yield stem + suffix
    if folder not in ("", ".", ".."):
        yield f"{stem}_{folder}{suffix}"
    yield from (f"{stem}_{k}{suffix}" for k in range(2, 1000))
    yield from numbered(f"{stem}_{hashlib.sha1(src.lower().encode()).hexdigest()[:12]}", suffix, src)


POLICIES: dict[str, Callable] = {"numbered": numbered, "telling": telling}


def plan_names(files: DataFrame, folder: str = "out_dir", stem: str = "stem", suffix: str = ".jpg", pos: str = "pos", src: str = "src", taken: DataFrame | None = None, policy: str = "numbered", shared: bool = False) -> DataFrame:
    """Adds ``dst_name``: the first name of the policy that is free, in input order.

    A source that is listed again has none, or with ``shared`` the same as before. A number that a natural name holds is
    passed over, which is why a window's row number won't do. ``taken``: (folder, name) on disk. Folders are planned apart.
    """
    names = POLICIES[policy]
    df = files.select(F.col(folder).alias("_folder"), F.col(stem).alias("_stem"), F.col(pos).alias(pos), F.col(src).alias("_src"), F.lit(None).cast("string").alias("_taken"))
    if taken is not None:
        df = df.unionByName(taken.select(F.col(folder).alias("_folder"), F.col("name").alias("_taken")), allowMissingColumns=True)

    def run(g: pa.RecordBatch) -> dict:
        used = {n.lower() for n in g.column("_taken").to_pylist() if n is not None}
        given: dict = {}
        going: dict = {}  # of names that only count on, where their counting is
        out: dict = {pos: [], src: [], "dst_name": []}
        for s, p, path in zip(*(g.column(c).to_pylist() for c in ("_stem", pos, "_src"))):
            if s is None:
                continue
            again = path in given
            if not again:
                tries = going.setdefault(s.lower(), names(s, suffix, path)) if names is numbered else names(s, suffix, path)
                name = next(n for n in tries if n.lower() not in used)
                given[path] = s + name[len(s) :]
                used.add(name.lower())
            out[pos].append(p)
            out[src].append(path)
            out["dst_name"].append(None if again and not shared else given[path])
        return out

    made = per_group(df, "_folder", [pos], f"{pos} {files.schema[pos].dataType.simpleString()}, {src} string, dst_name string", run)
    return made.withColumnRenamed("_folder", folder)


def foreign(plan: DataFrame, sources: DataFrame, dst: str = "dst", path: str = "path") -> DataFrame:
    """Rows of a plan that write over no source (P10)."""
    return plan.join(sources.select(F.lower(path).alias("_p")), F.lower(dst) == F.col("_p"), "left_anti")


def outside_sources(plan: DataFrame, sources: DataFrame, out_dir: str = "out_dir", path: str = "path") -> DataFrame:
    """Rows of a plan whose folder neither is one of the sources' folders nor lies inside one (P10).

    A folder's own path and all above it are looked up, so no row meets another but by an equal path.
    """
    tidy = lambda c: F.regexp_replace(F.lower(c), r"/+$", "")
    homes = sources.select(F.regexp_replace(F.lower(path), r"/[^/]*$", "").alias("_home")).distinct()
    parts = F.split(tidy(out_dir), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    inside = plan.select(out_dir).distinct().select(out_dir, F.explode(above).alias("_home")).join(homes, "_home").select(out_dir).distinct()
    return plan.join(inside, out_dir, "left_anti")
