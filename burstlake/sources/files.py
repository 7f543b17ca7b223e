"""A file catalog as a Python data source (survey S1, S2), and what a command line names.

Spark's own file sources leave out names that begin with an underscore, as a
camera's Adobe RGB frames do; this one lists folders itself, a partition per
folder below the root.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders that hold no frames, and the extensions of images.
SKIPPED = ("__macosx", "$recycle.bin")
IMAGES = ("jpg", "jpeg", "png", "tif", "tiff", "cr2")
SCHEMA = "dir string, name string, stem string, ext string, path string, size long, problem string"


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.lower() in SKIPPED


def walk(top: str, deep: bool) -> Iterator[tuple]:
    """Rows of a folder; links are not followed, and what can't be read is a row with its problem."""
    todo, seen = [top], set()
    while todo:
        here = todo.pop()
        if (real := os.path.realpath(here)) in seen:
            continue
        seen.add(real)
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError as e:
            yield here, None, None, None, here, None, f"{type(e).__name__}: {e}"
            continue
        for e in entries:
            if _hidden(e.name):
                continue
            try:
                if e.is_dir(follow_symlinks=False):
                    if deep:
                        todo.append(e.path)
                elif e.is_file():
                    stem, dot, ext = e.name.rpartition(".")
                    yield here, e.name, stem if dot else e.name, ext.lower() if dot else "", e.path, e.stat().st_size, None
            except OSError as x:
                yield here, e.name, None, None, e.path, None, f"{type(x).__name__}: {x}"


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.deep = options["path"], options.get("recursive", "true").lower() == "true"

    def partitions(self) -> list[Folder]:
        below = []
        if self.deep:
            try:
                below = [e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and not _hidden(e.name)]
            except OSError:
                below = []
        return [Folder(self.root, False), *(Folder(p, True) for p in sorted(below))]

    def read(self, partition: Folder) -> Iterator[tuple]:
        return walk(partition.path, partition.deep)


class Catalog(DataSource):
    """``spark.read.format("frames").option("recursive", ...).load(root)``; the root is a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def literal(spec: str) -> str:
    """A mask whose folders before the first wildcard are taken as they're written, brackets and all."""
    parts = spec.split("/")
    first = next((k for k, p in enumerate(parts) if "*" in p or "?" in p), len(parts))
    return "/".join([glob.escape("/".join(parts[:first]))] * (first > 0) + parts[first:]) if "/".join(parts[:first]) else spec


def expanded(specs: list[str]) -> tuple[list[tuple[str, bool]], list[tuple[str, str]]]:
    """(paths in order, each with whether it's a folder; what couldn't be read and why) of folders, files and masks.

    Quotes around a spec go; a path that is listed twice counts once, by its own spelling alone, as a merge would lose a file.
    A mask that finds nothing as it's written is tried with its brackets as sets of characters.
    """
    found: dict = {}
    problems = []
    for spec in specs:
        spec = spec.strip().strip("\"'")
        if not spec:
            continue
        names = [spec] if os.path.lexists(spec) else sorted(glob.glob(literal(spec), recursive=True), key=str.lower) or sorted(glob.glob(spec, recursive=True), key=str.lower)
        if not names:
            problems.append((spec, "nothing is there"))
        for name in names:
            found.setdefault(os.path.abspath(name), os.path.isdir(name))
    return list(found.items()), problems


def inputs(spark: SparkSession, specs: list[str], recursive: bool = True, extensions: tuple = IMAGES) -> tuple[DataFrame, DataFrame]:
    """(files, problems) of folders, files and masks, each file once, in the order of the specs."""
    paths, problems = expanded(specs)
    kinds = SCHEMA.replace(", problem string", "")
    df, bad = spark.createDataFrame([], f"{kinds}, _nth long"), spark.createDataFrame(problems, "path string, problem string")
    single = []
    for nth, (path, folder) in enumerate(paths):
        if folder:
            some, wrong = catalog(spark, path, recursive, extensions)
            df, bad = df.unionByName(some.withColumn("_nth", F.lit(nth).cast("long"))), bad.unionByName(wrong)
        else:
            where, name = os.path.split(path)
            stem, dot, ext = name.rpartition(".")
            single.append((where, name, stem if dot else name, ext.lower() if dot else "", path, os.path.getsize(path), nth))
    df = df.unionByName(spark.createDataFrame(single, f"{kinds}, _nth long").where(F.col("ext").isin(*extensions)))
    first = Window.partitionBy("path").orderBy("_nth")
    df = df.withColumn("_r", F.row_number().over(first)).where("_r = 1").orderBy("_nth", F.lower("dir"), F.lower("name"))
    return df.drop("_nth", "_r"), bad


def catalog(spark: SparkSession, root: str, recursive: bool = True, extensions: tuple = IMAGES) -> tuple[DataFrame, DataFrame]:
    """(files, problems): images in order of folder and name, whatever case, and what could not be read."""
    spark.dataSource.register(Catalog)
    df = spark.read.format("frames").option("recursive", str(recursive).lower()).load(root)
    found = df.where(F.col("problem").isNull() & F.col("ext").isin(*extensions)).drop("problem")
    return found.orderBy(F.lower("dir"), F.lower("name")), df.where(F.col("problem").isNotNull()).select("path", "problem")
