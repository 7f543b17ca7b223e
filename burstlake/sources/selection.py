"""Selections and settings as JSON (survey S25, S26, O8), and copying what they name."""

from __future__ import annotations

import json
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "burstlake-selection"


def save(path: str, names: list[str], note: str = "") -> None:
    """Writes beside the target, then puts it in place, so no reader sees half of it."""
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump({"format": FORMAT, "version": 1, "note": note, "files": names}, f, ensure_ascii=False, indent=1)
    os.replace(temp, path)


# The encodings that old settings may have, in order of trial.
LEGACY = ("cp1251", "cp866", "koi8-r", "mac-cyrillic")


def decoded(data: bytes) -> str:
    """The text of a settings file (S26): UTF-8 if it is that, else in the encoding that gives most small Cyrillic letters, the first of equal ones."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        tries = [data.decode(e, "replace") for e in LEGACY]
        return max(tries, key=lambda t: sum("а" <= c <= "я" or c == "ё" for c in t))


def load_settings(path: str) -> tuple[dict, str | None]:
    """(settings, where a broken file was put aside or null) (S26): what isn't an object of JSON doesn't stop a start, and isn't lost."""
    try:
        with open(path, "rb") as f:
            found = json.loads(decoded(f.read()))
        if isinstance(found, dict):
            return found, None
    except FileNotFoundError:
        return {}, None
    except ValueError:
        pass
    os.replace(path, path + ".broken")
    return {}, path + ".broken"


def load(spark: SparkSession, path: str) -> DataFrame:
    """(pos, file) of a selection; anything but strings is left out, another format is an error."""
    df = spark.read.schema("format string, version int, note string, files array<string>").json(path, multiLine=True)
    df = df.withColumn("_ok", F.coalesce(F.col("format") == FORMAT, F.lit(False)))
    checked = df.withColumn("files", F.when(F.col("_ok"), F.col("files")).otherwise(F.raise_error(F.lit("not a selection")).cast("array<string>")))
    return checked.select(F.posexplode("files").alias("pos", "file")).where("file is not null")


def export(plan: DataFrame, out_dir: str) -> DataFrame:
    """Copies (src, dst_name) rows into a folder that all executors see: (src, dst, error) per row.

    A file is made under a name of its own and linked in place, so a task that
    runs again finds its own copy and nothing is overwritten.
    """

    def run(batches):
        import pyarrow as pa

        os.makedirs(out_dir, exist_ok=True)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                dst, error, temp = os.path.join(out_dir, r["dst_name"]), None, None
                try:
                    handle, temp = tempfile.mkstemp(dir=out_dir, prefix=".part-")
                    os.close(handle)
                    shutil.copy2(r["src"], temp)
                    os.link(temp, dst)
                except FileExistsError:
                    same = os.path.getsize(dst) == os.path.getsize(r["src"]) and int(os.path.getmtime(dst)) == int(os.path.getmtime(r["src"]))
                    error = None if same else f"exists: {dst}"
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
                finally:
                    if temp and os.path.exists(temp):
                        os.unlink(temp)
                rows.append({"src": r["src"], "dst": None if error else dst, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("src", pa.string()), ("dst", pa.string()), ("error", pa.string())]))

    return plan.select("src", "dst_name").where("dst_name is not null").mapInArrow(run, "src string, dst string, error string")
