"""Token counts by a two-tier lookup on the map side.

Texts are cut into runs of pre-tokens at spaces that a non-space follows, where
a byte-level BPE pre-tokenizer cuts too, whatever stands around. A first pass
finds the runs that are frequent in the whole corpus (each task keeps bounded
counts of the heaviest, Spark sums those); the driver encodes them once and
broadcasts their lengths. In the second pass a task looks each run up in that
table, then in its worker's cache, and encodes what neither knows. No run is
shuffled but the few heavy ones, and no text leaves its task.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, heaviest, map_rows

#: Where one text can be cut without changing any token. Python's \S is the narrower class, so a cut is always safe.
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|\Z)")
_LOADED: dict = {}


def _runs(text: str) -> list[str]:
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


def _tokenizer(path: str):
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = tok, {}
    return _LOADED[path]


def frequent_runs(docs: DataFrame, text: str = "text", most: int = 65_536, per_task: int = 8_192, longest: int = 64) -> list[str]:
    """The heaviest runs of the corpus, ``most`` at most; runs over ``longest`` characters never count as frequent.

    A task's counter is cut back to its heaviest half at 32 * ``per_task`` runs,
    so its memory is bounded. A run that this misses costs time, not results.
    """

    def make():
        counts: Counter = Counter()

        def each(cols):
            nonlocal counts
            for x in cols[text]:
                if x:
                    counts.update(_runs(x)[1:])
                    if len(counts) > 32 * per_task:
                        counts = Counter(dict(counts.most_common(16 * per_task)))

        def last():
            top = [(k, n) for k, n in counts.most_common(per_task) if n > 1 and len(k) <= longest]
            return {"run": [k for k, _ in top], "n": [n for _, n in top]} if top else None

        each.last = last
        return each

    heavy = map_rows(docs.select(text), "run string, n long", make)
    scratch = Scratch(docs.sparkSession, "runs")
    heavy = scratch.table(heavy.groupBy("run").agg(F.sum("n").alias("n")), "heavy")
    runs = sorted(heaviest(heavy, "n", most).select("run").toArrow()["run"].to_pylist())
    scratch.drop()
    return runs


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text: str = "text", most: int = 65_536, cache: int = 60_000_000) -> DataFrame:
    """One row per row of ``docs``: id, UTF-8 bytes, tokens, and whether they exceed ``limit``.

    ``tokenizer``: a file of the tokenizers library with a byte-level BPE, at the
    same path on every executor. Null and empty texts have 0 bytes and 0 tokens.
    Texts that hold a special string are encoded whole, as the library does it.
    Null and repeated ids and repeated rows each get a row; an empty table gives
    none; other columns are left out. A worker's cache is emptied once it holds
    ``cache`` bytes, counting 100 for each run besides its characters, so it has
    no more than that and a batch's own runs.
    """
    spark = docs.sparkSession
    tok, _ = _tokenizer(tokenizer)
    runs = frequent_runs(docs, text, most)
    sizes = [len(e) for e in tok.encode_batch([" " + r for r in runs], add_special_tokens=False)]
    table = spark.sparkContext.broadcast(dict(zip(runs, sizes)))
    special = [t.content for t in tok.get_added_tokens_decoder().values()]

    def make():
        tok, known = _tokenizer(tokenizer)
        if known.get("of") is not table.value:
            known.clear()
            known.update(of=table.value, all=dict(table.value), held=0)
        lengths = known["all"]

        def encode(texts):
            return [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

        def each(cols):
            nonlocal lengths
            out, cut = {"id": cols[id_col], "n_bytes": [], "n_tokens": []}, []
            for x in cols[text]:
                x = x or ""
                out["n_bytes"].append(len(x.encode()))
                cut.append(encode([x])[0] if any(s in x for s in special) else _runs(x) if x else 0)
            split = [c for c in cut if isinstance(c, list)]
            heads = iter(encode([c[0] for c in split]))
            if known["held"] > cache:
                lengths = known["all"] = dict(table.value)
                known["held"] = 0
            missing: set = set()
            for c in split:
                missing.update(c[1:])
            missing = [m for m in missing if m not in lengths]
            for k in range(0, len(missing), 4096):
                part = missing[k : k + 4096]
                lengths.update(zip(part, encode([" " + m for m in part])))
                known["held"] += sum(map(len, part)) + 100 * len(part)
            for c in cut:
                if isinstance(c, list):
                    c = next(heads) + sum(map(lengths.__getitem__, c[1:]))
                out["n_tokens"].append(c)
            return out

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    counted = map_rows(docs.select(id_col, text), f"id {kind}, n_bytes long, n_tokens long", make)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
