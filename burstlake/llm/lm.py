"""Scores of texts by a log-bilinear model that is trained by noise-contrastive estimation.

The model predicts a token from the two tokens before it, in two steps:
C1 r(w1) + C2 r(w2) is compared with each class's vector, plus a bias, and then
with the vectors of the tokens of that class. The most frequent tokens are
classes of their own; the others share classes of equal weight, in order of
their counts, so that frequent tokens have few neighbours. All tokens that occur
often enough to learn from have vectors of their own, so their number grows with
the vocabulary; rarer tokens are grouped by their last letters, a group is one
more entry of a class, and a token has its smoothed share of its group.

Training goes in rounds, each over its part of the training texts: every task
starts from the last mean and trains a copy on its share; the copies' mean, each
row weighted by how often a copy has trained it, starts the next round.

Scores are normalised. The classes' partition function of a context (w1, w2) is
a sum of exp(q.C1 r(w1) + b) exp(q.C2 r(w2)), so it's the product of two rows of
matrices that hold a row for each token of a stretch, not for each context;
within a class it's a matrix product over the class's members.

Counts of all tokens are a table, never a broadcast: the most frequent ones,
a bounded number, go to every task; the rest are joined. Texts are cut and
encoded once, by Arrow's kernels; training and scoring read entries' numbers.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, heaviest, map_rows

#: The token that ends a text; no word is empty.
END = b""
#: Tokens of more bytes than this are known by their SHA-256 and last two bytes, so no token is too long to broadcast.
LONGEST = 64
_WORKER: dict = {}


def stretches(texts: pa.Array, most: int = 6_000_000) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) texts of stretches of about ``most`` bytes; a longer text is one of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The contract's tokens of texts in a row, A-Z in lower case, and how many each text has; ends are not among them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    values = lists.flatten()
    whole = pc.binary_length(values).to_numpy() > 0  # what is cut before a leading blank is empty
    if not whole.all():
        so_far = np.r_[0, np.cumsum(whole)]
        ends = np.cumsum(sizes)
        sizes = so_far[ends] - so_far[ends - sizes]
        values = values.filter(pa.array(whole))
    return values, sizes


def keys(tokens: pa.Array) -> pa.Array:
    """Tokens as they are counted and looked up."""
    tokens = tokens.cast(pa.binary())
    long = np.flatnonzero(pc.binary_length(tokens).to_numpy() > LONGEST)
    if not len(long):
        return tokens
    mask = np.zeros(len(tokens), bool)
    mask[long] = True
    short = [hashlib.sha256(t).digest() + t[-2:] for t in tokens.take(pa.array(long)).to_pylist()]
    return pc.replace_with_mask(tokens, pa.array(mask), pa.array(short, pa.binary()))


def _groups_by_tail(shared: int) -> np.ndarray:
    """The crc32 of all pairs of bytes and, behind them, single bytes, by ``shared``."""
    pairs = [zlib.crc32(bytes([a, b])) % shared for a in range(256) for b in range(256)]
    return np.array(pairs + [zlib.crc32(bytes([b])) % shared for b in range(256)] + [zlib.crc32(b"") % shared], np.int32)


class Classes:
    """Entries of the vocabulary: 0 .. own-1 for the most frequent tokens, then ``shared`` for the groups of rare tokens by the
    crc32 of the last two bytes, then one for each further token that occurs ``least`` times.

    A group's class is its own; the further tokens are dealt to the classes in order of counts, by equal sums of the roots of
    counts, so the expected number of a token's neighbours is small.
    """

    def __init__(self, frequent: list[tuple[bytes, int]] | tuple[pa.Array, np.ndarray], own: int, shared: int, least: int):
        if isinstance(frequent, list):
            frequent = pa.array([w for w, _ in frequent], pa.binary()), np.array([c for _, c in frequent], np.int64)
        self.frequent, counts = frequent
        frequent = self.frequent
        self.own, self.shared = min(own, len(frequent)), shared
        self.size = self.own + shared
        self.by_tail = _groups_by_tail(shared)
        self.hashes = self.groups(self.frequent)
        self.known = self.own + int((counts[self.own :] >= least).sum())  # ``frequent`` is in order of counts
        self.entries = self.size + self.known - self.own
        self.start = self.entries  # the context before a text
        self.classes = np.concatenate([np.arange(self.own), np.arange(self.size, self.entries), self.own + self.hashes[self.known :], [-1]]).astype(np.int32)
        self.counts = np.r_[counts, 0].astype(np.float64)
        weight = np.cumsum(np.sqrt(counts[self.own : self.known].astype(np.float64)))
        dealt = np.minimum(weight * (shared / weight[-1]), shared - 1).astype(np.int32) if len(weight) else np.empty(0, np.int32)
        #: The class of each entry.
        self.head = np.concatenate([np.arange(self.size), self.own + dealt]).astype(np.int32)

    def groups(self, tokens: pa.Array) -> np.ndarray:
        """The group of each token, whether it's rare or not."""
        if not len(tokens):
            return np.empty(0, np.int32)
        _, offsets, data = tokens.buffers()
        ends = np.frombuffer(offsets, np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        size, last = np.diff(ends), data[np.maximum(ends[1:] - 1, 0)].astype(np.int32)
        both = data[np.maximum(ends[1:] - 2, 0)].astype(np.int32) * 256 + last
        return self.by_tail[np.where(size > 1, both, np.where(size == 1, 65536 + last, 65536 + 256))]

    def members(self) -> list[np.ndarray]:
        """Of each shared class its entries, counted from ``own``."""
        order = np.argsort(self.head[self.own :], kind="stable")
        return np.split(order, np.searchsorted(self.head[self.own :][order], np.arange(self.own + 1, self.size)))

    def encode(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of tokens as ``keys`` gives them: place among the frequent (-1: none) and entry."""
        place = pc.fill_null(pc.index_in(tokens, value_set=self.frequent), -1).to_numpy(zero_copy_only=False)
        entry = self.classes[place]
        other = np.flatnonzero(place < 0)
        if len(other):
            entry[other] = self.own + self.groups(tokens.take(pa.array(other)))
        return place, entry


class Model:
    """Tables: r (a row per entry and the start, d), q (classes, d and the bias), t (entries of shared classes, likewise), c (c1 over c2)."""

    def __init__(self, size: int, d: int, noise: np.ndarray, tail: np.ndarray | None = None, head: np.ndarray | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        tail = np.empty(0) if tail is None else tail
        self.head = np.arange(size, dtype=np.int32) if head is None else head
        self.first = len(self.head) - len(tail)  # entries from here on are in ``t``
        draw = lambda n: rng.normal(0, 0.1, (n, d)).astype(np.float32)
        # tokens of shared classes start from their class: as context at its row, to which theirs is added, and within it at their count
        self.size = size
        self.r = draw(len(self.head) + 1)
        self.r[size:-1] = 0
        self.q = np.column_stack([draw(size), np.log(noise)]).astype(np.float32)
        self.t = np.column_stack([np.zeros((len(tail), d)), np.log(tail)]).astype(np.float32)
        self.c = np.concatenate([np.eye(d, dtype=np.float32) * x for x in (0.7, 0.3)])
        self.tables = [self.r, self.q, self.t, self.c]

    @property
    def c1(self) -> np.ndarray:
        return self.c[: self.c.shape[1]]

    @property
    def c2(self) -> np.ndarray:
        return self.c[self.c.shape[1] :]

    def named(self, w: np.ndarray) -> np.ndarray:
        """Where in ``w`` tokens of shared classes are that have a row of their own."""
        return np.flatnonzero((w >= self.size) & (w < len(self.head)))

    def load(self, tables: list[np.ndarray]) -> None:
        """Takes copies of a model's tables as its own."""
        self.tables = [self.r, self.q, self.t, self.c] = [x.copy() for x in tables]

    @classmethod
    def of(cls, tables: list[np.ndarray], classes: Classes) -> "Model":
        """A trained model to score with; its tables aren't copied."""
        m = cls.__new__(cls)
        m.tables = [m.r, m.q, m.t, m.c] = tables
        m.size, m.head = classes.size, classes.head
        m.first = len(m.head) - len(m.t)
        return m

    def context(self, w: np.ndarray) -> np.ndarray:
        x, at = self.r.take(w, axis=0), self.named(w)
        x[at] += self.r.take(self.head.take(w[at]), axis=0)
        return x

    def log_probabilities(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """All classes' normalised natural log-probabilities, a row per context (w1: the token just before)."""
        s = (self.context(w1) @ self.c1 + self.context(w2) @ self.c2) @ self.q[:, :-1].T + self.q[:, -1]
        return s - _log_sum(s)[:, None]


def _log_sum(s: np.ndarray) -> np.ndarray:
    """Logs of the rows' sums of exponentials."""
    top = s.max(axis=1)
    return top + np.log(np.exp(s - top[:, None]).sum(axis=1))


class Trainer:
    """Noise-contrastive estimation with Adagrad; noise is drawn from the unigram and shared by a batch."""

    def __init__(self, model: Model, noise: np.ndarray, k: int = 64, rate: float = 0.08, batch: int = 2048, seed: int = 11, tail: np.ndarray | None = None):
        self.m, self.k, self.rate, self.batch = model, k, rate, batch
        self.noise = [(np.cumsum(p)[:-1], np.log(k * p).astype(np.float32)) for p in (noise, np.empty(0) if tail is None else tail)]
        self.rng = np.random.default_rng(seed)
        self.seen = 0
        self.sq = [np.full(x.shape, 1e-3, np.float32) for x in model.tables]
        #: How often each row was trained.
        self.times = [np.zeros(len(x), np.int64) for x in model.tables]

    def train(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> None:
        order = self.rng.permutation(len(w))
        with np.errstate(over="ignore"):  # the exponential of a sure noise token may be infinite
            for a in range(0, len(w), self.batch):
                at = order[a : a + self.batch]
                self._one(w1[at], w2[at], w[at])
        self.seen += len(w)

    def _one(self, w1, w2, w):
        m, n = self.m, np.float32(len(w))
        r1, r2 = m.context(w1), m.context(w2)
        h = np.empty((len(w), m.c.shape[1] + 1), np.float32)  # a one behind it meets the bias
        np.add(r1 @ m.c1, r2 @ m.c2, out=h[:, :-1])
        h[:, -1] = 1
        dh = self._contrast(1, h, m.head[w], n)
        if len(m.t) and len(at := np.flatnonzero(w >= m.first)):
            dh[at] += self._contrast(2, h[at], w[at] - m.first, n)
        dc = np.concatenate([r1.T @ dh, r2.T @ dh])
        at, rows = np.concatenate([w1, w2]), np.concatenate([dh @ m.c1.T, dh @ m.c2.T])
        up = m.named(at)
        self._step(0, np.concatenate([at, m.head[at[up]]]), np.concatenate([rows, rows[up]]))
        self.sq[3] += dc * dc
        m.c += self.rate * dc / np.sqrt(self.sq[3])
        self.times[3] += len(w)

    def _contrast(self, which: int, h: np.ndarray, w: np.ndarray, n) -> np.ndarray:
        """Takes a step of the rows ``w`` of q or t against noise; the gradient of ``h`` without its one."""
        q, (cut, lognoise) = self.m.tables[which], self.noise[which - 1]
        noise = np.searchsorted(cut, self.rng.random(self.k)).astype(np.int32)
        qw, qn = q.take(w, axis=0), q.take(noise, axis=0)
        gd = (1 / ((1 + np.exp(np.vecdot(h, qw) - lognoise.take(w))) * n))[:, None]
        apart = -qn
        apart[:, -1] += lognoise.take(noise)
        gn = h @ apart.T
        np.exp(gn, out=gn)
        gn += 1
        np.reciprocal(gn, out=gn)  # times -1 / n, which the products take up
        self._step(which, np.concatenate([w, noise]), np.concatenate([gd * h, gn.T @ (h * (-1 / n))]))
        qw *= gd
        qw += gn @ (qn * (-1 / n))
        return qw[:, :-1]

    def _step(self, which: int, at: np.ndarray, rows: np.ndarray) -> None:
        """Adagrad on the rows ``at``, equal ones together; the others' gradient is zero, so they stay as they are."""
        bits = len(at).bit_length()
        order = np.sort(at.astype(np.int64) << bits | np.arange(len(at)))  # places beside numbers: faster than sorting places by them
        at, order = order >> bits, order & (1 << bits) - 1
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        g, at = np.add.reduceat(rows.take(order, axis=0), begin, axis=0), at[begin]
        sq = self.sq[which].take(at, axis=0)
        sq += g * g
        self.sq[which][at] = sq
        g *= self.rate
        g /= np.sqrt(sq, out=sq)
        g += self.m.tables[which].take(at, axis=0)
        self.m.tables[which][at] = g
        self.times[which][at] += np.diff(np.r_[begin, len(order)])


def _contexts(w: np.ndarray, sizes: list[int], start: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two before each of ``w``, which holds texts of these sizes in a row, none of them empty."""
    begin = np.cumsum([0, *sizes[:-1]])
    w1, w2 = np.roll(w, 1), np.roll(w, 2)
    w1[begin] = w2[begin] = start
    w2[begin[np.asarray(sizes) > 1] + 1] = start
    return w1, w2


def _over_arrow(df: DataFrame, schema: T.StructType, make) -> DataFrame:
    """``mapInArrow`` for functions from a record batch to record batches; ``make()`` runs once a task, and its function's ``last`` closes it."""

    def run(batches):
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)
        if last := getattr(each, "last", None):
            yield from last()

    return df.mapInArrow(run, schema)


def count_tokens(texts: DataFrame, text: str = "_text") -> DataFrame:
    """(token, c) over all texts, with an end each; stretches are added up before Spark does, in bounded memory."""

    def make():
        def each(batch):
            for a, b in stretches(batch.column(0)):
                values, _ = cut(batch.column(0)[a:b])
                counts = pc.value_counts(values)
                token = pa.concat_arrays([keys(counts.field(0)), pa.array([END], pa.binary())])
                yield pa.RecordBatch.from_arrays([token, pa.concat_arrays([counts.field(1), pa.array([b - a], pa.int64())])], names=["token", "n"])

        return each

    counted = _over_arrow(texts.select(text), T.StructType.fromDDL("token binary, n long"), make)
    return counted.groupBy("token").agg(F.sum("n").alias("c"))


def score(train: DataFrame | Column, docs: DataFrame, own: int = 64, shared: int = 256, d: int = 16, most: int = 120_000, least: int = 100, rounds: int = 3) -> DataFrame:
    """Adds to ``docs`` (with ``_text``): n_tokens, n_known, train_tokens, base_score and score, both log10.

    Learns from ``train``: a table with ``_text``, or the condition for rows of
    ``docs`` that are to be learned from. Null and empty texts are one end.
    Without training texts every class is as likely as any other.
    ``most``: frequent tokens that are broadcast; those that occur ``least``
    times have vectors of their own. ``rounds``: how often the copies are averaged.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    inside = isinstance(train, Column)
    counts = scratch.table(count_tokens(docs.where(train) if inside else train), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = heaviest(counts, "c", most).toArrow()
    frequent = sorted(zip(top["token"].to_pylist(), top["c"].to_pylist()), key=lambda x: (-x[1], x[0]))
    frequent = pa.array([w for w, _ in frequent], pa.binary()), np.array([c for _, c in frequent], np.int64)  # a worker holds no object a token
    del top
    classes = Classes(frequent, own, shared, least)
    # counts and sizes of the groups of rare tokens: at most ``shared`` rows
    tail = F.when(F.octet_length("token") <= 2, F.col("token")).otherwise(F.expr("substring(token, octet_length(token) - 1, 2)"))
    sums = counts.groupBy((F.crc32(tail) % shared).alias("g")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    mass, types = np.zeros(shared), np.zeros(shared)
    for r in sums:
        mass[r.g], types[r.g] = r.c, r.v
    known, groups = classes.counts[: classes.known], classes.hashes[: classes.known]
    mass -= np.bincount(groups, known, shared)
    types -= np.bincount(groups, minlength=shared)
    within = np.r_[mass, known[classes.own :]] + 1.0
    total = np.r_[known[: classes.own], np.bincount(classes.head[classes.own :] - classes.own, within, shared)] + 1.0
    noise, within = total / total.sum(), within / within.sum()
    shared_log = np.r_[np.zeros(classes.own), np.log10(mass + types + 1), np.zeros(classes.known - classes.own)]
    sent = spark.sparkContext.broadcast((frequent, own, shared, least, d, noise, within, shared_log))
    rows = docs.withColumn("_learn", train) if inside else docs.withColumn("_learn", F.lit(True))
    encoded = scratch.table(_encode(rows, sent).withColumn("_row", F.monotonically_increasing_id()), "encoded")
    learn = encoded if inside else scratch.table(_encode(train.select("_text", F.lit(True).alias("_learn")), sent).withColumn("_row", F.monotonically_increasing_id()), "learn")
    params = spark.sparkContext.broadcast(_train(learn.where("_learn").select("_ids", "_row"), sent, rounds, n).tables)
    scored = scratch.table(_score(encoded.drop("_rare", "_learn"), sent, params), "scored")
    rare = encoded.select("_row", F.explode("_rare").alias("t")).select("_row", "t.token", "t.n")
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(counts, "token", "left").groupBy("_row").agg(
        F.sum(F.col("n") * F.log10(c + 1.0)).alias("_log"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("_known")
    )
    out = scored.join(rare.withColumnRenamed("_row", "_of"), F.col("_row") == F.col("_of"), "left")
    log = F.col("_log_c") + F.coalesce("_log", F.lit(0.0))
    return out.withColumns({
        "n_known": F.col("n_known") + F.coalesce("_known", F.lit(0)),
        "train_tokens": F.lit(int(n)).cast("long"),
        "base_score": log - F.col("n_tokens") * float(np.log10(n + v + 1)),
        # tokens with a vector of their own have no share in it to pay for
        "score": F.col("_class_log") + log - F.col("_own_log_c"),
    }).drop("_row", "_of", "_log", "_known", "_log_c", "_own_log_c", "_class_log")


def _worker() -> dict:
    """The worker's own state; closures travel with copies of globals, so they ask for it."""
    return _WORKER


def _vocabulary(sent) -> Classes:
    if _WORKER.get("of") is not sent.value:
        frequent, own, shared, least, d, noise, within, shared_log = sent.value
        classes = Classes(frequent, own, shared, least)
        _WORKER.clear()
        _WORKER.update(of=sent.value, classes=classes, noise=noise, within=within, shared_log=shared_log, d=d)
    return _WORKER["classes"]


def _lean() -> None:
    """Gives back what earlier tasks of this worker have freed, before more is taken."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _setup(sent) -> tuple[Classes, Model]:
    classes = _vocabulary(sent)
    return classes, Model(classes.size, _WORKER["d"], _WORKER["noise"], _WORKER["within"], classes.head)


def _encode(docs: DataFrame, sent) -> DataFrame:
    """``docs`` without ``_text``: entries' numbers with the ends, as bytes, figures of the frequent tokens, and the others."""
    passed = [f for f in docs.schema.fields if f.name != "_text"]
    made = T.StructType.fromDDL("_ids binary, n_tokens long, n_known long, _log_c double, _own_log_c double, _rare array<struct<token:binary,n:long>>")
    schema = T.StructType([*passed, *made.fields])

    def make():
        from pyspark.sql.pandas.types import to_arrow_schema

        _lean()
        classes = _vocabulary(sent)
        logs, out = np.log10(classes.counts + 1), to_arrow_schema(schema)

        def some(texts):
            values, sizes = cut(texts)
            values = values.dictionary_encode()
            tokens = pa.concat_arrays([keys(values.dictionary), pa.array([END], pa.binary())])
            place, entry = classes.encode(tokens)
            ends = np.cumsum(sizes + 1) - 1
            code = np.full(ends[-1] + 1, len(tokens) - 1, np.int32)
            rest = np.ones(len(code), bool)
            rest[ends] = False
            code[rest] = values.indices.to_numpy()
            begin, sizes = ends - sizes, sizes + 1
            known = np.add.reduceat((classes.counts[place] > 0).astype(np.int64)[code], begin)
            own = (place >= 0) & ((entry < classes.own) | (entry >= classes.size))
            log = logs[place]
            rare = np.flatnonzero((place < 0)[code])
            pair, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[rare] * len(tokens) + code[rare], return_counts=True)
            lists = np.searchsorted(pair, np.arange(len(sizes) + 1) * len(tokens))
            items = pa.StructArray.from_arrays([tokens.take(pa.array(pair % len(tokens))), pa.array(times, pa.int64())], names=["token", "n"])
            blobs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes * 4)].astype(np.int32)), pa.py_buffer(entry[code].astype(np.int32))])
            sums = [np.add.reduceat(x[code], begin) for x in (log, np.where(own, log, 0.0))]
            return [blobs, *map(pa.array, (sizes, known, *sums)), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), items)]

        def each(batch):
            texts, before = batch.column(batch.schema.get_field_index("_text")), [batch.column(f.name) for f in passed]
            for a, b in stretches(texts):
                cols = [*(c[a:b] for c in before), *some(texts[a:b])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out)], schema=out)

        return each

    return _over_arrow(docs, schema, make)


def _flat(blobs: pa.Array, most: int = 500_000) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Entries of texts in a row, and how many each has, in parts of about ``most`` entries; a longer text is a part of its own. Nothing is copied."""
    _, offsets, data = blobs.buffers()
    ends = np.frombuffer(offsets, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1] // 4
    entries = np.frombuffer(data, np.int32, int(ends[-1]))
    at = 0
    while at < len(blobs):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield entries[ends[at] : ends[end]], np.diff(ends[at : end + 1]).tolist()
        at = end


def _train(ids: DataFrame, sent, rounds: int, tokens: int, per_copy: int = 6_000_000, chunk: int = 1_000_000, block: int = 512) -> Model:
    """The model after ``rounds`` over parts of the texts (``_ids``, ``_row``), which together are all of them.

    A round's result is the mean of its tasks' copies, each row weighted by how
    often they trained it; it's taken by blocks of rows, so the driver gets one
    model. A copy trains on about ``per_copy`` tokens a round, so what copies
    send (in half precision) stays a part of what they read.
    """
    spark = ids.sparkSession
    _, model = _setup(sent)
    copies = 1 + tokens // (rounds * per_copy)

    def one(texts: DataFrame, start) -> pa.Table:
        def make():
            _lean()
            sent_rows = pa.schema([("which", pa.int32()), ("block", pa.int32()), ("at", pa.binary()), ("n", pa.binary()), ("rows", pa.binary())])
            classes, model = _setup(sent)
            if start is not None:
                model.load(start.value)
            trainer = Trainer(model, _worker()["noise"], tail=_worker()["within"])

            def each(batch):
                for w, sizes in _flat(batch.column(0)):
                    w1, w2 = _contexts(w, sizes, classes.start)
                    for a in range(0, len(w), chunk):
                        trainer.train(w1[a : a + chunk], w2[a : a + chunk], w[a : a + chunk])
                return []

            def last():
                out: dict = {"which": [], "block": [], "at": [], "n": [], "rows": []}
                for which, (x, times) in enumerate(zip(model.tables, trainer.times)):
                    for a in range(0, len(x), block):
                        at = a + np.flatnonzero(times[a : a + block])
                        if len(at):
                            out["which"].append(which)
                            out["block"].append(a // block)
                            out["at"].append((at - a).astype(np.int16).tobytes())
                            out["n"].append(times[at].astype(np.float32).tobytes())
                            out["rows"].append(x[at].astype(np.float16).tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=sent_rows)

            each.last = last
            return each

        def mean(g: pd.DataFrame) -> pd.DataFrame:
            first = int(g["block"].iloc[0]) * block
            width = len(g["rows"].iloc[0]) // len(g["at"].iloc[0])  # two bytes each
            total, weight = np.zeros((block, width)), np.zeros(block)
            for at, n, rows in zip(g["at"], g["n"], g["rows"]):
                at, n = np.frombuffer(at, np.int16), np.frombuffer(n, np.float32).astype(np.float64)
                total[at] += n[:, None] * np.frombuffer(rows, np.float16).reshape(-1, width)
                weight[at] += n
            at = np.flatnonzero(weight)
            return pd.DataFrame({"which": [g["which"].iloc[0]], "at": [(at + first).astype(np.int32).tobytes()], "rows": [(total[at] / weight[at, None]).astype(np.float32).tobytes()]})

        parts = _over_arrow(texts, T.StructType.fromDDL("which int, block int, at binary, n binary, rows binary"), make)
        return parts.groupBy("which", "block").applyInPandas(mean, "which int, at binary, rows binary").toArrow()

    for k in range(rounds):
        got = one(ids.where(F.pmod("_row", F.lit(rounds)) == k).select("_ids").coalesce(copies), spark.sparkContext.broadcast(model.tables) if k else None)
        for which, at, rows in zip(*(got[c].to_pylist() for c in ("which", "at", "rows"))):
            at = np.frombuffer(at, np.int32)
            model.tables[which][at] = np.frombuffer(rows, np.float32).reshape(len(at), -1)
    return model


def _score(docs: DataFrame, sent, params) -> DataFrame:
    """``docs`` with ``_class_log`` in place of ``_ids``: log10 of the model's probability of the entries and of the rare tokens' shares but for their counts."""
    passed = [f for f in docs.schema.fields if f.name != "_ids"]
    schema = T.StructType([*passed, T.StructField("_class_log", T.DoubleType())])

    def make():
        from pyspark.sql.pandas.types import to_arrow_schema

        _lean()
        classes, out = _vocabulary(sent), to_arrow_schema(schema)
        shared_log, scores = _worker()["shared_log"], Scores(Model.of(params.value, classes), classes)

        def each(batch):
            got = []
            for w, sizes in _flat(batch.column(batch.schema.get_field_index("_ids"))):
                w1, w2 = _contexts(w, sizes, classes.start)
                logs = scores.of(w1, w2, w).astype(np.float64) / np.log(10) - shared_log[w]
                got.append(np.add.reduceat(logs, np.cumsum([0, *sizes[:-1]])))
            cols = [*(batch.column(batch.schema.get_field_index(f.name)) for f in passed), pa.array(np.concatenate(got))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out)], schema=out)

        return each

    return _over_arrow(docs, schema, make)


class Scores:
    """Normalised natural log-probabilities of entries after contexts."""

    def __init__(self, model: Model, classes: Classes):
        self.m, self.classes = model, classes
        r = model.context(np.arange(classes.entries + 1))
        self.rc = r @ model.c1, r @ model.c2
        self.of_class = [model.t[m] for m in classes.members()]

    def log_sums(self, w1: np.ndarray, w2: np.ndarray, block: int = 32) -> np.ndarray:
        """Logs of the classes' partition functions, by blocks of classes: a row of exponentials for each different token before and each two before."""
        q = self.m.q
        sides = []
        for rows, w in zip(self.rc, (w1, w2)):
            seen = np.zeros(self.classes.entries + 1, bool)
            seen[w] = True
            at = np.flatnonzero(seen)
            row = np.empty(len(seen), np.int32)
            row[at] = np.arange(len(at))
            sides.append((rows.take(at, axis=0), row.take(w)))
        z = np.zeros(len(w1), np.float32)
        with np.errstate(over="ignore", invalid="ignore"):
            for c in range(0, len(q), block):
                part = q[c : c + block]
                first, second = sides[0][0] @ part[:, :-1].T, sides[1][0] @ part[:, :-1].T
                first += part[:, -1]
                np.exp(first, out=first)
                np.exp(second, out=second)
                for k in range(0, len(z), 4096):
                    z[k : k + 4096] += np.vecdot(first.take(sides[0][1][k : k + 4096], axis=0), second.take(sides[1][1][k : k + 4096], axis=0))
            apart = np.flatnonzero(~((z > 1e-30) & (z < 1e30)))  # the products are out of their type's range
            z = np.log(z, where=z > 0, out=z)
        for k in range(0, len(apart), 4096):
            at = apart[k : k + 4096]
            z[at] = _log_sum((self.rc[0][w1[at]] + self.rc[1][w2[at]]) @ q[:, :-1].T + q[:, -1])
        return z

    def of(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, chunk: int = 2_000_000, part: int = 100_000) -> np.ndarray:
        """A stretch's memory is bounded by ``chunk`` and ``part``, not by its length."""
        out = np.empty(len(w), np.float32)
        for a in range(0, len(w), chunk):
            end = min(a + chunk, len(w))
            z = self.log_sums(w1[a:end], w2[a:end])
            for k in range(a, end, part):
                at = slice(k, min(k + part, end))
                out[at] = self._joint(w1[at], w2[at], w[at]) - z[k - a : at.stop - a]
        return out

    def _joint(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Scores of the classes plus log-probabilities within them."""
        q, t, classes = self.m.q, self.m.t, self.classes
        h = self.rc[0].take(w1, axis=0)
        h += self.rc[1].take(w2, axis=0)
        head = classes.head[w]
        qw = q.take(head, axis=0)
        raw = np.vecdot(h, qw[:, :-1]) + qw[:, -1]
        inner = np.flatnonzero(w >= classes.own)
        inner = inner[np.argsort(head[inner].astype(np.int16), kind="stable")]
        h, tw = h.take(inner, axis=0), t.take(w[inner] - classes.own, axis=0)
        own = np.vecdot(h, tw[:, :-1]) + tw[:, -1]
        edges = np.searchsorted(head[inner], np.arange(classes.own, classes.size + 1))
        for g in np.flatnonzero(np.diff(edges)).tolist():
            for k in range(edges[g], edges[g + 1], 1024):
                end = min(k + 1024, edges[g + 1])
                own[k:end] -= _log_sum(h[k:end] @ self.of_class[g][:, :-1].T + self.of_class[g][:, -1])
        raw[inner] += own
        return raw


def score_held_out(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, **params) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Held out are documents whose crc32(id as text) leaves ``fold``; a null id
    counts as an empty text. Other columns are left out. Repeated rows are
    documents of their own; an empty table gives no rows.
    """
    out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), out.alias("held_out"))
    got = score(~F.col("held_out"), rows, **params)
    return got.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
