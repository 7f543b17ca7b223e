import hashlib
import random

import pytest

from burstlake.llm import decontamination, mixing, queries, warc
from burstlake.llm.shared import Scratch


def archive(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, value string, split int")
    s = Scratch(spark, "test")
    warc.write_warc(pages.repartition(2), s.path("archive"), s)
    return s, {r.page_id: r for r in warc.read_warc(spark, s.path("archive"), s).collect()}


def test_round_trip(spark):
    forged = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Type: application/http\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"
    big, r = "é" * 700, random.Random(4)
    htmls = {1: big, 2: big, 3: big, 4: None, 5: "", 6: forged, 7: forged * 30, 8: forged * 30, 9: "WARC/1.0\r\n", 10: "\r\n\r\n", 11: "s" * 999, 12: "s" * 999}
    htmls |= {k: "".join(r.choices("ab\r\n", k=r.randrange(3000))) for k in range(20, 60)}
    _, got = archive(spark, [(k, "http://x/\r\n" if k % 2 else None, h, "v", 1) for k, h in htmls.items()])
    assert set(got) == set(htmls)
    largest = {}
    for k, h in htmls.items():
        if len((h or "").encode()) >= 1000:
            largest[h] = max(k, largest.get(h, k))
    for k, h in htmls.items():
        body = (h or "").encode()
        first = largest.get(h, k)
        g = got[k]
        assert (g.payload_bytes, g.payload_digest) == (len(body), hashlib.sha1(body).hexdigest()), k
        assert (g.record_type, g.refers_to) == (("response", None) if first == k else ("revisit", first)), k
        assert g.digest_ok


def test_small_splits(spark):
    """Chains that cross many splits, and records longer than one."""
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        r = random.Random(1)
        htmls = {k: "".join(r.choices(["WARC/1.0\r\n", "text ", "\r\n\r\n"], k=r.choice([3, 40, 2500]))) for k in range(60)}
        _, got = archive(spark, [(k, None, h, "v", 1) for k, h in htmls.items()])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    assert {k: g.payload_digest for k, g in got.items()} == {k: hashlib.sha1(h.encode()).hexdigest() for k, h in htmls.items()}


def test_broken_chain(spark):
    """What lies behind a wrong length is not reached."""
    s, _ = archive(spark, [(1, None, "abc", "v", 1)])
    lines = spark.sparkContext.parallelize([warc.MAGIC + "WARC-Type: resource\r\nContent-Length: 5\r\n\r\nabc" + warc.GAP + warc.MAGIC + "WARC-Type: resource\r\nContent-Length: 0\r\n\r\n"], 1)
    lines.toDF("string").write.option("lineSep", warc.GAP).text(s.path("broken"))
    t = Scratch(spark, "test")
    assert warc.records(spark, s.path("broken"), t).count() == 1


def test_no_pages_null_ids_and_repeated_rows(spark):
    s, got = archive(spark, [(1, None, "abc", "v", 1)])
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(none, s.path("none"), s)
    assert warc.read_warc(spark, s.path("none"), s).count() == 0
    big = "b" * 1500
    pages = spark.createDataFrame([(5, "u", big), (5, "u", big), (None, "u", big), (2, "u", big), (None, None, "small"), (None, None, None)], "page_id long, url string, html string")
    warc.write_warc(pages, s.path("odd"), s)
    rows = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, s.path("odd"), s).collect())
    assert rows == [("2", 1500, "revisit", 5), ("5", 1500, "response", None), ("5", 1500, "response", None), ("None", 0, "response", None), ("None", 5, "response", None), ("None", 1500, "revisit", 5)]


def test_empty_pages(spark):
    assert archive(spark, [(1, None, None, None, None)])[1][1].payload_bytes == 0


def test_warc_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op1_warc(spark, sf).collect()}
    largest: dict = {}
    for p in pages:
        if len(p.html.encode()) >= 1000:
            largest[p.html] = max(p.page_id, largest.get(p.html, p.page_id))
    assert len(got) == len(pages)
    for p in pages:
        r, first = got[p.page_id], largest.get(p.html, p.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(p.html.encode()), hashlib.sha1(p.html.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if first == p.page_id else ("revisit", first))


def water(sizes, weights, most):
    """Targets by resharing until none is above its limit."""
    left, share, done = float(sum(sizes)), {}, set()
    while True:
        free = [i for i in range(len(sizes)) if i not in done]
        w = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / w > most * sizes[i] + 1e-9]
        if not above:
            return [share.get(i, left * weights[i] / w) for i in range(len(sizes))]
        for i in above:
            share[i] = most * sizes[i]
            done.add(i)
        left = sum(sizes) - sum(share.values())


def test_mix(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 7, 40, 900])), s) for i, s in enumerate(r.choices(["a", "b", "c", "d", "e", None], [1, 2, 30, 3, 9, 5], k=600))]
    rows += [(9999, None, "zero"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    names = [*sorted({s for *_, s in rows if s}), None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    want = dict(zip(names, water(sizes, [1 + k % 3 for k in range(len(names))], 3)))
    source = {i: s for i, _, s in rows}
    taken = dict.fromkeys(names, 0)
    for g in got:
        s = source[g.doc_id]
        assert abs(g.target - want[s]) < 1e-6 and g.taken <= 3 * g.size and g.source_size == sizes[names.index(s)]
        taken[s] += g.taken
    assert all(int(want[s] + 1e-9) - taken[s] in (0, 1) for s in names)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_query_and_odd_rows(spark, sf):
    got = queries.op6_mixing(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    names = sorted({d.source for d in docs.values()})
    sizes = [sum(len((d.text or "").encode().split()) for d in docs.values() if d.source == n) for n in names]
    want = dict(zip(names, water(sizes, [1 + k % 3 for k in range(len(names))], 3)))
    taken = dict.fromkeys(names, 0)
    for g in got:
        d = docs[g.doc_id]
        assert g.size == len((d.text or "").encode().split()) and abs(g.target - want[d.source]) < 1e-6 and g.taken <= 3 * g.size
        taken[d.source] += g.taken
    assert len(got) == len(docs) and all(abs(int(want[s] + 1e-9) - taken[s]) <= 1 for s in names)
    df = spark.createDataFrame([(None, "a b", None, 1, "k"), (None, "a b", None, 1, "k"), (3, None, "s", 2, "l")], "doc_id long, text string, source string, size int, key string")
    rows = mixing.mix(df, keep=["text", "size", "key"]).collect()
    assert sorted((str(r.doc_id), r.size, str(r.text), r.key) for r in rows) == [("3", 0, "None", "l"), ("None", 2, "a b", "k"), ("None", 2, "a b", "k")]


def shuffled(spark, df) -> int:
    """Bytes that ``df()`` and what it runs before it's returned write to shuffles."""
    sc, written = spark.sparkContext._jsc.sc(), 0
    jvm = spark.sparkContext._jvm

    def total():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before = total()
    df().write.format("noop").mode("overwrite").save()
    return sum(v for k, v in total().items() if k not in before)


def test_mix_does_not_shuffle_what_it_passes_on(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(k, r.randbytes(10_000).hex(), f"s{k % 3}") for k in range(200)], "doc_id long, text string, source string")
    assert mixing.mix(df, keep=["text"]).where("text is not null").count() == 200
    assert 0 < shuffled(spark, lambda: mixing.mix(df, keep=["text"])) < 200_000 < 200 * 10_000


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_mix_of_equal_rows(spark, broadcast):
    """Against all rows in one order: ids that many rows share, rows equal in all, sources without words, and no broadcast."""
    r = random.Random(13)
    rows = [(r.choice([None, 1, 2, k]), " ".join(r.choices("ab", k=r.choice([0, 1, 3, 3, 8]))), r.choice(["a", "b", "c", None])) for k in range(400)]
    rows += [(None, "x y z", s) for s in "abcd" for _ in range(90)] + [(None, "", "none"), (7, None, "none")]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        runs = [mixing.mix(df.repartition(n), keep=["text", "source"]).collect() for n in (1, 5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    key = lambda g: (str(g.source), str(g.doc_id), g.size, str(g.text), g.taken)
    assert sorted(map(key, runs[0])) == sorted(map(key, runs[1]))
    md5 = lambda i: hashlib.md5(f"mix-0:{'' if i is None else i}".encode()).hexdigest()
    for s in {s for *_, s in rows}:
        got = [g for g in runs[1] if g.source == s]
        assert sorted((str(g.doc_id), str(g.text)) for g in got) == sorted((str(i), str(t)) for i, t, x in rows if x == s)
        size, left = sum(g.size for g in got), int(got[0].target)
        assert {(g.source_size, g.target) for g in got} == {(size, got[0].target)} and sum(g.taken for g in got) == left
        epochs, left = divmod(left, size) if size else (0, 0)
        want = []
        for i, n in sorted(((i, len((t or "").split())) for i, t, x in rows if x == s), key=lambda x: (md5(x[0]), x[1])):
            want.append((str(i), n, epochs * n + min(left, n)))
            left -= min(left, n)
        assert sorted((str(g.doc_id), g.size, g.taken) for g in got) == sorted(want)


def test_tiling(spark):
    item = "The quick brown fox jumps over the lazy dog while eleven owls watch quietly from a tall old tree"
    w = item.split()
    texts = [f"x y {item} z", " ".join(w[10:] + ["and"] + w[:10]), " ".join(w[:6]), "nothing of it", None, "", item.upper().replace(" ", " - "), "tiny item here", " ".join(w[:5] * 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "tiny item"), (9, None), (10, ""), (None, item), (11, item)], "item_id long, text string")
    for bits in (1 << 27, 64):  # a bitmap that tells seeds apart, and one that's full
        got = {r.doc_id: r for r in decontamination.decontaminate(docs, bench, most_bits=bits).collect()}
        assert [got[i].contaminated for i in range(len(texts))] == [True, True, False, False, False, False, True, True, False]
        assert got[0].items == [7, 11] and got[0].item_id == 7 and got[0].coverage == got[1].coverage == 1.0
        assert abs(got[2].coverage - 6 / len(w)) < 1e-9 and got[7].items == [8] and got[4].coverage == 0
        assert abs(got[8].coverage - 5 / len(w)) < 1e-9  # a tile is used once
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.decontaminate(docs.limit(0), bench).count() == 0


def test_tiling_items_without_id(spark):
    a, b = "one two three four five six seven", "red green blue black white grey brown"
    docs = spark.createDataFrame([(0, f"x {a} y"), (1, f"{a} {b}"), (2, f"{b} {a} {a}"), (3, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, a), (5, b), (None, "one two three four five six seven eight")], "item_id long, text string")
    for bits in (1 << 27, 64):
        got = {r.doc_id: r for r in decontamination.decontaminate(docs, bench, most_bits=bits).collect()}
        assert [(got[i].contaminated, got[i].n_items, got[i].item_id, got[i].items) for i in range(4)] == [(True, 2, None, []), (True, 3, 5, [5]), (True, 3, 5, [5]), (False, 0, None, [])]
        assert got[0].coverage == 1.0


def slow_tiling(item, doc, least):
    """Greedy string tiling as published: the longest unmarked match, again and again."""
    a, b = [False] * len(item), [False] * len(doc)
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return sum(a) / len(a)
        for k in range(best[0]):
            a[best[1] + k] = b[best[2] + k] = True


@pytest.mark.parametrize("seed", range(4))
def test_tiling_against_the_plain_one(seed):
    r = random.Random(seed)
    for _ in range(20):
        item = [f"t{k}" for k in range(20)]
        parts = [item[a : a + r.randrange(4, 12)] for a in (r.randrange(18) for _ in range(4))]
        doc = [w for p in parts for w in [*p, "gap"]]
        assert abs(decontamination.coverage(" ".join(item), " ".join(doc)) - slow_tiling(item, doc, 5)) < 1e-9


def test_tiling_of_repeated_seeds():
    """Runs that cross chunks of pairs, and many places of a seed, in bounded time."""
    import time

    r = random.Random(6)
    for _ in range(60):
        item, doc = r.choices("ab", k=r.randrange(5, 16)), r.choices("abc", k=r.randrange(5, 40))
        want = slow_tiling(item, doc, 5)
        assert abs(decontamination.coverage(" ".join(item), " ".join(doc)) - want) < 1e-9
    places = [([0, 1, 2, 3, 9], [0, 4]), ([4, 5], [1, 2])]
    whole = sorted(decontamination.matches(places, 5))
    assert all(sorted(decontamination.matches(places, 5, most)) == whole for most in (1, 2, 3, 5, 7))
    began = time.monotonic()
    assert decontamination.coverage("a " * 60, "a " * 100_000) == 1.0
    assert time.monotonic() - began < 10


def test_tiling_of_many_items(spark):
    """Every document against every item, as the plain version has it."""
    r = random.Random(11)
    words = [f"w{k}" for k in range(30)]
    items = [(k if k % 9 else None, " ".join(r.choices(words, k=r.choice([2, 6, 15, 25])))) for k in range(40)] + [(3, "w1 w2 w3 w4 w5 w6")] * 2
    texts = [" ".join(" ".join(r.choice(items)[1].split()[r.randrange(3) :]) for _ in range(r.randrange(5))) for _ in range(50)] + [None, ""]
    docs = spark.createDataFrame([(i if i % 7 else None, t, 0.5, "x") for i, t in enumerate(texts)], "doc_id long, text string, coverage double, items string")
    got = {r.text: r for r in decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), keep=["text", "coverage"]).collect()}
    for t in texts:
        want = [(slow_tiling(x.split(), (t or "").split(), min(5, len(x.split()))), i) for i, x in items]
        over = [i for c, i in want if c >= 0.5]
        best = min(((-c, i is None, i) for c, i in want if c > 0), default=(0, True, None))
        assert (got[t].contaminated, got[t].n_items, got[t].items) == (bool(over), len(over), sorted(i for i in over if i is not None))
        assert abs(got[t].coverage + best[0]) < 1e-9 and got[t].item_id == best[2]


def test_tiling_query(spark, sf):
    got = {r.doc_id: r for r in queries.op10_decontaminate(spark, sf).collect()}
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert len(got) == len(docs)
    for d in docs:
        covered = {b.item_id: decontamination.coverage(b.text, d.text or "") for b in bench}
        assert got[d.doc_id].items == sorted(i for i, c in covered.items() if c >= 0.5) and abs(got[d.doc_id].coverage - max(covered.values())) < 1e-9


def test_pipeline_stages(spark, sf):
    import corpus_pipeline
    from brute import near, quality, secrets

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "mixed":
            assert out.columns == docs.columns
        at[name] = docs.collect(), out.collect()
        docs = spark.createDataFrame(at[name][1], out.schema)
    was, now = at["quality"]
    assert {r.doc_id for r in now} <= {r.doc_id for r in was if not quality(r.text)[5]}
    was, now = at["near_duplicates"]
    was = sorted(was, key=lambda r: r.doc_id)
    roots = near([r.text for r in was])[0]
    assert {r.doc_id for r in now} == {was[k].doc_id for k in roots}
    was, now = at["benchmark_free"]
    texts = [b.text for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert all(t not in (r.text or "") for t in texts for r in now) and len(now) > 0.8 * len(was)
    was, now = at["without_secrets"]
    assert len(was) == len(now) and not any(secrets(r.text) for r in now)
    assert {r.doc_id for r in at["mixed"][1]} <= {r.doc_id for r in at["mixed"][0]}
    assert corpus_pipeline.run(spark, sf).count() == len(at["mixed"][1])


def test_pipeline_carries_any_column(spark, sf, tmp_path):
    """Columns named like the operators' own, null and shared ids, copies and an empty table."""
    import corpus_pipeline

    r = random.Random(3)
    prose = lambda: " ".join(r.choices([f"word{k}" for k in range(500)], k=80))
    a, b = prose(), prose()
    names = "kept n_words rule spans redacted coverage contaminated n_items items item_id class_id n_links _row key part rest id"
    extra = {n: f"x-{n}" for n in names.split()}
    texts = [(1, a), (1, a), (1, b), (None, b), (None, a + " more"), (2, prose()), (3, None), (None, ""), (4, "h1" + "=" * 40 + " " + prose()), (5, "iVBOR1" + "A" * 24 + "Q== " + prose())]
    docs = spark.createDataFrame([{"doc_id": i, "text": t, "source": "s", "n_chars": len(t or ""), **extra} for i, t in texts], "doc_id long, text string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in extra))
    want = {"quality": 8, "near_duplicates": 5, "benchmark_free": 5, "without_secrets": 5}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name == "mixed":
            assert all(r[n] == f"x-{n}" for r in rows for n in extra if n in out.columns) and {r.text for r in rows} <= {r.text for r in docs.collect()}
            break
        assert out.columns == docs.columns and len(rows) == want[name], (name, rows)
        assert all(r[n] == f"x-{n}" for r in rows for n in extra)
        docs = spark.createDataFrame(rows, docs.schema)


def test_scoped_tables_go(spark):
    import os

    from burstlake.llm import shared

    df = spark.createDataFrame([(k, "a b c") for k in range(5)], "doc_id long, text string").selectExpr("*", "'s' as source")
    root = shared.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    with shared.scoped():
        assert mixing.mix(df).count() == 5 and len(set(os.listdir(root)) - before) == 1
    assert not {d for d in set(os.listdir(root)) - before if os.listdir(f"{root}/{d}")}
