import random

import numpy as np
from pyspark.sql import Row

from burstlake.functions import scalars as S
from burstlake.operators import bursts as B
from burstlake.operators import relate as R
from burstlake.operators import segments as G
from burstlake.operators.sinkplan import plan_names


def far(k):
    return random.Random(k).getrandbits(63)


def one_hot(k, n):
    return [1.0 if i == k % n else 0.0 for i in range(n)]


def shoot(spark, rows):
    """(t, sharpness, hash, look) rows of one shoot."""
    data = [Row(shoot_id=1, path=f"/s/IMG_{i:04d}.jpg", name=f"IMG_{i:04d}.jpg", file_number=i, t=t, sharpness=s, ahash=h, hist=one_hot(look, 96), error=None) for i, (t, s, h, look) in enumerate(rows)]
    return spark.createDataFrame(data, "shoot_id long, path string, name string, file_number long, t double, sharpness double, ahash long, hist array<double>, error string")


def flip(h, n):
    return h ^ ((1 << n) - 1)


def test_a_reframe_by_hand_stays_in_its_burst(spark):
    base = far(1)
    rows = [(0.0, 1.0, base, 1), (0.8, 1.0, flip(base, 18), 2), (1.9, 1.0, flip(base, 15), 3), (4.9, 1.0, base, 4), (5.9, 1.0, far(9), 5)]
    got = B.bursts(B.capture_order(shoot(spark, rows))).groupBy("burst_id").count().orderBy("burst_id").collect()
    assert [r["count"] for r in got] == [3, 1, 1]


def test_unreadable_frames_break_bursts(spark):
    from pyspark.sql import functions as F

    df = shoot(spark, [(0.0, 1.0, 5, 1), (1.0, 1.0, 5, 1), (2.0, 1.0, 5, 1)]).withColumn("error", F.when(F.col("file_number") == 1, "broken"))
    assert B.bursts(B.capture_order(df)).select("burst_id").distinct().count() == 3


def test_without_a_clock_names_order(spark):
    rows = [(None, 1.0, far(1), 1), (5.0, 1.0, far(2), 2), (None, 1.0, far(3), 3)]
    got = B.capture_order(shoot(spark, rows)).orderBy("capture_order").collect()
    assert [r.file_number for r in got] == [0, 1, 2] and not got[0].timed


def test_frames_of_one_moment_are_picked_last(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0, 0, 1.0), (1, 1, 0, 5.0, 0, 0.5), (1, 2, 0, 120.0, 0, 0.0)], "shoot_id long, capture_order long, segment_id long, t_rel double, penalty int, pct double")
    assert {r.capture_order for r in G.suggest(df, 2).collect()} == {0, 2}
    assert G.suggest(df, None).count() == G.suggest(df, 3).count() == 3 and G.suggest(df, 0).count() == 0


def test_a_repetitive_segment_gives_its_place_away(spark):
    rows = [(1, i, 0, 3.0 * i, 0, 1 - i / 10) for i in range(4)] + [(1, 4 + k, 1, 1000 + 100.0 * k, 0, 0.5) for k in range(3)]
    df = spark.createDataFrame(rows, "shoot_id long, capture_order long, segment_id long, t_rel double, penalty int, pct double")
    got = G.suggest(df, 3).collect()
    assert sorted(r.segment_id for r in got) == [0, 1, 1]


def test_apportionment(spark):
    def quota(cap, n):
        df = spark.createDataFrame([(1, i, c, n) for i, c in enumerate(cap)], "shoot_id long, segment_id long, capacity long, n long")
        return [r.quota for r in G.apportion(df).orderBy("segment_id").collect()]

    q = quota([17, 11, 14, 2, 19, 1, 16], 14)
    assert sum(q) == 14 and min(q) >= 1 and q[5] <= 1 and max(q) <= 3
    q = quota([5] * 6, 2)
    assert sum(q) == 2 and sum(q[:3]) == 1
    assert quota([1, 2], 10) == [1, 2] and quota([0, 0], 3) == [0, 0] and quota([3], 0) == [0]
    r = random.Random(3)
    for _ in range(12):
        cap = [r.randrange(0, 12) for _ in range(r.randrange(1, 9))]
        n = r.randrange(0, 30)
        assert quota(cap, n) == G._quota(cap, n), (cap, n)


def test_quota_one_by_one():
    """The divisor method, a pick at a time."""
    r = random.Random(5)
    for _ in range(500):
        cap = [r.randrange(0, 15) for _ in range(r.randrange(1, 9))]
        live = [i for i, c in enumerate(cap) if c]
        n = r.randrange(len(live), 40)
        got = [min(c, 1) for c in cap]
        for _ in range(n - len(live)):
            free = [i for i in live if got[i] < cap[i]]
            if not free:
                break
            got[max(free, key=lambda i: (cap[i] ** 0.5 / (got[i] + 0.5), -i))] += 1
        assert G._quota(cap, n) == (got if n else [0] * len(cap))


def slow_cuts(t, legal, rules):
    out = []

    def go(a, b):
        if t[b] - t[a] <= rules.target_s:
            return out.append((a, b))
        best, gap = None, rules.min_gap_s
        for i in range(a + rules.min_frames, b - rules.min_frames + 2):
            if legal[i] and t[i] - t[i - 1] >= gap:
                best, gap = i, t[i] - t[i - 1]
        if best is None:
            return out.append((a, b))
        go(a, best - 1)
        go(best, b)

    first = 0
    for i in range(1, len(t) + 1):
        if i == len(t) or (legal[i] and t[i] - t[i - 1] >= rules.break_s):
            go(first, i - 1)
            first = i
    return [k for k, (a, b) in enumerate(sorted(out)) for _ in range(a, b + 1)]


def test_segments():
    r = random.Random(7)
    for _ in range(200):
        n = r.randrange(1, 60)
        t = np.cumsum([r.choice([1, 5, 31, 40, 60, 200]) for _ in range(n)]).astype(float)
        legal = np.array([True] + [r.random() < 0.7 for _ in range(n - 1)])
        assert G.cuts(t, legal, G.SegmentRules()).tolist() == slow_cuts(t, legal, G.SegmentRules())
    assert len(set(G.cuts(np.full(60, np.nan), np.ones(60, bool), G.SegmentRules(), timed=False))) == 3


def test_names(spark):
    stems = ["a", "A", "a_2", "b", "a", "b", "c"]
    rows = [(k, "out", s, f"/{k}") for k, s in enumerate(stems)] + [(9, "out", "a", "/0")]
    df = spark.createDataFrame(rows, "pos long, out_dir string, stem string, src string")
    taken = spark.createDataFrame([("out", "C.JPG")], "out_dir string, name string")
    got = [r.dst_name for r in plan_names(df, taken=taken).orderBy("pos").collect()]
    assert got == ["a.jpg", "A_2.jpg", "a_2_2.jpg", "b.jpg", "a_3.jpg", "b_2.jpg", "c_2.jpg", None]


def test_pairs(spark):
    rows = [(0, "a", "IMG_1", "CR2"), (1, "a", "IMG_1", "jpg"), (2, "a", "img_1", "cr2"), (3, "b", "IMG_1", "jpg")]
    df = spark.createDataFrame([(p, d, s, e, f"{d}/{s}.{e}") for p, d, s, e in rows], "pos long, dir string, stem string, ext string, path string")
    got = [(r.path, r.pair_path) for r in R.raw_jpeg_pairs(df).orderBy("pos").collect()]
    assert got == [("a/IMG_1.jpg", "a/IMG_1.CR2"), ("a/img_1.cr2", None), ("b/IMG_1.jpg", None)]
    assert [r.path for r in R.drop_raw_twins(df).orderBy("pos").collect()] == ["a/IMG_1.jpg", "b/IMG_1.jpg"]


def test_subject(spark):
    face = "array<struct<x:int,y:int,w:int,h:int>>"
    df = spark.createDataFrame([([(0, 0, 200, 200), (300, 200, 60, 60), (10, 10, 20, 20)],), ([(0, 0, 90, 90)],), ([],), ([(100, 100, 40, 40), (500, 292, 40, 40)],)], f"faces {face}")
    from pyspark.sql import functions as F

    got = [r.s.x if r.s else None for r in df.select(S.subject(F.col("faces"), F.lit(640), F.lit(432)).alias("s")).collect()]
    assert got == [300, 0, None, 100]


def test_hashes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1.0] * 64, [-1.0] * 64), ([1.0] + [-1.0] * 63, [-1.0] * 64)], "a array<double>, b array<double>")
    got = df.select(S.hamming(S.sign_hash(F.col("a")), S.sign_hash(F.col("b"))).alias("d"), S.sign_hash(F.col("a")).alias("h")).collect()
    assert [r.d for r in got] == [64, 1] and got[1].h == 1
