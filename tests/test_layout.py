import numpy as np
from pyspark.sql import functions as F

from burstlake.functions import layout as L
from burstlake.operators import segments as G


def test_rectangles_meet(spark):
    df = spark.range(1).select(L.pixels_of([F.lit(0.0), F.lit(0.0), F.lit(1 / 3), F.lit(0.0)], F.lit(100), F.lit(50)).alias("a"), L.pixels_of([F.lit(1 / 3), F.lit(0.5), F.lit(2.0), F.lit(0.5)], F.lit(100), F.lit(50)).alias("b"))
    r = df.first()
    assert tuple(r.a) == (0, 0, 33, 1) and tuple(r.b) == (33, 25, 100, 50)


def test_coverage(spark):
    r = spark.range(1).select(*[L.coverage(F.lit(float(x)), F.lit(0.8), F.lit(0.05)).alias(f"c{x}") for x in (0, 53, 100)]).first()
    assert r.c0 == 1.0 and r.c100 == 0.0 and abs(r.c53 - (0.8 - ((53 + 16) / 116) ** 3) / 0.75) < 1e-9


def test_shares_and_balance(spark):
    palette = {"cream": (250, 240, 220), "graphite": (50, 50, 55), "crimson": (160, 20, 50), "sand": (220, 200, 160)}
    rows = [("i", *palette["cream"], False)] * 6 + [("i", 52, 51, 56, False)] * 3 + [("i", *palette["crimson"], False)] + [("j", 0, 255, 0, False), ("j", *palette["crimson"], True)]
    df = L.colour_shares(spark.createDataFrame(rows, "image string, r int, g int, b int, photo boolean"), palette)
    got = {r.image: r for r in df.withColumn("warnings", L.balance_warnings()).collect()}
    assert abs(got["i"].cream - 0.6) < 1e-12 and abs(got["i"].graphite - 0.3) < 1e-12 and got["i"].warnings == []
    assert got["j"].photo == got["j"].other == 0.5 and got["j"].photo_ink == 1.0 and got["j"].warnings == ["cream low", "graphite low", "accent low"]
    parts = spark.createDataFrame([("a.jpg.0af.tmp", 4000.0), ("a.jpg.0af.tmp", 10.0), ("a.tmp", 9999.0)], "name string, age double")
    assert [r.s for r in parts.select(L.stale_part(F.col("name"), F.col("age")).alias("s")).collect()] == [True, False, False]


def test_scores(spark):
    rng = np.random.default_rng(5)
    w = rng.uniform(40, 300, 400)
    e = w**0.8 * np.exp(rng.normal(0, 0.2, 400))
    assert abs(G.size_exponent(w, e) - 0.8) < 0.1 and G.size_exponent(w[:10], e[:10]) == 0.596
    assert abs(G.spearman(np.log(e) - G.size_exponent(w, e) * np.log(w), w)) < 0.02
    face = np.arange(10.0)
    mapped = G.on_face_scale(np.array([5.0, 1.0, 3.0]), face)
    assert np.allclose(mapped, np.quantile(face, [2.5 / 3, 0.5 / 3, 1.5 / 3])) and G.on_face_scale(face, face[:2]) is face
    rows = [(1, i, 50.0 + i, 0.1, 1.0, None) for i in range(6)] + [(1, 6, None, None, 2.0, None), (1, 7, None, None, None, "broken")]
    df = spark.createDataFrame(rows, "shoot_id long, capture_order long, face_width double, ten_n double, frame_sharp double, error string")
    got = {r.capture_order: r for r in G.subject_scores(df).collect()}
    assert got[6].basis == "frame" and got[0].basis == "face" and abs(got[7].score - (min(r.score for k, r in got.items() if k != 7) - 1)) < 1e-12
