import os

import numpy as np
import pytest

from burstlake.functions import pixels
from burstlake.operators import relate as R
from burstlake.operators import sinkplan as P
from burstlake.sources import convert as V
from burstlake.sources import cr2, files, fixture, jpeg


def a_file(**more):
    return fixture.cr2_file(**{"width": 640, "height": 432, "payload": b"scan" * 50} | more)


@pytest.mark.parametrize("order", ["<", ">"])
def test_the_scan_is_copied_and_metadata_rebuilt(order):
    data = a_file(order=order, orientation=6, pad=300)
    got = V.convert(data)
    assert got["ok"] and (got["mode"], got["source"], got["width"], got["height"], got["orientation"]) == ("lossless", "ifd0", 640, 432, 6)
    out = got["data"]
    found, status = jpeg.walk(out)
    assert status == "complete" and [m for m, *_ in found] == [0xE1, 0xC0, 0xDA]  # its own Exif and JFIF went
    assert out.endswith(b"scan" * 50 + b"\xff\xd9" + b"") and b"old" not in out
    tiff = out[found[0][1] + 10 : found[0][1] + found[0][2]]
    t = cr2.Tiff(tiff)
    main, following = t.ifd(t.first)
    exif = cr2.below(t, main, cr2.EXIF)
    assert (t.ints(main, cr2.ORIENTATION), t.text(main, cr2.MODEL), t.text(exif, cr2.ORIGINAL)) == ([6], "Canon EOS 550D", "2019:05:04 03:02:01")
    assert (t.ints(exif, V.WIDE), t.ints(exif, V.HIGH)) == ([640], [432])
    small, _ = t.ifd(following)
    at, n = t.ints(small, cr2.THUMB)[0], t.ints(small, cr2.THUMB_SIZE)[0]
    assert jpeg.frame(tiff[at : at + n])["w"] == 160


def test_long_notes_go(spark):
    got = V.convert(a_file(note=b"n" * 80_000))
    assert got["ok"] and [n for n in got["notes"]] == ["tag 0x0201 left out", "tag 0x927c left out"]
    assert b"n" * 1000 in V.convert(a_file(note=b"n" * 1000))["data"]
    d = V.Directory()
    d.entries = {1: (7, 40_000, b"a" * 40_000), 2: (7, 40_000, b"b" * 40_000), 3: (2, 3, b"ab\0")}
    t = cr2.Tiff(b"II*\0\x10\0\0\0" + bytes(60))
    t.data = t.data + d.entries[1][2] + d.entries[2][2]
    seg, dropped = V.exif_segment(t, {1: (7, 40_000, 68), 2: (7, 40_000, 40_068)}, {}, {}, 1, 1, 1, b"")
    assert dropped == [1] and len(seg) < 65_540  # of equal ones the first


def test_what_cannot_be_done_says_so():
    assert V.convert(b"")["mode"] == "raw" and not V.convert(a_file(keep=0.3))["ok"] and "decoder" in V.convert(a_file(keep=0.3))["message"]
    assert V.convert(a_file(), V.Options(bake_rotation=True))["mode"] == V.convert(a_file(), V.Options(max_side=100))["mode"] == "reencode"
    assert "no preview of the editor" in V.convert(a_file(), V.Options(prefer_dpp=True))["notes"]
    assert V.convert(a_file(), V.Options(copy_exif=False))["data"].startswith(b"\xff\xd8\xff\xc0")
    for k in range(1, 10):
        assert V.convert(a_file(keep=k / 10))["message"] or k > 9


def test_verify():
    whole = fixture.jpeg_stream(64, 48, b"x" * 9)
    assert V.verified(whole, 64, 48) == "" and "64 x 48" in V.verified(whole, 1, 1) and V.verified(b"", 1, 1) == "no frame header"
    assert V.verified(whole[:-2], 64, 48) == "no end behind the scan"
    header = whole[: whole.index(b"\xff\xda")]
    assert V.verified(header + b"\xff\xfe\x00\x04\xff\xda\xff\xd9", 64, 48) == "no scan"


def test_best():
    p = lambda s, w: {"source": s, "offset": 1, "length": 2, "width": w, "height": 10}
    all_ = [p("vrd_ihl", 90), p("ifd2", 50), p("ifd0", 20)]
    assert V.best(all_)["source"] == "ifd2" and V.best(all_, True)["source"] == "vrd_ihl" and V.best(all_[:1])["source"] == "vrd_ihl" and V.best([]) is None
    assert V.best(all_[1:], True)["source"] == "ifd2"


def test_write(spark, tmp_path):
    rows = [(f"/{k}.CR2", bytearray(a_file(payload=b"%d" % k * 20)), f"{k}.jpg") for k in range(5)] + [("/bad.CR2", bytearray(b"II"), "bad.jpg"), ("/none.CR2", None, None)]
    df = V.convert_files(spark.createDataFrame(rows, "path string, content binary, dst_name string"))
    total = V.totals(df).first()
    assert (total.ok, total.failed) == (5, 2) and [f.path for f in total.failures] == ["/bad.CR2", "/none.CR2"]
    for _ in range(2):  # a task that runs again
        got = V.write_files(df, str(tmp_path / "out")).collect()
        assert sum(r.ok for r in got) == 5 and sorted(os.listdir(tmp_path / "out")) == [f"{k}.jpg" for k in range(5)]
    (tmp_path / "out" / "0.jpg").write_bytes(b"other")
    assert {r.message for r in V.write_files(df, str(tmp_path / "out")).collect() if r.path == "/0.CR2"} == {"exists"}
    assert all(r.ok for r in V.write_files(df.where("path = '/0.CR2'"), str(tmp_path / "out"), overwrite=True).collect())
    old = tmp_path / "out" / "x.jpg.abc.tmp"
    old.write_bytes(b"")
    os.utime(old, (1, 1))
    (tmp_path / "out" / "y.jpg.abc.tmp").write_bytes(b"")
    assert V.sweep(str(tmp_path / "out")) == ["x.jpg.abc.tmp"]


def test_inputs(spark, tmp_path):
    for name in ("shoot [1]/a.CR2", "shoot [1]/b.jpg", "c1.CR2", "c2.CR2", "note.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
    specs = [f'"{tmp_path}/shoot [1]/*.CR2"', f"{tmp_path}/shoot [1]", f"{tmp_path}/c[12].CR2", str(tmp_path / "note.txt"), str(tmp_path / "gone"), ""]
    found, bad = files.inputs(spark, specs)
    assert [r.name for r in found.collect()] == ["a.CR2", "b.jpg", "c1.CR2", "c2.CR2"] and [r.path for r in bad.collect()] == [str(tmp_path / "gone")]
    assert files.literal("/a/x [1]/*.cr2") == "/a/x [[]1]/*.cr2" and files.literal("/a[1]/b") == "/a[[]1]/b" and files.literal("*.x") == "*.x"


def test_converter_names(spark):
    rows = [(0, "out", "a", "/x/a.cr2"), (1, "out", "A", "/y/A.cr2"), (2, "out", "a", "/y/sub/y/a.cr2"), (3, "out", "a", "/x/a.cr2"), (4, "out", "a_y", "/z/a_y.cr2"), (5, "out", "a", "/q/y/a.cr2")]
    df = spark.createDataFrame(rows, "pos long, out_dir string, stem string, src string")
    got = [r.dst_name for r in P.plan_names(df, policy="telling", shared=True).orderBy("pos").collect()]
    assert got == ["a.jpg", "A_y.jpg", "a_2.jpg", "a.jpg", "a_y_z.jpg", "a_3.jpg"]
    many = spark.createDataFrame([(k, "out", "a", f"/s/{k}/s/a") for k in range(1005)], "pos long, out_dir string, stem string, src string")
    names = [r.dst_name for r in P.plan_names(many, policy="telling").orderBy("pos").collect()]
    assert names[:3] == ["a.jpg", "a_s.jpg", "a_2.jpg"] and names[999] == "a_999.jpg" and len(names[1001]) == len("a_.jpg") + 12 and len(set(names)) == 1005
    plan = spark.createDataFrame([("/x",), ("/x/in/",), ("/other",), ("/",)], "out_dir string")
    sources = spark.createDataFrame([("/X/a.cr2",)], "path string")
    assert sorted(r.out_dir for r in P.outside_sources(plan, sources).collect()) == ["/", "/other"]


def test_carry_over(spark):
    fields = spark.createDataFrame([("p", "k1", "L", "e1"), ("p", "k2", "M", "e2"), ("q", "k1", "L", "e3"), ("q", "k9", "N", None)], "template string, key string, label string, example string")
    current = spark.createDataFrame([("k1", "L", "now"), ("k2", "other", "x"), ("k9", "N", "  ")], "key string, label string, value string")
    saved = spark.createDataFrame([("q", "k1", None)], "template string, key string, value string")
    got = {(r.template, r.key): r.value for r in R.carry_over(fields, current, saved).collect()}
    assert got == {("p", "k1"): "now", ("p", "k2"): "e2", ("q", "k1"): "", ("q", "k9"): ""}


def test_pairs_by_bands(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    rows = [(k, k % 2, base[k % 12] ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 16)), replace=False))) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, part long, h long")
    want = {(a, b, (x ^ y).bit_count()) for a, p, x in rows for b, q, y in rows if a < b and p == q and (x ^ y).bit_count() <= 12}
    got = [(r.id, r.other, r.bits) for r in R.near_pairs(df, "id", ["part"], "h", 12).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicates_across_segments(spark):
    rng = np.random.default_rng(6)
    base, looks = [int(x) for x in rng.integers(0, 1 << 63, 9)], rng.normal(size=(30, 8))
    looks /= np.linalg.norm(looks, axis=1)[:, None]
    rows = []
    for k in range(700):
        h = base[k % 9] ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 13)), replace=False))
        v = looks[k % 30] + rng.normal(0, 0.2, 8)
        v = [float(x) for x in v / np.linalg.norm(v)]
        rows.append((k, int(k >= 600), None if k % 11 == 0 else h, None if k % 13 == 0 else float(rng.uniform(-900, 9000)), None if k % 7 == 0 else k % 5, None if k % 3 == 0 else v))

    def alike(a, b):
        apart = abs(a[3] - b[3]) if a[3] is not None and b[3] is not None else None
        bits = (a[2] ^ b[2]).bit_count() if a[2] is not None and b[2] is not None else 99
        look = a[5] and b[5] and round(sum(x * y for x, y in zip(a[5], b[5])), 6) >= 0.6
        return bits <= 12 or apart is not None and (apart <= 10 and a[4] == b[4] or apart <= 60 and bits <= 16) or bool(look)

    want = {(a[1], a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and alike(a, b)}
    df = spark.createDataFrame(rows, "id long, shoot long, h long, t double, seg long, v array<double>")
    got = [(r.shoot, r.id, r.other) for r in R.near_duplicates(df, "id", ["shoot"], "h", "t", "seg", "v").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert R.near_duplicates(df.limit(0), "id", ["shoot"], "h", "t", "seg", "v").count() == 0


def test_closest_by_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(k, int(k >= 200) + int(k == 299), [float(x) for x in rng.integers(-3, 4, 3)] if k % 9 else None) for k in range(300)]
    dot = lambda a, b: float(sum(x * y for x, y in zip(a[2], b[2])))
    want = {}
    for a in rows:
        others = [(-dot(a, b), b[0]) for b in rows if a[2] and b[2] and a[1] == b[1] and a[0] != b[0]]
        if others:
            want[a[0]] = (min(others)[1], -min(others)[0])
    df = spark.createDataFrame(rows, "id long, part long, v array<float>")
    for block in (256, 23):
        got = R.closest(df, "id", ["part"], "v", block).collect()
        assert len(got) == len(want) and {r.id: (r.best, r.corr) for r in got} == want


def test_range_join(spark):
    points = spark.createDataFrame([(1, 5.0, "a"), (1, 10.0, "b"), (1, 10.5, "c"), (1, 20.0, "d"), (2, 5.0, "e"), (1, -1.0, "f"), (1, None, "g")], "s long, t double, id string")
    ranges = spark.createDataFrame([(1, 0.0, 10.0, 0), (1, 11.0, 20.0, 1)], "s long, a double, z double, k long")
    assert sorted((r.id, r.k) for r in R.in_range(points, ranges, ["s"], "t", "a", "z").collect()) == [("a", 0), ("b", 0), ("d", 1)]


def test_retained(spark):
    df = spark.createDataFrame([(k, k) for k in range(10)] + [(3, 50)], "k long, seq long")
    assert sorted(r.k for r in R.retained(df, "k", "seq", 0, 3).collect()) == [0, 3, 9]


def test_flat_frames_have_a_sharpness():
    lap, sharp = pixels.sharpness(np.full((200, 200), 9, np.uint8))
    assert lap == 0 and sharp < -10 and pixels.tiles(np.zeros((130, 70))).shape == (2, 1, 64, 64)


def test_faces_of_given_boxes(spark):
    skin = np.full((120, 160, 3), (224, 172, 140), np.uint8)
    skin[:, :60] = (20, 90, 30)
    boxes = [(70, 20, 60, 60), (0, 0, 50, 50), (150, 100, 90, 90), (-20, 30, 200, 80)]
    faces = "boxes array<struct<x:int,y:int,w:int,h:int>>"
    df = spark.createDataFrame([("a", 120, 160, bytearray(skin.tobytes()), boxes), ("b", 1, 1, bytearray(b"x"), boxes), ("c", 120, 160, bytearray(skin.tobytes()), None)], f"path string, h int, w int, data binary, {faces}")
    got = {r.path: r.faces for r in pixels.measure_faces(df).collect()}
    assert [(f.x, f.y, f.w, f.h) for f in got["a"]] == [(70, 20, 60, 60), (0, 30, 160, 80)] and got["b"] is None and got["c"] == []
    assert abs(got["a"][0].mean - (224 + 172 + 140) / 3) < 1e-9 and got["a"][0].clip_hi == 0 and got["a"][0].ten_n < 1e-3
    assert pixels.shrunk(np.zeros((1000, 500, 3), np.uint8)).shape == (648, 324, 3) and pixels.shrunk(skin) is skin
    ramp = np.tile(np.arange(64.0), (8, 1))
    assert np.allclose(pixels.bilinear_resize(ramp, 8, 64), ramp) and abs(pixels.bilinear_resize(ramp, 4, 32).mean() - 31.5) < 0.6


def test_streams(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    from burstlake.streaming import results

    src = tmp_path / "in"
    src.mkdir()
    rows = [("log", 1, 1, "a"), ("log", 1, 3, "c"), ("log", 1, 2, "b"), ("pick", 2, 1, "x"), ("other", 3, 1, "y")]
    for k, r in enumerate(rows):
        (src / f"{k}.json").write_text(json.dumps(dict(zip(("topic", "key", "gen", "value"), r))))
    seen: dict = {"log": [], "pick": []}
    take = lambda name: lambda batch, number: seen[name].extend((number, r.key, r.value) for r in batch.collect())
    stream = results.arriving(spark, str(src), "topic string, key int, gen int, value string", most_files=2)
    results.drained(stream, str(tmp_path / "c1"), {name: take(name) for name in seen}).awaitTermination(60)
    assert sorted(v for _, _, v in seen["log"]) == ["a", "b", "c"] and [v for _, _, v in seen["pick"]] == ["x"]
    assert len({n for part in seen.values() for n, _, _ in part}) >= 2  # a batch takes two files
    batch = spark.createDataFrame(rows, "topic string, key int, gen int, value string")
    assert {r.key: (r.gen, r.value) for r in results.newest(batch, "key", "gen", "value").collect()} == {1: (3, "c"), 2: (1, "x"), 3: (1, "y")}
    times = spark.range(6).select(F.lit(1).alias("shoot_id"), F.timestamp_seconds(F.col("id") * 30).alias("ts"), F.col("id").cast("double").alias("sharpness"))
    assert sorted(r.n for r in results.windowed(times, "1 minute").collect()) == [2, 2, 2] and sum(r.n for r in results.windowed(times, "1 minute", "30 seconds").collect()) == 12


def test_command_line(spark, tmp_path, capsys):
    from burstlake.__main__ import main, parsed

    (tmp_path / "in" / "s").mkdir(parents=True)
    (tmp_path / "in" / "_MG_1.CR2").write_bytes(a_file())
    (tmp_path / "in" / "s" / "_mg_1.cr2").write_bytes(a_file())
    out = str(tmp_path / "out")
    assert main([str(tmp_path / "in"), "-o", out]) == 0 and sorted(os.listdir(out)) == ["_MG_1.jpg", "_mg_1_s.jpg"]
    (tmp_path / "in" / "bad.CR2").write_bytes(b"II")
    assert main([str(tmp_path / "in"), "-o", out, "--dry-run"]) == 1 and main([str(tmp_path / "out"), "-o", out]) == 2
    for wrong in (["--min-ratio", "2"], ["--max-side", "9"], ["--suffix", "a/b"], ["--suffix", "a."], ["--workers", "65"]):
        with pytest.raises(SystemExit) as e:
            parsed(["x", "-o", out, *wrong])
        assert e.value.code == 2


def test_durations(spark):
    from pyspark.sql import functions as F

    from burstlake.functions import scalars as S

    got = spark.createDataFrame([(5.25,), (75.0,), (3720.0,), (-1.0,)], "s double").select(S.duration(F.col("s")).alias("d")).collect()
    assert [r.d for r in got] == ["5.3 с", "1 мин 15 с", "1 ч 2 мин", "0.0 с"]


def test_settings(tmp_path):
    from burstlake.sources import selection

    text = '{"папка": "шёл дождь", "n": 1}'
    for e in ("utf-8", "utf-8-sig", *selection.LEGACY):
        (tmp_path / "s.json").write_bytes(text.encode(e))
        assert selection.load_settings(str(tmp_path / "s.json")) == ({"папка": "шёл дождь", "n": 1}, None), e
    (tmp_path / "s.json").write_text("[1")
    assert selection.load_settings(str(tmp_path / "s.json")) == ({}, str(tmp_path / "s.json.broken")) and os.path.exists(tmp_path / "s.json.broken")
    assert selection.load_settings(str(tmp_path / "s.json")) == ({}, None)
