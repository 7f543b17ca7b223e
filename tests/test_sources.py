import os
import struct

import numpy as np
import pytest

from burstlake.functions import pixels
from burstlake.sources import cr2, files, jpeg, selection
from burstlake.streaming.bursts import session_bursts


def a_jpeg(w=64, h=48, process=0, pad=b""):
    sof = bytes([0xFF, 0xC0 + process]) + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\x01\x11\x00\x02\x11\x00\x03\x11\x00"
    sos = b"\xff\xda" + struct.pack(">H", 12) + b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00"
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + sof + sos + b"\x11\x22\xff\x00" * 40 + b"\xff\xd9" + pad


def a_cr2(order="<", orientation=1, pad=b"", keep=1.0, broken=False):
    """A container with a preview, a thumbnail, Exif and a date."""
    big, small = a_jpeg(1936, 1288, pad=pad), a_jpeg(160, 120)
    if broken:
        big = small = b"\xff\xd8nonsense" * 20
    texts = {0x010F: b"Canon\0", 0x0110: b"Canon EOS 40D\0", 0x9003: b"2016:07:14 11:22:33\0"}
    at, blobs = 512, {}
    for key, data in [*texts.items(), ("big", big), ("small", small)]:
        blobs[key] = at, data
        at += len(data) + len(data) % 2

    def ifd(entries, following):
        out = struct.pack(order + "H", len(entries))
        for tag, kind, count, value in entries:
            inline = struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value)
            out += struct.pack(order + "HHI", tag, kind, count) + inline
        return out + struct.pack(order + "I", following)

    text = lambda tag: (tag, 2, len(texts[tag]), blobs[tag][0])
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 16) + b"CR\x02\x00" + struct.pack(order + "I", 0)
    first = [text(0x010F), text(0x0110), (0x0111, 4, 1, blobs["big"][0]), (0x0112, 3, 1, orientation), (0x0117, 4, 1, len(big)), (0x8769, 4, 1, 300)]
    out = bytearray(at)
    for where, data in ((0, head), (16, ifd(first, 200)), (200, ifd([(0x0201, 4, 1, blobs["small"][0]), (0x0202, 4, 1, len(small))], 16)), (300, ifd([text(0x9003)], 0)), *blobs.values()):
        out[where : where + len(data)] = data
    return bytes(out[: int(len(out) * keep)])


@pytest.mark.parametrize("order", ["<", ">"])
def test_probe(order):
    got = cr2.probe(a_cr2(order, 6, b"\0" * 600))
    assert (got["byte_order"], got["orientation"], got["camera"], got["shot_at"], got["error"]) == (order, 6, "Canon EOS 40D", "2016:07:14 11:22:33", None)
    assert [(p["source"], p["width"], p["height"], p["length"]) for p in got["previews"]] == [("ifd0", 1936, 1288, len(a_jpeg())), ("ifd1", 160, 120, len(a_jpeg()))]


def test_probe_never_raises(spark):
    data = a_cr2()
    odd = [b"", b"II", os.urandom(400), b"II" + bytes(40), a_cr2(broken=True), b"MM\x00\x2a" + b"\xff" * 60, data[:8] + cr2.ONE_D + data[12:]]
    odd += [a_cr2(keep=k / 10) for k in range(1, 10)]
    rows = spark.createDataFrame([(f"/{i}", bytearray(d)) for i, d in enumerate([data, *odd])], "path string, content binary")
    got = {r.path: r for r in cr2.probe_files(rows).collect()}
    assert len(got) == len(odd) + 1 and got["/0"].error is None and all(got[f"/{i}"].error for i in range(1, 8))


def test_markers():
    j = a_jpeg()
    found, status = jpeg.walk(j)
    assert status == "complete" and [m for m, _, _ in found] == [0xE0, 0xC0, 0xDA]
    assert jpeg.walk(j[:20], len(j))[1] == "partial" and jpeg.walk(j[:20])[1] == "broken" and jpeg.walk(j[:8] + b"xx" + j[8:])[1] == "broken"
    assert jpeg.frame(j) == {"w": 64, "h": 48, "ncomp": 3, "process": 0} and jpeg.frame(b"no") is None
    assert jpeg.trimmed(a_jpeg(pad=b"\0" * 12)) == len(j) and jpeg.trimmed(a_jpeg(pad=b"\0" * 5000)) == len(j) + 5000
    assert cr2.preview(b"x" + a_jpeg(process=3), "ifd2", 1, len(j)) is None


def test_catalog(spark, tmp_path):
    for name in ("_MG_2.CR2", "IMG_1.jpg", ".hidden.jpg", "note.txt", "sub/b.JPG", "__MACOSX/x.jpg", "sub/deep/c.png"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * 3)
    os.symlink(tmp_path, tmp_path / "sub" / "loop")
    found, problems = files.catalog(spark, str(tmp_path))
    assert [(r.name, r.ext, r.size) for r in found.collect()] == [("_MG_2.CR2", "cr2", 3), ("IMG_1.jpg", "jpg", 3), ("b.JPG", "jpg", 3), ("c.png", "png", 3)]
    assert problems.count() == 0 and files.catalog(spark, str(tmp_path), recursive=False)[0].count() == 2
    assert files.catalog(spark, str(tmp_path / "nowhere"))[1].count() == 1


def test_selection_and_export(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"one")
    selection.save(str(tmp_path / "s.json"), ["a.jpg", "gone.jpg"])
    assert [r.file for r in selection.load(spark, str(tmp_path / "s.json")).orderBy("pos").collect()] == ["a.jpg", "gone.jpg"]
    plan = spark.createDataFrame([(str(tmp_path / "a.jpg"), "x.jpg"), (str(tmp_path / "gone.jpg"), "y.jpg")], "src string, dst_name string")
    for _ in range(2):  # a task that runs again
        got = {os.path.basename(r.src): r for r in selection.export(plan, str(tmp_path / "out")).collect()}
        assert got["a.jpg"].error is None and "FileNotFoundError" in got["gone.jpg"].error
    assert sorted(os.listdir(tmp_path / "out")) == ["x.jpg"]
    (tmp_path / "bad.json").write_text('{"format": "other", "files": ["a"]}')
    with pytest.raises(Exception, match="not a selection"):
        selection.load(spark, str(tmp_path / "bad.json")).collect()


def test_features(spark):
    rng = np.random.default_rng(3)
    sharp = rng.integers(0, 255, (200, 300, 3), dtype=np.uint8)
    blurred = np.stack([pixels.box_resize(pixels.box_resize(sharp[..., c], 20, 30), 200, 300) for c in range(3)], -1).astype(np.uint8)
    rows = [("sharp", 200, 300, bytearray(sharp.tobytes())), ("soft", 200, 300, bytearray(blurred.tobytes())), ("short", 200, 300, bytearray(b"xx"))]
    got = {r.path: r for r in pixels.measure(spark.createDataFrame(rows, "path string, h int, w int, data binary")).collect()}
    assert got["sharp"].lapvar > got["soft"].lapvar and got["sharp"].frame_sharp > got["soft"].frame_sharp and got["short"].error
    assert abs(sum(got["sharp"].hist) - 1) < 1e-9 and abs(sum(x * x for x in got["sharp"].signature) - 1) < 1e-3
    half = np.zeros((80, 80), np.uint8)
    half[:40] = 255
    assert pixels.average_hash(half) == (1 << 32) - 1 and pixels.average_hash(255 - half) == -(1 << 32)
    skin, grey = np.full((9, 9, 3), (224, 172, 140), np.uint8), np.full((9, 9, 3), 128, np.uint8)
    assert pixels.plausible_face(skin, 0.12) and not pixels.plausible_face(skin, 0.59) and not pixels.plausible_face(grey, 0.1)


def test_session_bursts(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, at + datetime.timedelta(seconds=s), float(s)) for s in (0, 8, 17)], "shoot_id long, ts timestamp, sharpness double")
    assert [r.n for r in session_bursts(df).orderBy("start").collect()] == [2, 1]


def a_recipe(*blocks):
    body = b"".join(struct.pack(">II", kind, len(data)) + data for kind, data in blocks)
    size = struct.pack(">I", len(body))
    return cr2.TRAILER + bytes(4) + size + body + cr2.TRAILER + size + bytes(40)


def test_recipe_trailer():
    item = lambda tag, data, more: cr2.ITEM + bytes(4) + struct.pack("<3I", tag, len(data), more) + data
    items = item(3, a_jpeg(16, 12), 1) + item(4, a_jpeg(1600, 1200, pad=b"\0" * 7), 0) + item(3, b"behind the last", 0)
    got = cr2.probe(a_cr2() + a_recipe((0xFFFF00F7, b"abc"), (0xFFFF00F5, items)))
    assert got["has_dpp_recipe"] and got["recipe_blocks"] == ["dpp4", "ihl"] and "DPP 4" in got["recipe_hint"] and "own" in got["recipe_hint"]
    assert [(p["source"], p["width"]) for p in got["previews"]] == [("ifd0", 1936), ("vrd_ihl", 1600), ("ifd1", 160), ("vrd_ihl_thumb", 16)]
    plain = cr2.probe(a_cr2())
    assert not plain["has_dpp_recipe"] and plain["recipe_blocks"] == [] and plain["recipe_hint"].startswith("no recipe")
    short = a_recipe((0xFFFF00F4, b"abc"))
    assert cr2.recipe_trailer(short)[0] == ["dpp3"] and cr2.recipe_trailer(short[1:]) == (None, []) and cr2.recipe_trailer(b"") == (None, [])
    assert "Photo Professional" in cr2.recipe_hint(None, False, "Digital Photo Professional")


@pytest.mark.parametrize("parts,slices,want", [([0x11, 0x11], None, (200, 48, False)), ([0x11, 0x11], (1, 90, 100), (190, 48, False)), ([0x21, 0x11, 0x11], None, (100, 48, True)), ([0x12, 0x11], None, (100, 48, True)), ([], None, (0, 0, False))])
def test_raw_size(parts, slices, want):
    head = b"\xff\xd8\xff\xc3" + struct.pack(">HBHHB", 8 + 3 * len(parts), 14, 48, 100, len(parts)) + b"".join(bytes([k, v, 0]) for k, v in enumerate(parts))
    data = b"II*\0\x10\0\0\0" + bytes(100) + (head if parts else b"none" * 8) + bytes(20)
    t = cr2.Tiff(data + struct.pack("<3H", *(slices or (0, 0, 0))) + struct.pack("<2I", 108, len(head) + 8))
    end = len(t.data)
    entries = {cr2.STRIP: (4, 1, end - 8), cr2.STRIP_SIZE: (4, 1, end - 4)} | ({cr2.SLICES: (3, 3, end - 14)} if slices else {})
    assert cr2.raw_size(t, entries) == want


def test_visible_size():
    v = [17, 4000, 3000, 0, 0, 10, 20, 3909, 2619]
    t = cr2.Tiff(b"II*\0\x10\0\0\0" + bytes(40) + struct.pack("<9H", *v))
    assert cr2.visible_size(t, {cr2.SENSOR: (3, 9, 48)}) == (3900, 2600) and cr2.visible_size(t, {cr2.SENSOR: (3, 5, 48)}) == (0, 0) and cr2.visible_size(t, {}) == (0, 0)
