"""Image files, archives, presets, reports."""

import io
import pickle
import struct
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom import errors
from bitloom.operators import audit, evaluate, features, preprocess, report
from bitloom.operators.dictionary import decode
from bitloom.plans import presets
from bitloom.sources import containers, images, objects


def noise(h=9, w=7, ch=3, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, ch)).astype(np.uint8)


def filtered_png(image, kinds):
    """A PNG with the given filter in each line, by the definition."""
    import zlib

    h, w, ch = image.shape
    out, above = [], np.zeros(w * ch, int)
    for y in range(h):
        line, k = image[y].reshape(-1).astype(int), kinds[y % len(kinds)]
        left = np.concatenate([np.zeros(ch, int), line[:-ch]])
        corner = np.concatenate([np.zeros(ch, int), above[:-ch]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        out.append(bytes([k]) + ((line - [np.zeros_like(line), left, above, (left + above) // 2, paeth][k]) % 256).astype(np.uint8).tobytes())
        above = line
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[ch], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(out))) + chunk(b"IEND", b"")


def test_png_and_bmp():
    for ch in (3, 4):
        image = noise(ch=ch)
        assert (images.read_png(images.write_png(image)) == image).all()
        assert (images.read_png(filtered_png(image, [0, 1, 2, 3, 4])) == image).all()
    grey = noise(ch=1)
    assert (images.read_png(filtered_png(grey, [4, 2])) == np.repeat(grey, 3, 2)).all()
    image = noise(5, 7)
    rows = b"".join(image[y, :, ::-1].tobytes() + b"\0" * 3 for y in range(4, -1, -1))
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, 5, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (images.decode(bmp) == image).all()
    for bad in (b"GIF89a", b"", images.write_png(image)[:60]):
        with pytest.raises(errors.InvalidFormat):
            images.decode(bad)


def test_folders_of_images(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"i{i}.png").write_bytes(images.write_png(noise(seed=i)))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    files = containers.scan(spark, str(tmp_path), "*.png")
    px = images.pixels(files)
    assert px.where("error is null").count() == 3 * 63 and px.where("error is not null").count() == 1
    packed = images.compressed(files)
    assert packed.where("error is not null").count() == 1
    one = packed.where("path like '%i1.png'").first()
    c = objects.read_image(bytes(one.content))
    assert (objects.matrix_image(c.matrix(), c.grid) == noise(seed=1)).all() and one.k == len(c.bases)
    coded = images.converted(files.where("path like '%i2.png'"), "ycocg_r").first()
    assert (objects.from_model(images.decode(bytes(coded.content)), "ycocg_r") == noise(seed=2)).all()
    assert images.converted(files.where("path like '%i2.png'"), "ycbcr").count() == 1


def test_archives(spark, tmp_path):
    data, out = np.arange(2 * 3072).reshape(2, 3072).astype(np.uint8), io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, body in (("x/data_batch_1", {b"data": data, b"labels": [3, 9], b"filenames": [b"a.png", b"b.png"]}), ("x/readme", None)):
            raw = pickle.dumps(body, protocol=2)
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    (tmp_path / "c.tar.gz").write_bytes(out.getvalue())
    rows = images.cifar(containers.scan(spark, str(tmp_path), "*.tar.gz"))
    got = rows.orderBy("batch_index").collect()
    assert [(r.batch, r.label, r["class"], r.file) for r in got] == [("data_batch_1", 3, "cat", "a.png"), ("data_batch_1", 9, "truck", "b.png")]
    px = images.bytes_to_pixels(rows.select("file", "pixels"), "pixels", 32).where("file = 'b.png' and y = 2 and x = 5").first()
    assert (px.r, px.g, px.b) == tuple(int(data[1].reshape(3, 32, 32)[i, 2, 5]) for i in range(3))
    with pytest.raises(errors.InvalidFormat):
        images._Plain(io.BytesIO(pickle.dumps(tarfile.open))).load()


def test_presets(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("a"), (F.col("id") * 31 % 256).cast("int").alias("b"), (F.col("id") % 3 / 2).alias("c"))
    for name, p in presets.PRESETS.items():
        d, walk = presets.compress(df, ["a", "b", "c"], ["id"], name, scale=1)
        back = preprocess.reconstruct(decode(d, ["id"]), d.layout, ["id"])
        assert back.exceptAll(df).isEmpty() and back.count() == 3000 and walk.steps
        assert presets.encoded_bits(d, ["id"], p.encoding) > 0
    with pytest.raises(errors.InvalidConfig):
        presets.compress(df, ["a"], ["id"], presets.Preset(selector="x"))


def test_actions():
    assert [presets.action(*a) for a in (("t.csv",), ("a.PNG",), ("t.tgd",), ("i.igd",))] == ["compress_table", "compress_image", "decompress_table", "decompress_image"]
    assert presets.action("t.tgd", rows="1-2") == "decompress_rows" and presets.action("i.igd", crop="0,0,1,1") == "decompress_crop" and presets.action("t.tgd", analytics=True) == "analytics"
    for bad in ({"source": "t.tgd", "crop": "0,0,1,1"}, {"source": "i.igd", "rows": "1"}, {"source": "x"}, {"source": "t.csv", "rows": "1"}, {"source": "t.tgd", "rows": "1", "analytics": True}):
        with pytest.raises(errors.InvalidConfig):
            presets.action(**bad)


def test_cached_statistics(spark, tmp_path):
    calls = []

    def compute(df):
        calls.append(1)
        return evaluate.moments(df, ["v"])

    df = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    for context in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert presets.cached(df, str(tmp_path / "s"), context, compute).first().mean_v == 2.0
    assert len(calls) == 2


def test_report_and_classifier(spark):
    df = spark.createDataFrame([("train", "p", 100, 50, None), ("val", "q", 100, 200, 10)], "s string, p string, raw_bytes long, igd_bytes long, png_bytes long")
    text = report.markdown(audit.families(df, "s", "p", F.col("raw_bytes") < 0, audit.totals_of("raw_bytes", "igd_bytes", "png_bytes")))
    assert "| all | 2 | 200 B | 250 B | -25.00 | 1 |" in text and "split / train" in text
    rows = [(f"g{i}", int(v)) for i in range(24) for v in np.cumsum(np.random.default_rng(i).integers(1, 5 if i % 2 else 90, 30))]
    pooled = features.pooled(features.rank_delta(spark.createDataFrame(rows, "g string, v long"), "g", "v"), "g", 8)
    data = report.vectors(pooled, "g").withColumn("label", (F.substring("g", 2, 2).cast("int") % 2).cast("double"))
    model = report.classifier(data, 2, bins=8, hidden=(4,), steps=60)
    assert model.transform(data).where("prediction = label").count() >= 22


def test_timing(monkeypatch, caplog):
    from bitloom.plans import timing

    seen = []
    with timing.timed("step", lambda *x: seen.append(x)):
        pass
    assert seen[0][0] == "step" and seen[0][1] >= 0
    monkeypatch.setenv("BITLOOM_TIMING", "1")
    monkeypatch.setenv("BITLOOM_LOG", "info")
    with caplog.at_level("WARNING"), timing.timed("logged"):
        assert timing.setup().level == 20
    assert "logged" in caplog.text
