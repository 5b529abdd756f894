"""Containers, object codecs, tables in and out, streams."""

import io
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom import errors
from bitloom.operators import features
from bitloom.sources import containers, objects, tabular
from bitloom.streaming import audits


def picture(width=11, height=8, channels=3, flat=False):
    y, x = np.indices((height, width))
    image = np.zeros((height, width, channels), np.uint8)
    image[..., 0] = 255 if flat else 128 | ((x // 2 + 3 * y) % 8)
    image[..., 1] = 0 if flat else (5 * x + y // 2) % 16
    image[..., 2] = 128 if flat else 64 | ((x + y) % 4)
    if channels == 4:
        image[..., 3] = (x * 7) % 256
    return image


@pytest.mark.parametrize("encoding,table", itertools.product(objects.ENCODINGS, objects.TABLES))
@pytest.mark.parametrize("transform,group", [("raw", (1, 1)), ("first_pixel", (3, 1)), ("minimum", (2, 2))])
def test_image_round_trips(encoding, table, transform, group):
    rnd = np.random.default_rng(1)
    noise = rnd.integers(0, 256, (9, 12, 3)).astype(np.uint8)
    for image, model in ((picture(), "ycocg_r"), (picture(12, 9, 4), "rgb"), (picture(12, 9, flat=True), "ycocg_r"), (noise, "ycocg_r"), (picture(1, 1), "rgb")):
        c = objects.compress_image(image, model, transform, group, encoding=encoding, table=table)
        data = objects.write_image(c)
        back = objects.read_image(data)
        assert (objects.matrix_image(back.matrix(), back.grid) == image).all()
        assert (back.ids == c.ids).all() and back.encoding == encoding
        assert objects.write_image(back) == data
        with pytest.raises(errors.InvalidFormat):
            objects.read_image(data[:-1])
        if min(image.shape[:2]) > 5:
            assert (objects.crop(back, 2, 1, 6, 4) == image[1:5, 2:7]).all()


def test_lossy_model_is_close():
    image = picture()
    c = objects.compress_image(image, "ycocg")
    back = objects.matrix_image(c.matrix(), c.grid).astype(int)
    assert np.abs(back - image).max() <= 4


def test_minimum_of_bases():
    bits = np.array([[i >> b & 1 for b in range(8)] for i in range(16)], np.uint8)
    cols = [objects.Column(4, 8)]
    assert len(objects.compress(bits, cols, least=5).bases) >= 5
    assert len(objects.compress(np.zeros((16, 8), np.uint8), cols, least=5).bases) == 1
    with pytest.raises(errors.InvalidConfig):
        objects.compress(bits, cols, least=0)


def test_tables_round_trip_and_damage():
    rnd = np.random.default_rng(0)
    bits = rnd.integers(0, 2, (2500, 20)).astype(np.uint8)
    bits[:, 3], bits[:, 9] = 1, 0
    cols = [objects.Column(5, 16, 2, 0, -70, "a column with a långer name", "int"), objects.Column(4, 4, 4, 2, 5, "b", "double")]
    for encoding in objects.ENCODINGS:
        c = objects.dictionary(bits, cols, [0, 1, 2, 3, 9, 15], encoding, "fixed")
        data = objects.write_table(c)
        back = objects.read_table(data)
        assert (back.matrix() == bits).all() and [(x.name, x.dtype, x.minimum, x.scale) for x in back.columns] == [(x.name, x.dtype, x.minimum, x.scale) for x in cols]
        assert (back.matrix(np.array([7, 3, 2499])) == bits[[7, 3, 2499]]).all()
    for bad in (b"", b"TGD\x02" + data[4:], data + b"x", data[:40]):
        with pytest.raises(errors.InvalidFormat):
            objects.read_table(bad)


def test_profile_and_extraction():
    rnd = np.random.default_rng(5)
    bits = rnd.integers(0, 2, (300, 12)).astype(np.uint8)
    order = rnd.permutation(12).tolist()
    assert objects.profile(bits, order) == [len(np.unique(bits[:, order[:j]], axis=0)) if j else 1 for j in range(13)]
    c = objects.compress_image(picture(), least=8)
    doc = objects.extract(c)
    assert sum(b["count"] for b in doc["bases"]) == 88 and len({b["bits"] for b in doc["bases"]}) == len(doc["bases"])
    pos = np.flatnonzero(c.states != objects.DEVIATION)
    rows = c.matrix()[:, pos]
    assert all("".join(map(str, rows[i])) == doc["bases"][k]["bits"] for i, k in enumerate(doc["base_ids"]))
    assert sorted(objects.dictionary_values(c, True)) != [] and len(set(objects.dictionary_values(c, True))) == len(c.bases)
    with pytest.raises(errors.InvalidConfig):
        objects.dictionary_values(objects.compress_image(picture(), group=(2, 1)), True)


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(f"img{i}", int(y), int(x), *map(int, picture()[y, x])) for i in range(3) for y in range(8) for x in range(11)]
    return spark.createDataFrame(rows, "image string, y int, x int, r int, g int, b int")


def test_sets_of_images(spark, pixels, tmp_path):
    files = containers.compress_images(pixels, "image", ["r", "g", "b"])
    back = containers.decompress_images(files, "image", ["r", "g", "b"])
    assert back.exceptAll(pixels).isEmpty() and pixels.exceptAll(back).isEmpty()
    for r in files.collect():
        (tmp_path / f"{r.image}.igd").write_bytes(r.content)
    (tmp_path / "bad.igd").write_bytes(b"IGD")
    scanned = containers.scan(spark, str(tmp_path))
    heads = {r.path.split("/")[-1]: r for r in containers.headers(scanned, length="length").collect()}
    assert heads["bad.igd"].error == "truncated" and heads["bad.igd"].width is None
    assert heads["img0.igd"].raw_bytes == 264 and heads["img0.igd"].igd_bytes == (tmp_path / "img0.igd").stat().st_size
    counts = containers.base_counts(scanned.withColumnRenamed("path", "image"), "image").collect()
    assert sum(r.error is not None for r in counts) == 1 and all(r.width == 11 for r in counts if r.error is None)


def test_maps_equal_windows(pixels):
    files = containers.compress_images(pixels, "image", ["r", "g", "b"], least=20)
    bases = containers.dictionaries(files, "image", interleaved=True)
    norm = features.normalized(features.rank_delta(bases, "image", "value"), "image")
    want = {(r.image, r.value): (r["scale"], r.z) for r in features.adaptive(norm, "image").collect()}
    got = containers.maps(files, "image").toPandas()
    c = objects.read_image(bytes(files.where("image = 'img1'").first().content))
    values = objects.dictionary_values(c, True)
    mine = got[got.image == "img1"].sort_values(["y", "x"])
    assert [(s, z) for s, z in zip(mine["scale"], mine.z)] == [want["img1", values[i]] for i in c.ids]
    archive = containers.archives(containers.maps(files, "image").select("image", "y", "x", "z"), "image", ["z"], 11).where("image = 'img1'").first()
    with np.load(io.BytesIO(bytes(archive.content))) as npz:
        assert npz["z"].dtype == np.uint16 and npz["z"].shape == (8, 11) and (npz["z"].ravel() == mine.z).all()
    doc = containers.extracted(files, "image").first().document
    assert '"bases"' in doc


def test_csv_and_fills(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, None), (2, None, 4), (3, 2.5, None)], "i int, a double, b int")
    path = tabular.write_csv(df, str(tmp_path / "t"))
    assert path.endswith(".csv") and tabular.read_csv(spark, path, schema="i int, a double, b int").orderBy("i").collect() == df.collect()
    assert dict(tabular.read_csv(spark, path).dtypes)["a"] == "double"
    fill = lambda *a, **k: [tuple(r) for r in tabular.fill_nulls(df, *a, **k).orderBy("i").collect()]
    assert fill("zero") == [(1, 1.5, 0), (2, 0.0, 4), (3, 2.5, 0)] and fill("mean")[1][1] == 2.0
    assert fill("forward", order="i") == [(1, 1.5, None), (2, 1.5, 4), (3, 2.5, 4)] and fill("backward", order="i")[0] == (1, 1.5, 4)
    assert fill("value", 9)[0][2] == 9 and fill("max")[0][2] == 4
    with pytest.raises(errors.InvalidConfig):
        tabular.fill_nulls(df, "other")


def test_manifests(spark, tmp_path):
    df = spark.createDataFrame([("a.png", 1, "train"), ("b.png", 2, "test")], "file string, label int, split string")
    with pytest.raises(errors.InvalidConfig):
        tabular.write_manifest(df.where("label = 1"), str(tmp_path / "m"), "split", "file")
    with pytest.raises(errors.DuplicateKey):
        tabular.write_manifest(df.union(df), str(tmp_path / "m"), "split", "file")
    tabular.write_manifest(df, str(tmp_path / "m"), "split", "file")
    assert tabular.read_records(spark, str(tmp_path / "m")).count() == 2
    (tmp_path / "doc.json").write_text('{"split": "train", "samples": [{"file": "a", "label": 1}, {"file": "b", "label": 0}]}')
    assert sorted(tuple(r) for r in tabular.read_manifest(spark, str(tmp_path / "doc.json")).select("file", "label", "split").collect()) == [("a", 1, "train"), ("b", 0, "train")]


def test_streamed_totals(spark, tmp_path):
    schema = "g string, raw_bytes long, igd_bytes long, png_bytes long"
    rows = [("a", 10, 5, 7), ("a", 20, 30, None), ("b", 5, 5, 0)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows[:2], schema).coalesce(1).write.parquet(folder)
    spark.createDataFrame(rows[2:], schema).coalesce(1).write.mode("append").parquet(folder)
    totals = audits.running_totals(audits.follow(spark, folder, schema, files_per_batch=1), "raw_bytes", "igd_bytes", "png_bytes", ["g"])
    q = audits.to_table(totals, "totals", str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r.g: r for r in spark.sql("select * from totals").collect()}
    assert got["a"].raw_bytes == 30 and got["a"].expansions == 1 and got["a"].paired == 1 and got["b"].images == 1


def test_row_access_in_containers(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"), (F.col("id") / 4).alias("d"))
    files = tabular.pack_groups(df, "g", ["v", "d"], encoding="rle")
    got = tabular.unpack_groups(files, "g", "g long, v long, d double", rows=[3, 0]).collect()
    assert sorted((r.g, r.v, r.d) for r in got) == [(0, 0, 0.0), (0, 6, 1.5), (1, 1, 0.25), (1, 7, 1.75)]
