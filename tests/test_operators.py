"""Known values, round trips and independent recomputation of the operators."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bitloom import errors
from bitloom.functions import pixels as px
from bitloom.functions import text as tx
from bitloom.layout import BitLayout, Feature, bits_needed, parse_crop, parse_rows, position_bits, smallest_width
from bitloom.operators import audit, bitstats, condensed, dictionary, encode, evaluate, features, pixels, preprocess, profile, sampling, select
from bitloom.plans.tables import numbered, running_sum, with_previous
from bitloom.sources import tabular


def layout_of(bits, width=1):
    return BitLayout(tuple(Feature(f"f{i}", "bigint", width, i * width) for i in range(bits // width)))


def words(spark, rows):
    """Rows given as strings, position 0 first."""
    return spark.createDataFrame([(i, sum(int(c) << p for p, c in enumerate(r))) for i, r in enumerate(rows)], "id long, b0 long")


def test_widths_and_positions():
    assert [smallest_width(x) for x in (0, 255, 256, 65536, 2**32, 2**64)] == [8, 8, 16, 32, 64, 128]
    with pytest.raises(errors.OutOfRange):
        smallest_width(2**128)
    assert [bits_needed(k) for k in (0, 1, 2, 3, 4, 5)] == [1, 1, 1, 2, 2, 3]
    assert [position_bits(k) for k in (1, 2, 3, 9)] == [0, 1, 2, 4]
    layout = layout_of(24, 8)
    assert [layout.feature_at(p).name for p in (0, 7, 8, 23)] == ["f0", "f0", "f1", "f2"]
    with pytest.raises(errors.OutOfRange):
        layout.feature_at(24)


def test_row_and_crop_texts():
    assert parse_rows("0,5,10-12, 5") == [0, 5, 10, 11, 12] and parse_crop("1,2,3,4") == (1, 2, 3, 4)
    for bad in ("5-1", "a", "", "1,,2"):
        with pytest.raises(errors.InvalidFormat):
            parse_rows(bad)
    with pytest.raises(errors.InvalidFormat):
        parse_crop("3,0,1,0")


def test_normalising(spark):
    df = spark.createDataFrame([(-10, 100, 1.5), (0, 105, 2.25), (5, 110, 0.75)], "a int, b bigint, c double")
    layout = preprocess.infer(df, scale=2)
    got = preprocess.codes(df, layout).collect()
    assert [tuple(r) for r in got] == [(0, 0, 75), (10, 5, 150), (15, 10, 0)] and layout.bits == 24
    assert preprocess.reconstruct(preprocess.pack(df, layout), layout).collect() == df.collect()
    half = spark.createDataFrame([(-2.5,), (2.5,)], "v double").select(preprocess.scaled(F.col("v"), 0).alias("v")).collect()
    assert [r.v for r in half] == [-3, 3]


def test_extreme_integers_and_floats_survive(spark):
    rows = [(-(2**63), 2**31 - 1, -1.5e300, 1.1), (2**63 - 1, -(2**31), 0.1, -0.0), (2**53 + 1, 0, 3.0, 2.5)]
    df = spark.createDataFrame(rows, "a bigint, b int, c double, d float")
    for kw in ({"floats": "raw"}, {"floats": "raw", "normalize": False}):
        layout = preprocess.infer(df, **kw)
        assert layout.bits > 2 * 62
        assert preprocess.reconstruct(preprocess.pack(df, layout), layout).collect() == df.collect()


def test_preprocessing_errors(spark):
    one = lambda v, t: spark.createDataFrame([(v,)], f"v {t}")
    for value, kind, error in ((None, "int", errors.NullValues), (float("nan"), "double", errors.NonFinite), (float("inf"), "float", errors.NonFinite), (1e30, "double", errors.OutOfRange), ("x", "string", errors.UnsupportedType), (True, "boolean", errors.UnsupportedType)):
        with pytest.raises(error):
            preprocess.infer(one(value, kind))
    with pytest.raises(errors.InvalidConfig):
        preprocess.infer(one(1, "int"), floats="other")
    assert preprocess.infer(one(1, "int").limit(0)).features[0].width == 8
    with pytest.raises(errors.InvalidConfig):
        preprocess.renamed(one(1, "int"), ["a", "b"], ["int", "int"])


def test_entropy_and_polarity(spark):
    bits = words(spark, ["1000", "1100", "1010", "0111"])
    layout = layout_of(4)
    h = {r.pos: round(r.entropy, 4) for r in bitstats.entropy(bits, layout).collect()}
    assert h == {0: 0.8113, 1: 1.0, 2: 1.0, 3: 0.8113}
    states = {r.pos: r.state for r in bitstats.polarity(words(spark, ["0101", "0110", "0100"]), layout).collect()}
    assert states == {0: "zero", 1: "one", 2: "varying", 3: "varying"}
    assert {r.state for r in bitstats.polarity(bits.limit(0), layout).collect()} == {"zero"}
    assert [r.ones for r in bitstats.ones(bits.limit(0), layout).orderBy("pos").collect()] == [0] * 4


def test_interleaved_order():
    counts = [(0, 0, 8), (1, 4, 8), (2, 2, 8), (3, 4, 8), (4, 1, 8), (5, 3, 8)]
    layout = BitLayout((Feature("a", "int", 3, 0), Feature("b", "int", 3, 3)))
    assert bitstats.interleaved(counts, layout) == [0, 5, 2, 1, 4, 3]


@pytest.mark.parametrize("width,limbs", [(40, 1), (150, 3)])
def test_profile_equals_counting(spark, width, limbs):
    rnd = np.random.default_rng(width)
    base = rnd.integers(0, 2, (40, width))
    rows = base[rnd.integers(0, 40, 500)]
    rows[:, :5] = rnd.integers(0, 2, (500, 5))
    layout = layout_of(width)
    data = [[int(sum(int(b) << k for k, b in enumerate(r[i * 62 : (i + 1) * 62]))) for i in range(limbs)] for r in rows]
    bits = spark.createDataFrame(data, ", ".join(f"b{i} long" for i in range(limbs)))
    order = rnd.permutation(width).tolist()
    want = [len({tuple(r[order[:j]]) for r in rows}) for j in range(width + 1)]
    assert profile.k_profile(bits.repartition(7), order) == want
    approx = profile.k_profile_approx(bits, order)
    assert all(abs(a - k) <= max(2, 0.25 * k) for a, k in zip(approx, want))
    assert profile.precision_summary(profile.precision(want, want)) ["rmse"] == 0 and len(layout.limbs) == limbs
    assert profile.k_profile(bits.limit(0), order) == [0] * (width + 1)


def test_selectors():
    model = select.SizeModel(1000, 10, 2)
    prof = [1, 1, 2, 2, 3, 4, 50, 200, 500, 900, 1000]
    h = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.9, 0.95, 0.97, 0.99, 1.0][:10]
    sizes = [model.size(j, k) for j, k in enumerate(prof)]
    assert select.naive(model, prof, 1, 100).best == min(range(1, 11), key=lambda j: sizes[j])
    assert select.naive(model, prof, 1, 0).best in (1, 2)
    assert select.threshold(model, prof, h, 0.45, 3).steps[0]["j"] == 5
    assert select.clusters([0.5] * 10, 0.5) == [10] and sum(select.clusters(h, 0.5)) == 10
    assert select.adaptive(model, prof, h, 1, 0.5, 10).best == select.naive(model, prof, 1, 100).best
    assert select.enforce_minimum([1, 2, 4, 8, 16], 1, 5) == 3 and select.enforce_minimum([1, 1, 1], 0, 9) == 2
    for bad in (lambda: select.enforce_minimum([1], 0, 0), lambda: select.clusters([1.0], 1.5), lambda: select.all_bits(model, prof, 0)):
        with pytest.raises(errors.InvalidConfig):
            bad()


def test_sorted_dictionary(spark):
    layout = layout_of(4, 4)
    bits = words(spark, ["1010", "0001", "1011", "0111"])
    d = dictionary.build(bits, layout, [0, 1, 2, 3], ["id"])
    assert d.order == [1, 2, 0, 3] or d.order[0] == 1
    ids = {r.id: r.base_id for r in d.rows.collect()}
    order = sorted(range(4), key=lambda i: [-int(["1010", "0001", "1011", "0111"][i][p]) for p in d.order])
    assert [ids[i] for i in order] == [0, 1, 2, 3]
    assert {(r.id, r.b0) for r in dictionary.decode(d, ["id"]).collect()} == {(r.id, r.b0) for r in bits.collect()}


def test_projection(spark):
    d = dictionary.build(words(spark, ["1010", "0001", "1011"]), layout_of(4), [0, 2, 3], ["id"], sort=False)
    got = dictionary.projected(d, [2, 3]).join(d.bases.select("base_id", "b0"), "base_id").collect()
    assert {(r.b0 >> 2 & 3, r.v0) for r in got} == {(r.v0, r.v0) for r in got} and len(got) == 3


def test_random_access(spark):
    bits = spark.range(500).select("id", (F.col("id") * 37 % 256).alias("b0"))
    d = dictionary.build(bits, layout_of(8, 8), [4, 5, 6, 7], ["id"])
    got = dictionary.random_access(d, "id", [7, 3, 7, 499])
    assert [(r.id, r.b0) for r in got.collect()] == [(i, i * 37 % 256) for i in (3, 7, 7, 499)]
    assert [r.id for r in dictionary.random_access(d, "id", [7, 3, 7], distinct=True).collect()] == [3, 7]
    assert dictionary.row_ranges(d, "id", [(0, 4), (490, 600)]).count() == 15
    broken = d.rows.withColumn("base_id", F.col("base_id") + 1000)
    with pytest.raises(PySparkException):
        dictionary.decode(d, ["id"], broken).collect()


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(13)
    assert [r.n for r in numbered(df, ["v"], "n").orderBy("v").collect()] == list(range(1000))
    assert numbered(df.limit(0), ["v"], "n").collect() == []


def test_running_sum_and_previous(spark):
    df = spark.range(300).select((F.col("id") * 7 % 300).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("x")).repartition(11)
    rows = sorted((r.v, r.x or 0) for r in df.collect())
    got = running_sum(df, [F.col("v")], F.col("x"), "s").orderBy("v").collect()
    assert [r.s for r in got] == np.cumsum([x for _, x in rows]).tolist()
    before = with_previous(df, [F.col("v").desc()], "v", "p").orderBy("v").collect()
    assert [r.p for r in before] == [*range(1, 300), None]
    assert running_sum(df.limit(0), ["v"], F.col("x"), "s").collect() == [] and with_previous(df.limit(0), ["v"], "v", "p").collect() == []


def test_run_lengths(spark):
    rnd = np.random.default_rng(3)
    symbols = np.repeat(rnd.integers(0, 4, 300), rnd.integers(1, 9, 300)).tolist() + [7] * 400 + list(range(300))
    for s in (symbols, [1], [1, 1], []):
        out, i = [], 0
        for r, m in encode.packets_of(np.array(s)):
            assert r < encode.MOST_RUN and m <= encode.MOST_LITERALS
            if r:
                out += [s[i]] * (r + 1)
                i += r + 1
            out += s[i : i + m]
            i += m
        assert out == s
    df = spark.createDataFrame(list(enumerate(symbols)), "i long, s long")
    p = encode.packets(df, ["s"], "i", F.floor(F.col("i") / 1024))
    want = sum(m + (r > 0) for b in range(0, len(symbols), 1024) for r, m in encode.packets_of(np.array(symbols[b : b + 1024])))
    assert encode.rle_size(p, 3).first().symbols == want


def test_huffman():
    counts = {i: n for i, n in enumerate([5, 9, 12, 13, 16, 45])}
    lengths = encode.huffman_lengths(counts)
    assert sorted(lengths.values()) == [1, 3, 3, 3, 4, 4] and sum(2.0**-n for n in lengths.values()) == 1
    table = encode.canonical(lengths)
    codes = [format(c, f"0{n}b") for n, c in table.values()]
    assert all(a == b or not b.startswith(a) for a in codes for b in codes)
    assert encode.huffman_lengths({4: 9}) == {4: 1} and encode.huffman_lengths({}) == {}
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    with pytest.raises(errors.OutOfRange):
        encode.huffman_lengths(dict(enumerate(fib)))


def test_deltas(spark):
    keys = [100, 90, 89, 5]
    d = encode.deltas(spark.createDataFrame([(k,) for k in keys], "k0 long"))
    assert {r.k0: r.delta for r in d.collect()} == {100: None, 90: 9, 89: 0, 5: 83}
    t = {r.delta: (r.bits, r.tier, r["size"]) for r in encode.tiered(d, False, 40).collect()}
    assert t == {0: (0, 0, 7), 9: (4, 2, 11), 83: (7, 4, 13)}
    u = {r.delta: (r.tier, r["size"]) for r in encode.tiered(d, True, 40).collect()}
    assert u == {0: (0, 10), 9: (0, 10), 83: (0, 10)}
    with pytest.raises(PySparkException):
        encode.deltas(spark.createDataFrame([(1,), (1,)], "k0 long")).collect()


def test_best_tiers_against_trying_all():
    from itertools import combinations

    hist = {1: 50, 3: 10, 4: 7, 9: 30, 12: 1}
    for unary in (True, False):
        for tiers in (1, 2, 3):
            best = None
            for n in range(1, tiers + 1):
                for c in combinations(sorted(hist), n):
                    if c[-1] == 12:
                        cost = sum(k * (c[i] + (i + 1 if unary else 6)) for b, k in hist.items() for i in [encode.tier_of(b, list(c))])
                        best = cost if best is None else min(best, cost)
            assert encode.best_tiers(hist, tiers, unary)[1] == best
    assert encode.knee([100, 40, 30, 25, 22]) == 1


def test_condensed(spark):
    rnd = np.random.default_rng(1)
    rows = rnd.integers(0, 256, (300, 3))
    df = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(rows)], "id long, a int, b int, c int")
    layout = preprocess.infer(df, ["a", "b", "c"], normalize=True)
    bits = preprocess.pack(df, layout)
    picked = [7, 6, 15]
    got = condensed.condense(bits, layout, picked)
    assert got.agg(F.sum("weight")).first()[0] == 300
    lows = rows.min(0)
    v = rows - lows
    groups = {}
    for r in v:
        groups.setdefault((r[0] >> 6, r[1] >> 7), []).append(r)
    want = sorted(((a << 6) + int(np.mean([r[0] & 63 for r in g]) // 1), (b << 7) + int(np.mean([r[1] & 127 for r in g]) // 1), int(np.mean([r[2] for r in g]) // 1), len(g)) for (a, b), g in groups.items())
    back = preprocess.reconstruct(got, layout, ["weight"]).collect()
    assert sorted((r.a - int(lows[0]), r.b - int(lows[1]), r.c - int(lows[2]), r.weight) for r in back) == want
    many = condensed.condensed_samples(bits, layout, 30)
    assert 30 <= many.count() <= 58
    pol = bitstats.polarity(bits, layout)
    assert condensed.appended_polarity(pol, many, layout).count() == 24


def test_scales():
    assert features.largest_scale(np.array([0.0])) == 0
    assert features.largest_scale(np.array([0.0, 1.0])) == 65534
    assert features.largest_scale(np.array([0.0, 0.5, 1.0])) == 43689
    assert features.zmax(np.array([1.0, 1.0, 1.0]), 255) == 768 and features.largest_fitting(np.array([1.0, 1.0, 1.0]), 255) == 84
    assert features.largest_fitting(np.zeros(300), 255) is None


def test_cumulative(spark):
    df = spark.createDataFrame([("g", i, a) for i, a in enumerate([0.0, 1.0, 0.2, 1.0])], "g string, rank long, delta_norm double")
    assert [r.z for r in features.cumulative(df, "g", 10).orderBy("rank").collect()] == [0, 11, 14, 25]
    df = spark.createDataFrame([("g", i, a) for i, a in enumerate([0.0, 0.49, 0.5, 1.0])], "g string, rank long, delta_norm double")
    assert [r.z for r in features.cumulative(df, "g", 1).orderBy("rank").collect()] == [0, 1, 3, 5]
    with pytest.raises(PySparkException):
        features.cumulative(df, "g", 60000).collect()


def test_adaptive_equals_bisection(spark):
    rnd = np.random.default_rng(8)
    rows = [(g, int(v)) for g in range(5) for v in np.unique(rnd.integers(0, 10**6, [1, 2, 30, 400, 2000][g]))]
    norm = features.normalized(features.rank_delta(spark.createDataFrame(rows, "g long, v long"), "g", "v"), "g")
    got = features.adaptive(norm, "g").toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values("rank")
        a = part.delta_norm.to_numpy()
        scale = features.largest_scale(a)
        assert set(part["scale"]) == {scale}
        assert part.z.tolist() == (np.arange(len(a)) + np.floor(scale * a).cumsum().astype(int)).tolist()
        assert part.z.max() <= 65535


def test_interleaved_key(spark):
    df = spark.createDataFrame([(0b1,), (0x800000,), (0xFFFFFF,)], "v long").select(features.interleaved_key(F.col("v")).alias("k"))
    order = sorted(range(24), key=lambda p: (7 - p % 8, p // 8))
    assert [r.k for r in df.collect()] == [1 << (23 - order.index(0)), 1 << (23 - order.index(23)), 0xFFFFFF] and order[:3] == [7, 15, 23]


def test_pooling(spark):
    d = np.array([2, 28, 5])
    assert np.isclose(features.pool(d, 16).mean(), (np.log2(1 + d) / 24).mean()) and not features.pool([], 4).any()
    rows = [("a", int(v)) for v in np.cumsum([5, 2, 28, 5, 9, 1, 77])] + [("b", 4)]
    ranked = features.rank_delta(spark.createDataFrame(rows, "g string, v long"), "g", "v")
    for bins in (1, 4, 16):
        got = features.pooled(ranked, "g", bins).orderBy("g", "bin").collect()
        assert np.allclose([r.pooled for r in got if r.g == "a"], features.pool([2, 28, 5, 9, 1, 77], bins))
        assert [r.pooled for r in got if r.g == "b"] == [0.0] * bins


def test_colours_are_reversible(spark):
    steps = F.sequence(F.lit(0), F.lit(255), F.lit(17))
    cube = spark.range(1).select(F.explode(steps).alias("r")).withColumn("g", F.explode(steps)).withColumn("b", F.explode(steps))
    coded = cube.select("r", "g", "b", F.array(*px.ycocg_r(F.col("r"), F.col("g"), F.col("b"))).alias("c"))
    back = px.from_ycocg_r(F.col("c")[0], F.col("c")[1], F.col("c")[2])
    assert coded.where((back[0] != F.col("r")) | (back[1] != F.col("g")) | (back[2] != F.col("b"))).count() == 0 and cube.count() == 4096
    one = spark.createDataFrame([(10, 20, 30)], "r int, g int, b int").select(*px.ycocg_r(F.col("r"), F.col("g"), F.col("b")))
    assert tuple(one.first()) == (20, 108, 128)
    z = spark.createDataFrame([(v,) for v in (0, -1, 1, -2, 2)], "v int").select(px.zigzag(F.col("v")))
    assert [r[0] for r in z.collect()] == [0, 1, 2, 3, 4]


def test_pixel_groups(spark):
    rows = [(0, y, x, (5 * x + 3 * y) % 256) for y in range(5) for x in range(7)]
    df = spark.createDataFrame(rows, "image int, y int, x int, r int")
    groups = pixels.grouped(df, "image", ["r"], 3, 2, 7, 5)
    assert groups.count() == 9 and groups.where("gx = 2 and gy = 2").first().r == [rows[34][3], 0, 0, 0, 0, 0]
    assert sorted(map(tuple, pixels.ungrouped(groups, "image", ["r"], 3, 2, 7, 5).collect())) == sorted(rows)
    low = groups.select(pixels.minimum(F.array(F.lit(4), F.lit(2), F.lit(9), F.lit(2))).alias("m")).first().m
    assert (low.low, low["at"], low.rest) == (2, 1, [2, 7, 0])
    assert [pixels.group_bits(6, t) for t in ("raw", "first_pixel", "minimum")] == [48, 53, 51]
    assert pixels.crop_groups(groups, 0, 0, 3, 1, 3, 2).count() == 2
    big = pixels.resized(df, "image", ["r"], 7, 5, 14, 10)
    assert big.count() == 140
    same = pixels.resized(df, "image", ["r"], 7, 5, 7, 5).select("image", "y", "x", "r")
    assert sorted(map(tuple, same.collect())) == sorted(rows)


def test_audits(spark):
    df = spark.createDataFrame([("a", 200, 100, 50), ("b", 300, 900, None), ("c", 100, 60, 0)], "id string, raw_bytes long, igd_bytes long, png_bytes long")
    two = df.where("id != 'c'")
    s = audit.summarize(two).first()
    assert s.expansions == 1 and s.paired == 1 and s.saving_paired_pct == -100 and s.raw_bytes == 500
    d = audit.describe(spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double"), "v").first()
    assert (d["count"], d["median"], d["std"]) == (2, 2.0, 1.0)
    with pytest.raises(errors.MissingKey):
        audit.total_join(df, two.select("id"), ["id"])
    with pytest.raises(errors.DuplicateKey):
        audit.total_join(df, df.union(two).select("id"), ["id"])
    with pytest.raises(PySparkException):
        audit.total_join(two, df.select("id", (F.col("raw_bytes") + 1).alias("other")), ["id"], {"raw_bytes": "other"}).collect()
    assert audit.same_set(df, df.union(two), "id") and not audit.same_set(df, two, "id")
    assert audit.same_rows(df, df) and not audit.same_rows(df, df.union(two))
    plan = audit.plan(df, spark.createDataFrame([("a", 40), ("b", 3)], "id string, k long"), "id", 32)
    assert {r.id: r.action for r in plan.collect()} == {"a": "copy", "b": "recompress", "c": "compress"}
    q = audit.nearest_rank(spark.range(1, 12).toDF("v"), "v", [0.05, 0.5, 0.95])
    assert sorted(tuple(r) for r in q.collect()) == [(0.05, 1), (0.5, 6), (0.95, 11)]


def test_evaluation(spark):
    rows = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)]
    df = spark.createDataFrame(rows, "target int, prediction int")
    counts = evaluate.confusion(df, [0, 1, 2, 3])
    assert counts.count() == 16 and counts.agg(F.sum("count")).first()[0] == 5
    m = {r["class"]: r for r in evaluate.class_metrics(counts).collect()}
    assert m[3].recall is None and m[1].recall == 1.0 and m[2].precision is None and round(m[1].f1, 4) == 0.8
    zero = evaluate.class_metrics(counts, undefined=0.0, percent=True)
    assert {r["class"]: r.recall for r in zero.collect()}[3] == 0.0
    assert evaluate.range_edges({1: 50, 3: 60, 9: 30}) == [0, 16]
    assert evaluate.range_edges({1: 150, 3: 160, 9: 30}) == [0, 2, 16] and evaluate.range_edges({}) == []
    p = spark.createDataFrame([([0.2, 0.5, 0.5], 2)], "p array<double>, t int")
    r = evaluate.predictions(p, "p", "t").first()
    assert (r.prediction, r.confidence, r.p_true, r.correct) == (1, 0.5, 0.5, False)
    h = spark.createDataFrame([("r", e, a) for e, a in enumerate([1.0, 1.1, 1.3, 1.4, 1.45, 2.0])], "run string, epoch int, acc double")
    assert tuple(evaluate.hysteresis(h, "run", "epoch", "acc", 0.2).first()) == ("r", 5, 2.0)
    split = evaluate.stratified_split(spark.range(100).withColumn("l", F.col("id") % 3), "l", "id", 0.25)
    assert {(r.l, r["count"]) for r in split.where("split = 'val'").groupBy("l").count().collect()} == {(0, 9), (1, 8), (2, 8)}
    with pytest.raises(errors.InvalidConfig):
        evaluate.sweep(df, "target", F.lit(True), [])


def test_samples_and_texts(spark):
    df = spark.range(200).toDF("k")
    a, b = (sampling.random_rows(df.repartition(n), "k", 0.1).collect() for n in (3, 9))
    assert sorted(a) == sorted(b) and len(a) == 20
    assert [r.k for r in sampling.sequential_rows(df, "k", 0.02, 5).orderBy("k").collect()] == [5, 6, 7, 8]
    names = spark.createDataFrame([("C:\\x\\img_1.network.npz",), ("a/b/img_2.igd",), ("img_3.PNG",)], "p string")
    assert [r[0] for r in names.select(tx.image_id(F.col("p"))).collect()] == ["img_1", "img_2", "img_3.PNG"]
    assert tx.with_extension("a", ".csv") == "a.csv" and tx.with_extension("a.CSV", ".csv") == "a.CSV"
    assert (tx.size_text(10), tx.size_text(2048), tx.duration_text(0.5), tx.duration_text(90)) == ("10 B", "2.00 KB", "500.0 ms", "1 min 30 s")


def test_carried_over_partitions(spark):
    rows = [(i, None if i % 3 else float(i), None if i < 5 or i % 7 else i) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, x double, y long").repartition(5)
    for strategy, step in (("forward", 1), ("backward", -1)):
        want, x, y = {}, None, None
        for i, a, b in rows[::step]:
            x, y = (x if a is None else a), (y if b is None else b)
            want[i] = (i, x, y)
        got = [tuple(r) for r in tabular.fill_nulls(df, strategy, order="i").orderBy("i").collect()]
        assert got == [want[i] for i in range(60)]
    before = {r.i: r.b for r in with_previous(df, ["i"], "y", "b").collect()}
    assert before == {0: None} | {i: rows[i - 1][2] for i in range(1, 60)}


def test_describe_groups(spark):
    rnd = np.random.default_rng(5)
    rows = [(None if k == 2 else k, float(v)) for k, n in ((0, 1), (1, 400), (2, 37)) for v in rnd.integers(0, 90, n)]
    df = spark.createDataFrame(rows, "k int, v double")
    for by in (["k"], []):
        for r in audit.describe(df, "v", by).collect():
            own = [v for k, v in rows if not by or k == r.k]
            assert r["count"] == len(own) and np.allclose([r.p05, r.median, r.p95, r.p99], np.percentile(own, [5, 50, 95, 99]))
        want = {(k if by else None, p): sorted(v for g, v in rows if not by or g == k)[round((sum(not by or g == k for g, _ in rows) - 1) * p)] for k in {k for k, _ in rows} for p in (0.1, 0.5)}
        assert {(r.k if by else None, r.p): r.v for r in audit.nearest_rank(df, "v", [0.1, 0.5], by).collect()} == want
    assert audit.describe(df.limit(0), "v", ["k"]).collect() == []
