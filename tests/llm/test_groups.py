"""Operators 4, 7 and 9 and the components against brute force, and on odd inputs."""

import random
import re

import numpy as np
import pytest

from bitloom.llm import components, minhash, neardup, search


def closure(nodes, links):
    low = {n: n for n in nodes}

    def top(n):
        while low[n] != n:
            n = low[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        low[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(rnd.randrange(2000, 2600), rnd.randrange(2000, 2600)) for _ in range(350)] + [(5, 5), (-7, 3000)]
    want = closure({n for e in edges for n in e if e[0] != e[1]}, edges)
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_by_force(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = []
    for x in range(len(sets)):
        for y in range(x):
            (a, s), (b, u) = sets[x], sets[y]
            if a is not None and b is not None and s and u:
                n = len(s & u)
                if 100 * n >= 75 * (len(s) + len(u) - n):
                    links.append((a, b))
    comp = closure({i for i, _ in sets if i is not None}, links)
    return sorted(((i, len(s), comp.get(i), i is not None and comp[i] == i) for i, s in sets), key=str)


def found(df):
    return sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)


@pytest.fixture(scope="module")
def copies(spark):
    """Copies, near copies in chains, short and empty texts, repeated rows, null ids."""
    rnd, rows = random.Random(8), []
    vocabulary = [f"w{i}" for i in range(500)] + ["É", "é", "Ab", "aB"]
    base = [[rnd.choice(vocabulary) for _ in range(120)] for _ in range(6)]
    for i in range(150):
        w = list(base[i % 6])
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 9])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((i + 1, rnd.choice([" ", "\n", "\t "]).join(w)))
    w = list(base[0])
    for i in range(40):  # a chain that drifts
        w[(i * 13) % 120] = f"x{i}"
        rows.append((500 + i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a b c"), (0, "a b"), (None, "a b"), (903, "a b"), (906, "x" * 50_000), (907, "v " * 30_000)]
    rows += [(None, None), (908, "a\x0bb"), (909, "a\x1fb"), (910, "aÉb é"), (911, "aéb é")]
    return rows


def test_near_duplicates(spark, copies):
    df = spark.createDataFrame([(i, t, "c", 7) for i, t in copies], "doc_id long, text string, key string, component_id int")
    assert found(df.repartition(5)) == near_by_force(copies)


def test_near_duplicates_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(df) == near_by_force([(r.doc_id, r.text) for r in df.collect()])


def test_near_duplicates_empty(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
    assert found(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == [(1, 0, 1, True), (2, 0, 2, True)]


def thue_morse(first, second, n):
    return "".join((first, second)[i.bit_count() & 1] for i in range(n))


def test_words_that_polynomial_hashes_confuse(spark):
    rows = [(1, thue_morse("a", "b", 1024)), (2, thue_morse("b", "a", 1024)), (3, thue_morse("a", "b", 4096)), (4, thue_morse("b", "a", 4096))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == [(i, 1, i, True) for i in (1, 2, 3, 4)]
    a, b = minhash.shingle_sets([rows[0][1], rows[1][1]], wide=True)
    assert not minhash.similar(a, b, 75) and minhash.similar(a, a, 100)


def test_links_need_both_halves_of_the_hashes():
    x = np.stack([np.arange(8, dtype=np.uint64), np.arange(8, dtype=np.uint64)], 1)
    y = x.copy()
    y[:3, 1] += np.uint64(1)  # the first halves are equal
    assert minhash.similar(x, x.copy(), 100) and not minhash.similar(x, y, 75)


def test_families_bounded_by_shingles(spark, copies, monkeypatch):
    whole = minhash.within_families
    monkeypatch.setattr(minhash, "within_families", lambda *a: whole(*a, block=7, block_shingles=500))
    assert found(spark.createDataFrame(copies, "doc_id long, text string")) == near_by_force(copies)


def test_long_texts_in_pieces():
    texts = ["A few words " * 400 + "end", "x" * 3000 + " y z\tw v u", "", "  lead " * 300]
    for a, b in zip(minhash.shingle_sets(texts), minhash.shingle_sets(texts, piece=500)):
        assert (a == b).all()


def test_odd_sketch_estimates():
    rnd = np.random.default_rng(1)
    for similarity in (0.75, 0.9):
        worst = 0
        for _ in range(30):
            common = rnd.integers(0, 2**64, int(1000 * similarity), np.uint64)
            a, b = (np.unique(np.concatenate([common, rnd.integers(0, 2**64, int(1000 * (1 - similarity) / 2), np.uint64)])) for _ in range(2))
            s = minhash.odd_sketches(np.stack([minhash.samples(a), minhash.samples(b)]))
            n = minhash._popcounts(s[0], s[1])
            assert n <= minhash.most_bits(0.75)
            worst = max(worst, abs(minhash.estimate(n) - similarity))
        assert worst < 0.2


def vectors(seed=4):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(400):
        x = rnd.normal(size=16)
        rows.append((i * 5, x, int(i % 3)))
    hub = rnd.normal(size=16)
    for i in range(150):
        rows.append((3000 + i, hub + rnd.normal(size=16) * 0.04 * np.linalg.norm(hub) / 4 * (i % 4), 1))
    rows = [(i, [float(np.float32(v)) for v in x], lab) for i, x, lab in rows]
    rows += [(7000 + i, rows[401][1], 1) for i in range(20)] + [(7100, rows[401][1], 2), (7101, rows[401][1], None)]
    rows += [(8000, None, 1), (8100, [], 1), (8200, [0.0] * 16, 1), (8300, [float("nan")] * 16, 1), (8400, [None] * 16, 1), (8500, [1.0, 2.0], 1), (8600, [2.0, 4.0], 1), (8700, [float("inf")] * 16, 1)]
    return rows + [(7000, rows[401][1], 1), (None, rows[401][1], 1)]


def usable(x):
    return bool(x) and None not in x and np.isfinite(x).all() and np.any(x)


SCHEMA = "vec_id long, embedding array<float>, label int, rank string, v int"


@pytest.mark.parametrize("cells,block", [(4096, 1024), (40, 16)])
def test_near_vectors(spark, cells, block):
    rows = vectors()
    want, links = [], []
    n = [0] * len(rows)
    for x in range(len(rows)):
        for y in range(x):
            (a, u, k), (b, w, m) = rows[x], rows[y]
            if k is not None and k == m and a is not None and b is not None and usable(u) and usable(w) and len(u) == len(w):
                u, w = np.array(u), np.array(w)
                if u @ w / np.sqrt((u @ u) * (w @ w)) >= 0.98:
                    links.append((a, b))
                    n[x] += 1
                    n[y] += 1
    comp = closure({r[0] for r in rows if r[0] is not None}, links)
    want = sorted(((r[0], k, comp.get(r[0]), r[0] is not None and comp[r[0]] == r[0]) for r, k in zip(rows, n)), key=str)
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA).repartition(5)
    got = neardup.near_vectors(df, cell_rows=cells, block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert max(n) > 50


def test_near_vectors_of_one_id(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [1.0, 0.001], 1), (9, [0.0, 1.0], 1), (3, [0.001, 1.0], 1), (5, [1.0, 0.0], 2)]
    got = neardup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == [(3, 2, 3, True), (5, 0, 5, True), (5, 1, 5, True), (5, 2, 3, False), (7, 1, 5, False), (9, 2, 3, False)]


def by_force(rows, every, k=10):
    out = {}
    for q, x, _ in rows:
        if q is not None and q % every == 0 and usable(x):
            x = np.array(x)
            near = sorted((float(np.sqrt(((np.array(y) - x) ** 2).sum())), i) for i, y, _ in rows if usable(y) and len(y) == len(x) and i is not None and i != q)
            out[q] = near[:k]
    return out


def test_search(spark):
    rows = vectors()
    want = by_force(rows, 100)
    got = search.search(spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA).repartition(5), block_rows=200, block_queries=3, shortlist=80).collect()
    hits = total = 0
    for q, near in want.items():
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(near) + 1))
        assert sorted((m[2], m[1]) for m in mine) == [(m[2], m[1]) for m in mine]
        hits += sum(abs(m[2] - w[0]) < 1e-9 and m[1] == w[1] for m, w in zip(mine, near))
        total += len(near)
    assert hits / total > 0.95 and {r.query_id for r in got} == {q for q, n in want.items() if n}


def test_search_recall(spark, sf):
    rows = [(r.vec_id, r.embedding, 0) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = by_force(rows, 25)
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "vec_id long, embedding array<float>")
    got = search.search(df, every=25, shortlist=60)
    got = {(r.query_id, r.vec_id) for r in got.collect()}
    exact = {(q, i) for q, near in want.items() for _, i in near}
    assert len(got & exact) / len(exact) >= 0.9


def test_search_is_exact_beyond_the_shortlist(spark, sf):
    df = spark.read.parquet(f"{sf}/../sf0.1/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in search.search(df, every=20).collect()}
    assert len(rows) > 1000 and len(got) == 10 * len(ids[ids % 20 == 0])
    for q in ids[ids % 20 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        near = np.lexsort((ids, d))[:10]
        assert [got[q, r][0] for r in range(1, 11)] == ids[near].tolist()
        assert np.allclose([got[q, r][1] for r in range(1, 11)], d[near])


def test_search_with_many_copies(spark):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(900, 8))
    x[rnd.permutation(900)[:400]] = x[0]
    x[700:730] = x[699]
    rows = [(int(i), v.tolist(), 0) for i, v in zip(rnd.permutation(900), x)]
    rows += [(51, x[0].tolist(), 0)] * 25 + [(61, x[0].tolist(), 0)] * 25 + [(1000, (x[0] + 1e-3).tolist(), 0)]
    df = spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<double>")
    met = search.classes(search.usable(df.repartition(7), "vec_id", "embedding"), 10).collect()
    assert len(met) == len({tuple(r[1]) for r in rows}) and max(len(r.ids) for r in met) == 20
    want = by_force(rows, 50)
    runs = [sorted(map(tuple, search.search(df.repartition(n), every=50, block_rows=5000, shortlist=20).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]
    for q, near in want.items():
        mine = [r for r in runs[0] if r[0] == q]
        assert [r[1:3] for r in mine] == [(n + 1, i) for n, (_, i) in enumerate(near)]
        assert np.allclose([r[3] for r in mine], [d for d, _ in near])


def test_vectors_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert neardup.near_vectors(df).collect() == [] and search.search(df).collect() == []
    one = spark.createDataFrame([(100, [1.0], 1, "", 0), (1, None, 1, "", 0)], SCHEMA)
    assert search.search(one).collect() == []
    assert sorted(map(tuple, neardup.near_vectors(one).collect())) == [(1, 0, 1, True), (100, 0, 100, True)]
