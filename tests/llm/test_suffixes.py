"""Operator 8 against brute force, and its suffix sorting against sorting plainly."""

import hashlib
import random

import numpy as np
import pytest

from bitloom.llm import suffixes


def by_force(rows, length=100):
    """Rows of (id, text) in their order; nulls and ids as remove_repeated has them."""
    seen, out = set(), {}
    for at in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)):
        raw = (rows[at][1] or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        n = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[at] = (rows[at][0], len(raw), sum(gone), n, hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=str)


def found(df, **kw):
    return sorted((tuple(r)[:5] for r in suffixes.remove_repeated(df, **kw).collect()), key=str)


def test_suffix_order():
    rnd = random.Random(1)
    for _ in range(300):
        length = rnd.choice([8, 9, 16, 23])
        alphabet = rnd.choice([b"ab", b"a", b"abcdefgh", bytes(range(256))])
        segments = [bytes(rnd.choice(alphabet) for _ in range(length + rnd.randrange(30))) for _ in range(rnd.randint(1, 12))]
        segments += [segments[0]] * rnd.randint(0, 2) + [segments[-1][: length + 3]] * (len(segments[-1]) > length + 3)
        sizes = np.array([len(s) for s in segments])
        ends = np.cumsum(sizes)
        first, last, b = ends - sizes, ends - length, b"".join(segments)
        order = suffixes.suffix_order(np.frombuffer(b, np.uint8), first, last, ends, length)
        want = [p for f, e in zip(first, last) for p in range(f, e + 1)]
        assert sorted(order.tolist()) == want
        keys = [b[p : p + length] for p in order.tolist()]
        assert keys == sorted(keys)
        lcp = suffixes.common_prefixes(np.frombuffer(b, np.uint8), order, length)
        assert lcp.tolist() == [next((k for k in range(length) if x[k] != y[k]), length) for x, y in zip(keys, keys[1:])]


def test_anchors_do_not_depend_on_what_stands_around():
    rnd = np.random.default_rng(0)
    core = rnd.integers(97, 123, 400).astype(np.uint8)
    got = []
    for pad in (0, 37, 250):
        data = np.concatenate([rnd.integers(97, 123, pad).astype(np.uint8), core, rnd.integers(97, 123, 90).astype(np.uint8)])
        text, start, n, f, g = suffixes.runs(data, np.array([0, len(data)]))
        assert n.sum() == len(data) - 99 and (np.diff(start) == n[:-1]).all()
        got.append({(int(s) - pad, int(k), int(y)) for s, k, y in zip(start, n, g) if s >= pad and s + k <= pad + 301})
    assert len(set.intersection(*got)) >= 5


@pytest.fixture(scope="module")
def rows():
    rnd, out = random.Random(2), []
    word = lambda: "".join(rnd.choice("abcdefé") for _ in range(rnd.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rnd.choice([15, 20, 30, 60]))) for _ in range(8)]
    for i in range(90):
        parts = [" ".join(word() for _ in range(rnd.randrange(60))) for _ in range(3)]
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            parts.insert(rnd.randrange(4), p[rnd.randrange(30) :] if rnd.random() < 0.5 else p)
        out.append((1000 - 3 * i, rnd.choice(["", " "]).join(parts)))
    out += [(2000, out[5][1]), (1, out[6][1]), (None, out[7][1]), (2001, "a" * 700), (2002, "ab" * 300 + "a" * 150), (2003, None), (2004, ""), (2005, "x" * 99), (2006, "x" * 100), (2006, "x" * 100), (2007, "x" * 101), (None, None)]
    return out


def test_remove_repeated(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, rid int, f string").coalesce(1)
    assert found(df) == by_force(rows)
    assert found(df, hot_least=3, hot_most=3) == by_force(rows)
    several = df.where("doc_id is not null and doc_id != 2006").repartition(6)
    rest = by_force([r for r in rows if r[0] is not None and r[0] != 2006])
    assert found(several) == rest and found(several, hot_least=1, hot_most=1) == rest


def test_remove_repeated_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(df, hot_least=5, hot_most=5) == found(df) == by_force([(r.doc_id, r.text) for r in df.collect()])


def test_pieces_of_long_texts(monkeypatch):
    data = np.frombuffer(b"".join(b"%d," % i for i in range(3000)), np.uint8)
    offsets = np.array([0, len(data)])
    whole = {(s + k) for _, s0, n, *_ in [suffixes.runs(data, offsets)] for s, m in zip(s0, n) for k in range(m)}
    parts = []
    for s, part, o in suffixes._pieces(data, offsets, 0, 1, 100, most=1000):
        _, start, n, *_ = suffixes.runs(part, o)
        parts += [s + x + k for x, m in zip(start, n) for k in range(m)]
    assert sorted(parts) == sorted(whole)


def test_empty_and_kept_text(spark, rows):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert found(df) == []
    df = spark.createDataFrame([(1, "é" * 60, "p"), (2, "xé" + "é" * 60, "q")], "doc_id long, text string, source string")
    got = {r[0]: r for r in suffixes.remove_repeated(df, keep=["source"], with_text=True).collect()}
    assert (got[1].n_removed, got[1].kept_text) == (118, "é")
    assert (got[2].n_removed, got[2].kept_text, got[2]._keep_source) == (122, "x", "q")


def test_known_runs_that_follow_each_other_are_one_row(spark):
    rnd = random.Random(7)
    text = "".join(rnd.choice("abcdefghij ") for _ in range(3000))
    df = spark.createDataFrame([(i, i, x) for i, x in enumerate([text, "x" + text + "y", text[500:2500]])], "rid long, doc long, text string").coalesce(1)
    known = {r.rid: (r["at"] >> 8, r.g) for r in suffixes._anchored(df, 100).where("known").collect()}
    count = suffixes._anchored(df, 100).where("known").count()
    assert count == 2 and set(known) == {1, 2}  # a row for each copy, not one for each of its runs
    assert all(n > 255 for _, n in known.values())
    out = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.remove_repeated(df.withColumnRenamed("doc", "doc_id")).collect()}
    assert out == {0: (0, 0), 1: (3000, 1), 2: (2000, 1)}
