"""Operators 1, 3 and 10 against the libraries, and on odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from bitloom.llm import language, packing, pieces

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "  a  b ", "\n", "é漢😀", "</s> <unk> <0x41>", "<|endoftext|> x", "x" * 9000, " " * 500, "ab " * 5000, "1 234", "▁ ▁▁a", "Á ́b", "a b c\td\x00", "it's we'LL 'd", "<|startoftext|>a<|endoftext|>"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i else None, t, "clash", -1, "en" if i % 2 else None) for i, t in enumerate(ODD)] + [(5, "same", "a", 0, "de"), (5, "same", "a", 0, "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, offset int, lang string")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_pieces_equal_the_library(which, request):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df = request.getfixturevalue(which)
    want = []
    for r in df.collect():
        ids = sp.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    got = [tuple(r) for r in pieces.encode_documents(df, PIECES).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pieces_random_strings():
    import sentencepiece

    sp, enc, rnd = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.PieceEncoder(PIECES), random.Random(5)
    parts = ["the", " ", "  ", "a", "ing", "é", "漢", "😀", "▁", "\n", "e", "t", "00", "==", "-" * 20, " " * 17, "\x00", "'s", "tion"]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        ids = enc.encode(text)
        assert ids == sp.encode(text, add_eos=True) and enc.decode(ids) == sp.decode(ids)
    for text in ("=-" * 3000, "ab" * 4000, " " * 5000):
        assert enc.encode(text, eos=False) == sp.encode(text)
    for _ in range(300):
        ids = [rnd.choice([0, 1, 2, rnd.randrange(3, 259), rnd.randrange(259, 32000)]) for _ in range(12)]
        assert enc.decode(ids) == sp.decode(ids)


def test_pieces_empty_table(spark, odd):
    assert pieces.encode_documents(odd.limit(0), PIECES).collect() == []
    r = pieces.encode_documents(odd.where("text = 'same'"), PIECES, with_ids=True).collect()
    assert len(r) == 2 and r[0].decoded == "same" and r[0].ids[-1] == 2


@pytest.mark.parametrize("which", ["odd", "documents"])
@pytest.mark.parametrize("limits,chunk", [(packing.Limits(), 6_000_000), (packing.Limits(64, 3, 64), 500), (packing.Limits(64, 8, 40), 5000)])
def test_packing(which, limits, chunk, request):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    df = request.getfixturevalue(which)
    want = {}
    for r in df.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.setdefault(r.doc_id, []).append(ids)
    got = packing.pack_documents(df, WORDS, limits, chunk_tokens=chunk, with_ids=True).toPandas()
    assert got.length.min() > 0 and got.groupby("sequence_id").length.sum().max() <= limits.tokens
    assert got.groupby("sequence_id").size().max() <= limits.segments
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    for doc, g in got.groupby("doc_id", dropna=False):
        all_ids = want[None if pd.isna(doc) else doc]
        assert g.length.sum() == sum(map(len, all_ids))
        if len(all_ids) == 1:
            assert [i for x in g.sort_values("start").ids for i in x] == all_ids[0]
    if limits.loss == limits.tokens and limits.segments > 100:
        used = got.groupby("sequence_id").length.sum()
        padding = sum(0 if u & (u - 1) == 0 else limits.tokens - u for u in used)
        assert padding <= 0.01 * used.sum()


def test_packing_loss_column(spark):
    limits = packing.Limits(64, 8, 20)
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["red", "house", "river", "tree"]) for _ in range(rnd.randint(1, 90))), rnd.choice([0, 3, 10, 500, None, -4])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, answer int")
    got = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"), limits, loss_col="answer").collect()
    tokens, bearing, whole = {}, {}, {}
    for r in got:
        k = rows[r.doc_id][2]
        k = r.doc_tokens if k is None else min(max(k, 0), r.doc_tokens)
        tokens[r.sequence_id] = tokens.get(r.sequence_id, 0) + r.length
        bearing[r.sequence_id] = bearing.get(r.sequence_id, 0) + max(0, r.start + r.length - max(r.start, r.doc_tokens - k))
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert max(tokens.values()) == 64 and max(bearing.values()) == 20
    assert whole == {r.doc_id: r.doc_tokens for r in got} and len(whole) == len(rows)


def test_packing_loss_limit():
    rnd = np.random.default_rng(2)
    n = rnd.integers(1, 90, 400)
    loss = np.minimum(n, rnd.integers(0, 60, 400))
    p = packing.Packer(packing.Limits(64, 5, 30))
    bins = p.pack(n, loss)
    seen = {}
    for b in bins:
        assert len(b) <= 5 and sum(x[2] for x in b) <= 64
        assert sum(p._loss(int(n[i]), int(loss[i]), s, k) for i, s, k in b) <= 30
        for i, s, k in b:
            seen.setdefault(i, []).append((s, k))
    for i in range(400):
        at = 0
        for s, k in sorted(seen[i]):
            assert s == at
            at += k
        assert at == n[i]


def test_packing_empty(odd):
    assert packing.pack_documents(odd.limit(0), WORDS).collect() == []


def test_language(spark, documents):
    got = language.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    out = got[got.held_out & (got.lang_pred != "und")]
    assert len(out) > 100 and (out.lang_pred == out.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_odd(spark, odd):
    model = language.fit(odd)
    got = language.identify(odd, model, keep=["lang"]).toPandas()
    assert len(got) == odd.count() and set(got.lang_pred) <= {"en", "de", "und"} and "_keep_lang" in got
    plain = language.identify(odd, None).toPandas()
    assert set(plain.lang_pred) == {"und"} and set(plain.score) == {0.0}
    assert language.fit(odd.limit(0)) is None and language.identify(odd.limit(0), model).collect() == []
    by = {r.doc_id: r for r in got.itertuples()}
    assert by[1.0].lang_pred == "und" and by[12.0].lang_pred == "und" and by[3.0].lang_pred != "und"


def test_language_tables_equal_the_network():
    rnd = np.random.default_rng(0)
    net = language.ByteNetwork(["a", "b", "c"], window=32)
    x = rnd.integers(0, 256, (20, 32)).astype(np.uint8)
    pooled, _ = net._pooled(x)
    z = np.maximum(pooled, 0) @ net.p["o"]
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(z, net.log_probabilities(x), atol=1e-4)


def test_language_of_long_texts_in_pieces():
    net = language.ByteNetwork(["a", "b"], window=64)
    texts = ["some words " * 200, "x", "é" * 333, None, "other words here " * 90]
    whole, parts = net.predict(texts), net.predict(texts, piece=640)
    assert [w[0] for w in whole] == [p[0] for p in parts] and np.allclose([w[1] for w in whole], [p[1] for p in parts])


def test_each_limit_binds():
    rnd = np.random.default_rng(2)
    small, long = rnd.integers(2, 40, 600), rnd.integers(1500, 9000, 40)
    n = np.concatenate([small, long, rnd.integers(50, 1500, 200)])
    loss = n - np.floor(n * packing.INSTRUCTION["prompt_share"]).astype(np.int64)
    p = packing.Packer(packing.INSTRUCTION["limits"])
    bins = p.pack(n, loss)
    tokens = [sum(k for *_, k in b) for b in bins]
    bearing = [sum(p._loss(int(n[i]), int(loss[i]), s, k) for i, s, k in b) for b in bins]
    assert max(tokens) == 4096 and max(map(len, bins)) == 32 and 3700 < max(bearing) <= 3840
    assert all(t == 4096 or t & (t - 1) == 0 for t in tokens) and sum(tokens) == n.sum()
    loose = packing.Packer(packing.Limits()).pack(n, loss)  # without the two limits, both are overstepped
    assert max(map(len, loose)) > 32
    assert max(sum(p._loss(int(n[i]), int(loss[i]), s, k) for i, s, k in b) for b in loose) == 4096
    assert sum(t == 4096 for t in tokens) > 0.6 * n.sum() / 4096


def test_dot_product_choice(monkeypatch):
    """The placement against the heuristic written plainly, item by item."""
    rnd = np.random.default_rng(4)
    p = packing.Packer(packing.Limits(50, 6, 30))
    monkeypatch.setattr(packing.Packer, "_fill", lambda self, bins, lengths, loss: bins)
    for _ in range(30):
        n = rnd.integers(1, 30, 60)
        loss = np.minimum(n, rnd.integers(0, 30, 60))
        need = [(a / 50, 1 / 6, k / 30) for a, k in zip(n.tolist(), loss.tolist())]
        mean = [sum(x) / 60 for x in zip(*need)]
        value = lambda i, free: sum(a * m * f for a, m, f in zip(need[i], mean, free))  # noqa: E731, B023
        todo, want = set(range(60)), []
        while todo:
            free, held = (1.0, 1.0, 1.0), []
            while fit := [i for i in todo if all(a <= f + 1e-12 for a, f in zip(need[i], free))]:
                best = max(fit, key=lambda i: (round(value(i, free), 12), round(value(i, (1, 1, 1)), 12), -i))  # noqa: B023
                held.append(best)
                todo.remove(best)
                free = tuple(f - a for a, f in zip(need[best], free))
            want.append(held)
        got = [[x[0] for x in b] for b in p.pack(n, loss)]
        assert [sorted((n[i], loss[i]) for i in b) for b in got] == [sorted((n[i], loss[i]) for i in b) for b in want]


def test_windows_of_whole_texts(spark):
    text = "".join(f"{i:07d}|" for i in range(4000))
    df = spark.createDataFrame([(i, text[:4096] if i % 2 else text, "en") for i in range(1, 40)], "doc_id long, text string, lang string")
    got = {len(t): t for _, t, _ in language.training_rows(df)}
    assert got[4096] == text[:4096] and len(got) == 2
    pieces = got[8 * 512 + 7].split(" ")
    assert [len(x) for x in pieces] == [512] * 8 and text.startswith(pieces[0]) and text.endswith(pieces[-1])


def test_gradients_against_differences():
    """What fit's Adam step uses as its gradient, against differences of the loss."""
    rnd = np.random.default_rng(0)
    x, y = rnd.integers(0, 256, (6, 20)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    net = language.ByteNetwork(["a", "b"], window=20, d=3, f=2)
    grad = net.gradients(x, y)

    def loss():
        pooled, _ = net._pooled(x)
        z = np.maximum(pooled, 0) @ net.p["o"] + net.p["ob"]
        z -= z.max(1, keepdims=True)
        return -np.mean((z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(len(y)), y])

    for k in net.p:
        flat, g = net.p[k].reshape(-1), grad[k].reshape(-1)
        for at in rnd.choice(len(flat), min(12, len(flat)), replace=False):
            old, eps = flat[at], 1e-5
            flat[at] = old + eps
            up = loss()
            flat[at] = old - eps
            down = loss()
            flat[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-5, (k, at)
