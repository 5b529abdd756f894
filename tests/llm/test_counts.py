"""Operator 6 against encoding everything again."""

import random

import public_tokenizers
import pytest

from bitloom.llm import counts
from bitloom.llm.common import stored

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_edits(enc):
    rnd, cache = random.Random(6), counts.counter(PATH)
    bits = ["word", " ", "  ", "\n", " \n", "a", "'s", "é", "漢", "12", ".", " the", "\t", "\x1c", "\xa0", "😀", " x y z", "longer text with many words "]
    for _ in range(250):
        text = "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 3, 30, 400])))
        tree = counts.TokenTree(text, cache)
        assert tree.tokens == len(enc.encode_ordinary(text)) and tree.text == text
        for _ in range(8):
            s = rnd.randint(0, len(text))
            e = min(len(text), s + rnd.choice([0, 0, 1, 2, 9, 60, 10_000]))
            new = "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 2, 5, 200])))
            tree.edit(s, e, new)
            text = text[:s] + new + text[e:]
            assert tree.text == text and tree.chars == len(text)
            assert tree.tokens == len(enc.encode_ordinary(text))


def test_few_parts_are_encoded_again():
    tree = counts.TokenTree("some words " * 20_000, counts.counter(PATH))
    assert tree.edit(100_000, 100_003, "other") <= 6
    with pytest.raises(ValueError):
        tree.edit(5, 10**9, "")


def test_documents(spark, sf, enc):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in counts.count_edited(df, PATH).collect()}
    for r in df.collect():
        text = r.text
        assert got[r.doc_id].n_tokens == len(enc.encode_ordinary(text))
        for s, e, new in counts.script(r.doc_id, text):
            text = text[:s] + new + text[e:]
        assert got[r.doc_id].n_tokens_edited == len(enc.encode_ordinary(text))


def test_odd(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, " ", 3), (2, " ", 3), (3, "x" * 100_000, 4), (4, "a " * 50_000, 5)], "doc_id long, text string, n_tokens long")
    assert len(counts.count_edited(df, PATH).collect()) == 6 and counts.count_edited(df.limit(0), PATH).collect() == []


def test_trees_are_kept_and_edits_come_as_a_table(spark, sf, enc):
    """Two rounds: the second takes up the trees that the first left, and encodes only what it touches."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    edits = counts.edit_table(df)
    by_id = {}
    for e in sorted(edits.collect()):
        by_id.setdefault(e.id, []).append((e.start, e.end, e.new))
    assert by_id == {r.doc_id: counts.script(r.doc_id, r.text or "") for r in df.collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    kept, now = stored(counts.trees(df, PATH)), df
    for _ in range(2):
        out = stored(counts.edited(now, kept, edits, PATH, with_trees=True)).cache()
        for r in out.collect():
            text = texts[r.doc_id]
            assert r.n_tokens == len(enc.encode_ordinary(text))
            for s, e, new in by_id[r.doc_id]:
                text = text[: min(s, len(text))] + new + text[min(e, len(text)) :]
            assert r.text == text and r.n_tokens_edited == len(enc.encode_ordinary(text)) and r.n_encoded <= 3 * 40
            texts[r.doc_id] = text
        now, kept = out.select("doc_id", "text"), out.selectExpr("doc_id as id", "digest", "counts")


def test_edit_tables_with_odd_rows(spark, enc):
    df = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (2, "x y z", 3), (2, "x y z", 3), (2, "other", 4)], "doc_id long, text string, id long")
    rows = [(2, 1, 0, 1, "one"), (2, 1, 0, 1, "One"), (2, 0, 3, 99, None), (1, 0, -5, 99, "new words"), (None, 0, 0, 1, "q"), (2, 2, None, 3, "q"), (9, 0, 0, 0, "q")]
    edits = spark.createDataFrame(rows, "id long, seq int, start long, end long, new string")
    got = counts.edited(df, counts.trees(df, PATH), edits, PATH, with_trees=True).collect()
    # of 2: cut from 3 on, then "One" and "one" in the place of the first character
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", "new words"), ("2", "onene y"), ("2", "onene y"), ("2", "oneneth"), ("None", "a b")]
    for r in got:
        assert r.n_tokens_edited == len(enc.encode_ordinary(r.text))
        assert sum(counts.unpacked(bytes(r.counts))) == r.n_tokens_edited
    assert len(got) == 5 and counts.edited(df.limit(0), counts.trees(df, PATH), edits, PATH).collect() == []
    with pytest.raises(Exception, match="no tree is kept"):
        counts.edited(df, counts.trees(df, PATH).where("id = 2"), edits, PATH).collect()
