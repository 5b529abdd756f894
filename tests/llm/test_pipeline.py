"""The pipeline's stages and its end against brute force on a small table."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_groups import closure, shingles
from test_spans import secret_base

import corpus_pipeline
from bitloom.llm import secrets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rnd, out = random.Random(12), []
    words = {"en": ["the", "house", "of", "and", "river", "green", "with", "thing", "was", "over", "where", "they"], "de": ["der", "und", "haus", "über", "schön", "nicht", "fluß", "straße", "ein", "auch", "während", "möchte"]}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) + rnd.choice(["", "", str(rnd.randrange(99))]) for _ in range(n))
    shared = text("en", 40)
    for i in range(60):
        lang = "en" if i % 3 else "de"
        t = text(lang, rnd.choice([8, 30, 120]))
        if i % 7 == 0:
            t += " " + shared + " " + text(lang, 60)
        if i % 11 == 0:
            t += f' token = "{rnd.randrange(16**10):010x}" then password: aaaaaaaaa{i}'
        out.append((i + 1, t, lang, f"s{i % 4}", len(t)))
    for k in range(8):  # copies and near copies
        w = out[2 * k + 20][1].split(" ")
        if k % 2 and len(w) > 100:
            w[50] = "changed"
        out.append((100 + k, " ".join(w), "en", "s9", 1))
    return out + [(200, None, None, None, None), (201, "", "en", "x", 0), (202, "12 34 !!", "en", "x", 8), (0, out[3][1], "de", "s1", 3)]


def test_stages(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, COLUMNS).coalesce(1)
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        sizes.append(len(after))
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        if name == "language":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {200, 201, 202}
        if name == "near_dedup":
            sets = {r.doc_id: shingles(r.text) for r in before}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            comp = closure(list(sets), links)
            assert {r.doc_id for r in after} == {i for i, c in comp.items() if i == c} and links
            assert set(after) <= set(before)
        if name == "suffix_dedup":
            seen, want = set(), {}
            for r in sorted(before, key=lambda r: r.doc_id):
                raw = r.text.encode()
                gone = np.zeros(len(raw), bool)
                for s in range(len(raw) - 99):
                    if raw[s : s + 100] in seen:
                        gone[s : s + 100] = True
                    seen.add(raw[s : s + 100])
                want[r.doc_id] = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
            assert {r.doc_id: r.text for r in after} == want and any(r.text != want[r.doc_id] for r in before)
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "secrets":
            want = {}
            for r in before:
                t = r.text
                for s, _, e in reversed(secret_base(t)):
                    t = t[:s] + "[secret]" + t[e:]
                want[r.doc_id] = t
            assert {r.doc_id: r.text for r in after} == want and any("[secret]" in t for t in want.values())
        if name == "packing":
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 2] for r in before}
            got = {}
            for r in after:
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
                assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
            assert got == {i: len(x) for i, x in want.items()}
    assert sizes[0] > sizes[1]


def test_language_rejects_what_was_not_learned(spark, rows):
    rnd = random.Random(5)
    letters = lambda a, n: " ".join("".join(rnd.choice(a) for _ in range(rnd.randint(2, 9))) for _ in range(n))
    odd = [letters("αβγδεζηθικλμνξοπρστυφχψω", 40), letters("абвгдежзийклмнопрстуфхцчшщыьэюя", 40), letters("bcdfghjklmnpqrstvwxzäöüß", 60), letters("漢字仮名交文日本語", 30)]
    mixed = [a[1] + " " + b[1] for a, b in zip([r for r in rows[:60] if r[2] == "en"][:5], [r for r in rows[:60] if r[2] == "de"][:5])]
    more = [(1000 + i, t, None, "z", len(t)) for i, t in enumerate(odd + mixed)]
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows + more, COLUMNS), "").collect()}
    assert kept == {r[0] for r in rows} - {200, 201, 202} | {1004, 1005, 1006, 1007, 1008}


def test_redact_overlaps_and_nulls(spark):
    a = "q9" * 20
    df = spark.createDataFrame([(1, f"x token: {a} é secret=abcdefgh", "s", 1), (2, None, "s", 1), (3, "", None, 1), (4, "plain", "s", 1), (4, "plain", "s", 1), (5, "token=short", "s", 1), (6, "é" + "0" * 40 + "😀AKIA" + "A" * 20, "t", 1)], "doc_id long, text string, source string, rid int")
    got = sorted((r.doc_id, r.text) for r in secrets.redact(df).collect() if r.text is not None)
    assert got == [(1, "x [secret] é [secret]"), (3, ""), (4, "plain"), (4, "plain"), (5, "token=short"), (6, "é[secret]😀[secret]")]
    assert secrets.redact(df).count() == 7 and secrets.redact(df.limit(0)).collect() == [] and secrets.redact(df).columns == df.columns


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_leave_other_columns_alone(spark, rows):
    """Names that the operators use themselves, with dots, and with backticks."""
    names = ["gone", "_rid", "rid", "_all", "all", "a.b", "_keep_x", "x`y", "found", "box", "id", "owner", "key", "starts", "c0", "DOC"]
    docs = spark.createDataFrame(rows, COLUMNS)
    columns = [c.split()[0] for c in COLUMNS.split(", ")]
    more = docs.toDF(*columns).select(*columns, *[F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")).alias(n) for i, n in enumerate(names)])
    more = spark.createDataFrame(more.collect(), more.schema).coalesce(1)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = (stage(spark, d, "") for d in (docs.coalesce(1), more))
        assert wide.columns == more.columns, name
        got = sorted((tuple(r) for r in wide.collect()), key=str)
        assert sorted((r[: len(columns)] for r in got), key=str) == sorted((tuple(r) for r in plain.collect()), key=str), name
        assert all(r[len(columns) :] == tuple(f"{i}:{r[0]}" for i in range(len(names))) for r in got), name
    assert corpus_pipeline.STAGES[-1][1](spark, more, "").count() >= len(rows)


def test_stages_with_null_ids_and_repeated_rows(spark, rows):
    text = rows[20][1]
    docs = spark.createDataFrame([(None, text, "en", "s1", 3), (None, None, "en", None, 0), (7, text, "en", "s1", 3), (7, text, "en", "s1", 3), (8, "", None, "s", 0)], COLUMNS).coalesce(1)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, "")
        assert out.count() == 5 and out.where("text is null").count() == 1, name
        assert stage(spark, docs.limit(0), "").columns == docs.columns and stage(spark, docs.limit(0), "").count() == 0
