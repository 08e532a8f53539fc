"""SentencePiece against the library."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import pieces

PATH = public_tokenizers.path(pieces.MODEL)


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    alphabet = "abcdefghi nopqrstu  thein ▁\n0123456789é日ñ"
    strange = lambda: chr(r.choice([r.randint(0, 0x2FFF), r.randint(0x3000, 0xD7FF), r.randint(0x10000, 0x1FFFF)]))
    out = ["", None, " ", "  ", "a", "  two  spaces   three    ", "▁▁x ▁ y▁ z", "日本語 テスト 🎉🎉 é́", "\n\n\tfoo\x00bar\x0b", "a" * 800, "<s> </s> <unk> <0x41>", "the quick brown fox", "the quick brown fox"]
    out += [" " * n + tail for n in (*range(40), 1000, 1023) for tail in ("", "x", "日", " the")]
    out += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    out += ["".join(r.choice("ab ") for _ in range(r.randint(0, 60))) for _ in range(500)]
    out += ["".join(strange() for _ in range(30)) for _ in range(500)]
    return [*out, "".join(r.choice("abcdeinght") for _ in range(50_000))]


def test_model_equals_library(texts, lib):
    m = pieces.model(PATH)
    ids, at = m.encode(pa.array(texts))
    want = lib.encode([t or "" for t in texts], num_threads=1)
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == want
    assert [x.decode() for x in m.decode(ids, at)] == [lib.decode(x) if x else "" for x in want]


def test_decode_any_ids(spark, lib):
    r = random.Random(1)
    rows = [(k, [r.choice([r.randint(0, 300), r.randint(0, 31999)]) for _ in range(r.randint(1, 20))]) for k in range(500)]
    df = spark.createDataFrame([*rows, (500, []), (501, None), (502, [1, None, 2])], "k long, ids array<int>")
    got = {x.k: x.decoded for x in pieces.decode(df).collect()}
    assert got == {k: lib.decode(ids) for k, ids in rows} | {500: "", 501: "", 502: ""}


def test_query(spark, texts, lib):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "no id", None)], "doc_id long, text string, pieces string").repartition(3)
    got = {r.doc_id: r for r in pieces.round_trip(df.drop("pieces")).select("doc_id", "pieces.*").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for k, t in [*enumerate(texts), (None, "no id")]:
        ids = lib.encode(t or "")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids) if ids else ""))
    back = pieces.decode(pieces.encode(df.where("doc_id < 3000"), column="own"), ids="own").where(F.regexp_replace("text", pieces.SPACE, " ") != F.col("decoded"))
    assert back.count() == 0
    assert pieces.round_trip(df.limit(0)).count() == 0


def test_runs_of_tied_pieces():
    known = [False, True, True, True]  # pieces of 1 to 3
    assert [[x for x in row if x] for row in pieces.run_cuts(pieces.np.array(known)).tolist()] == [[], [1], [2], [3], [3, 1], [3, 2]]
    assert pieces.run_cuts(pieces.np.array([False, True, False, True])) is None
