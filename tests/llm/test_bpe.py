import base64
import hashlib
import random

import __spark_entry__
import public_tokenizers
import tiktoken

from siftwork.llm import bpe
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def library() -> tiktoken.Encoding:
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_op4_is_what_the_library_gives_for_all_documents(spark):
    encode = library().encode_ordinary
    rows = __spark_entry__.queries()["op4_bpe"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == sha(",".join(map(str, want)).encode())
        assert r["decoded_sha256"] == sha((texts[r["doc_id"]] or "").encode())


def test_odd_texts(spark):
    rng, encode = random.Random(4), library().encode_ordinary
    texts = [None, "", " ", "a  b \n\n c", "it's we'll", "\u0085　x  y", "𝒳é ß漢字カナ 12³", "=" * 300, "=" * 700, "<|endoftext|> [INST]", "\u0000\u0001", "".join(rng.choice("abcDEF019é ") for _ in range(3000)), "".join(rng.choice("abAB") for _ in range(900)), "the end " * 60_000]
    texts += texts[3:6]
    rows = bpe.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, text in zip(rows, texts, strict=True):
        assert r["tokens"] == encode(text or "") and r["n_tokens"] == len(r["tokens"])
        assert r["text"] == text and bytes(r["decoded"]) == (text or "").encode()


def test_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b", "x", 7)], "doc_id long, text string, pieces string, tokens int")
    (row,) = bpe.encoded(docs).collect()
    assert row["pieces"] == "x" and row["doc_id"] is None and len(row["tokens"]) == 2
    assert bpe.encoded(docs.limit(0)).collect() == []


def test_odd_documents(spark):
    encode, docs = library().encode_ordinary, cases.documents(spark)
    rows = bpe.encoded(docs).collect()
    assert len(rows) == len(cases.ROWS)
    assert sorted((repr(r["doc_id"]), r["tokens"]) for r in rows) == sorted((repr(r[0]), encode(r[1] or "")) for r in cases.ROWS)
    assert bpe.encoded(docs).columns == [*docs.columns, "tokens", "n_tokens", "decoded"]
