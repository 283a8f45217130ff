import random
from hashlib import sha256

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marquee.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


def test_ids_equal_the_library(library, codec):
    rnd = random.Random(1)
    chars = "aàé ß\t\n\r\x0b\x1c\x1f\x85\xa0​12٣½!'s't're<|endoftext|>😀́漢字 \x00　 _-ªµº×÷²¼"
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += ["<|endoftext|>x<|endoftext|>", "", "a" * 9000, "ab" * 3000 + " the", "é" * 999, " " * 700 + "x", "!" * 1000]
    texts += ["".join(chr(rnd.randint(1, 255)) for _ in range(40)) for _ in range(1000)]
    expected = library.encode_batch(texts, add_special_tokens=False)
    got = codec.encode(texts)
    assert got == [e.ids for e in expected]
    assert [codec.decode(ids) for ids in got] == [library.decode(e.ids, skip_special_tokens=False) for e in expected]


def test_scan_and_queue_agree(codec):
    rnd = random.Random(2)
    words = [bytes(rnd.choice(b"theingaou ") for _ in range(rnd.randint(1, 60))) for _ in range(500)]
    assert bpe.merge_scanned(words, codec.vocabulary) == [bpe.merge_queued(w, codec.vocabulary) for w in words]


def test_memory_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 10)
    fresh = bpe.Codec(PATH)
    texts = [f"word{i} other{i} the" for i in range(50)]
    assert [fresh.encode([t])[0] for t in texts] == codec.encode(texts)
    assert len(fresh.memory) <= 30


def test_rows(spark, make_documents, library):
    docs = make_documents([(1, "The thing <|endoftext|> x"), (2, None), (3, ""), (3, ""), (None, "two\n\n lines")]).withColumn("ids", F.lit(7))
    out = {(r.key, r.n_tokens): (r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(docs, PATH, F.col("doc_id"), F.col("text")).collect()}
    for key, text in [(1, "The thing <|endoftext|> x"), (2, ""), (3, ""), (None, "two\n\n lines")]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert out[key, len(ids)] == (sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest())
    rows = bpe.encoded(docs, PATH, F.col("doc_id"), F.col("text")).collect()
    assert len(rows) == 5 and all(len(r.ids) == 0 for r in rows if r.key == 3)
    assert bpe.token_digests(docs.limit(0), PATH, F.col("doc_id"), F.col("text")).count() == 0
