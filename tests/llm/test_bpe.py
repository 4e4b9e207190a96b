import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from plumbline.llm import bpe
from pyspark.sql import functions as F

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SMALL = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(PATH)


@pytest.fixture(scope="module")
def known(coder):
    ranks = {t.encode("latin-1"): r for t, r in coder.rank.items()}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(coder, known):
    rng = random.Random(1)
    kinds = ["abc ", "  \n\t'sdmtlvre", "éüßñ日本語한국", "0123456789", "\x1c\x85\xa0 ​<|endoftext|>#*", "😀👩‍👩é"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "a" * 30_000, "ab" * 9000, "日" * 3000, " x" * 300 + "y" * 200 + " ", "don't  stop\n\n now"]
    for t in texts:
        ids = [int.from_bytes(x, "little") for x in zip(*[iter(coder.encode([t])[0])] * 4)]
        assert ids == known.encode_ordinary(t)
        assert coder.decode(ids).decode() == t


def test_pieces_whose_seams_need_backtracking(coder, known):
    rng = random.Random(2)
    tokens = [t for t in coder.text if t.isascii() and t.isalpha()]
    for _ in range(20_000):
        word = "".join(rng.choice(tokens) for _ in range(rng.randint(2, 5)))
        assert coder.piece(word) == known.encode_ordinary(word)


def test_round_trip_of_a_table(spark, known):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(SMALL).select("doc_id", "text").collect()]
    rows += [(None, "tie"), (1, None), (1, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(0))
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert back.columns == ["doc_id", "text", "ids", "decoded"]
    for r in back.collect():
        assert r.ids == known.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    empty = docs.where("false")
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0
    assert bytes(bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).first().decoded) == b""


def test_query(spark, known):
    from plumbline.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(SMALL).collect()}
    rows = QUERIES["op2_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = known.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
