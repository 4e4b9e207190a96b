import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from plumbline.llm import packing
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001/documents.parquet"


def check_bins(rows, length):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        assert at <= length
    return len(bins)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_of_all_kinds_of_text(library):
    ids = packing.Ids(PATH)
    rng = random.Random(1)
    kinds = ["abc ", "  \n\t'sdmtlvre", "éüßñÄŸɎ", "0123456789", "\x1c\x85\xa0<|endoftext|>#*²¼ªº×\xad", "日本語 ​😀"]
    texts = ["".join(rng.choice(rng.choice(kinds[: rng.randint(1, 6)])) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += [" " * 3000 + "x", "\n" * 120_000 + "x", "", "".join(map(chr, range(1, 0x250)))]
    end = "<|endoftext|>"
    texts += [end, f"a{end}b", f" a {end} b", end + end, f"x{end}{end}\n", "<|endoftext|", "<|ENDOFTEXT|>", "a <| b |>"]
    prose = "ab cd's 12 " * 10_000
    for run in (9_999, 10_000):  # both sides of each limit
        texts += [prose[: 100_000 - run] + " " * run, prose[: 100_001 - run] + " " * run, prose + "\t" * run + "x"]
    texts += ["a\u024fb", "a\u0250b"]
    for t in texts:
        assert np.frombuffer(ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_documents(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(SMALL).select("doc_id", "text").collect()]
    rows += [(900, None), (900, None), (None, "tie"), (901, "a b c d e f g " * 3000), (902, "a<|endoftext|>b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(5)).withColumn("bin", F.lit(5))
    got = packing.pack_documents(docs, PATH).collect()
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0] + list(range(first, len(ids) + 1, 2048))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(map(repr, [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got])) == sorted(map(repr, want))
    assert check_bins(got, 2048) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.pack_documents(docs.where("false"), PATH).count() == 0


@pytest.mark.parametrize("sizes, slack", [("mixed", 2), ("large", 2), ("halves", 2), ("one", 0)])
def test_many_small_blocks_merge(spark, tmp_path, sizes, slack):
    rng = random.Random(4)
    draw = {"mixed": lambda: rng.randint(1, 100), "large": lambda: rng.randint(51, 100), "halves": lambda: rng.choice([34, 50]), "one": lambda: 1}[sizes]
    given = [(i, draw()) for i in range(6000)]
    path = str(tmp_path / "items")
    spark.createDataFrame(given, "id long, length long").repartition(3).write.parquet(path)
    got = packing.pack(spark.read.parquet(path), length=100, block=400, slack=slack, fan=4, keep=8).collect()
    assert sorted((r.id, r.length) for r in got) == given
    bins = check_bins(got, 100)
    bound = -(-sum(s for _, s in given) // 100)
    if sizes == "large":  # no two fit together
        bound = len(given)
    elif sizes == "halves":  # two of a kind fill a sequence as far as it can be
        bound = len(given) / 2
    assert bins <= bound * 1.06 + 2


def test_best_fit_takes_the_fullest_bin_with_room():
    bins, offsets, fills = packing.best_fit(np.array([6, 5, 4, 5]), 10)
    assert bins.tolist() == [0, 1, 0, 1] and offsets.tolist() == [0, 0, 6, 5] and fills.tolist() == [10] * 4
    assert [x.tolist() for x in packing.best_fit(np.array([], np.int64), 10)] == [[], [], []]
