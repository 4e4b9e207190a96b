import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from plumbline.llm import suffix_dedup as S

SMALL = "/root/testdata/sf0.001/documents.parquet"
L = S.LENGTH


def plain(rows):
    """repr of (doc_id, n_bytes, spans, kept) of every row, by the definition."""
    last = 1 << 63
    texts = [(last if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in texts:
        for p in range(len(t) - L + 1):
            w = t[p : p + L]
            first[w] = min(first.get(w, (d, p)), (d, p))
    out = []
    for (d, t), (given, _) in zip(texts, rows):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - L + 1):
            if first[t[p : p + L]] < (d, p):
                gone[p : p + L] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone].astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append(repr((given, len(t), spans, bytes(b for b, g in zip(t, gone) if not g))))
    return sorted(out)


def ours(df):
    return sorted(repr((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept))) for r in df.collect())


def made_up():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(60), prose(40)
    rows = [(None, None), (None, passage), (None, passage), (1, ""), (2, "a" * 99), (3, "a" * 99), (4, "a" * 100), (5, "a" * 450), (6, "ab" * 200 + prose(5)), (6, "x" + "ab" * 200)]
    for i in range(60):
        text = prose(rng.randint(0, 30)) + rng.choice(["", passage, passage[20:], other, passage + other, other + " " + other]) + prose(rng.randint(0, 30))
        rows.append((100 - i, text))
    near = list(passage + other + prose(50))
    for i in range(30):
        near[rng.randrange(len(near))] = rng.choice("xyz")
        rows += [(200 + i, "".join(near)), (200 + i // 2, "".join(near))]
    rows += [(7, rows[12][1]), (300, rows[12][1]), (300, rows[12][1]), (301, "é" * 120), (302, "x" + "é" * 120)]
    return rows


@pytest.mark.parametrize("crowded", [S.CROWDED, 3])
def test_agrees_with_the_definition(spark, crowded):
    rows = made_up()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS digest", "1 AS id", "2 AS kept").repartition(5)
    assert ours(S.remove_repeats(docs, crowded=crowded)) == plain(rows)


def test_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(SMALL, columns=["doc_id", "text"]).to_pylist()]
    assert ours(S.remove_repeats(spark.read.parquet(SMALL))) == plain(rows)


def test_long_text_in_steps(spark, monkeypatch):
    rng = random.Random(1)
    raw = bytes(rng.choice(b"abcdefgh") for _ in range(9000))
    whole = {(int(k), p) for k, s, n in zip(*S.runs(raw)) for p in range(s, s + abs(n))}
    monkeypatch.setattr(S, "STEP", 1000)
    parts = {(int(k), p) for k, s, n in zip(*S.runs(raw)) for p in range(s, s + abs(n))}
    assert whole == parts and len(whole) == len(raw) - L + 1


def test_blind_trie_orders():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(7)) + bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(500)]
    trie = S.BlindTrie()
    for i, s in enumerate(strings):
        trie.add(s, i)
    got = [[strings[i] for i in same] for same in trie.ordered()]
    assert [g[0] for g in got] == sorted(set(strings)) and all(len(set(g)) == 1 for g in got)
    assert sum(map(len, got)) == 500 and list(S.BlindTrie().ordered()) == []


def test_equal_windows_of_one_run_are_told():
    for period in (1, 3, 50, 61, 70, 99):
        rng = random.Random(period)
        unit = bytes(rng.randrange(256) for _ in range(period))
        text = bytes(rng.randrange(256) for _ in range(200)) + (unit * 300)[: 100 + period] + bytes(rng.randrange(256) for _ in range(200))
        seen = {}
        for k, s, n in zip(*S.runs(text)):
            for p in range(s, s + abs(n)):
                seen.setdefault(text[p : p + L], []).append((int(k), int(s), n < 0))
        for at in seen.values():
            if len(at) > 1:
                assert len({x[:2] for x in at}) > 1 or at[0][2]


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
