import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from plumbline.llm import collocations as C


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0a-\x0d]", lowered)]


def plain(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in words_of(text):
            n[lang or "und"] += len(piece)
            for m in range(1, 5):
                for i in range(len(piece) - m + 1):
                    f[lang or "und"][tuple(piece[i : i + m])] += 1
    out = []
    for lang, found in f.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        ranked = []
        for p, a in candidates.items():
            if 100 * longer[p] < 80 * a:
                score, _, l, r = min((2_000_000 * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def ours(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made_up():
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "x\x1cy", "Ärger", "ÄRGER", "e", "\x00", "a#", "zz", " "] + [f"w{i}" for i in range(40)]
    weights = [40, 9, 20, 3, 3, 3, 3, 3, 3, 3, 3] + [1] * 40
    rows = [(None, "en"), ("", "en"), (" \t\n..", None), ("one", None), ("New York, New York new york", "und"), ("the of the of " * 400, "en"), ("b " * 700, "fr")]
    for i in range(200):
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\r\x0b", " ,"]) for w in rng.choices(vocabulary, weights, k=rng.randint(0, 60)))
        rows.append((text + rng.choice(["", "new york city hall is old", "New York City Hall"]), rng.choice(["en", "de", None])))
    return rows + rows[50:60] * 3


@pytest.mark.parametrize("window_range, least, chunk", [(C.RANGE, 4, C.CHUNK), (300, 4, 500), (50, 30, 97)])
def test_agrees_with_the_definition(spark, monkeypatch, window_range, least, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rows = made_up()
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "'x' AS phrase", "1 AS range").repartition(3)
    assert ours(C.collocations(docs, least=least, window_range=window_range)) == plain(rows, least)
    assert ours(C.collocations(docs, top=5, least=least, window_range=window_range)) == plain(rows, least, 5)


def test_oracle(spark):
    rows = [r for r in made_up() if "\x00" not in (r[0] or "")]  # DuckDB's translate ends at a NUL
    documents = pa.table({"text": [r[0] for r in rows], "lang": [r[1] for r in rows]})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(con.execute(C.ORACLE).fetchall()) == ours(C.collocations(spark.createDataFrame(rows, "text string, lang string")))


def test_automata():
    rng = random.Random(5)
    words = [b"a", b"b", b"c", b"dd"]
    for size in (1, 2, 300):
        some = np.array([sorted([rng.randint(1, 4) for _ in range(4)]) if rng.random() < 0.8 else [rng.randint(1, 4), 0, 0, 0] for _ in range(size)])
        windows, weights = C.summed(some)
        built = C.CountAutomaton.from_bytes(C.CountAutomaton.of_sorted(words, windows, weights).to_bytes())
        names, back, total = C.united([built, built])
        spelled = Counter()
        for row, w in zip(back.tolist(), total.tolist()):
            spelled[tuple(names[i - 1] for i in row if i)] += w
        want = Counter(tuple(words[i - 1] for i in row if i) for row in some.tolist())
        assert spelled == Counter({k: 2 * v for k, v in want.items()})
        prefixes = [(b"a",), (b"a", b"b"), (b"dd", b"dd", b"dd", b"dd"), (b"b", b"zz"), (b"zz",), (b"b", b"c", b"c")]
        assert built.compose(prefixes).tolist() == [sum(n for k, n in want.items() if k[: len(p)] == p) for p in prefixes]
    assert sum(len(s) for s in built.sizes) < len(windows)  # equal continuations are held once


def test_long_text_in_slices(monkeypatch):
    text = ("Ab cd. ef\tgh " * 50 + "x" * 40 + " ") * 3
    index = C._new_index()
    whole = C.ids_of(text.encode(), index)
    monkeypatch.setattr(C, "AT_ONCE", 5)
    assert (C.ids_of(text.encode(), index) == whole).all()


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
