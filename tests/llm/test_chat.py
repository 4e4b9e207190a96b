import hashlib

import duckdb
import pyarrow as pa
from plumbline.llm import chat
from pyspark.sql import functions as F


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 1, "message", "user", "Hi"), (1, 2, 2, "message", "assistant", ""), (1, 3, 2, "delta", None, "Hel"), (1, 4, 2, "delta", None, "lo"),
        (1, 5, 1, "edit", None, "Hi there"), (1, 6, 2, "regenerate", None, None), (1, 8, 2, "delta", None, "body"), (1, 7, 2, "delta", None, "Some"),
        (1, 9, 3, "unknown", "user", "x"), (2, 1, 1, "delta", "assistant", "a"), (2, 2, 1, "delta", None, "b"), (None, 1, 1, "message", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, target long, kind string, role string, text string")
    got = sorted(map(repr, map(tuple, chat.fold(events).collect())))
    assert got == sorted(map(repr, [(1, 1, "user", "Hi there"), (1, 2, "assistant", "Somebody"), (2, 1, "assistant", "ab"), (None, 1, "", "")]))
    made = {r.conv_id: r for r in chat.render(chat.fold(events)).collect()}
    assert made[1].formatted == "### user:\nHi there</turn>\n### assistant:\nSomebody</turn>\n"
    assert [tuple(m) for m in made[1].loss_mask] == [(1, 16, 8)]


ROWS = [
    (1, 1, "assistant", "b</turn>\n### user:\n\\l"), (1, 0, "user", "\\### Assistant: </turn> ok \\\\b\\h"), (1, 2, None, None), (1, 3, "assistant", ""),
    (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, "system", "first é😀"), (None, 0, "assistant", "x"), (2, 0, "a:\nb#", "role"),
    (3, 5, "assistant", "### </turn>\\" * 20_000), (4, 0, "user", " \n "),
]


def test_read_back(spark):
    table = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("formatted", F.lit(2))
    got = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    by = {}
    for conv, turn, role, text in ROWS:
        by.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), digest("".join(f"{x}\n{t}\n" for _, _, x, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), digest(loss))
    assert chat.format_conversations(table.where("false")).count() == 0


def test_against_sql(spark):
    rows = [r for r in ROWS if r[1] is not None]
    control = "\\### Assistant: </turn> ok"
    table = spark.createDataFrame(rows + [(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(table).collect()
    conversations = pa.table({k: list(v) for k, v in zip(("conv_id", "turn", "role", "text"), zip(*rows))})
    con = duckdb.connect()
    con.register("conversations", conversations)
    cur = con.execute(chat.ORACLE)
    names = [c[0] for c in cur.description]
    assert sorted(repr(tuple(r[n] for n in names)) for r in got) == sorted(map(repr, cur.fetchall()))


def test_the_derived_log_holds_every_kind_and_folds_to_the_turns(spark):
    table = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    log = chat.streamed_log(table)
    kinds = {(r.kind, r.role or "") for r in log.select("kind", "role").distinct().collect()}
    assert {k for k, _ in kinds} == {"message", "delta", "edit", "regenerate"}
    drafts = log.where("kind = 'message' AND length(text) > 0").count()
    assert drafts == sum(bool(t) for _, _, _, t in ROWS)
    for parts in (1, 2, 4, 7):
        back = chat.fold(chat.streamed_log(table, parts), ("turn", "copy")).collect()
        assert sorted(repr((r.conv_id, r.turn, r.role, r.text)) for r in back) == sorted(repr((c, t, r or "", x or "")) for c, t, r, x in ROWS)
