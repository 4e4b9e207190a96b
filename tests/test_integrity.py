"""Record integrity and lineage over small tables, and the closure against a breadth-first search."""

import random
from collections import deque

from plumbline.operators import integrity as integ
from pyspark.sql import functions as F

COLUMNS = {
    "sources": "id string, kind string",
    "datasets": "id string, source_id string, row_count long, positive_label string",
    "dataset_columns": "dataset_id string, name string",
    "calls": "id string, investigation_id string, tool string, version int, requested_at timestamp_ntz, dataset_id string, comparison_dataset_id string, name string, positive_label string, hypothesis_id string, cost_evidence_id string, method string",
    "call_thresholds": "call_id string, threshold double",
    "results": "id string, call_id string, tool string, version int, status string, completed_at timestamp_ntz, hypothesis_id string, method string",
    "result_datasets": "result_id string, dataset_id string",
    "result_thresholds": "result_id string, threshold double",
    "evidence": "id string, kind string, route string, source_id string, dataset_id string, result_id string, experiment_id string, name string, first_row long, last_row long, measurements int, metric string, unit string",
    "result_evidence": "result_id string, evidence_id string",
    "hypotheses": "id string, status string",
    "hypothesis_evidence": "hypothesis_id string, evidence_id string, relationship string",
    "experiments": "id string, hypothesis_id string, status string, outcome string",
    "experiment_calls": "experiment_id string, call_id string",
    "experiment_evidence": "experiment_id string, evidence_id string",
    "repairs": "id string, hypothesis_id string, kind string, dataset_id string, criterion string, policy string, cost_evidence_id string",
    "repair_evidence": "repair_id string, evidence_id string",
    "comparisons": "id string, repair_id string, dataset_id string, metric string, unit string, criterion string, after_policy string, baseline_label string, after_label string, baseline_costs string, after_costs string, cost_evidence_id string",
    "comparison_evidence": "comparison_id string, side string, evidence_id string",
    "diagnoses": "id string, investigation_id string, primary_hypothesis_id string",
    "diagnosis_links": "diagnosis_id string, entity_id string",
    "record_events": "id string, kind string, entity_id string, moment timestamp_ntz",
}


def records(spark, **changed):
    """One sound investigation, some of whose tables are replaced."""
    import datetime as dt

    day = dt.datetime(2024, 1, 5)
    sound = {
        "sources": [("source_1", "uploaded_file"), ("assumption_1", "user_assumption")],
        "datasets": [("dataset_1", "source_1", 50, "1")],
        "dataset_columns": [("dataset_1", "y_true"), ("dataset_1", "site")],
        "calls": [("call_1", "investigation_1", "threshold_sweep", 1, day, "dataset_1", None, "site", "1", None, "evidence_9", None)],
        "call_thresholds": [("call_1", 0.25), ("call_1", 0.5)],
        "results": [("result_1", "call_1", "threshold_sweep", 1, "completed", day, None, None)],
        "result_datasets": [("result_1", "dataset_1")],
        "result_thresholds": [("result_1", 0.5), ("result_1", 0.25)],
        "evidence": [
            ("evidence_1", "measurement", "tool_result", None, None, "result_1", None, None, None, None, 1, "recall", "ratio"),
            ("evidence_2", "measurement", "experiment", None, None, None, "experiment_1", None, None, None, 1, "recall", "ratio"),
            ("evidence_3", "measurement", "source", "source_1", "dataset_1", None, None, "site", 1, 50, 1, "recall", "ratio"),
            ("evidence_9", "assumption", "source", "assumption_1", None, None, None, None, None, None, 0, None, None),
        ],
        "result_evidence": [("result_1", "evidence_1")],
        "hypotheses": [("hypothesis_1", "confirmed")],
        "hypothesis_evidence": [("hypothesis_1", "evidence_1", "supports")],
        "experiments": [("experiment_1", "hypothesis_1", "completed", "supports")],
        "experiment_calls": [("experiment_1", "call_1")],
        "experiment_evidence": [("experiment_1", "evidence_2")],
        "repairs": [("repair_1", "hypothesis_1", "operating_policy", "dataset_1", "c", "p", "evidence_9")],
        "repair_evidence": [("repair_1", "evidence_1")],
        "comparisons": [("comparison_1", "repair_1", "dataset_1", "recall", "ratio", "c", "p", "1", "1", "10/1", "10/1", "evidence_9")],
        "comparison_evidence": [("comparison_1", "baseline", "evidence_1"), ("comparison_1", "after", "evidence_2"), ("comparison_1", "after", "evidence_3")],
        "diagnoses": [("diagnosis_1", "investigation_1", "hypothesis_1")],
        "diagnosis_links": [("diagnosis_1", "hypothesis_1"), ("diagnosis_1", "evidence_1")],
        "record_events": [("event_1", "tool_requested", "call_1", day)],
    }
    return {name: spark.createDataFrame(changed.get(name, rows), COLUMNS[name]) for name, rows in sound.items()}


def broken(tables):
    found = integ.integrity(tables, "investigation_1", ("2024-01-02 00:00:00", "2024-01-29 00:00:00"))
    return {tuple(r) for r in found.collect()}


def test_sound_records_break_no_rule(spark):
    assert broken(records(spark)) == set()


def test_links_that_one_side_knows(spark):
    tables = records(spark, result_evidence=[("result_1", "evidence_3")], experiment_evidence=[("experiment_1", "evidence_1")])
    assert broken(tables) == {
        ("evidence", "evidence_1", "result does not list it"),
        ("evidence", "evidence_2", "experiment does not list it"),
        ("results", "result_1", "lists evidence of another record"),
        ("experiments", "experiment_1", "lists evidence of another record"),
    }


def test_scope_of_comparison_evidence(spark):
    # the experiment's call was answered over two datasets: not every one is the comparison's
    sets = {"datasets": [("dataset_1", "source_1", 50, "1"), ("dataset_2", "source_1", 50, "1")], "result_datasets": [("result_1", "dataset_1"), ("result_1", "dataset_2")]}
    got = broken(records(spark, **sets))
    assert ("comparisons", "comparison_1", "evidence measures something else") in got and ("results", "result_1", "scope differs from call") in got
    none = broken(records(spark, result_datasets=[]))  # no scope at all
    assert none == {("comparisons", "comparison_1", "evidence measures something else"), ("results", "result_1", "scope differs from call")}


def test_statuses_repairs_and_repeated_ids(spark):
    assert broken(records(spark, hypotheses=[("hypothesis_1", "rejected")])) == {("hypotheses", "hypothesis_1", "status without its evidence")}
    assert broken(records(spark, hypotheses=[("hypothesis_1", "proposed")], hypothesis_evidence=[])) == set()
    assert broken(records(spark, repair_evidence=[("repair_1", "evidence_x")])) == {("repairs", "repair_1", "unknown evidence")}
    change = [("repair_1", "hypothesis_1", "data_change", None, None, None, "evidence_1")]  # neither dataset nor costs are asked of it
    assert broken(records(spark, repairs=change, comparisons=[], comparison_evidence=[])) == set()
    twice = records(spark, sources=[("source_1", "uploaded_file"), ("assumption_1", "user_assumption"), ("event_1", "uploaded_file")])
    assert broken(twice) == {("any", "event_1", "duplicate id")}


def test_empty_tables(spark):
    assert broken(records(spark, **{name: [] for name in COLUMNS})) == set()


def plain_closure(edges, start, out):
    step = {}
    for a, b in edges:
        step.setdefault(a if out else b, set()).add(b if out else a)
    hops, todo = {}, deque([(start, 0)])
    while todo:
        at, n = todo.popleft()
        for x in step.get(at, ()):
            if x not in hops:
                hops[x] = n + 1
                todo.append((x, n + 1))
    return hops


def test_closure_ends_in_cycles_and_passes_hubs(spark):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(70)] + [("a", "b"), ("b", "c"), ("c", "a"), ("s", "s")]
    edges += [("hub", f"leaf{i}") for i in range(500)] + [("n1", "hub")]
    ids = ["a", "s", "hub", "leaf3", "n1", "n2", "n3", "nowhere"]
    frame = spark.createDataFrame([(a, b, "r") for a, b in edges + edges[:9]], "from string, to string, relationship string")
    starts = spark.createDataFrame([(i,) for i in ids + ids[:2]], "id string")
    got = sorted((r.id, r.direction, r.reached, r.hops, r.cyclic) for r in integ.lineage_closure(frame, starts).collect())
    want = [(i, d, x, n, x == i) for i in ids for d in ("in", "out") for x, n in plain_closure(edges, i, d == "out").items()]
    assert got == sorted(want)
    assert ("a", "out", "a", 3, True) in got and ("s", "in", "s", 1, True) in got
    near = integ.lineage_closure(frame, starts, most=1)
    assert sorted((r.id, r.direction, r.reached) for r in near.collect()) == sorted(w[:3] for w in want if w[3] == 1)
    assert integ.lineage_closure(frame, starts.where(F.lit(False))).count() == 0


def test_neighbors_join_once_however_many_tables_the_edges_unite(spark):
    """A join pushed into every united branch would move the ids, and each branch's edges, once a branch."""
    from functools import reduce

    from plumbline.operators.records import lineage_neighbors

    some = [spark.range(20).selectExpr(f"'{kind}_' || id AS `from`", f"'call_' || (id + {i}) AS `to`", f"'r{i}' AS relationship") for i, kind in enumerate("abcdcall")]
    edges = reduce(lambda a, b: a.unionByName(b), some).distinct()
    ids = spark.range(5).selectExpr("'call_' || id AS id")
    found = lineage_neighbors(edges, ids)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= 2
    rows = [tuple(r) for r in edges.collect()]
    known = {f"call_{i}" for i in range(5)}
    want = [(a, b, r, "out") for a, b, r in rows if a in known] + [(b, a, r, "in") for a, b, r in rows if b in known]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and lineage_neighbors(edges, ids.where("false")).count() == 0


def test_closure_moves_only_steps_that_leave_the_frontier(spark, monkeypatch):
    """A round used to join, and at size to shuffle, every step of both directions."""
    edges = spark.range(2000).selectExpr("'n' || id AS `from`", "'n' || (id + 2000) AS `to`", "'r' AS relationship")
    starts = spark.createDataFrame([("n7",)], "id string")
    seen = []
    plain = integ._leaving

    def counted(*given):
        found = plain(*given)
        seen.append(found.count())
        return found

    monkeypatch.setattr(integ, "_leaving", counted)
    got = {(r.direction, r.reached, r.hops) for r in integ.lineage_closure(edges, starts).collect()}
    assert got == {("out", "n2007", 1)} and seen == [1, 0]
    none_sent = integ.lineage_closure(edges, starts, broadcast_keys=0)
    assert {(r.direction, r.reached, r.hops) for r in none_sent.collect()} == got and seen[2:] == [4000, 4000]


def test_lookups_sort_one_long(spark):
    """Ids sort slowly, since they share their first bytes; null references are spread, not sent to one task."""
    t = records(spark, evidence=[(f"evidence_{i}", "measurement", "source", "source_1", "dataset_1" if i % 9 == 0 else None, None, None, None, None, None, 1, "recall", "ratio") for i in range(900)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        beside = integ.beside(t["evidence"], "dataset_id", t["datasets"], "scope", "row_count")
        for found in (integ.unknown_references(t), integ.unknown_columns(t), integ.costs_without_assumption(t), beside):
            joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in line]
            assert joins and all(line.split("SortMergeJoin ")[1].startswith("[xxhash64(") and line.count("xxhash64(") == 2 for line in joins)
        assert beside.where("scope_row_count = 50").count() == 100 and beside.count() == 900
        keys = beside.select(F.xxhash64(F.coalesce("dataset_id", "id")).alias("key")).groupBy("key").count()
        assert keys.agg(F.max("count")).first()[0] == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_equal_hashes_are_not_equal_ids(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "ab"), ("ab", "a"), (None, "a"), ("", "a")], "ref string, known string")
    assert [tuple(r) for r in rows.where(integ._equal(F.col("ref"), F.col("known"))).collect()] == [("a", "a")]


def test_closure_starts_from_every_hypothesis_and_source(spark, tmp_path):
    """Only ids divisible by 100 used to start, and of the sources only uploaded files."""
    import datetime as dt

    import duckdb
    from plumbline.plans.catalog import ORACLE, QUERIES

    day = dt.datetime(2024, 1, 5)
    rows = {
        "customer": ([(1,), (2,), (3,)], "c_custkey long"),
        "orders": ([(10, 1, "F", day, 5.0, "1-URGENT"), (11, 1, "O", day, 5.0, "5-LOW"), (21, 2, "P", day, 5.0, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_totalprice double, o_orderpriority string"),
        "lineitem": ([(k, i, 1.0) for k in (10, 11, 21) for i in range(1, 8)], "l_orderkey long, l_linenumber int, l_quantity double"),
        "events": ([(4, day, 1)], "event_id long, ts timestamp_ntz, user_id long"),
    }
    con = duckdb.connect()
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["j_lineage_closure"](spark, str(tmp_path)).select("id", "direction", "reached", "hops", "cyclic").collect()]
    assert {r[0] for r in got} == {f"{kind}_{c}" for kind in ("hypothesis", "source", "assumption") for c in (1, 2)}
    assert ("source_1", "out", "dataset_10", 1, False) in got and ("assumption_2", "out", "evidence_21_7", 1, False) in got
    assert sorted(got) == sorted(con.execute(f"SELECT id, direction, reached, hops, cyclic FROM ({ORACLE['j_lineage_closure']})").fetchall())


def test_closure_has_no_longest_walk_in_sql_either(spark):
    """The SQL used to end walks after 24 steps."""
    import duckdb
    from plumbline.plans.catalog.records import CLOSURE

    edges = [(f"n{i}", f"n{i + 1}") for i in range(26)] + [("n26", "n24"), ("n7", "n0"), ("s", "s")]
    tables = (("edges(\"from\", \"to\")", edges), ("hypotheses(id)", [("n0",), ("s",)]), ("sources(id)", [("n26",), ("nowhere",)]))
    given = ", ".join(f"{name} AS (VALUES {', '.join('(' + ', '.join(repr(x) for x in row) + ')' for row in rows)})" for name, rows in tables)
    want = duckdb.sql(f"WITH RECURSIVE {given}, {CLOSURE} SELECT id, direction, reached, hops, reached = id FROM walks WHERE NOT started").fetchall()
    frame = spark.createDataFrame(edges, "from string, to string")
    got = [tuple(r) for r in integ.lineage_closure(frame, spark.createDataFrame(tables[1][1] + tables[2][1], "id string")).collect()]
    assert sorted(got) == sorted(want) and ("n0", "out", "n26", 26, False) in got and ("n26", "in", "n0", 26, False) in got


def test_closure_reaches_a_missing_end_once(spark):
    """An edge without an end was found again in every round that came back to its start."""
    frame = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", None), (None, "b"), (None, None)], "from string, to string")
    starts = spark.createDataFrame([("a",), (None,)], "id string")
    got = {(r.direction, r.reached, r.hops, r.cyclic) for r in integ.lineage_closure(frame, starts).collect()}
    assert got == {("out", "b", 1, False), ("out", "a", 2, True), ("out", None, 1, None), ("in", "b", 1, False), ("in", "a", 2, True), ("in", None, 2, None)}
    assert integ.lineage_closure(frame, starts).count() == len(got)


def test_closure_is_the_same_whether_hashes_are_sent_or_rows_move(spark):
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)]
    frame, ids = spark.createDataFrame(edges, "from string, to string"), [f"n{i}" for i in range(12)]
    starts = spark.createDataFrame([(i,) for i in ids], "id string")
    want = sorted((i, d, x, n, x == i) for i in ids for d in ("in", "out") for x, n in plain_closure(edges, i, d == "out").items())
    for sent in (0, 30, 1000):
        assert sorted(tuple(r) for r in integ.lineage_closure(frame, starts, broadcast_keys=sent).select("id", "direction", "reached", "hops", "cyclic").collect()) == want
