import pytest
from pyspark.sql import functions as F

from plumbline.operators import records as rec
from plumbline.operators import trends as tr
from plumbline.plans import jobs, tools
from plumbline.session import shared_dir
from plumbline.sources import evaluation as ev
from plumbline.sources import logs as lg
from plumbline.sources import predictions as pr
from plumbline.sources import sinks


def lines(spark, *texts, source="run"):
    return spark.createDataFrame([(source, i + 1, t) for i, t in enumerate(texts)], "source string, line_no long, line string")


def test_aliases_scaling_and_rejects(spark):
    log = lines(spark, "[validation] accuracy=94%", "production/accuracy: 0.616", "val_accuracy=1.4", "train_loss=5%", "test_r2=-0.5 x=3")
    rows = {r.metric: (r.value, r.reason) for r in lg.metric_tokens(log.filter("line_no <> 3")).collect()}
    assert rows["Validation accuracy"][0] == pytest.approx(0.94)
    assert rows["Training loss"] == (None, "percent of an unbounded metric")
    assert rows["Test R2"][0] == -0.5
    gap = tr.gap_findings(tr.last_valid(lg.extract_metrics(log))).first()
    assert gap.title == "Possible distribution shift" and gap.evidence == "32.4 points"


def test_keras_headers_join_the_next_line(spark):
    log = lines(spark, "Epoch 1/2", "", "loss: 0.9 - val_loss: 0.8", "Epoch 2/2", "loss: 0.7 - val_loss: 0.9")
    history = tr.epoch_history(lg.extract_metrics(lg.join_headers(log)))
    got = {(r.epoch, r.metric): r.value for r in history.collect()}
    assert got == {(1, "Training loss"): 0.9, (1, "Validation loss"): 0.8, (2, "Training loss"): 0.7, (2, "Validation loss"): 0.9}


def curve(spark, train, val):
    return lines(spark, *[f"epoch={i} train_loss={t} val_loss={v}" for i, (t, v) in enumerate(zip(train, val))])


@pytest.mark.parametrize(
    "train, val, title",
    [
        ([1.0, 0.8, 0.6, 0.5], [0.5, 0.6, 0.7, 0.8], "Possible overfitting"),
        ([0.5, 0.5, 0.5, 0.5], [0.9, 0.6, 0.5, 0.4], "Possible stalled learning"),
        ([0.5, 0.9, 0.5, 0.9], [0.9, 0.8, 0.6, 0.5], "Possible unstable training"),
        ([0.9, 0.7, 0.6, 0.5], [0.9, 0.8, 0.7, 0.6], None),
    ],
)
def test_trends(spark, train, val, title):
    found = [r.title for r in tr.trends(tr.epoch_history(lg.extract_metrics(curve(spark, train, val)))).collect()]
    assert found == ([title] if title else [])


def test_restarted_runs_lose_their_history(spark):
    log = lines(spark, "epoch=1 train_loss=1", "epoch=2 train_loss=1", "epoch=1 val_loss=1")
    assert tr.epoch_history(lg.extract_metrics(log)).count() == 0


def test_json_records_and_depth(spark):
    text = ['{"validation":{"accuracy":0.94}}', '[{"a":1},{"b":[true,"x"]}]', "not json", '{"history":[{"epoch":3}]}']
    df = spark.createDataFrame(list(enumerate(text)), "doc long, text string")
    got = sorted((r.doc, r.record, r.path, r.value) for r in lg.flatten_json(df, "doc", "text").collect())
    assert got == [(0, 0, "validation_accuracy", "0.94"), (1, 0, "a", "1"), (1, 1, "b_1", "x"), (3, 0, "epoch", "3")]


def test_column_mapping_is_checked(spark):
    df = spark.createDataFrame([(1, 0.5)], "round int, error double")
    assert lg.map_metric_columns(df, {"round": "epoch", "error": "train_loss"}).columns == ["epoch", "train_loss"]
    for bad in ({"nope": "epoch"}, {"round": "price"}, {"round": "epoch", "error": "epoch"}):
        with pytest.raises(ValueError):
            lg.map_metric_columns(df, bad)


def test_ingestion_is_atomic(spark):
    raw = spark.createDataFrame([(1, "1", "0", "0.5", "x"), (2, "yes", "NA", "1.5", "")], "row_no long, y_true string, y_pred string, y_probability string, site string")
    rows, issues = ev.ingest(raw, "row_no")
    assert rows.count() == 0
    assert {(r.row, r.column, r.code) for r in issues.collect()} == {(2, "y_true", "label"), (2, "y_pred", "missing_value"), (2, "y_probability", "probability")}
    good, none = ev.ingest(raw.filter("row_no = 1"), "row_no")
    assert good.first().attributes == {"site": "x"} and none.count() == 0
    with pytest.raises(ValueError):
        ev.ingest(raw.drop("y_pred"), "row_no")


def test_csv_shape(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text('a,b\n1,"x, ""y""\nz"\n\n2\n3,4,5\n')
    rows, bad = ev.read_strict_csv(spark, str(path), multi_line=True)
    assert [tuple(r) for r in rows.collect()] == [("1", 'x, "y"\nz')]
    assert bad.count() == 2
    with pytest.raises(ValueError):
        ev.read_strict_csv(spark, str(path))
    path.write_text('a,b\n1,"x, ""y"""\n\n2\n3,4,5\n')
    rows, bad = ev.read_strict_csv(spark, str(path))
    assert [tuple(r) for r in rows.collect()] == [("1", 'x, "y"')] and bad.count() == 2
    for header in (["a", ""], ["a", "a"]):
        with pytest.raises(ValueError):
            ev.check_header(header)


def test_lenient_predictions(spark):
    rows = [(1, "A.png", "Positive", "1", "2", "Train"), (2, "A.png", "0", "0", "0.1", "val"), (3, "b", "maybe", "true", "x", "??")]
    raw = spark.createDataFrame(rows, "n long, image_id string, label string, pred string, score string, split string")
    kept, issues = pr.ingest_predictions(raw, "n")
    got = {r.id: (r.y_true, r.y_pred, r.y_probability, r.split) for r in kept.collect()}
    assert got == {"A.png": (1, 1, 1.0, "train"), "b": (0, 1, 0.5, "unassigned")}
    assert {(r.row, r.code) for r in issues.collect()} == {(1, "probability"), (2, "duplicate_id"), (3, "probability")}
    files = spark.createDataFrame([("x/a.JPG", 1), ("c.png", 2), ("b.txt", 3)], "name string, position int")
    matched, missing, unmatched = pr.match_files(kept, files)
    assert [r.id for r in matched.collect()] == ["A.png"] and [r.id for r in missing.collect()] == ["b"]
    # A file is unmatched when its stem is no id: "a" is not "a.png".
    assert {r.name for r in unmatched.collect()} == {"x/a.JPG", "c.png"}


def test_round_trip_and_gate(spark):
    tables = {"t": spark.createDataFrame([("a", 1), ("b", None)], "id string, n long")}
    assert tuple(sinks.round_trip(tables, shared_dir(spark, "test")).first()) == ("t", 2, 0, 1)
    checks = spark.createDataFrame([("after", "recall", "at_least", 0.9, "ratio"), ("after", "f1", "at_least", 0.9, "ratio")], "stage string, metric string, operator string, value double, unit string")
    seen = spark.createDataFrame([("after", "recall", "ratio", 1.0), ("after", "f1", "ratio", None)], "stage string, metric string, unit string, value double")
    checked = rec.policy_checks(checks, seen)
    assert {r.metric: r.status for r in checked.collect()} == {"recall": "passed", "f1": "inconclusive"}
    assert not rec.evaluate_gate(checked).first().passed


def test_falsification_fails_closed(spark):
    seen = spark.createDataFrame([("s", "a", "ratio", 0.9), ("s", "b", "ratio", 0.1), ("s", "c", "ratio", None)], "scope string, metric string, unit string, value double")
    rule = lambda h, metric: (h, "s", metric, "ratio", "at_least", 0.5)
    rules = [rule("all", "a"), rule("some", "a"), rule("some", "b"), rule("none", "b"), rule("open", "a"), rule("open", "c"), rule("gone", "z")]
    criteria = spark.createDataFrame(rules, "hypothesis_id string, scope string, metric string, unit string, operator string, value double")
    got = {r.hypothesis_id: r.outcome for r in rec.falsify(seen, criteria).collect()}
    assert got == {"all": "supports", "some": "weakens", "none": "rejects", "open": "inconclusive", "gone": "inconclusive"}


def test_reliability_scores_only_what_was_measured(spark):
    names = ("accuracy", "balanced_accuracy", "minority_recall", "ece", "psi", "suspicions", "cost_before", "cost_after")
    df = spark.createDataFrame([(0.9, 0.8, 0.2, None, None, None, None, None)], ", ".join(f"{n} double" for n in names))
    rows = {r.dimension: r for r in rec.reliability_profile(df).collect()}
    assert rows["performance"].score == 87 and rows["minority"].score == 20 and rows["total"].score == 35
    assert all(rows[k].score is None for k in ("calibration", "drift", "leakage", "cost"))


def test_threshold_repair_protocol(frame):
    """Scores planted so that 0.5 misses eight of ten positives and 0.2 finds all at four false alarms."""
    pairs = [(1, 0.8)] * 2 + [(1, 0.2)] * 8 + [(0, 0.35)] * 4 + [(0, 0.1)] * 86
    report = jobs.threshold_repair(frame(pairs), 10, 1, 0.5, 10.0)
    assert report["selection"].first().threshold == 0.2
    cost = report["comparison"].filter(F.col("metric") == "total_cost").first()
    assert (cost.before, cost.after, cost.status) == (80.0, 4.0, "passed") and report["gate"].first().passed


def test_tools_are_a_closed_list(frame):
    assert tools.run_tool("run_counterfactual_test", frame([(1, 0.9), (0, 0.2), (0, 0.1)]))["outcome"].count() == 1
    with pytest.raises(ValueError):
        tools.run_tool("drop_table", frame([(1, 0.9)]))


def test_tokens_are_taken_apart_once(spark):
    """No pattern is matched on the exploded tokens, where every expression that names a part would match it again."""
    from plumbline.sources import logs

    lines = spark.createDataFrame(
        [("a", 1, "[epoch 3/9] Train/acc: 50% val_loss = 1e400 [production] R2=-0.5"), ("a", 2, "loss: nan test.f1=1.5 val_mae=3% prod_recall:.25"), ("a", 3, None)],
        "source string, line_no long, line string",
    )
    found = logs.metric_tokens(lines)
    rows = {(r.line_no, r.position): (r.epoch, r.metric, r.value, r.reason) for r in found.collect()}
    assert rows == {
        (1, 0): (3, "Training accuracy", 0.5, None),
        (1, 1): (3, "Validation loss", None, "not finite"),
        (1, 2): (3, "Production R2", -0.5, None),
        (2, 0): (None, "Training loss", None, "not finite"),
        (2, 1): (None, "Test F1", None, "rate above one"),
        (2, 2): (None, "Validation MAE", None, "percent of an unbounded metric"),
        (2, 3): (None, "Production RECALL", 0.25, None),
    }
    plan = found.filter("reason IS NULL")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RLIKE(metric") <= 1 and "regexp_extract(t#" not in plan  # once, on the table of labels


def test_kinds_of_json_nodes_are_found_once_and_lines_without_an_epoch_skip_its_pattern(spark):
    """The schema of every leaf used to be derived again for each test of its kind, and nothing cast to a number per line."""
    docs = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":"x"},true,null,{}]}}'), (2, '[{"v":2},3]')], "k int, text string")
    leaves = lg.flatten_json(docs, "k", "text")
    assert "schema_of_variant" not in leaves._jdf.queryExecution().optimizedPlan().toString().split("inline(")[0]
    got = sorted(tuple(r) for r in leaves.collect())
    assert got == [(1, 0, "a_b_0", "1"), (1, 0, "a_b_1_c", "x"), (2, 0, "v", "2"), (2, 1, "", "3")]
    lines = spark.createDataFrame([("EPOCH 3 loss=1",), ("loss=7",), ("epochs 4",), ("x Epoch: 5/9",)], "line string")
    epochs = lines.select(lg.epoch_of(F.col("line")).alias("e"))
    assert [r.e for r in epochs.collect()] == [3, None, None, 5]
    assert "contains(lower(line" in epochs._jdf.queryExecution().optimizedPlan().toString().lower()
