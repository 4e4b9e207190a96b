"""Integrity of linked records, the edges between them, and everything that one record reaches.

Record tables have an ``id``; nested lists are link tables, one row per link. A rule marks the records that break it. Rules
that look at the same parent share its join, which moves only the records that name one. All references of all tables are
looked up in one join, all column names in another. Lookups join on hashes of ids (``names``).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_dir

Tables = Mapping[str, DataFrame]

# What a record's event is called and the prefix of its id; the evidence that a status needs.
EVENT_PREFIXES = {
    "dataset_registered": "dataset_",
    "tool_requested": "call_",
    "tool_completed": "result_",
    "tool_failed": "result_",
    "hypothesis_updated": "hypothesis_",
    "experiment_completed": "experiment_",
    "repair_proposed": "repair_",
    "comparison_completed": "comparison_",
    "investigation_completed": "investigation_",
    "investigation_failed": "investigation_",
}
NEEDED = {"supported": "supports", "weakened": "weakens", "rejected": "rejects", "confirmed": "supports"}
BROADCAST_KEYS = 2_000_000  # 16 MB of hashes
RECORDS = ("sources", "datasets", "calls", "results", "evidence", "hypotheses", "experiments", "repairs", "comparisons", "diagnoses", "record_events")


def named(mapping: Mapping[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)


def broken(rows: DataFrame, entity: str, rules: Mapping[str, Column]) -> DataFrame:
    """(entity, id, rule) of every rule that holds for a row; null counts as false."""
    marks = F.array_compact(F.array(*[F.when(c, F.lit(rule)) for rule, c in rules.items()]))
    return rows.where(reduce(Column.__or__, rules.values())).select(F.lit(entity).alias("entity"), "id", F.explode(marks).alias("rule"))


def names(ref: Column, known: Column, spread: Column | None = None) -> Column:
    """The join condition that two strings are equal, with their hash as its only key.

    Ids share their first bytes, so that sorting them compares whole strings; one long key is sorted by its bits. That the
    strings are equal is checked on the rows that meet, in a form that the planner takes for no second key. Null references
    match nothing; ``spread`` deals them out where an outer join keeps them.
    """
    key = ref if spread is None else F.coalesce(ref, spread)
    return (F.xxhash64(key) == F.xxhash64(known)) & _equal(ref, known)


def _equal(a: Column, b: Column) -> Column:
    return a.startswith(b) & b.startswith(a)


def beside(rows: DataFrame, column: str, parent: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """``rows`` with the parent that ``column`` names: its id as <prefix>_id (null if there is none) and the columns asked for."""
    found = parent.select(F.col("id").alias(f"{prefix}_id"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
    return rows.join(found, names(F.col(column), F.col(f"{prefix}_id"), F.col("id")), "left")


def listed(rows: DataFrame, links: DataFrame, by: str, mark: str) -> DataFrame:
    """``rows`` with ``mark``: how many links name each."""
    return rows.join(links.groupBy(F.col(by).alias("id")).agg(F.count("*").alias(mark)), "id", "left").withColumn(mark, F.coalesce(mark, F.lit(0)))


def one_sided(own: DataFrame, listed_in: DataFrame) -> DataFrame:
    """Links (holder, id) that only one side knows: ``side`` is 'own' (a record names a holder that does not list it) or 'list'."""
    both = own.select("holder", "id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(listed_in.select("holder", "id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    sums = both.groupBy("holder", "id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return sums.where("a <> b").select("holder", "id", F.when(F.col("a") == 1, "own").otherwise("list").alias("side"))


def _mark(rows: DataFrame, entity: str, rule: str, column: str = "id") -> DataFrame:
    return rows.select(F.lit(entity).alias("entity"), F.col(column).alias("id"), F.lit(rule).alias("rule"))


# child table, its own id, the reference, the parent table, the reporting entity, the rule
REFERENCES = (
    ("datasets", "id", "source_id", "sources", "datasets", "unknown source"),
    ("evidence", "id", "source_id", "sources", "evidence", "unknown source"),
    ("evidence", "id", "dataset_id", "datasets", "evidence", "unknown dataset"),
    ("evidence", "id", "result_id", "results", "evidence", "unknown result"),
    ("evidence", "id", "experiment_id", "experiments", "evidence", "unknown experiment"),
    ("calls", "id", "dataset_id", "datasets", "calls", "unknown dataset"),
    ("calls", "id", "comparison_dataset_id", "datasets", "calls", "unknown comparison dataset"),
    ("calls", "id", "hypothesis_id", "hypotheses", "calls", "unknown hypothesis"),
    ("results", "id", "call_id", "calls", "results", "unknown call"),
    ("hypothesis_evidence", "hypothesis_id", "evidence_id", "evidence", "hypotheses", "unknown evidence"),
    ("experiments", "id", "hypothesis_id", "hypotheses", "experiments", "unknown hypothesis"),
    ("experiment_calls", "experiment_id", "call_id", "calls", "experiments", "unknown call"),
    ("experiment_evidence", "experiment_id", "evidence_id", "evidence", "experiments", "unknown evidence"),
    ("repairs", "id", "hypothesis_id", "hypotheses", "repairs", "unknown hypothesis"),
    ("policies", "id", "dataset_id", "datasets", "repairs", "unknown dataset"),
    ("repair_evidence", "repair_id", "evidence_id", "evidence", "repairs", "unknown evidence"),
    ("comparisons", "id", "repair_id", "repairs", "comparisons", "unknown repair"),
    ("comparisons", "id", "dataset_id", "datasets", "comparisons", "unknown dataset"),
    ("comparison_evidence", "comparison_id", "evidence_id", "evidence", "comparisons", "unknown evidence"),
    ("diagnosis_links", "diagnosis_id", "entity_id", "any", "diagnoses", "unknown entity"),
    ("record_events", "id", "entity_id", "any", "record_events", "unknown entity"),
)
COSTED = ("calls", "repairs", "comparisons")


def unknown_references(t: Tables) -> DataFrame:
    """Records whose references name nothing: all references at once against the ids of all tables."""
    t = dict(t, policies=t["repairs"].where("kind = 'operating_policy'"))
    rows = [
        t[child].select(F.col(column).alias("ref"), F.lit(place).alias("of"), F.col(own).alias("id"), F.lit(i).alias("what"))
        for i, (child, own, column, parent, _, _) in enumerate(REFERENCES)
        for place in [-1 if parent == "any" else RECORDS.index(parent)]
    ]
    asked = reduce(DataFrame.unionByName, rows).where("ref IS NOT NULL")
    known = reduce(DataFrame.unionByName, [t[name].select(F.col("id").alias("known"), F.lit(i).alias("kind")) for i, name in enumerate(RECORDS)])
    named_by = names(F.col("ref"), F.col("known")) & ((F.col("of") == F.col("kind")) | (F.col("of") == -1))
    unknown = asked.join(known, named_by, "left_anti")
    texts = F.array(*[F.struct(F.lit(entity).alias("entity"), F.lit(rule).alias("rule")) for _, _, _, _, entity, rule in REFERENCES])
    return unknown.select("id", F.get(texts, F.col("what")).alias("text")).select("text.entity", "id", "text.rule").distinct()


def costs_without_assumption(t: Tables) -> DataFrame:
    t = dict(t, repairs=t["repairs"].where("kind = 'operating_policy'"))
    rows = reduce(DataFrame.unionByName, [t[name].select("id", F.lit(name).alias("entity"), F.col("cost_evidence_id").alias("ref")) for name in COSTED])
    assumed = t["evidence"].where("kind = 'assumption'").select(F.col("id").alias("known"))
    unfounded = rows.where("ref IS NOT NULL").join(assumed, names(F.col("ref"), F.col("known")), "left_anti")
    return unfounded.select("entity", "id", F.lit("costs without assumption").alias("rule"))


def unknown_columns(t: Tables) -> DataFrame:
    """Records that name a column which their (known) dataset does not have: all at once against the columns of all datasets."""
    asked = (
        ("evidence", "dataset_id", "unknown provenance column"),
        ("calls", "dataset_id", "absent dataset column"),
        ("calls", "comparison_dataset_id", "absent comparison column"),
    )
    rows = [t[entity].select(F.lit(entity).alias("entity"), "id", F.lit(rule).alias("rule"), F.col(of).alias("of"), F.col("name").alias("asked")) for entity, of, rule in asked]
    rows = reduce(DataFrame.unionByName, rows).where("of IS NOT NULL AND asked IS NOT NULL")
    has = (F.xxhash64("of", "asked") == F.xxhash64("dataset_id", "name")) & _equal(F.col("of"), F.col("dataset_id")) & _equal(F.col("asked"), F.col("name"))
    absent = rows.join(t["dataset_columns"].select("dataset_id", "name"), has, "left_anti")
    return absent.join(t["datasets"].select(F.col("id").alias("known")), names(F.col("of"), F.col("known"))).select("entity", "id", "rule")


def one_sided_evidence(t: Tables) -> DataFrame:
    """Evidence of results and experiments that its holder does not list, and holders that list others' evidence."""
    own = t["evidence"].where("route <> 'source'").select(F.coalesce("result_id", "experiment_id").alias("holder"), "id")
    lists = [t[f"{kind}_evidence"].select(F.col(f"{kind}_id").alias("holder"), F.col("evidence_id").alias("id")) for kind in ("result", "experiment")]
    sides = one_sided(own, lists[0].unionByName(lists[1]))
    kind = F.when(F.col("holder").startswith("result_"), "result").otherwise("experiment")
    mine, rule = F.col("side") == "own", F.concat(kind, F.lit(" does not list it"))
    return sides.select(
        F.when(mine, "evidence").otherwise(F.concat(kind, F.lit("s"))).alias("entity"),
        F.when(mine, F.col("id")).otherwise(F.col("holder")).alias("id"),
        F.when(mine, rule).otherwise("lists evidence of another record").alias("rule"),
    ).distinct()


def scopes(t: Tables, e: DataFrame) -> DataFrame:
    """(evidence_id, dataset_id): the datasets that the evidence ``e`` rests on, by the route of its provenance.

    From a source: the dataset it names. From a result: the result's datasets. From an experiment: those of all results of
    its calls. Evidence without any has no row.
    """
    direct = e.where("route = 'source' AND dataset_id IS NOT NULL").select(F.col("id").alias("evidence_id"), "dataset_id")
    of_result = e.where("route = 'tool_result'").select(F.col("id").alias("evidence_id"), "result_id").join(t["result_datasets"], "result_id")
    answered = t["results"].select(F.col("id").alias("result_id"), "call_id").join(t["result_datasets"], "result_id").select("call_id", "dataset_id")
    tried = e.where("route = 'experiment'").select(F.col("id").alias("evidence_id"), "experiment_id").join(t["experiment_calls"], "experiment_id").join(answered, "call_id")
    return direct.unionByName(of_result.select("evidence_id", "dataset_id")).unionByName(tried.select("evidence_id", "dataset_id")).distinct()


def _evidence(t: Tables) -> list[DataFrame]:
    source, first, last = F.col("route") == "source", F.col("first_row"), F.col("last_row")
    e, assumption, maybe = t["evidence"], F.col("kind") == "assumption", F.coalesce(F.col("route") == "source", F.lit(True))
    own = {
        "measurement without value": (F.col("kind") == "measurement") & (F.col("measurements") == 0),
        "assumption without assumption source": assumption & ~(maybe & F.col("source_id").isNotNull()),
        "rows outside dataset": F.col("dataset_id").isNull() & ((first < 1) | (first > last)),
        "rows without dataset": F.col("dataset_id").isNull() & (first.isNotNull() | F.col("name").isNotNull()),
    }
    scoped = beside(e.where("dataset_id IS NOT NULL").select("id", "dataset_id", "source_id", "first_row", "last_row"), "dataset_id", t["datasets"], "scope", "source_id", "row_count")
    of_dataset = {
        "dataset of another source": F.col("scope_source_id") != F.col("source_id"),
        "rows outside dataset": (first < 1) | (first > last) | (last > F.col("scope_row_count")),
    }
    ids = lambda name, kept: t[name].where(kept).select(F.col("id").alias("known"))
    named_by = lambda column: names(F.col(column), F.col("known"))
    sourced = lambda kept: e.where(kept & F.col("source_id").isNotNull()).select("id", "source_id")
    assumed = ids("sources", "kind = 'user_assumption'")
    parts = [
        _mark(sourced(maybe & assumption).join(assumed, named_by("source_id"), "left_anti"), "evidence", "assumption without assumption source"),
        _mark(sourced(source & ~assumption).join(assumed, named_by("source_id"), "left_semi"), "evidence", "assumption source with measurement"),
    ]
    for kind in ("result", "experiment"):
        unfinished = e.where(F.col(f"{kind}_id").isNotNull()).select("id", f"{kind}_id").join(ids(f"{kind}s", "status <> 'completed'"), named_by(f"{kind}_id"), "left_semi")
        parts.append(_mark(unfinished, "evidence", f"{kind} not completed"))
    return [broken(e, "evidence", own), broken(scoped, "evidence", of_dataset), *parts]


def _calls(t: Tables, investigation: str) -> list[DataFrame]:
    asked = t["calls"].where("positive_label IS NOT NULL").select("id", "dataset_id", "positive_label")
    return [
        broken(t["calls"], "calls", {"wrong investigation": F.col("investigation_id") != investigation}),
        broken(beside(asked, "dataset_id", t["datasets"], "input", "positive_label"), "calls", {"positive label differs": F.col("positive_label") != F.col("input_positive_label")}),
    ]


def _results(t: Tables) -> list[DataFrame]:
    many = lambda name, value, by: t[name].groupBy(F.col(by).alias("of")).agg(F.sort_array(F.collect_list(value)).alias(name))
    with_many = lambda rows, *of: rows.join(many(*of), F.col("id") == F.col("of"), "left").drop("of")
    calls = with_many(t["calls"], "call_thresholds", "threshold", "call_id")
    r = with_many(with_many(t["results"], "result_datasets", "dataset_id", "result_id"), "result_thresholds", "threshold", "result_id")
    r = listed(r, t["result_evidence"], "result_id", "held")
    r = beside(r, "call_id", calls, "asked", "tool", "version", "requested_at", "hypothesis_id", "method", "dataset_id", "comparison_dataset_id", "call_thresholds")
    finished = F.col("status") == "completed"
    same = lambda tool: finished & (F.col("tool") == tool) & (F.col("asked_tool") == tool)
    wanted = F.sort_array(F.array_compact(F.array("asked_dataset_id", "asked_comparison_dataset_id")))
    none = lambda name: F.coalesce(F.col(name), F.array().cast(r.schema[name].dataType))
    rules = {
        "result does not match call": (F.col("tool") != F.col("asked_tool")) | (F.col("version") != F.col("asked_version")) | (F.col("completed_at") < F.col("asked_requested_at")),
        "evidence of an unfinished result": ~finished & (F.col("held") > 0),
        "hypothesis differs from call": same("run_counterfactual_test") & ~F.col("hypothesis_id").eqNullSafe(F.col("asked_hypothesis_id")),
        "method differs from call": same("run_drift_tests") & ~F.col("method").eqNullSafe(F.col("asked_method")),
        "scope differs from call": F.col("asked_id").isNotNull() & (none("result_datasets") != wanted),
        "thresholds differ from call": same("threshold_sweep") & (none("result_thresholds") != none("asked_call_thresholds")),
    }
    repeated = t["results"].groupBy(F.col("call_id").alias("of")).count().where("count > 1")
    twice = t["results"].select("id", "call_id").join(repeated, F.equal_null("call_id", "of")).groupBy("call_id").agg(F.max("id").alias("id"))
    return [broken(r, "results", rules), _mark(twice, "results", "call answered twice")]


def _hypotheses(t: Tables) -> list[DataFrame]:
    links = t["hypothesis_evidence"]
    kinds = sorted(set(NEEDED.values()))
    shown = links.groupBy(F.col("hypothesis_id").alias("id")).agg(*[F.count_if(F.col("relationship") == kind).alias(kind) for kind in kinds], F.count("*").alias("n"))
    verified = t["experiments"].where("status = 'completed' AND outcome = 'supports'").select(F.col("hypothesis_id").alias("id")).distinct().withColumn("verified", F.lit(True))
    h = t["hypotheses"].join(shown, "id", "left").join(verified, "id", "left")
    lacking = reduce(Column.__or__, [(named(NEEDED, F.col("status")) == kind) & (F.coalesce(kind, F.lit(0)) == 0) for kind in kinds])
    rules = {
        "assessed without evidence": (F.col("status") != "proposed") & F.col("n").isNull(),
        "status without its evidence": lacking,
        "confirmed without verification": (F.col("status") == "confirmed") & F.col("verified").isNull(),
    }
    twice = links.groupBy("hypothesis_id", "evidence_id").count().where("count > 1").select("hypothesis_id").distinct()
    return [broken(h, "hypotheses", rules), _mark(twice, "hypotheses", "evidence linked twice", "hypothesis_id")]


def _experiments(t: Tables) -> DataFrame:
    answered = t["results"].where("status = 'completed'").select("call_id").distinct().withColumn("answered", F.lit(1))
    ran = t["experiment_calls"].join(answered, "call_id", "left").groupBy(F.col("experiment_id").alias("id")).agg(F.count("*").alias("calls"), F.count("answered").alias("answered"))
    e = listed(t["experiments"], t["experiment_evidence"], "experiment_id", "held").join(ran, "id", "left")
    done = F.col("status") == "completed"
    rules = {
        "completed without outcome": done & F.col("outcome").isNull(),
        "completed without evidence": done & (F.col("held") == 0),
        "completed without finished calls": done & (F.col("calls").isNull() | (F.col("answered") < F.col("calls"))),
        "results without completion": ~done & (F.col("outcome").isNotNull() | (F.col("held") > 0)),
    }
    return broken(e, "experiments", rules)


def _repairs(t: Tables) -> DataFrame:
    return broken(listed(t["repairs"], t["repair_evidence"], "repair_id", "held"), "repairs", {"repair without evidence": F.col("held") == 0})


def _comparisons(t: Tables) -> list[DataFrame]:
    links = t["comparison_evidence"]
    c = beside(t["comparisons"], "repair_id", t["repairs"], "repair_of", "kind", "dataset_id", "criterion", "policy")
    repaired = (F.col("repair_of_kind") == "operating_policy") & (F.col("repair_of_dataset_id") == F.col("dataset_id"))
    repaired &= (F.col("repair_of_criterion") == F.col("criterion")) & (F.col("repair_of_policy") == F.col("after_policy"))
    rules = {
        "not the repair's dataset, policy and criterion": F.col("repair_of_id").isNotNull() & ~repaired,
        "class or cost definitions differ": ~(F.col("baseline_label").eqNullSafe(F.col("after_label")) & F.col("baseline_costs").eqNullSafe(F.col("after_costs"))),
    }
    # relational division: every dataset that a piece of evidence rests on must be the comparison's, and there must be one
    wanted = t["comparisons"].select(F.col("id").alias("comparison_id"), F.col("dataset_id").alias("wanted"), F.col("metric").alias("wanted_metric"), F.col("unit").alias("wanted_unit"))
    route = ("route", "dataset_id", "result_id", "experiment_id")
    e = t["evidence"].select(F.col("id").alias("found"), "kind", "metric", "unit", "measurements", *route)
    held = cut(links.join(wanted, "comparison_id").join(e, names(F.col("evidence_id"), F.col("found"))).drop("found"), "held")
    held = held.drop(*route).join(scopes(t, held.select(F.col("evidence_id").alias("id"), *route).distinct()), "evidence_id", "left")
    measures = (F.col("kind") == "measurement") & (F.col("measurements") > 0) & (F.col("metric") == F.col("wanted_metric")) & (F.col("unit") == F.col("wanted_unit"))
    fits = measures & F.coalesce(F.col("dataset_id") == F.col("wanted"), F.lit(False))
    both = links.groupBy("comparison_id", "evidence_id").agg(F.count_distinct("side").alias("sides")).where("sides > 1")
    return [
        broken(c, "comparisons", rules),
        _mark(held.where(~fits).select("comparison_id").distinct(), "comparisons", "evidence measures something else", "comparison_id"),
        _mark(both.select("comparison_id").distinct(), "comparisons", "evidence on both sides", "comparison_id"),
    ]


def integrity(t: Tables, investigation: str, period: tuple[str, str]) -> DataFrame:
    """Violations over all record and link tables: entity, id, rule.

    ``investigation`` is the one that all records belong to; ``period`` bounds the times of events.
    """
    every = reduce(DataFrame.unionByName, [t[name].select("id") for name in RECORDS])
    start, end = (F.lit(x).cast("timestamp_ntz") for x in period)
    of_events = {
        "kind and entity differ": ~F.col("entity_id").startswith(named(EVENT_PREFIXES, F.col("kind"))),
        "outside the period": ~F.col("moment").cast("timestamp_ntz").between(start, end),
    }
    primary = t["diagnosis_links"].select(F.col("diagnosis_id").alias("of"), F.col("entity_id").alias("listed")).distinct()
    diagnoses = t["diagnoses"].join(primary, (F.col("id") == F.col("of")) & (F.col("primary_hypothesis_id") == F.col("listed")), "left")
    of_diagnoses = {
        "wrong investigation": F.col("investigation_id") != investigation,
        "primary hypothesis not listed": F.col("primary_hypothesis_id").isNotNull() & F.col("listed").isNull(),
    }
    parts = [
        _mark(every.groupBy("id").count().where("count > 1"), "any", "duplicate id"),
        unknown_references(t),
        costs_without_assumption(t),
        one_sided_evidence(t),
        unknown_columns(t),
        *_evidence(t),
        *_calls(t, investigation),
        *_results(t),
        *_hypotheses(t),
        _experiments(t),
        _repairs(t),
        *_comparisons(t),
        broken(t["record_events"], "record_events", of_events),
        broken(diagnoses, "diagnoses", of_diagnoses),
    ]
    return reduce(DataFrame.unionByName, parts)


def lineage_links(t: Tables) -> DataFrame:
    """Edges from all references, repeats included, in one pass without a shuffle but for two joins: from, to, relationship."""
    nested = [
        ("datasets", "source_id", "provides dataset"),
        ("calls", "dataset_id", "dataset of call"),
        ("calls", "comparison_dataset_id", "comparison dataset of call"),
        ("calls", "cost_evidence_id", "supplies cost assumption"),
        ("results", "call_id", "produced result"),
        ("evidence", "source_id", "source of evidence"),
        ("evidence", "dataset_id", "scopes evidence"),
        ("evidence", "result_id", "generated evidence"),
        ("evidence", "experiment_id", "generated evidence"),
        ("experiments", "hypothesis_id", "tested by"),
        ("repairs", "hypothesis_id", "motivates repair"),
        ("repairs", "dataset_id", "repair dataset"),
        ("repairs", "cost_evidence_id", "supplies cost assumption"),
        ("comparisons", "repair_id", "re-evaluated by"),
        ("comparisons", "dataset_id", "comparison dataset"),
    ]
    edges = [t[c].where(F.col(column).isNotNull()).select(F.col(column).alias("from"), F.col("id").alias("to"), F.lit(name).alias("relationship")) for c, column, name in nested]
    linked = [
        ("result_datasets", "dataset_id", "result_id", F.lit("measured dataset")),
        ("hypothesis_evidence", "evidence_id", "hypothesis_id", F.col("relationship")),
        ("experiment_calls", "experiment_id", "call_id", F.lit("executes test")),
        ("repair_evidence", "evidence_id", "repair_id", F.lit("informs repair")),
        ("comparison_evidence", "evidence_id", "comparison_id", F.concat("side", F.lit(" evidence"))),
    ]
    edges += [t[name].select(F.col(a).alias("from"), F.col(b).alias("to"), kind.alias("relationship")) for name, a, b, kind in linked]
    results = t["results"].select("call_id", F.col("id").alias("to"))
    edges.append(t["experiment_calls"].join(results, "call_id").select(F.col("experiment_id").alias("from"), "to", F.lit("test result").alias("relationship")))
    whose = t["diagnoses"].select(F.col("id").alias("diagnosis_id"), "primary_hypothesis_id")
    role = F.when(F.col("entity_id") == F.col("primary_hypothesis_id"), "primary hypothesis").when(F.col("entity_id").startswith("hypothesis_"), "considered hypothesis").otherwise("included in diagnosis")
    edges.append(t["diagnosis_links"].join(whose, "diagnosis_id").select(F.col("entity_id").alias("from"), F.col("diagnosis_id").alias("to"), role.alias("relationship")))
    return reduce(DataFrame.unionByName, edges)


def lineage_edges(t: Tables) -> DataFrame:
    """Edges from all references, each once: from, to, relationship."""
    return lineage_links(t).distinct()


def _among(rows: DataFrame, key: Column, asked: DataFrame, size: int, broadcast_keys: int) -> DataFrame:
    """The rows whose hash ``key`` is among the ``size`` rows ``asked`` (key): rows stay where they are, only hashes are sent.

    Other rows with the same hash come through too, which the join that follows drops. More than ``broadcast_keys`` hashes
    are not sent, and all rows stay in.
    """
    keys = asked.distinct()
    if size > broadcast_keys and keys.count() > broadcast_keys:
        return rows
    return rows.join(F.broadcast(keys), key == F.col("key"), "left_semi")


def _leaving(steps: DataFrame, frontier: DataFrame, size: int, broadcast_keys: int) -> DataFrame:
    """The steps that may leave the frontier of ``size`` rows, by the hash of their place."""
    return _among(steps, F.xxhash64("way", "place"), frontier.select(F.xxhash64("direction", "at").alias("key")), size, broadcast_keys)


def _fresh(reached: DataFrame, seen: DataFrame, few: bool, broadcast_keys: int) -> DataFrame:
    """``reached`` without what is ``seen``; if ``few`` left, only what is reached again is moved of it."""
    if few:
        reached = cut(reached, "again")
        seen = _among(seen, F.col("mark"), reached.select(F.col("mark").alias("key")), reached.count(), broadcast_keys)
    return reached.join(seen.hint("merge"), ["mark", "id", "direction", "at"], "left_anti")


def lineage_closure(edges: DataFrame, ids: DataFrame, most: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Everything that each of ``ids`` (id) reaches along the edges ('out') and against them ('in').

    (id, direction, reached, hops, cyclic): ``hops`` is the length of a shortest path; a record that comes back to itself is
    reached after its shortest cycle and marked ``cyclic``. Rounds go on from what the round before found first, until
    nothing is new (or after ``most`` hops), so a cycle ends them. Every round is written; a record that many edges leave
    is joined once a start and round, and its neighbours are spread by their own ids. Edges may repeat: they are written once,
    in both directions, and a round moves only those that leave its frontier and only those finds that it may repeat. Joins
    compare hashes before ids, which share their first bytes. Edges without an end lead to null, once a start.
    """
    spark = edges.sparkSession
    way = lambda name, at, to: F.struct(F.lit(name).alias("way"), F.col(at).alias("place"), F.col(to).alias("next"))
    steps = cut(edges.select(F.inline(F.array(way("out", "from", "to"), way("in", "to", "from")))).where("place IS NOT NULL"), "steps")
    starts = ids.select("id").where("id IS NOT NULL").distinct()
    frontier = cut(starts.select("id", F.explode(F.array(F.lit("out"), F.lit("in"))).alias("direction"), F.col("id").alias("at")), "frontier")
    marked = lambda rows: rows.withColumn("mark", F.xxhash64("id", "direction", "at"))
    leaves = (F.xxhash64("way", "place") == F.xxhash64("direction", "at")) & _equal(F.col("way"), F.col("direction")) & _equal(F.col("place"), F.col("at"))
    folder, columns, hops = shared_dir(spark, "reached"), "id string, direction string, at string", 0
    size = frontier.count()
    while size and (most is None or hops < most):
        met = _leaving(steps, frontier, size, broadcast_keys).join(frontier.hint("merge"), leaves)
        reached = marked(met.select("id", "direction", F.col("next").alias("at"))).distinct()
        if hops:
            seen = spark.read.schema(columns).parquet(*[f"{folder}/hops={i + 1}" for i in range(hops)])
            reached = _fresh(reached, marked(seen), size <= broadcast_keys, broadcast_keys)
        hops += 1
        reached.drop("mark").write.parquet(f"{folder}/hops={hops}")
        frontier = spark.read.schema(columns).parquet(f"{folder}/hops={hops}").where("at IS NOT NULL")
        size = frontier.count()
    if not hops:
        return starts.where("false").select("id", F.lit("out").alias("direction"), F.col("id").alias("reached"), F.lit(0).alias("hops"), F.lit(False).alias("cyclic"))
    found = spark.read.schema(f"{columns}, hops int").parquet(folder)
    nowhere = found.where("at IS NULL").groupBy("id", "direction", "at").agg(F.min("hops").alias("hops"))
    rows = found.where("at IS NOT NULL").unionByName(nowhere)
    return rows.select("id", "direction", F.col("at").alias("reached"), "hops", (F.col("at") == F.col("id")).alias("cyclic"))
