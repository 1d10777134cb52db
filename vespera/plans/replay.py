"""Staged replay: the state after each evidence step, what each step adds, and how hypotheses move."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vespera.plans import evidence as P


STEP = r"^(step_[^/]*)/"


def steps(files: DataFrame) -> DataFrame:
    """Files of step folders (named step_...) with their step; files elsewhere belong to none."""
    return files.withColumn("step", F.regexp_extract("path", STEP, 1)).where("step != ''")


def first_seen(facts: DataFrame, key: list[str], path: str) -> DataFrame:
    """key, step: the step whose evidence brings each fact first. State only grows, so this is the whole replay in one job."""
    return facts.withColumn("step", F.regexp_extract(path, STEP, 1)).where("step != ''").groupBy(*key).agg(F.min("step").alias("step"))


KINDS = ("event", "entity", "ioc", "hypothesis")


def running(first: DataFrame, names: DataFrame) -> DataFrame:
    """step, kind, n_new, n_total from first-seen rows (kind, step) over all steps (names: step), with running totals by kind."""
    every = names.select("step").distinct().crossJoin(names.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string"))
    counts = every.join(first.groupBy("kind", "step").agg(F.count("*").alias("n_new")), ["kind", "step"], "left").fillna(0, ["n_new"])
    return counts.withColumn("n_total", F.sum("n_new").over(Window.partitionBy("kind").orderBy("step")))


def growth(files: DataFrame) -> DataFrame:
    """step, kind, n_new, n_total: events, entities, indicators and hypotheses by step, with running totals."""
    files = steps(files)
    found = P.iocs(files)
    parts = [
        first_seen(P.events(files), ["ts", "description", "path"], "path").select(F.lit("event").alias("kind"), "step"),
        first_seen(P.entities(files).withColumn("key", F.lower("value")), ["type", "key"], "source").select(F.lit("entity").alias("kind"), "step"),
        first_seen(found.withColumn("key", F.lower("artifact")), ["type", "key"], "source").select(F.lit("ioc").alias("kind"), "step"),
        first_seen(P.hypotheses(found).withColumn("key", F.lower("title")), ["key"], "source").select(F.lit("hypothesis").alias("kind"), "step"),
    ]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return running(every, files)


def intervals(facts: DataFrame, key: list[str], value: str, order) -> DataFrame:
    """key, value, valid_from, valid_to (null: still): what each key's value was from which step on, in one job.

    facts: key, value, step. A key's value after a step is the one of the highest `order` that it has had until then, as in
    the merges. State at a step, what a step changed, and snapshots are reads of this table.
    """
    ranked = facts.groupBy(*key, "step").agg(F.max(F.struct(order.alias("o"), F.col(value).alias("v"))).alias("x"))
    by = Window.partitionBy(*key).orderBy("step")
    so_far = ranked.withColumn("x", F.max("x").over(by))
    moved = so_far.withColumn("before", F.lag("x").over(by)).where("before is null or before.o < x.o")
    return moved.select(*key, F.col("x.v").alias(value), F.col("step").alias("valid_from"), F.lead("step").over(by).alias("valid_to"))


def as_of(states: DataFrame, step) -> DataFrame:
    """The rows of intervals() that held after a step."""
    return states.where((F.col("valid_from") <= step) & (F.col("valid_to").isNull() | (F.col("valid_to") > step)))


def moves(states: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, step, before (null: new), value: what each step brought or changed."""
    by = Window.partitionBy(*key).orderBy("valid_from")
    return states.select(*key, F.col("valid_from").alias("step"), F.lag(value).over(by).alias("before"), value)


def report(steps_: list[dict]) -> str:
    """The Markdown of a replay: for each step what it added, what moved, how checks went. steps_: as Case.evolve gives them."""
    out = ["# Replay", "", f"{len(steps_)} step(s)."]
    for s in steps_:
        out += ["", f"## {s['step']}", "", f"- files: {s['files']}", f"- pages changed: {', '.join(s['pages']) or 'none'}"]
        out += [f"- new hypothesis: {t}" for t in s["new_hypotheses"]]
        out += [f"- confidence of {c['title']}: {c['old']} to {c['new']}" for c in s["confidence_changes"]]
        out += [f"- new contradiction: {t}" for t in s["new_contradictions"]]
        out.append("- findings: " + ", ".join(f"{k} {n}" for k, n in s["findings"].items()))
        if s["passed"] is not None:
            out.append(f"- questions passed: {s['passed']} of {s['questions']}")
        out.append(f"- assessment: {s['assessment']}")
    return "\n".join(out) + "\n"
