"""Identities of registered roots, asked of the file system within a time budget."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tracelake.operators.store import Store
from tracelake.operators.views import merge_identities
from tracelake.plans.deadline import Deadline
from tracelake.schema import TABLES
from tracelake.sources.discovery import git_identity

COUNTERS = ["registered", "recorded", "already_probed", "no_remote", "unresolved", "skipped_out_of_budget"]


def sweep(store: Store, *, seconds: float = 30.0, deadline: Deadline | None = None, asked: set[str] | None = None, now_ms: int | None = None) -> dict[str, int]:
    """Ask each registered root for its identity and record the answers in two commits; six counters.

    Only ``git:`` ids are stored; every answer leaves a verdict. asked: roots known from earlier sweeps of
    this process; one whose question failed is forgotten, so that it is asked again. Roots that the budget
    doesn't reach are counted, never passed over in silence.
    """
    spark, deadline = store.spark, deadline or Deadline.after(seconds)
    now = int(time.time() * 1000) if now_ms is None else now_ms
    asked = set() if asked is None else asked
    roots = [(r.root_key, r.root_path) for r in store.table("project_root_registry").orderBy("root_key").collect()]  # a small table
    out = dict.fromkeys(COUNTERS, 0) | {"registered": len(roots)}
    found, verdicts = [], []
    for key, path in roots:
        if deadline.expired():
            out["skipped_out_of_budget"] += 1
        elif key in asked:
            out["already_probed"] += 1
        else:
            outcome, name = git_identity(path)
            if outcome != "failed":
                asked.add(key)
            out[{"resolved": "recorded", "none": "no_remote"}.get(outcome, "unresolved")] += 1
            verdicts.append((key, outcome, name, now))
            if outcome == "resolved":
                found.append((key, name, now, now))
    if found:
        old = store.table("project_identity")
        new = spark.createDataFrame(found, "project_root string, canonical_id string, first_seen_ms long, last_seen_ms long")
        names = ["project_root", "canonical_id"]
        both = merge_identities(old.select(*new.columns).unionByName(new)).join(new.select(*names), names, "left_semi")
        top = old.agg(F.max("id")).first()[0] or 0
        numbers = spark.createDataFrame([(k, n, top + i + 1) for i, (k, n, _, _) in enumerate(found)], "project_root string, canonical_id string, _new long")
        both = both.join(old.select(*names, "id"), names, "left").join(numbers, names).withColumn("id", F.coalesce("id", "_new")).drop("_new")
        store.upsert("project_identity", both, names)
    if verdicts:
        store.upsert("project_identity_probe", spark.createDataFrame(verdicts, TABLES["project_identity_probe"]), ["project_root"])
    return out


def latest_of(own):
    """The last identity of each root; of equal times the larger id."""
    return own.groupBy("project_root").agg(F.max_by(F.struct("canonical_id", "first_seen_ms", "last_seen_ms"), F.struct("last_seen_ms", "id")).alias("x")).select("project_root", "x.*")


def latest(store: Store):
    return latest_of(store.table("project_identity"))


def history(store: Store, root_key: str):
    """All identities that a root has had, the last first."""
    return store.table("project_identity").where(F.col("project_root") == root_key).orderBy(F.desc("last_seen_ms"), F.desc("id"))
