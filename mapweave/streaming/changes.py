"""Derived tables kept up to date from change batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import latest_versions
from ..operators import resolve as R


@dataclass
class State:
    """Base tables: nodes (id, .., lon, lat), ways (id, .., nodes), relations (id, .., members)."""

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame


@dataclass
class Affected:
    """Ids whose derived rows are to be made anew, and those that only depend on changed ones."""

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame
    pending_ways: DataFrame
    pending_relations: DataFrame


def apply_objects(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The last version of each changed object replaces the old one; deleted ones go."""
    last = latest_versions(changes, ["id"], ["version"])
    return old.join(last.select("id"), "id", "left_anti").unionByName(last.where("visible").select(*old.columns))


def changed_ids(changes: DataFrame, kind: str) -> DataFrame:
    """Nodes and ways of version 1 are new and have no parents; all other versions count, as do all relations that are not deleted."""
    last = latest_versions(changes, ["id"], ["version"])
    return last.where("version <> 1" if kind in "nw" else "visible").select("id")


def affected(old: State, new: State, dn: DataFrame, dw: DataFrame, dr: DataFrame) -> Affected:
    """The closure: changed objects, ways of changed nodes, relations of changed nodes, of changed ways, and of those ways.

    Edges of both the old and the new state count, so that former parents and
    members are made anew as well.
    """
    ways_e = R.way_edges(new.ways).select("way_id", "ref")
    rels_e = R.member_edges(new.relations).select("rel_id", "type", "ref").union(R.member_edges(old.relations).select("rel_id", "type", "ref"))
    n, w, r = (d.select("id").distinct() for d in (dn, dw, dr))
    pend_w = R.minus_ids(R.parent_ways(changed_ids(dn, "n"), ways_e), w)
    touched = R.union_ids(changed_ids(dw, "w"), pend_w)
    pend_r = R.minus_ids(R.union_ids(R.parent_relations(changed_ids(dn, "n"), rels_e, "n"), R.parent_relations(touched, rels_e, "w")), r)
    return Affected(n, R.union_ids(w, pend_w), R.union_ids(r, pend_r), pend_w, pend_r)


def marked_members(old: State, new: State, relations: DataFrame, kind: str) -> DataFrame:
    """Members, before or after, of changed relations: their relation data has to be made anew."""
    e = R.member_edges(old.relations).unionByName(R.member_edges(new.relations)).where(F.col("type") == kind)
    return e.join(relations.select(F.col("id").alias("rel_id")), "rel_id", "left_semi").select(F.col("ref").alias("id")).distinct()


def refresh(derived: DataFrame, gone: DataFrame, rebuild: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """A derived table without the affected ids' rows, and with what ``rebuild`` makes of them."""
    return derived.join(gone.select(F.col("id").alias(key)), key, "left_anti").unionByName(rebuild(gone))


def apply(old: State, dn: DataFrame, dw: DataFrame, dr: DataFrame) -> tuple[State, Affected]:
    new = State(apply_objects(old.nodes, dn), apply_objects(old.ways, dw), apply_objects(old.relations, dr))
    return new, affected(old, new, dn, dw, dr)


def start_stream(changes: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Run ``process(batch, number)`` for each batch of a change stream. A batch that is repeated after a failure has the same number."""
    w = changes.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
