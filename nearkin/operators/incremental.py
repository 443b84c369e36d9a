"""Keeping only what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.operators.bloom import select_by_cascade
from nearkin.sources.storage import MAX_BROADCAST_KEYS, durable, few_keys, restrict, settled

KEEP, FIRST = "keep", "first"


def new_only(batch: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not stored yet.

    A stored id list small enough to broadcast is left to the planner. One that
    is larger than that and than the batch is first cut down to the ids of the
    batch: the batch's keys are read once more, and its wide rows need no
    shuffle. Otherwise both are shuffled, and a hot key on the batch side is
    split at run time.
    """
    existing = existing.select(key)
    keys = few_keys(existing, batch, key)
    if keys is not None:
        seen = restrict(existing, keys, key).distinct()
        existing, _ = settled(seen, MAX_BROADCAST_KEYS)
    return batch.join(existing, key, "left_anti")


def first_of_each(batch: DataFrame, order: str, key: str = "id") -> DataFrame:
    """One row per key, the lowest by ``order``.

    ``min_by`` combines map-side, so copies of one document leave each task as
    a single row; a window would bring all of them to one place first.
    """
    row = F.min_by(F.struct(*batch.columns), order).alias("row")
    return batch.groupBy(F.col(key).alias("_key")).agg(row).select("row.*")


def within_batch(batch: DataFrame, rule: str, order: str, key: str = "id") -> DataFrame:
    """``keep`` leaves equal documents of one batch alone; ``first`` takes one."""
    if rule == KEEP:
        return batch
    if rule == FIRST:
        return first_of_each(batch, order, key)
    raise ValueError(f"rule must be {KEEP!r} or {FIRST!r}, not {rule!r}")


def select_in_place(
    rows: DataFrame, keys: DataFrame, others: DataFrame, on: list[str], most: int
) -> DataFrame:
    """The rows with one of ``keys``, without moving any row.

    ``others`` are the keys of all other rows. The fewer of the two are sent to the
    rows; where both are more than ``most``, a cascade of Bloom filters is. The rows
    are read once in any case.
    """
    wanted, rest = keys.count(), others.count()
    if not rest:
        return rows
    if rest < wanted and rest <= most:
        return rows.join(F.broadcast(others), on, "left_anti")
    if wanted <= most:
        return rows.join(F.broadcast(keys), on, "left_semi")
    return select_by_cascade(rows, keys, others, on, most)


def new_files(
    files: DataFrame, existing: DataFrame, rule: str, most: int = MAX_BROADCAST_KEYS
) -> tuple[DataFrame, bool]:
    """The rows ``id, filename, content`` to ingest, and if some are the same twice.

    What is new, and which of equal files is first, is settled on ids and names
    alone; contents stay where they are. Only rows alike in id and name can't be
    told apart that way, and are left to whoever collapses the result.
    """
    if rule not in (KEEP, FIRST):
        raise ValueError(f"rule must be {KEEP!r} or {FIRST!r}, not {rule!r}")
    names = files.select("id", "filename").groupBy("id", "filename").agg(F.count("*").alias("n"))
    names = durable(names, "files")
    fresh = new_only(names, existing)
    twice = False
    if rule == FIRST:
        fresh = fresh.groupBy("id").agg(F.min("filename").alias("filename"))
        twice = names.where("n > 1").limit(1).count() > 0
    on = ["id", "filename"]
    keys = durable(fresh.select(on), "new-files")
    others = durable(names.select(on).join(keys, on, "left_anti"), "other-files")
    return select_in_place(files, keys, others, on, most), twice
