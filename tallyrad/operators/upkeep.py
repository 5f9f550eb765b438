"""Totals of a table of snapshots, kept up to date: what was added is added, days that were rewritten are counted again.

No day that stayed as it was is read. Where rows were only appended to a day, just the new rows are read and added to
the day's totals; an edit or a soft delete rewrites its day, whose totals are then counted from its rows, so work
units that went away lower them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .snapshots import NULL_PART, Change, Conflict, Snapshot, Warehouse
from .totals import counted, live

ATTEMPTS = 5


def day_totals(logs: DataFrame) -> DataFrame:
    """Work units, studies and studies under review of live logs by profile, day and modality; sums all of them."""
    return live(logs).groupBy("profile_id", "log_date", "modality").agg(
        F.sum(F.coalesce(counted(), F.lit(0.0))).alias("wrvu"), F.count("*").alias("studies"), F.count_if(F.col("needs_review")).alias("under_review")
    )


def changes(before: Snapshot, now: Snapshot, table: str) -> tuple[dict[str, list[str]], set[str]]:
    """Parts that grew, with their new folders, and parts that were rewritten or are gone."""
    old, new = before.folders(table), now.folders(table)
    grown, rewritten = {}, {p for p in old if p not in new}
    for part, folders in new.items():
        had = old.get(part, [])
        if folders[: len(had)] == had and len(folders) > len(had):
            grown[part] = folders[len(had) :]
        elif folders != had:
            rewritten.add(part)
    return grown, rewritten


def refresh(
    warehouse: Warehouse, source: str = "logs", target: str = "totals", measure: Callable[[DataFrame], DataFrame] = day_totals,
    keys: tuple[str, ...] = ("profile_id", "log_date", "modality"), day: str = "log_date",
) -> Snapshot:
    """Brings the totals up to the newest snapshot and returns that; nothing is written if nothing changed.

    measure: sums of rows by `keys`, one of which is the partition column `day` of both tables.
    """
    by = f"totals/{target}"
    for _ in range(ATTEMPTS):
        now = warehouse.snapshot()
        before = warehouse.snapshot(max(0, now.done.get(by, 0)))
        grown, rewritten = changes(before, now, source)
        if not grown and not rewritten:
            return now
        schema = warehouse.read(source, at=now).schema
        folders = [f"{warehouse.root}/{f}" for own in grown.values() for f in own]
        added = measure(warehouse.spark.read.schema(schema).parquet(*folders)) if folders else None
        again = measure(warehouse.read(source, parts=rewritten, at=now)) if rewritten else None
        like = added if added is not None else again
        if added is not None:
            sums = [c for c in added.columns if c not in keys]
            had = warehouse.read(target, like, set(grown), now)
            added = had.unionByName(added).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
        every = added if again is None else again if added is None else added.unionByName(again)
        number = now.version
        try:
            return warehouse.commit({target: Change(every.select(*like.columns), day, set(grown) | rewritten)}, now, None, by, number)
        except Conflict:
            continue  # another one brought the totals up
    raise Conflict(f"others kept changing {target}")


def of_day(warehouse: Warehouse, day: str | None, target: str = "totals") -> DataFrame:
    """The totals of one day (None: of logs without one)."""
    return warehouse.read(target, parts={day or NULL_PART})
