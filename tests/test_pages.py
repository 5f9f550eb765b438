"""Pages of a remote table that fail at times, and the swap that waits for all of them."""

import os

import pytest

from tallyrad.operators.snapshots import Warehouse
from tallyrad.sources import pages


def test_pages_are_tried_again(spark, tmp_path):
    marks = str(tmp_path)

    def fetch(low, high):
        mark = f"{marks}/{low}"
        if low % 30 == 0 and not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("the service is busy")
        return [(k, f"row {k}") for k in range(low, high) if k % 7]

    rows = pages.paged(spark, fetch, "id long, name string", 5, 305, size=10, pages_per_task=4, wait=0.01)
    assert sorted(r.id for r in rows.collect()) == [k for k in range(5, 305) if k % 7]
    assert rows.rdd.getNumPartitions() == 8


def test_a_page_that_never_comes_fails(spark):
    def fetch(low, high):
        raise OSError("gone")

    with pytest.raises(Exception, match="gone"):
        pages.paged(spark, fetch, "id long", 0, 10, wait=0.01, tries=2).collect()


def test_only_whole_tables_are_swapped_in(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    load = lambda n, missing=-1: pages.paged(spark, lambda a, b: [(k,) for k in range(a, b) if k != missing], "id long", 0, n, size=10)
    pages.replace_if_whole(w, "fees", load(50), 50, "id", datasets=spark.createDataFrame([("2025", 50)], "version string, rows int"))
    for rows in (load(60, missing=33), load(60).unionByName(load(1))):
        with pytest.raises(pages.Incomplete):
            pages.replace_if_whole(w, "fees", rows, 60, "id")
    assert w.read("fees").count() == 50 and w.snapshot().version == 1
    pages.replace_if_whole(w, "fees", load(60), 60, "id")
    assert w.read("fees").count() == 60 and w.read("datasets").count() == 1
