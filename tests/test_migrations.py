"""Aliases and settings of several versions as one table."""

from pyspark.sql import functions as F

from tallyrad.functions import text as T
from tallyrad.operators import migrations


def test_four_versions_of_aliases(spark):
    first = spark.createDataFrame([(1, "ct head", 7)], "id int, alias_text string, times_used long")
    fifth = spark.createDataFrame([(2, "mri", 0, ["70553"], None, 5)], "id int, alias_text string, times_used long, cpt_codes array<string>, canonical_exam_name string, schema_version int")
    twelfth = spark.createDataFrame([(3, "us", 3, None, 12)], "id int, alias_text string, confirmations long, corrections long, schema_version int")
    newest = spark.createDataFrame([(4, "xr", 9, 14)], "id int, alias_text string, site_id long, schema_version int")
    found = {r.id: r for r in migrations.as_one([first, fifth, twelfth, newest], "exam_aliases").collect()}
    assert (found[1].cpt_codes, found[1].confirmations, found[1].corrections, found[1].site_id) == ([], 7, 0, None)
    assert (found[2].cpt_codes, found[2].confirmations) == (["70553"], 0)
    assert (found[3].confirmations, found[3].corrections) == (3, None)  # a row of that version keeps its null
    assert found[4].site_id == 9 and {r.schema_version for r in found.values()} == {14}


def test_again_changes_nothing(spark):
    once = migrations.migrate(spark.createDataFrame([(1, None), (2, 9)], "id int, schema_version int"), "settings")
    again = migrations.migrate(once, "settings")
    assert once.columns == again.columns and once.exceptAll(again).isEmpty()
    row = once.where(F.col("id") == 1).first()
    assert row.require_crop_before_ocr is True and row.auto_delete_processed is False and row.estimated_comp_per_wrvu is None


def test_texts_are_normalised_once_each(spark):
    rows = spark.createDataFrame([(1, "CT Head w/o contrast", 1), (2, None, 1), (3, "CT Head w/o contrast", 12)], "id int, exam_name_raw string, schema_version int")
    found = migrations.migrate(rows, "study_logs")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [exam_title_normalized:new:text" in plan.replace("`", "")
    assert {r.id: r.exam_title_normalized for r in found.collect()} == {
        r.id: r.t for r in rows.select("id", T.normalize_description(F.coalesce("exam_name_raw", F.lit(""))).alias("t")).collect()
    }
    own = migrations.migrate(rows.withColumn("exam_title_normalized", F.when(F.col("id") == 2, "kept")), "study_logs")
    assert {r.id: r.exam_title_normalized for r in own.collect()} == {1: found.where("id = 1").first().exam_title_normalized, 2: "kept", 3: None}
