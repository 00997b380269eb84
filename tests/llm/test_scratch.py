"""Tables in the shared folder, and what is broadcast."""

import os

import pytest
from pyspark.sql import functions as F

from heronry.llm import scratch
from heronry.llm.scratch import BATCH_BYTES, BATCH_ROWS, cut, shared_dir, small_or_not, text_batches


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_a_cut_has_the_rows_and_schema_but_no_lineage(spark):
    df = spark.range(10).select("id", F.lit(None).cast("int").alias("x"), F.array(F.struct(F.lit("a").alias("b"))).alias("c"))
    found = cut(df.repartition(3))
    assert found.dtypes == df.dtypes and sorted(found.collect()) == sorted(df.collect())
    assert "Range" not in plan(found)
    assert all(shared_dir(spark).removeprefix("file://") in f for f in found.inputFiles())
    assert cut(df.where("false")).dtypes == df.dtypes


def test_a_folder_that_cannot_be_removed_does_not_keep_the_others(spark, monkeypatch):
    path = f"{shared_dir(spark)}/to-remove"
    spark.range(1).write.parquet(path)
    monkeypatch.setattr(scratch, "_made", [(None, "gone"), (spark, path)])
    scratch._clean()
    assert not os.path.exists(path.removeprefix("file://"))


def test_only_small_tables_are_broadcast(spark):
    t = cut(spark.range(100))
    assert "broadcast" in plan(small_or_not(t))
    assert "broadcast" in plan(small_or_not(t, rows=100))
    assert "broadcast" not in plan(small_or_not(t, rows=99))
    assert "broadcast" not in plan(small_or_not(t, size=10))


def test_the_folder_is_the_sessions_own_setting(spark):
    set_ = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == set_.rstrip("/")


def test_a_cluster_must_name_a_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_text_batches_leave_what_a_user_chose(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    session = spark.newSession()
    text_batches(session.range(1))
    assert [int(session.conf.get(n).rstrip("b")) for n in names] == [BATCH_ROWS, BATCH_BYTES]
    session.conf.set(names[0], "77")
    text_batches(session.range(1))
    assert session.conf.get(names[0]) == "77"
