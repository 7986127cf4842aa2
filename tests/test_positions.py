"""Positions in file order against the sort, and the plans that give them."""
import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from fieldpulse.operators import counters as C
from fieldpulse.operators import replay as RP
from fieldpulse.operators.positions import file_slice, with_file_position

SF = "/root/testdata/sf0.001"


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture()
def folder(spark, scratch):
    """A table in time order in 13 files of several row groups, one of them empty."""
    path = os.path.join(scratch, "ordered")
    ordered = spark.range(5000).repartitionByRange(13, "id").sortWithinPartitions("id").where("id < 300 OR id > 700")
    ordered.write.option("parquet.block.size", 1024).parquet(path)
    return path


def test_positions_equal_the_sort_where_files_are_in_order(spark, folder):
    df = spark.read.parquet(folder)
    got = with_file_position(df, "n", with_total=True)
    ids = sorted(r.id for r in df.collect())
    assert [(r.id, r.n, r.n_total) for r in got.orderBy("n").collect()] == [(x, i + 1, len(ids)) for i, x in enumerate(ids)]
    replayed, sorted_ = RP.replay_files(df, 20, 5), RP.replay_batches(df, ["id"], 20, 5)
    assert sorted(map(tuple, replayed.collect())) == sorted(map(tuple, sorted_.collect()))
    assert sorted(map(tuple, C.progress_of_files(df, 100).collect())) == \
        sorted(map(tuple, C.progress_every_n(df, ["id"], 100).collect()))


def test_no_row_is_moved(spark, folder):
    for df in (RP.replay_files(spark.read.parquet(folder)), C.progress_of_files(spark.read.parquet(SF + "/events.parquet"))):
        text = plan(df)
        assert "rangepartitioning" not in text and "ExistingRDD" not in text and "SortMergeJoin" not in text
        # all that is shuffled are the files' counts
        for line in text.splitlines():
            if line.startswith("Arguments: hashpartitioning"):
                assert "_file" in line
        assert "BroadcastHashJoin" in text


@pytest.mark.parametrize("skip, take", [(0, 1), (0, 20), (290, 30), (2000, 1500), (4590, 100), (9000, 5), (100, 0)])
def test_slices(spark, folder, skip, take):
    df = spark.read.parquet(folder)
    ids = sorted(r.id for r in df.collect())
    got = file_slice(df, skip, take, "n").orderBy("n").collect()
    assert [(r.id, r.n) for r in got] == [(x, skip + i + 1) for i, x in enumerate(ids[skip:skip + take])]


def test_a_far_page_reads_only_its_files(spark, folder):
    far = file_slice(spark.read.parquet(folder), 4500, 10, "n")
    assert len(far.select("id").inputFiles()) <= 13 and far.count() == 10
    # the filter on the file reaches the scan
    assert "file_path" in plan(far).split("PartitionFilters")[0] or "metadata" in plan(far)


def test_csv_blocks(spark, scratch):
    path = os.path.join(scratch, "csv")
    spark.range(20000).select("id", F.lit("x" * 50).alias("pad")).repartitionByRange(3, "id").sortWithinPartitions("id") \
        .write.option("header", True).csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")            # several blocks a file
    try:
        df = spark.read.option("header", True).csv(path)
        assert df.rdd.getNumPartitions() > 6
        got = with_file_position(df, "n").where(F.col("id").cast("long") + 1 != F.col("n"))
        assert got.count() == 0
        assert file_slice(df, 12345, 3, "n").select(F.col("id").cast("long")).orderBy("id").collect() == \
            [(12345,), (12346,), (12347,)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_table(spark, scratch):
    path = os.path.join(scratch, "none")
    spark.range(0).write.parquet(path)
    assert with_file_position(spark.read.parquet(path)).count() == 0
    assert file_slice(spark.read.parquet(path), 0, 5).count() == 0
