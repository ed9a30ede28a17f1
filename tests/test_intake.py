"""Exactly-once intake by key, and files over several deliveries."""

import shutil

import pytest
from pyspark.sql import functions as F

from haulmark.sources import files
from haulmark.streaming import intake

ROW = "k long, v string"


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "data"), str(tmp_path / "checkpoint")


def empty_store(spark, path):
    empty = spark.createDataFrame([], ROW)
    empty.write.parquet(f"{path}/batch_id=-1")
    empty.select("k").write.parquet(f"{intake.key_store(path)}/prefix=0/batch_id=-1")


def rows(spark, path):
    return sorted(((r.k, r.v, r.batch_id) for r in spark.read.parquet(path).collect()), key=lambda r: (r[0] is None, r))


def test_a_batch_reads_only_the_prefixes_it_holds(spark, place):
    path, _ = place
    empty_store(spark, path)
    intake.insert_batch(spark.range(500).select(F.col("id").alias("k"), F.lit("a").alias("v")), 0, path, "k", prefixes=16)
    batch = spark.createDataFrame([(7, "x"), (500, "y")], ROW)
    known = intake.known_keys(batch, intake.key_store(path), "k", 1, prefixes=16)
    read = {r[0].split("prefix=")[1].split("/")[0] for r in known.select(F.input_file_name()).distinct().collect()}
    held = {str(r[0]) for r in batch.select(F.pmod(F.xxhash64("k"), F.lit(16))).collect()}
    assert read <= held and len(read) <= 2
    intake.insert_batch(batch, 1, path, "k", prefixes=16)
    assert spark.read.parquet(path).count() == 501


def test_a_repeated_batch_adds_nothing(spark, place):
    path, _ = place
    empty_store(spark, path)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n")], ROW)
    second = spark.createDataFrame([(2, "late"), (3, "c"), (None, "late")], ROW)
    intake.insert_batch(first, 0, path, "k")
    intake.insert_batch(second, 1, path, "k")
    want = [(1, "a", 0), (2, "b", 0), (3, "c", 1), (None, "n", 0)]
    assert rows(spark, path) == want
    intake.insert_batch(second, 1, path, "k")
    assert rows(spark, path) == want
    # An attempt that wrote its rows but not its keys is repeated whole.
    third = spark.createDataFrame([(4, "d"), (1, "late")], ROW)
    third.where("k = 4").withColumn("batch_id", F.lit(2).cast("long")).write.mode("append").partitionBy("batch_id").parquet(path)
    intake.insert_batch(third, 2, path, "k")
    assert rows(spark, path) == sorted([*want, (4, "d", 2)], key=lambda r: (r[0] is None, r))
    stored = spark.read.parquet(intake.key_store(path)).where("batch_id >= 0")
    assert stored.count() == 5


def test_deliveries_are_read_once_and_large_files_listed(spark, tmp_path, place):
    path, checkpoint = place
    folder = tmp_path / "in" / "claims"
    folder.mkdir(parents=True)

    def run(name):
        intake.intake_files(files.stream_files(spark, str(tmp_path / "in"), "*.txt", per_batch=1), path, checkpoint, name, max_bytes=10)
        return sorted((r.path.rsplit("/", 1)[1], r.length, r.content and bytes(r.content), r.too_large, r.delivery) for r in spark.read.parquet(path).collect())

    (folder / "a.txt").write_text("one")
    (folder / "b.txt").write_text("x" * 11)
    first = run("first")
    assert first == [("a.txt", 3, b"one", False, "first"), ("b.txt", 11, None, True, "first")]
    assert run("nothing new") == first
    (folder / "c.txt").write_text("ten chars.")
    (folder / "other.bin").write_text("no")
    assert run("second") == [*first, ("c.txt", 10, b"ten chars.", False, "second")]


def test_a_table_streams_from_one_file_or_from_a_folder_of_files(spark, tmp_path):
    spark.range(20).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    shutil.copy(next((tmp_path / "many.parquet").glob("part-*")), tmp_path / "one.parquet")
    one = spark.read.parquet(str(tmp_path / "one.parquet")).count()
    for name, rows in (("many", 20), ("one", one)):
        out = str(tmp_path / f"out-{name}")
        intake.run_available(intake.table_stream(spark, str(tmp_path), f"{name}.parquet"), out, f"{out}-checkpoint")
        assert spark.read.parquet(out).count() == rows
