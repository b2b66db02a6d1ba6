"""What intermediate tables leave on disk."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import exchange
from tessella.llm.storage import bucketed, discard, written

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p for d in dirs for p in Path(d.getPath()).rglob("shuffle_*")}


@pytest.mark.parametrize("write", [lambda df: written(df, "test"), lambda df: bucketed(df, "test", "k", 3)])
def test_shuffle_files_go_with_the_write(spark, write):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    rows = spark.range(10_000).select("id", (F.col("id") % 7).alias("k"))
    counts = rows.repartition(3, "id").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    found = write(rows.join(counts.hint("merge"), "k"))
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP) == setting
    assert found.count() == 10_000 and {r.n for r in found.select("n").distinct().collect()} == {1428, 1429}
    discard(found)


def test_slices_write_no_table_of_questions(spark, monkeypatch):
    """A shuffle of the questions and one of the slices' sums are most of the disk; a third copy went over four times the input."""
    labels = []
    monkeypatch.setattr(exchange, "written", lambda df, label: labels.append(label) or written(df, label))
    asked = spark.createDataFrame([(0, b, exchange.gaps(np.array([3, 5 + b], np.uint64)), exchange.small(np.array([1, 2]))) for b in range(4)], exchange.ASKED)
    answers = exchange.answered(asked, exchange.Shape(1, 2), "test")
    assert {r.block: exchange.from_small(r.counts)[0] for r in answers.collect()} == dict.fromkeys(range(4), 4)
    assert labels == ["test-totals", "test"]
