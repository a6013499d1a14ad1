"""Written cuts of lineage: where they lie, and that they need no recomputation."""

import pytest
from pyspark.sql import functions as F

from strandloom.runtime import Workspace, shared_dir


def test_workspace(spark):
    space = Workspace(spark, "t")
    assert space.root.startswith(shared_dir(spark))
    calls = spark.sparkContext.accumulator(0)

    def count(it):
        for b in it:
            calls.add(1)
            yield b

    saved = space.save(spark.range(10, numPartitions=1).mapInArrow(count, "id long"))
    assert saved.count() == saved.agg(F.sum("id")).first()[0] - 35 == 10 and calls.value == 1
    space.drop(saved, spark.range(1))
    with pytest.raises(Exception):
        saved.collect()
