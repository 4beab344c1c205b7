import os

import pytest

from spark_cues import runtime


def test_temporary_tables_go_and_named_ones_stay(spark):
    kept = runtime.scratch_path(spark, "kept")
    with runtime.temporary(spark):
        inner = runtime.materialize(spark.range(3).toDF("n"), "inner")
        place = inner.inputFiles()[0].removeprefix("file://").removeprefix("file:")
        assert os.path.exists(place)
        named = runtime.materialize(inner, "named", kept)
    assert not os.path.exists(place)
    assert named.count() == 3
    runtime.discard(spark, kept)
    assert not os.path.exists(kept.removeprefix("file://").removeprefix("file:"))


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        runtime.shared_dir(Session())
