"""Where intermediate tables go."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from rosterlake.session import materialise, scratch_path, scratch_root


def _session(named, master):
    context = SimpleNamespace(master=master, applicationId="app-1", getCheckpointDir=lambda: None)
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: named), sparkContext=context
    )


def test_the_named_folder_is_used():
    session = _session("hdfs:///shared/checkpoints/", "spark://host:7077")
    assert scratch_root(session) == "hdfs:///shared/checkpoints/rosterlake/app-1"


def test_a_cluster_without_a_named_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(_session(None, "spark://host:7077"))


def test_paths_are_never_reused(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_materialised_rows_read_back_with_their_schema(spark):
    df = spark.sql("SELECT 1 AS b, CAST('2.50' AS DECIMAL(5,2)) AS a, DATE '9999-12-31' AS c")
    stored = materialise(df, "t")
    assert stored.columns == df.columns and stored.collect() == df.collect()
    assert [f.dataType for f in stored.schema] == [f.dataType for f in df.schema]
