"""Lineage cuts and stream state go to the session's shared checkpoint
folder; tenant scoping edge cases."""

import os

import pytest
from pyspark.sql import functions as F

from papyra.operators import gates as G
from papyra.session import cut_lineage, ensure_checkpoint_dir
from papyra.streaming.runners import checkpoint_location


def test_checkpoints_use_session_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert ensure_checkpoint_dir(spark) == configured
    assert checkpoint_location(spark, "q").startswith(configured)
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10
    # the checkpointed plan starts from the saved RDD, not from the range
    assert "Range" not in df._jdf.queryExecution().analyzed().toString()
    assert os.path.isdir(configured.replace("file:", ""))


def test_tenant_scope_edges(spark, fx):
    d = fx.v_documents
    assert G.tenant_view(d, "").count() == 0 and G.tenant_view(d, None).count() == 0
    one = d.filter(F.col("user_id") == 7).select("id").first().id
    assert G.document_by_id(d, fx.v_document_types, one, "7").count() == 1
    assert G.document_by_id(d, fx.v_document_types, one, "8").count() == 0


def test_no_scratch_folder_off_local_mode():
    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
