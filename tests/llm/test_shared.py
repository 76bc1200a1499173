import os

import pytest

from tallyframe.llm import shared
from tallyframe.llm.avi import clips, store_texts
from tallyframe.llm.quality import quality_rules
from tallyframe.llm.urlrules import judge_urls, query_rules


def test_settled_tables_go(spark):
    df = shared.settle(spark.range(5))
    path = shared._paths[df].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path) and spark.sparkContext.applicationId in path
    shared.release(df, spark.range(3))
    assert not os.path.exists(path)


class Cluster:
    """As much of a session as shared_dir asks."""

    class conf:
        named: str | None = None

        @classmethod
        def get(cls, key, default):
            return cls.named or default

    class sparkContext:
        master, folder = "spark://host:7077", None

        @classmethod
        def getCheckpointDir(cls):
            return cls.folder


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        monkeypatch.setattr(Cluster.sparkContext, "master", master)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.shared_dir(Cluster)
    monkeypatch.setattr(Cluster.sparkContext, "folder", "hdfs://x/y")
    assert shared.shared_dir(Cluster) == "hdfs://x/y"
    monkeypatch.setattr(Cluster.conf, "named", "hdfs://x/z/")
    assert shared.shared_dir(Cluster) == "hdfs://x/z"


def test_columns_named_like_inner_ones(spark):
    df = spark.createDataFrame([(1, "some text", "a", "b", "c", 4)], "doc_id int, text string, __text string, __media string, __url string, __rank int")
    out = quality_rules(df).first()
    assert (out["__text"], out["n_words"]) == ("a", 2)
    found = clips(store_texts(df)).first()
    assert (found["__media"], found["__text"], found["clip"]) == ("b", "a", 0)
    judged = judge_urls(df.withColumnRenamed("text", "url"), query_rules()).first()
    assert (judged["__url"], judged["__rank"], judged["verdict"]) == ("c", 4, "allow")
    assert shared.free_name(df, "__TEXT") == "__TEXT_"
