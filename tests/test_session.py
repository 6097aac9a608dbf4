import pytest

from eventlab import session


class FakeContext:
    folder = None
    master = "local[4]"

    def setCheckpointDir(self, folder):
        self.folder = f"file:{folder}/app"

    def getCheckpointDir(self):
        return self.folder


class FakeConf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class FakeSpark:
    def __init__(self, **conf):
        self.conf, self.sparkContext = FakeConf(conf), FakeContext()


def test_cluster_folder_wins():
    spark = FakeSpark(**{"spark.checkpoint.dir": "hdfs:///shared"})
    assert session.scratch_path(spark, "x").startswith("hdfs:///shared/x-")
    assert spark.sparkContext.folder is None


def test_temporary_folder_only_where_none_is_named():
    spark = FakeSpark()
    first = session.shared_dir(spark)
    assert "eventlab-" in first and session.shared_dir(spark) == first


def test_a_cluster_must_name_its_folder():
    spark = FakeSpark()
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077"):
        spark.sparkContext.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(spark)
    assert spark.sparkContext.folder is None


def test_runtime_settings(spark):
    session.configure(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")
