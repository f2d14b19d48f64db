import pytest

from prepkit import session


def test_shuffle_partitions_follow_the_size(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        session.configure(spark, shuffled_bytes=100 << 40)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == (100 << 40) // (128 << 20)
        session.configure(spark, shuffled_bytes=1)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == (100 << 40) // (128 << 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_staged_tables_lie_in_the_shared_folder(spark):
    one, two = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    root = session.scratch_root(spark)
    assert one != two and one.startswith(root)
    staged = session.stage(spark.range(5))
    assert staged.count() == 5 and root.removeprefix("file:") in staged.inputFiles()[0]


def test_a_large_input_gets_more_partitions(spark, tmp_path, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.range(100000)
    df.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    size = session.input_bytes(read.groupBy("id").count().join(read, "id"))
    assert size == 2 * session.input_bytes(read) > 100000
    try:
        monkeypatch.setattr(session, "PARTITION_BYTES", 10000)
        session.stage(read.groupBy("id").count())
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) >= 3 * size // 2 // 10000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_settings_of_the_user_stay(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        session.configure(spark)
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_staged_tables_go_at_the_end_of_a_job(spark):
    import os

    with session.scratch(spark):
        staged = session.stage(spark.range(5))
        path = os.path.dirname(staged.inputFiles()[0].removeprefix("file://"))
        assert os.path.isdir(path)
    assert not os.path.exists(path)


class Stub:
    """A session with these settings."""

    def __init__(self, named, master):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_the_named_folder_is_used():
    assert session.scratch_root(Stub("hdfs://host/shared/", "spark://host:7077")) == "hdfs://host/shared"


def test_only_a_local_session_makes_its_own_folder():
    local = Stub(None, "local[2]")
    assert session.scratch_root(local) == session.scratch_root(local) == local.folder
    for master in ("spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.scratch_root(Stub(None, master))
