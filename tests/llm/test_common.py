import hashlib

from pyspark.sql import functions as F

from prepkit.llm import common as c


def test_seeded_is_the_digest_of_seed_and_parts(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "i bigint, s string")
    got = [r[0] for r in df.select(c.seeded(7, "i", F.col("s"))).collect()]
    texts = ["7|1|a", "7||b", "7|2|"]
    assert got == [int(hashlib.md5(t.encode()).hexdigest()[:13], 16) for t in texts]


def test_names_that_clash(spark):
    assert c.fresh("x", ["a", "X", "_x"]) == "__x"
    df = spark.createDataFrame([(1, 2, 3)], "kept int, _kept int, other int")
    assert c.aside(df, ["Kept"]).columns == ["__kept", "_kept", "other"]
    assert c.aside(df, ["none"]).columns == df.columns


def test_workers_get_the_package_once(spark):
    c.ship(spark)
    before = len(spark.sparkContext.listFiles)
    c.ship(spark)
    sent = [f for f in spark.sparkContext.listFiles if f.endswith("prepkit.zip")]
    assert len(sent) == 1 and len(spark.sparkContext.listFiles) == before
