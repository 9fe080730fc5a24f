from pyspark.sql import functions as F

from stemloom.session import _written, hot_limit, join_groups, join_hot, materialize, scratch


def rows(spark):
    """One key holds a third of the rows."""
    return spark.range(0, 3000, numPartitions=4).select(F.col("id").alias("v"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).cast("int").alias("k"))


def largest_task(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_limit_bounds_the_hot_keys():
    assert hot_limit(10) == 100_000 and 10**12 // hot_limit(10**12) <= 1 << 17


def test_join_groups(spark):
    r = rows(spark)
    g = r.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = join_groups(r, g, ["k"], "n", 3000, limit=100)
    assert sorted(map(tuple, got.select("v", "k", "n").collect())) == sorted(map(tuple, r.join(g, "k").select("v", "k", "n").collect()))


def test_join_hot(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        r, o = rows(spark), spark.range(0, 600).select((F.col("id") % 600).cast("int").alias("k"), (F.col("id") * 2).alias("w"))
        hot = r.groupBy("k").count().where("count > 100")
        got, plain = join_hot(r, o, ["k"], hot, 16), r.join(o, "k")
        assert sorted(map(tuple, got.select("v", "k", "w").collect())) == sorted(map(tuple, plain.select("v", "k", "w").collect()))
        assert largest_task(got) < 1200 < largest_task(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_scratch_removes_what_was_written(spark):
    before = len(_written)
    with scratch():
        d = materialize(rows(spark), by="k")
        assert d.where("k = 7").count() == 4 and len(_written) == before + 1
        path = _written[-1][1]
    assert len(_written) == before
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
