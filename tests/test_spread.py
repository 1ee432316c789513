"""Tables of few row groups are dealt out over the cores, however many splits their files are cut into."""

from pyspark.sql import functions as F

from threatloom import session


def _filled(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_one_row_group_in_many_splits(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("t"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/t")
    before = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        df = spark.read.parquet(f"{tmp_path}/t")
        cores = spark.sparkContext.defaultParallelism
        assert df.rdd.getNumPartitions() >= cores and _filled(df) == 1
        dealt = session.spread(df, "id")
        assert _filled(dealt) == cores and dealt.distinct().count() == 20_000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_larger_tables_get_more_parts_and_many_parts_stay(spark, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_ROWS", 100)
    assert session.spread(spark.range(5_000).coalesce(1), "id").rdd.getNumPartitions() == 50
    many = spark.range(0, 5_000, 1, session.FEW_SPLITS)
    assert session.spread(many, "id") is many
    assert session.spread(spark.range(0), "id").count() == 0
