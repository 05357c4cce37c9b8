"""Joins and groups where one key has a third of all rows, and where very many keys are hot."""

from pyspark.sql import functions as F

from corpusloom.plans import reduce
from corpusloom.plans.staging import join_hot


def spread(df):
    """Rows of the largest task of the joined table's last stage."""
    return max(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


def test_more_hot_keys_than_are_broadcast(spark):
    """The hottest go by broadcast, the others by shuffle; all are joined. Limits are lowered: 201 keys are hot, 100 are broadcast."""
    skewed = spark.range(30_000).select(F.when(F.col("id") < 10_000, 0).otherwise(F.col("id") % 200 + 1).alias("k"), "id")
    rows = skewed.repartition(8).cache()
    sizes = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("k"), "k")).cache()
    joined = join_hot(rows, sizes, "k", hot=20, most=100)
    got = joined.agg(F.count("*"), F.count_if(F.col("name") == F.concat(F.lit("k"), "k")), F.countDistinct("id")).first()
    assert tuple(got) == (30_000, 30_000, 30_000)
    assert spread(joined) < 8_000  # key 0 alone has 10,000 rows
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()


def test_a_hot_class_of_near_duplicates(spark, monkeypatch):
    """A class with a third of all rows meets its group by broadcast."""
    monkeypatch.setattr(reduce, "join_hot", lambda a, b, key: join_hot(a, b, key, hot=100))
    same = "licensed under the terms of the licence that comes with it"
    text = F.when(F.col("id") % 3 == 0, same).when(F.col("id") == 1, f"{same} now").otherwise(F.concat(F.lit("text number "), F.sha2(F.col("id").cast("string"), 256)))
    rows = spark.range(9_000).withColumn("t", text).repartition(8)
    groups = reduce.near_groups(rows, "id", "t").cache()
    got = {r.group_id: r.n for r in groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").collect()}
    assert got == {0: 3_001} and groups.count() == 9_000 and groups.where("id = 1").first().n_links == 1
    assert spread(groups) < 3_000
