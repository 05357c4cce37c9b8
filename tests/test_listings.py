"""Files followed by listings: what comes, changes and goes is told once each."""

from corpusloom.operators import incremental


def test_deletes_are_told_once(spark, tmp_path):
    schema = "path string, text string"
    state = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def listed(rows, day):
        incremental.listing(spark.createDataFrame(rows, schema), f"2024-01-{day:02} 00:00:00").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.watch_listings(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
        rows = spark.read.schema("file_path string, change string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).collect()
        return sorted((r.file_path, r.change) for r in rows)

    first = [("a", "added"), ("b", "added"), ("c", "added")]
    assert listed([("a", "1"), ("b", "1"), ("c", "1")], 1) == first
    second = [*first, ("b", "changed"), ("c", "deleted"), ("d", "added")]
    assert listed([("a", "1"), ("b", "2"), ("d", "1")], 2) == sorted(second)
    third = [*second, ("c", "added"), ("d", "deleted")]
    assert listed([("a", "1"), ("b", "2"), ("c", "9")], 3) == sorted(third)
    assert listed([("a", "1"), ("b", "2"), ("c", "9")], 4) == sorted(third)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == state


def test_state_goes_to_python_in_batches(spark, tmp_path):
    """No call for each file's state: those grew to hours on large trees."""
    listings = spark.readStream.schema(incremental.LISTING).parquet(str(tmp_path))
    plan = incremental.changes(listings)._jdf.queryExecution().logical().toString()
    assert "TransformWithState" not in plan
