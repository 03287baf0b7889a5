from millrace import session


def test_spread_bounds_the_rows_of_a_task(spark, tmp_path, monkeypatch):
    """Rows that compress well come as few splits, whatever their number."""
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    path = str(tmp_path / "t")
    spark.range(6_000).repartition(8).write.parquet(path)
    dealt = session.spread(spark.read.parquet(path))
    assert dealt.rdd.getNumPartitions() == 60 and dealt.count() == 6_000
    assert max(dealt.rdd.glom().map(len).collect()) <= 200
    few = spark.read.parquet(path).filter("id < 1000")
    splits = few.rdd.getNumPartitions()
    assert session.spread(few).rdd.getNumPartitions() == (splits if splits >= 4 else 10)
