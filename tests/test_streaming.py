import shutil

from opinara.streaming import opinions


def test_daily_windows_match_the_batch(spark, sf_dir, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in" / "a.parquet")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    opinions.run_available(opinions.daily(opinions.read(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {(str(r["day"])[:10], r["stance"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(ts AS date) AS day", "event_type").groupBy("day", "event_type").count().collect()
    want = {(str(r[0]), r[1]): r[2] for r in want}
    # days that the watermark has not passed yet are still open
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 15
