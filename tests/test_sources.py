"""Dumps, listed files and platform tables."""

import json

import pytest
import zstandard
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from opinara.operators import graph
from opinara.sources import dumps, readers


@pytest.fixture
def folder(tmp_path):
    for month, rows in (("2024-01", 25_000), ("2024-02", 10)):
        lines = [json.dumps({"id": f"{month}-{i}", "subreddit": "abc"[i % 3], "created_utc": i, "score": "x" if i == 4 else i, "body": "é  " * 3, "more": [1]}) for i in range(rows)]
        lines[1:1] = ["", "no json", "[1]", '{"id": "lonely"}']
        raw = "\n".join(lines).encode()
        params = zstandard.ZstdCompressionParameters(window_log=28, enable_ldm=True)
        half = len(raw) // 2
        packed = b"".join(zstandard.ZstdCompressor(compression_params=params).compress(x) for x in (raw[:half], raw[half:]))
        (tmp_path / f"RC_{month}.zst").write_bytes(packed)
    (tmp_path / "notes.txt").write_text("not a dump")
    return str(tmp_path)


def test_dumps_are_streams(spark, folder):
    df = dumps.read_dumps(spark, folder, readers.COMMENT)
    assert df.count() == 25_012 and df.rdd.getNumPartitions() == 2
    assert df.where("subreddit = 'a'").count() == 8334 + 4
    r = df.where("id = '2024-02-4'").first()
    assert r["score"] is None and r["created_utc"] == 4 and r["body"] == "é  " * 3
    assert df.where("subreddit IS NULL").count() == 2
    assert dumps.read_dumps(spark, folder, readers.COMMENT, ["b", "zzz"]).select("subreddit").distinct().collect()[0][0] == "b"
    assert dumps.read_dumps(spark, f"{folder}/RC_2024-02.zst", readers.COMMENT).count() == 11


def test_filters_reach_the_reader(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert dumps.read_dumps(spark, folder, readers.COMMENT).where("subreddit IN ('a', 'b') AND score > 24000").count() == 666
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = dumps.FilteringReader(readers.COMMENT, f"file://{folder}", ".zst", "subreddit", None)
    more = GreaterThan(("score",), 3)
    assert list(reader.pushFilters([In(("subreddit",), ("a", "b")), more, EqualTo(("subreddit",), "b")])) == [more]
    assert reader.keep == {"b"}
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 8333 + 3
    assert max(b.num_rows for p in reader.partitions() for b in reader.read(p)) <= dumps.BATCH


def test_lines_across_blocks():
    raw = b"ab\ncd\n\nefg"
    assert all(list(dumps.lines(raw[i : i + n] for i in range(0, len(raw), n))) == [b"ab", b"cd", b"", b"efg"] for n in range(1, 12))


def test_listed_files_are_scanned(spark, tmp_path):
    for month, schema in (("2024-01", "id string, score long"), ("2024-02", "score long, id string, title string"), ("2024-03", "id string")):
        row = {"id": month, "score": 7, "title": "t"}
        names = [f.split()[0] for f in schema.split(", ")]
        spark.createDataFrame([tuple(row[n] for n in names)], schema).coalesce(1).write.parquet(f"{tmp_path}/raw/{month}")
        part = next((tmp_path / "raw" / month).glob("part-*.parquet"))
        part.rename(tmp_path / f"canada_comments_{month}.parquet")
    found = readers.files(spark, str(tmp_path), r"^canada_comments_2024-0[12]\.parquet$")
    got = sorted(map(tuple, readers.scan(spark, found, "id string, score long, title string").collect()))
    assert got == [("2024-01", 7, None, "2024-01"), ("2024-02", 7, "t", "2024-02")]
    assert readers.scan(spark, found.limit(0), "id string").count() == 0


def test_platform_tables(spark, tmp_path):
    (tmp_path / "videos.csv").write_text(
        "video_id,author_id,author_name,createtime,desc,hashtags,mentions,share_video_id,share_video_user_id,share_type\n"
        "007,1,ann,2024-01-02 03:04:05,\"a, b\",\"['x', 'y']\",[],,,\n007,1,ann,2024-01-02 03:04:06,later,[],[],,,\n8,2,bob,2024-01-03 00:00:00,c,,\"['1']\",007,1,duet\n"
    )
    (tmp_path / "comments.csv").write_text(
        "comment_id,video_id,author_id,author_name,createtime,text,comment_language,mentions,reply_comment_id\n"
        "1,007,2,bob,2024-01-02 04:00:00,hi,en,\"['1', '3']\",\n2,007,1,ann,2024-01-02 05:00:00,\"two\nlines\",en,[],1\n,007,1,ann,2024-01-02 05:00:00,none,en,[],\n"
    )
    v, c = readers.videos(spark, str(tmp_path / "videos.csv")), readers.video_comments(spark, str(tmp_path / "comments.csv"))
    got = {r["video_id"]: r for r in v.collect()}
    assert set(got) == {"007", "8"} and got["007"]["desc"] == "a, b" and got["007"]["hashtags"] == ["x", "y"] and got["8"]["hashtags"] == [] and got["8"]["mentions"] == ["1"]
    assert sorted((r["comment_id"], r["mentions"], r["text"]) for r in c.collect()) == [("1", ["1", "3"], "hi"), ("2", [], "two\nlines")]
    edges = sorted((r["src"], r["dst"], r["type"]) for r in graph.interaction_edges(v, c).collect())
    assert edges == [("1", "1", "video_comment"), ("1", "2", "comment_reply"), ("2", "1", "comment_mention"), ("2", "1", "video_comment"), ("2", "1", "video_mention"), ("2", "1", "video_share"), ("2", "3", "comment_mention")]
