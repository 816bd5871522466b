"""A registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        """Registers a function under its name, with the SQL that gives the same rows."""

        def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return put


#: The adapters of `sources.fixtures` in SQL.
OPINIONS = """opinions AS (
    SELECT event_id, user_id, event_type AS stance, ts, cast(json_extract_string(props, '$.k') AS INT) AS k,
           CASE WHEN cast(json_extract_string(props, '$.k') AS INT) < 33 THEN -1 WHEN cast(json_extract_string(props, '$.k') AS INT) < 66 THEN 0 ELSE 1 END AS predicted,
           event_id % 3 AS classifier_id, user_id % 4 AS community
    FROM events)"""
MOMENTS = "count(predicted) AS n, sum(predicted) / count(predicted) AS mean, greatest(sum(predicted * predicted) / count(predicted) - (sum(predicted) / count(predicted)) * (sum(predicted) / count(predicted)), 0.0) AS variance"
SNAPSHOTS = OPINIONS + f""", snapshots AS (
    SELECT CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS snapshot, user_id, stance, {MOMENTS.replace("sum(predicted)", "cast(sum(predicted) AS DOUBLE)").replace("sum(predicted * predicted)", "cast(sum(predicted * predicted) AS DOUBLE)")}
    FROM opinions GROUP BY ALL)"""
COMMENTS = """comments AS (
    SELECT conv_id || 'x' || turn AS id, CASE WHEN turn = 0 THEN NULL WHEN turn = 1 THEN 't3_' || conv_id ELSE 't1_' || conv_id || 'x' || (turn - 1) END AS parent_id,
           '/r/sub/comments/' || conv_id || '/title/' || CASE WHEN turn > 0 THEN turn || '/' ELSE '' END AS permalink, role AS author, text AS body, conv_id, turn
    FROM conversations), submissions AS (
    SELECT cast(conv_id AS VARCHAR) AS id, '/r/sub/comments/' || conv_id || '/title/' AS permalink, role AS title, text AS selftext FROM conversations WHERE turn = 0)"""
CONTENTS = "contents AS (SELECT vec_id AS content_id, vec_id % 25 AS author, vec_id AS t, label AS topic, vec_id // 2 AS viewed_id, embedding FROM embeddings)"
GRAPH = """graph AS (
    SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, l_returnflag AS type FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
ANNOTATIONS = """annotations AS (
    SELECT doc_id, unnest([1, 2, 3]) AS annotator, unnest([CASE WHEN quality = 1 THEN 'favor' ELSE 'against' END, CASE WHEN toxic = 1 THEN 'against' ELSE 'favor' END,
           CASE doc_id % 3 WHEN 0 THEN 'favor' WHEN 1 THEN 'neutral' ELSE 'against' END]) AS label FROM labels),
predictions AS (SELECT a.doc_id, a.label AS gold, b.label AS predicted FROM annotations a JOIN annotations b ON a.doc_id = b.doc_id AND a.annotator = 1 AND b.annotator = 3)"""
PROFILES = """profiles AS (
    SELECT c.classifier_id, t.v AS actual, p.v AS predicted, CASE WHEN t.v = p.v THEN c.d ELSE round((1 - c.d) / 2, 4) END AS prob
    FROM (VALUES (0, 0.9::DOUBLE), (1, 0.8), (2, 0.7)) c(classifier_id, d), (VALUES (-1), (0), (1)) t(v), (VALUES (-1), (0), (1)) p(v))"""
