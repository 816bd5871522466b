"""Operators on literal inputs with values worked out by hand."""

import json
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from opinara.functions import scores, text
from opinara.operators import chains, evaluation, graph, landscape, models, movement, opinions, polarization
from opinara.sources import readers

SIDE = {"f": "favor", "n": "neutral", "a": "against"}


def one(df):
    return df.collect()[0]


def test_kappa(spark):
    rows = [(i, a, SIDE[c]) for i, item in enumerate(("fff", "ffn", "fna", "nnn", "faa"[:3], "aaa", "fff"[:3])) for a, c in enumerate(item)]
    counts = [(3, 0, 0), (2, 1, 0), (0, 3, 0), (1, 1, 1), (0, 0, 3), (0, 1, 2), (2, 0, 1)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(counts)], "doc_id int, favor int, neutral int, against int")
    r = one(evaluation.agreement(df))
    assert (r["kappa"], r["unanimous"], r["full_disagreement"]) == (0.353, round(3 / 7, 6), round(1 / 7, 6))
    assert evaluation.label_counts(spark.createDataFrame(rows, "doc_id int, annotator int, label string")).count() == 7


def test_f_scores(spark):
    df = spark.createDataFrame([(SIDE[g], SIDE[p]) for g, p in zip("ffffaaannn", "ffnnaafnna", strict=True)], "gold string, predicted string")
    got = {r["class"]: [round(r[c], 6) for c in ("precision", "recall", "f1", "fbeta")] for r in evaluation.class_scores(df).collect()}
    assert got["favor"] == [0.666667, 0.5, 0.571429, 0.625]
    assert got["against"] == [0.666667] * 4
    assert got["neutral"] == [0.5, 0.666667, 0.571429, 0.526316]
    macro = one(evaluation.macro_scores(evaluation.class_scores(df)))
    assert [round(x, 6) for x in macro] == [0.666667, 0.583333, 0.619048, 0.645833]


def test_invalid_label_is_an_error(spark):
    with pytest.raises(Exception, match="invalid label"):
        evaluation.label_counts(spark.createDataFrame([(1, "odd")], "doc_id int, label string")).collect()


def test_polarization(spark):
    rows = [("t", u, a, b) for u, bs in enumerate([(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 0.5)]) for a, b in zip("xyz", map(float, bs), strict=True)]
    df = spark.createDataFrame(rows, "snapshot string, user_id int, stance string, b double")
    assert one(polarization.symmetric(df))["polarization"] == 0.6875
    got = {r["mask"]: r["polarization"] for r in polarization.asymmetric(df, ["z", "y", "x"]).collect()}
    assert len(got) == 3 and max(got.values()) == 0.0625 and all(0 <= v <= 1 / 16 for v in got.values())
    assert len(polarization.partitions(5)) == 15
    er = spark.createDataFrame([("t", i, "x", b) for i, b in enumerate([0.0, 0.05, 0.95, 1.0])], "snapshot string, user_id int, stance string, b double")
    assert one(polarization.esteban_ray(er))["polarization"] == 0.148445


def test_regression_and_moments(spark):
    rows = zip([-1.0, -0.5, 0.0, 0.5, 1.0], [-0.8, -0.6, 0.1, 0.3, 0.9], [0.0, 0.1, 0.2, 0.1, 0.0], [0.02, 0.1, 0.2, 0.3, 0.0], strict=True)
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, x double, y double, vx double, vy double")
    r = one(landscape.regression(df, "k"))
    assert (r["slope"], r["intercept"], r["r2"]) == (0.853214, 0.036968, 0.995755)
    m = df.select("k", F.col("x").alias("mean"), F.col("vx").alias("variance"))
    assert abs(one(opinions.certainty_mean(m, "k"))["weighted_mean"]) < 1e-9


def test_between_and_away(spark):
    cases = [(1, 2, 1), (0, 2, 2), (3, 0, 3), (500, 1, 500)]
    df = spark.createDataFrame([tuple(map(float, c)) for c in cases], "ou double, po double, up double")
    got = [tuple(round(x, 6) for x in r) for r in df.select(scores.between(F.col("ou"), F.col("up")), scores.away(F.col("ou"), F.col("po"), F.col("up"))).collect()]
    assert got == [(0.5, 0.5), (0.880797, 0.5), (0.5, 0.952574), (0.5, 1.0)]


def test_frobenius_and_smoothing(spark):
    cells = [("s", i - 1, j - 1, p) for i, row in enumerate([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0, 0.2, 0.8]]) for j, p in enumerate(row)]
    assert one(opinions.frobenius(spark.createDataFrame([c[:3] + (float(c[3]),) for c in cells], "k string, predicted int, next int, share double"), "k"))["movement"] == 0.3937
    rows = spark.sql("SELECT 'k' AS k, TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(d) AS ts, x AS predicted FROM VALUES (0, -1), (10, 0), (20, 1) v(d, x)")
    assert one(opinions.smoothed(rows, "2024-01-21 00:00:01", 10.0, "k"))["smoothed"] == pytest.approx(0.428571, abs=1e-4)


def test_p_value():
    assert landscape.incomplete_beta(10 / 2, 0.5, 10 / (10 + 2.228139**2)) == pytest.approx(0.05, abs=1e-6)


def test_text(spark):
    row = lambda e, t: spark.createDataFrame([(t,)], "t string").select(e(F.col("t")).alias("x")).first()["x"]
    assert row(text.post_permalink, "/r/canada/comments/abc/title_x/def/") == "/r/canada/comments/abc/title_x/"
    assert row(text.post_permalink, "zzz") is None and row(text.post_permalink, None) is None
    assert row(text.parent_of, "t1_ab") == "ab" and row(text.parent_of, "t3_ab") is None
    assert row(text.parse_stance, "i disagree fully") == "against"
    assert row(text.slug, "a b/c") == "a_b_c" and row(text.pretty, "stance_the_ndp") == "The NDP"
    assert row(text.shorten, "x" * 31) == "x" * 30 + "..."
    assert row(text.soft_wrap, "a" * 100 + " b\nc") == "a" * 100 + "\nb c"
    assert [m["content"] for m in row(text.messages, "Post: x\nStance: favor")] == ["Post: x\nStance:", "favor"]


def test_rings_of_isolated_and_looped_nodes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "x")], "src string, dst string")
    got = {(r["node"], r["ring"]) for r in graph.rings(edges, spark.createDataFrame([("a",), ("x",)], "user string")).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 3)}


def test_interaction_edges(spark):
    videos = spark.sql("SELECT 'v' AS video_id, 'u1' AS author_id, timestamp_seconds(5) AS createtime, array('u2') AS mentions, CAST(NULL AS STRING) AS share_video_user_id")
    comments = spark.sql("SELECT * FROM VALUES ('c1', 'v', 'u2', timestamp_seconds(6), array('u3'), NULL), ('c2', 'v', 'u3', timestamp_seconds(7), array(), 'c1') t(comment_id, video_id, author_id, createtime, mentions, reply_comment_id)")
    got = {(r["src"], r["dst"], r["type"]) for r in graph.interaction_edges(videos, comments).collect()}
    assert got == {("u2", "u1", "video_comment"), ("u3", "u1", "video_comment"), ("u2", "u3", "comment_mention"), ("u1", "u2", "video_mention"), ("u3", "u2", "comment_reply")}


def test_sources(spark, tmp_path):
    import zstandard

    rows = [{"author": "a", "body": "b", "created_utc": 1704067200 + i * 86400 * 20, "id": str(i), "subreddit": "x" if i % 2 else "y"} for i in range(6)]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "RC_2024-01.zst").write_bytes(zstandard.ZstdCompressor().compress("\n".join(map(json.dumps, rows)).encode()))
    plain = readers.ndjson(spark, str(tmp_path / "raw"), keep=["x"])
    assert plain.count() == 3 and readers.long_window_zst(spark, str(tmp_path / "raw"), keep=["x"]).count() == 3
    readers.write_months(plain, str(tmp_path / "months"))
    months = spark.read.parquet(str(tmp_path / "months"))
    assert months.select("year_month").distinct().count() > 1
    raw = spark.createDataFrame([("RC_2024-01.zst",), ("RC_2031-05.zst",)], "f string").select(readers.year_month(F.col("f")).alias("year_month"))
    assert [r[0] for r in readers.pending(raw, months.select(F.col("year_month").cast("string"))).collect()] == ["2031-05"]
    calls = []
    for _ in range(2):
        assert readers.write_once(lambda: calls.append(1) or plain, spark, str(tmp_path / "once")).count() == 3
    assert len(calls) == 1


def test_yes_no_by_the_first_line(spark):
    from opinara.functions import text

    said = {"I agree": "yes", "well\nyes": "no", "yes and no": "no", "Yes.": "yes", "no": "no", "": "no", "I support it, not sure": "yes"}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", text.parse_yes_no(F.col("t")).alias("y")).collect()
    # "not" holds "no"
    assert {r["t"]: r["y"] for r in rows} == said | {"I support it, not sure": "no"}


def test_lookup_of_one_row(spark):
    from opinara.operators import cohort

    known = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert cohort.lookup_one(spark.createDataFrame([(1,)], "k int"), known, "k").collect() == [(1, "a")]
    for k in (2, 3):
        with pytest.raises(Exception, match="rows found for a key"):
            cohort.lookup_one(spark.createDataFrame([(k,)], "k int"), known, "k").collect()


def test_running_sums_by_ranges(spark):
    from opinara.operators import scans

    rows = [("ab"[i % 2], (i * 37) % 101, i % 5) for i in range(101)]
    got = scans.running(spark.createDataFrame(rows, "g string, o int, v int"), "o", {"v": F.col("v")}, "g", rows=9).collect()
    for r in got:
        own = [v for g, o, v in rows if g == r["g"] and o <= r["o"]]
        assert r["run_v"] == sum(own) and r["total_v"] == sum(v for g, _, v in rows if g == r["g"])
    assert len(got) == 101


def test_slope_and_mean_tests(spark):
    df = spark.createDataFrame([(1, float(x), 0.5, float(y), 0.5) for x, y in zip((1, 2, 3, 4, 5), (2, 4, 5, 4, 5), strict=True)], "g int, x double, vx double, y double, vy double")
    r = one(landscape.regression_test(df, "g"))
    assert (round(r["slope"], 6), round(r["r2"], 6), round(r["t"], 4), round(r["p_value"], 4)) == (0.6, 0.6, 2.1213, 0.1240)
    m = one(landscape.mean_test(df, "g"))
    assert (m["n"], round(m["mean_x"], 6), round(m["t_x"], 4), round(m["mean_y"], 6)) == (5, 3.0, 4.2426, 4.0)
    assert round(m["p_x"], 4) == 0.0132


def plain_bca(rows, replicates, level=0.95):
    """From the definition: Poisson weights, bias from the share below, acceleration from leave-one-out means."""
    normal = NormalDist()
    cuts = [math.floor(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 1_000_003) for k in range(8)]

    def poisson(u, r):
        u %= 1_000_003
        a = (u * 7919 + r * 104729 + 12345) % 1_000_003
        b = (a * a + 31 * a + r * 7907) % 1_000_003
        return sum(c <= (b * b + 17 * b + u) % 1_000_003 for c in cuts)

    mean = lambda xs: sum(w * m for _, m, w in xs) / sum(w for _, _, w in xs)
    whole = mean(rows)
    drawn = sorted(mean([(u, m, w * poisson(u, r)) for u, m, w in rows]) for r in range(1, replicates + 1))
    z0 = normal.inv_cdf(sum(x < whole for x in drawn) / replicates)
    out = [mean(rows[:i] + rows[i + 1 :]) for i in range(len(rows))]
    middle = sum(out) / len(out)
    a = sum((middle - x) ** 3 for x in out) / (6 * sum((middle - x) ** 2 for x in out) ** 1.5)
    bounds = []
    for p in ((1 - level) / 2, (1 + level) / 2):
        z = normal.inv_cdf(p)
        at = normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) * (replicates - 1)
        i = int(at)
        bounds.append(drawn[i] + (at - i) * (drawn[min(i + 1, replicates - 1)] - drawn[i]))
    return bounds


def test_normal_distribution_in_sql(spark):
    xs = [(x / 10,) for x in range(-45, 46)]
    df = spark.createDataFrame(xs, "x double").selectExpr("x", f"{landscape.normal('x')} AS p")
    df = df.selectExpr("x", "p", f"{landscape.normal_quantile('p')} AS q").selectExpr("x", "p", f"{landscape.refined('q', 'p')} AS q").collect()
    assert all(abs(r["p"] - NormalDist().cdf(r["x"])) < 1e-7 for r in df)
    assert all(abs(r["q"] - r["x"]) < 1e-3 for r in df if abs(r["x"]) < 3)


def test_tokens_and_emoji(spark):
    said = "@ann Look: https://x.y/z?a=1 isn't it great!!! :-) #so-good 3.5kg don't... 😀🚀 e.g. état-major a@b.co…"
    r = spark.createDataFrame([(said,), ("",), (None,)], "t string").select(text.tokens(F.col("t")).alias("k"), text.normalize(F.col("t")).alias("n")).collect()
    assert r[0]["k"] == ["@ann", "Look", ":", "https://x.y/z?a=1", "isn't", "it", "great", "!", "!", "!", ":-)", "#so-good", "3.5", "kg", "don't", "...", "😀", "🚀", "e", ".", "g", ".", "état-major", "a@b.co", "…"]
    assert r[0]["n"] == "@USER Look : HTTPURL is n't it great ! ! ! :-) #so-good 3.5 kg do n't ... :grinning_face: :rocket: e . g . état-major a@b.co ..."
    assert (r[1]["k"], r[1]["n"], r[2]["n"]) == ([], "", None)


def test_empty_months(spark):
    rows = [(1, "2024-01-31 10:00:00", 2.0), (1, "2024-04-01 00:00:00", 4.0), (1, "2024-04-02 00:00:00", 5.0), (2, "2023-12-05 00:00:00", None), (3, None, 1.0)]
    df = spark.createDataFrame(rows, "u int, s string, v double").withColumn("ts", F.to_timestamp("s"))
    got = sorted((r["u"], str(r["month"])[:7], r["n"], r["mean"]) for r in movement.monthly(df, "u", "ts", "v").collect())
    assert got == [(1, "2024-01", 1, 2.0), (1, "2024-02", 0, None), (1, "2024-03", 0, None), (1, "2024-04", 2, 4.5), (2, "2023-12", 1, None)]


def test_bootstrap_intervals(spark):
    same = spark.createDataFrame([(i, "s", 0.25, 0.1) for i in range(20)], "user_id long, stance string, mean double, variance double")
    r = one(landscape.bootstrap_mean(same, 50, "stance"))
    assert (r["mean"], r["lo"], r["hi"]) == (0.25, 0.25, 0.25)
    spread = spark.createDataFrame([(i, "s", (-1.0) ** i, 0.0) for i in range(400)], "user_id long, stance string, mean double, variance double")
    r = one(landscape.bootstrap_mean(spread, 400, "stance"))
    # the standard error of the mean is 1/20, so the interval is about 0.098 to each side
    assert r["mean"] == 0 and -0.13 < r["lo"] < -0.07 and 0.07 < r["hi"] < 0.13
    skewed = [(i, "s", (i % 40) ** 3 / 32000 - 0.5, (i % 5) / 10) for i in range(120)]
    r = one(landscape.bootstrap_mean(spark.createDataFrame(skewed, "user_id long, stance string, mean double, variance double"), 500, "stance"))
    lo, hi = plain_bca([(u, m, math.exp(-v)) for u, _, m, v in skewed], 500)
    assert abs(r["lo"] - lo) < 1e-5 and abs(r["hi"] - hi) < 1e-5
    line = spark.createDataFrame([(i, "s", float(i), 2.0 * i) for i in range(30)], "user_id long, stance string, x double, y double")
    r = one(landscape.bootstrap(line, 50, "stance"))
    assert (r["lo"], r["hi"]) == (1.0, 1.0)


def test_beta(spark):
    o = spark.createDataFrame([(1, "a", 1), (1, "b", 0)], "user_id long, stance string, predicted int")  # Beta(2, 1) is 2x, Beta(1, 1) is 1
    got = {(r["stance"], r["cell"]): r["density"] for r in landscape.beta_density(o, 10).collect()}
    assert got[("a", 0)] == 0.1 and got[("a", 9)] == 1.9 and got[("b", 4)] == 1.0
    got = {(r["cx"], r["cy"]): r["density"] for r in landscape.beta_density_2d(o, 10).collect()}
    assert len(got) == 100 and got[(0, 7)] == 0.1 and got[(9, 0)] == 1.9
    q = one(spark.range(1).select(landscape.beta_quantile(F.lit(1), F.lit(1), 0.25).alias("flat"), landscape.beta_quantile(F.lit(2), F.lit(1), 0.5).alias("rising")))
    assert (round(q["flat"], 9), round(q["rising"], 9)) == (0.25, round(0.5**0.5, 9))


def test_hmm_finds_still_and_alternating_opinions(spark):
    rows = [(u, s, t, t, 0, 1 if s == "still" else (-1) ** t) for u in range(10) for s in ("still", "swing") for t in range(30)]
    o = spark.createDataFrame(rows, "user_id long, stance string, ts long, event_id long, classifier_id long, predicted int")
    sure = spark.createDataFrame([(0, a, p, 0.98 if a == p else 0.01) for a in (-1, 0, 1) for p in (-1, 0, 1)], "classifier_id long, actual int, predicted int, prob double")
    got = {(r["stance"], r["state"], r["next"]): r["prob"] for r in chains.hmm(o, sure).collect()}
    assert got[("still", 1, 1)] > 0.97 and got[("swing", 1, -1)] > 0.9 and got[("swing", -1, 1)] > 0.9


def test_spline_of_a_constant(spark):
    rows = [(1, "s", i, 1, f"2024-01-01 {i:02d}:00:00") for i in range(24)]
    o = spark.createDataFrame(rows, "user_id long, stance string, event_id long, predicted int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = models.splines(o, ridge=1e-6).collect()
    assert len(got) == 12 and all(abs(r["mean"] - 1) < 1e-4 and r["lo"] <= r["mean"] <= r["hi"] for r in got)


def test_predict_hook(spark):
    import pandas as pd

    df = spark.createDataFrame([(1, "abc"), (2, "a"), (3, None)], "id int, body string")
    got = dict(models.predict(df, lambda s: pd.Series(s.fillna("").str.len().astype(str)), "body").select("id", "predicted").collect())
    assert got == {1: "3", 2: "1", 3: "0"}


def test_best_class_macro(spark):
    rows = [("favor", "m1", 5, 0.5, 0.9, 0.6), ("favor", "m2", 5, 0.7, 0.7, 0.7), ("against", "m1", 5, 0.9, 0.3, 0.5), ("against", "m2", 5, 0.1, 0.1, 0.1), ("neutral", "m1", 5, 1.0, 1.0, 1.0)]
    r = one(evaluation.best_class_macro(spark.createDataFrame(rows, "class string, run string, support int, precision double, recall double, f1 double"), "run"))
    assert tuple(r) == (0.8, 0.5, 0.6)


def test_files_and_sinks(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for n in ("canada_comments_filtered_2022-01", "canada_comments_filtered_2022-02", "canada_submissions_filtered_2022-01", "other.txt"):
        (raw / n).write_text("x")
    side = {k: readers.files(spark, str(raw), rf"^canada_{k}_filtered_\d{{4}}-\d{{2}}$") for k in ("comments", "submissions")}
    assert side["comments"].count() == 2
    assert [r["year_month"] for r in readers.paired(side["comments"], side["submissions"]).collect()] == ["2022-01"]
    assert readers.file_sample(side["comments"], 1.0).count() == 2 and readers.file_sample(side["comments"], 0.0).count() == 0

    runs = spark.createDataFrame([("r1", "finished", 0.5), ("r2", "failed", None)], "run string, state string, f1 double")
    readers.write_metrics(runs, str(tmp_path / "runs"))
    assert [tuple(r) for r in readers.finished_runs(spark, str(tmp_path / "runs"), runs.schema).collect()] == [("r1", "finished", 0.5)]

    rows = spark.createDataFrame([("007", 'a "b"\nc', 3), ("x", "d", 1)], "id string, text string, n int")
    readers.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(readers.typed_csv(spark, str(tmp_path / "csv"), rows.schema).collect()) == sorted(rows.collect())
    readers.write_samples(rows, str(tmp_path / "zstd"))
    readers.write_sequences(rows, str(tmp_path / "sequences"), "id", "n")
    assert all(sorted(spark.read.parquet(str(tmp_path / p)).collect()) == sorted(rows.collect()) for p in ("zstd", "sequences"))

    readers.write_graph(spark.createDataFrame([("a", "b"), ("c", "c")], "src string, dst string"), str(tmp_path / "graph"))
    assert readers.read_graph(spark, str(tmp_path / "graph")).count() == 1
    assert spark.read.parquet(str(tmp_path / "graph/nodes")).count() == 3

    (tmp_path / "catalogue.json").write_text(json.dumps({"topic_stances": [{"topics": [1, 2], "stances": ["gun control"]}]}))
    known = readers.catalogue(spark, str(tmp_path / "catalogue.json"))
    got = readers.topics_of(spark.createDataFrame([("gun control",), ("rent",)], "stance string"), known)
    assert sorted((r["stance"], r["topic"] or 0) for r in got.collect()) == [("gun control", 1), ("gun control", 2), ("rent", 0)]


def test_linked_centroids(spark, monkeypatch):
    """The same as centroids of the join, with sums broadcast or shuffled; tasks hold the keys of few links."""
    from opinara.operators import vectors

    links = spark.createDataFrame([(f"k{i % 40}", i % 7) for i in range(600)] + [("k1", None), ("lone", 99), (None, 3)], "src string, author long")
    content = spark.createDataFrame([(i % 6, [float(i), None if i % 5 == 0 else i * 0.5, 1.0][: 3 - i % 2]) for i in range(50)] + [(None, [1.0]), (2, None)], "author long, embedding array<double>")
    want = sorted(map(tuple, vectors.centroids(links.distinct().join(content, "author"), "src").collect()), key=str)
    for most in (0, 10_000):
        monkeypatch.setattr(vectors, "MOST_BROADCAST", most)
        got = vectors.linked_centroids(links, content, "src", "author", each=50)
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert got.rdd.getNumPartitions() == 6  # 251 links
