"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns have defined results."""

import hashlib

import pytest

from opinara.llm import byte_bpe, compression, decontaminate, jaccard, language, line_dedup, pii, preference, quality, toxicity

LONG = "the quick brown fox jumps over the lazy dog again and again until night falls " * 3000
TEXTS = [None, "", "   \n\t ", "one", "a b c d e f g h", "a b c d e f g h", LONG, "Zürich ñandú 東京 🎉 " * 40, "x" * 70_000]
SCHEMA = "doc_id bigint, text string, lang string, score double, spans string, n int, sig string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, 0.5, "s", 1, "x", None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "a b c d e f g h", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_byte_bpe(odd, none):
    got = byte_bpe.decode(byte_bpe.encode(odd, chunk=300, overlap=30), digest=True).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] is not None:
            assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()
    assert all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (0, 1))
    assert byte_bpe.decode(byte_bpe.encode(none)).count() == 0


def test_compression(odd, none):
    got = {r["doc_id"]: r for r in compression.judge(odd).collect()}
    assert got[0]["n_words"] == 0 and got[0]["base_failed"] and not got[0]["kept"]
    assert not got[6]["kept"] and not got[8]["kept"]
    assert compression.judge(odd).count() == len(TEXTS) + 2 and compression.judge(none).count() == 0


def test_pii(odd, none):
    got = pii.find(odd).collect()
    assert len(got) == len(TEXTS) + 2 and all(r["spans"] == "" for r in got)
    assert pii.find(none).count() == 0


def test_language(odd, none):
    model = language.learn(odd)
    got = {r["doc_id"]: r for r in language.predict(odd, model).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[6]["lang_pred"] == "en"
    assert language.learn(none) is None
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}
    assert language.predict(none, model).count() == 0


def test_classifiers(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(TEXTS))], "doc_id bigint, label int")
    for op in (quality, toxicity):
        for l in (labels, labels.where("label = 1"), labels.limit(0)):
            model = op.learn(odd, l)
            got = op.score(odd, model).collect()
            assert len(got) == len(TEXTS) + 2 and all(0 <= r["score"] <= 1 for r in got)
        assert op.score(none, model).count() == 0


def test_jaccard(odd, none):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(odd).collect()]
    assert len(got) == len(TEXTS) + 2
    assert (4, 4, 4) in got and (5, 4, 4) in got and (0, 0, 0) in got and (2, 0, 2) in got and (3, 1, 3) in got
    assert (None, 4, 4) in got
    assert jaccard.join(none).count() == 0


def test_line_dedup(odd, none):
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(odd).collect()}
    # the null id sorts first and keeps the line
    assert 4 not in got and 5 not in got and got[None] == "a b c d e f g h" and got[0] is None and got[1] == "" and got[6] == LONG
    assert line_dedup.dedup(odd).columns == odd.columns
    assert line_dedup.dedup(none).count() == 0


def test_decontaminate(spark, odd, none):
    bench = spark.createDataFrame([(1, LONG[:200]), (2, None), (3, ""), (1, LONG[:200])], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, bench).collect()} == {(6, 1)}
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0 and decontaminate.leaks(none, bench).count() == 0


def test_preference(spark):
    rows = [(0, 0, 0, 0, "user", "hi"), (0, 0, 0, 0, "user", "hi"), (0, 0, 0, 1, "assistant", "yes"), (0, 1, 1, 0, "user", "hi"), (0, 1, 1, 1, "assistant", None), (1, 0, 2, None, None, "x"), (1, 1, 3, None, None, "x"), (2, 0, 4, 0, "user", "alone"), (None, 0, None, 0, "user", "no id")]
    got = {r["pair_id"]: r for r in preference.format_pairs(spark.createDataFrame(rows, "pair_id bigint, side bigint, conv_id bigint, turn bigint, role string, text string")).collect()}
    assert set(got) == {0, 1}
    r = got[0]
    assert r["n_common_turns"] == 1 and r["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    for side, said in (("chosen", "yes"), ("rejected", "")):
        a, b = map(int, r[f"{side}_loss"].split(":"))
        assert r[side][a:b] == said + "<|im_end|>"
    assert got[1]["n_common_turns"] == 1 and got[1]["chosen"] == "" and got[1]["chosen_loss"] == ""


STAGE = "doc_id bigint, text string, lang string, source string, n_chars bigint, of_doc int, gone_lines int, text_key int, sig string, found int"


@pytest.fixture(scope="module")
def stage_input(spark):
    rows = [(i, t, None, "s", len(t or ""), 1, 2, 3, "x", 4) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "a b c d e f g h", None, None, 15, None, None, None, None, None), (None, LONG, None, None, 5, None, None, None, None, None), (4, "not the same text as its namesake", None, None, 33, None, None, None, None, None)], STAGE)


def test_stages_take_any_input(spark, stage_input, tmp_path):
    """Each stage on nulls, repeated rows, shared ids, long texts, clashing column names, and on an empty table."""
    spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("first", LONG[:200]), (None, "zz yy xx")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (quality.keep_good, line_dedup.without_repeats, jaccard.keep_one, decontaminate.without_leaks):
        got = stage(spark, stage_input, str(tmp_path))
        assert got.columns == stage_input.columns
        kept = got.count()
        assert 0 < kept <= stage_input.count() or stage is quality.keep_good
        assert stage(spark, stage_input.limit(0), str(tmp_path)).count() == 0
    # only rows whose own text holds an item go
    left = decontaminate.without_leaks(spark, stage_input, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == sorted([0, 1, 2, 3, 4, 4, 4, 5, 7, 8])
    assert [r["text"] for r in left if r["doc_id"] is None] == ["a b c d e f g h"]


def test_loose_spans_among_many_base_spans():
    text = "a@b.co " * 3000 + "call (212) 555-0100 now"
    base = pii.base_spans(text)
    assert len(base) == 3000 and [k for _, k, _ in pii.loose_spans(text, base)] == [3]
    card = "+1 (212) 555-0100 and (212) 555-0101"
    assert [(a, b) for a, _, b in pii.loose_spans(card, pii.base_spans(card))] == [(22, 36)]


def test_chunks_cover_the_text():
    for n in (1, 2048, 2049, 3072, 3073, 5000, 7168, 9000):
        cut = compression.chunks(bytes(n), 2048)
        assert sum(map(len, cut)) == (n if n > 2048 else 0) and all(1024 < len(c) <= 3072 for c in cut)


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the quick brown fox number {i}", "en") for i in range(3000)] + [(5000 + i, f"東京都は日本の首都 {i}", "ja") for i in range(3)]
    model = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample=200)
    assert model["names"] == ["en", "ja"]
    got = language.predict(spark.createDataFrame([(1, "日本の首都"), (2, "a brown fox")], "doc_id bigint, text string"), model).collect()
    assert [r["lang_pred"] for r in got] == ["ja", "en"]


def test_preference_on_nothing(spark):
    none = spark.createDataFrame([], "pair_id bigint, side int, conv_id bigint, turn bigint, role string, text string, chosen string, prompt string")
    assert preference.format_pairs(none).count() == 0
    long = spark.createDataFrame([(0, 0, 0, 0, "user", LONG, "x", "y"), (0, 1, 1, 0, "user", LONG, "x", "y"), (0, 1, 1, 1, "assistant", LONG, "x", "y")], none.schema)
    r = preference.format_pairs(long).first()
    assert LONG in r["prompt"] and LONG in r["rejected"] and r["chosen"] == ""


def test_later_links_are_looked_at_by_roots(spark, monkeypatch):
    """Links of a dense group cost no more than the components that they join."""
    from opinara.llm import components as module
    from opinara.llm.components import components, extended

    first = [(i, i + 1) for i in range(0, 60, 3)]
    more = [(i, j) for i in range(30) for j in range(i)] + [(70, 71)]
    pairs = lambda x: spark.createDataFrame(x, "a long, b long")
    want = sorted(map(tuple, components(pairs(first + more)).collect()))
    seen, plain = [], components
    monkeypatch.setattr(module, "components", lambda links, *c: seen.append(links.count()) or plain(links, *c))
    assert sorted(map(tuple, extended(plain(pairs(first)), pairs(more)).collect())) == want
    assert seen[0] < len(more)
