"""Findings of the third round."""

import time

import numpy as np
import pyarrow as pa
import pytest

from opinara.llm import decontaminate, jaccard, line_dedup, textkit


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL ORDER BY doc_id").fetchall())


def _items(duck):
    return decontaminate.Items(duck.sql("SELECT item_id, text FROM benchmark ORDER BY item_id").fetchall())


def test_latent_space_comes_from_all_items(duck):
    """Its directions hold as much of all passages of the benchmark as the best ones of that rank."""
    items = _items(duck)
    idf = np.random.default_rng(4).uniform(0.5, 3, len(items.vocabulary))
    rank = len(items.of) // 3
    a, place = np.zeros((len(items.of), len(idf))), items.vocabulary.find(items.h)
    for i, (lo, hi) in enumerate(zip(items.start, items.end, strict=True)):
        np.add.at(a[i], place[lo:hi], idf[place[lo:hi]])
        a[i] /= np.sqrt((idf[place[lo:hi]] ** 2).sum())
    got, _ = np.linalg.qr(decontaminate.latent_space(items, idf, rank) / idf[:, None])
    best = np.linalg.svd(a, compute_uv=False)[:rank]
    assert np.linalg.norm(a @ got) ** 2 >= 0.97 * (best**2).sum()


def test_candidates_against_all_pairs(duck, texts, monkeypatch):
    """Of the leaks that comparing every passage with every item finds, the search by cosine finds 0.9 or more, and no other."""
    items = _items(duck)
    rng = np.random.default_rng(8)
    docs = list(texts.values())[:150]
    for n, (_, t) in enumerate(duck.sql("SELECT item_id, text FROM benchmark ORDER BY item_id").fetchall()):
        w = [f"zq{rng.integers(1000)}" if k % 6 == 3 else x for k, x in enumerate(t.split()) if rng.random() > 0.1]
        docs.append(f"{docs[n % 150][:250]} {' '.join(w)} {docs[(n + 1) % 150][250:500]}")
    buffer = textkit.text_buffer(pa.array(docs, pa.string()))
    h, rows, _, _ = textkit.words(*buffer, sep=textkit.TERM_SEP)
    place = items.vocabulary.find(h)
    df = np.bincount(np.unique(rows[place >= 0] * len(items.vocabulary) + place[place >= 0]) % len(items.vocabulary), minlength=len(items.vocabulary))
    idf = np.log((1 + len(docs)) / (1 + df)) + 0.01
    weights = decontaminate.latent_space(items, idf**2)
    items.weigh(idf)
    latent = items.tf_idf(weights)
    items.latent, items.length = decontaminate.unit(latent), np.maximum(np.linalg.norm(latent, axis=1), 1e-6)
    found = {x[:2] for x in decontaminate.search_texts(*buffer, items, weights)}
    monkeypatch.setattr(decontaminate, "PART", -np.inf)
    every = {x[:2] for x in decontaminate.search_texts(*buffer, items, weights, cosine=-2.0)}
    assert found <= every and len(found) >= 0.9 * len(every) and len(every) > 20


def test_sketches_are_short_lower_bounds():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 52, 300, dtype=np.int64)).astype(np.uint64)
    assert len(jaccard.sketch(a)) <= 128
    for out in (10, 60, 200):
        b = np.unique(np.r_[a[out:], rng.integers(0, 1 << 52, out, dtype=np.int64).astype(np.uint64)])
        bits = [np.frombuffer(jaccard.sketch(x), np.uint8) for x in (a, b)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))
    assert len(jaccard.sketch(a[:100])) == 64


def test_near_lists_of_a_member_are_few(spark):
    members = spark.createDataFrame([(t, s, 1, s, 50) for s in range(50) for t in range(20)], "token long, sig long, n long, root long, size long")
    some = jaccard._some_lists(members).collect()
    assert len(some) == 50 * jaccard.NEAREST and len({r["token"] for r in some}) == jaccard.NEAREST


def test_passages_are_summed_in_little_time():
    """The sums of the terms of all passages are those of a plain loop, and take much less CPU time than reduceat over all terms."""
    rng = np.random.default_rng(5)
    weights = rng.normal(size=(4000, 128)).astype(np.float32)
    rows = np.sort(rng.integers(0, 300, 60_000))
    place = np.where(rng.random(len(rows)) < 0.9, rng.integers(0, 4000, len(rows)), -1)
    began = time.thread_time()
    got = list(decontaminate.windows(place, rows, 301, weights, [16, 32, 64]))
    took = time.thread_time() - began
    known = weights[np.maximum(place, 0)] * (place >= 0)[:, None]
    for _, _, start, end, sums in got:
        for i in range(0, len(start), 97):
            np.testing.assert_allclose(sums[i], known[start[i] : end[i]].sum(axis=0), atol=1e-3)
    began = time.thread_time()
    np.add.reduceat(weights[place[place >= 0]], np.arange(0, (place >= 0).sum(), 8), axis=0)
    assert took < 0.8 * (time.thread_time() - began)


def test_sketches_of_other_sizes_are_folded():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 52, 700, dtype=np.int64)).astype(np.uint64)
    for b in (a[:500], a[100:], np.r_[a, a[:60] + np.uint64(1)]):
        x, y = jaccard.sketch(a), jaccard.sketch(np.unique(b))
        assert 0 < jaccard.apart(x, y) == jaccard.apart(y, x) <= len(np.setxor1d(a, b))
    assert jaccard.apart(jaccard.sketch(a), jaccard.sketch(a)) == 0


def test_whole_sets_are_only_fetched_for_possible_links(spark, monkeypatch):
    """Texts that share a passage but little else meet, and their sketches part them; links and components stay the same."""
    same = " ".join(f"s{i}" for i in range(60))
    texts = [f"{same} " + " ".join(f"w{k}x{i}" for i in range(300)) for k in range(40)]
    texts += [f"{texts[0]} end", f"{texts[1]} end", f"{texts[1]} other end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, verify = [], jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda pairs, *a: asked.append(pairs.count()) or verify(pairs, *a))
    for renewal in (0.0, 1e9):
        asked.clear()
        got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs, long=3, renewal=renewal).collect()}
        assert got == {k: k for k in range(40)} | {40: 0, 41: 1, 42: 1}
        assert sum(asked) <= 6


def test_renewals_are_for_many_pairs():
    assert jaccard.worth(np.array([5000, 70]), 1_000_000) and not jaccard.worth(np.array([200] * 100), 1_000_000)


def test_lines_are_counted_as_they_are_read(spark, tmp_path):
    """The texts are not read once more for the numbers of lines; rows without text or id, and repeated ones, keep theirs."""
    rows = [(1, "a b c d\nb"), (2, None), (3, ""), (None, "x\ny\nz\n"), (None, "x\ny\nz\n"), (1, "\n\na b c d")]
    for name, some in (("shared", rows), ("own", rows[:3])):
        spark.createDataFrame(some, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = line_dedup.op3_line_dedup(spark, f"{tmp_path}/{name}")
        assert not [f for f in out.inputFiles() if "documents.parquet" in f]
        got = sorted(((r["doc_id"], r["n_lines"]) for r in out.collect()), key=str)
        assert got == sorted(((i, 0 if t is None else t.count("\n") + 1) for i, t in some), key=str)
