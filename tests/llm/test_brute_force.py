"""Operators against plain Python on whole small tables."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from opinara.llm import byte_bpe, components, compression, decontaminate, jaccard, language, line_dedup, lists, pii, preference, quality, textkit, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_byte_bpe(spark, sf_dir, texts):
    encoding = byte_bpe._encoding(None)[0]
    for op in (byte_bpe.op9_byte_bpe(spark, sf_dir), byte_bpe.decode(byte_bpe.encode(textkit.documents(spark, sf_dir), chunk=400, overlap=30), digest=True)):
        for r in op.collect():
            ids = np.array(encoding.encode_ordinary(texts[r["doc_id"]]), "<u4")
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_stitching_resynchronises_anywhere():
    rng = np.random.default_rng(2)
    alphabet = list("ab1 \n\t'.é") + ["'s", "  ", " \n"]
    for _ in range(200):
        text = "".join(rng.choice(alphabet, 300))
        size, overlap = 40, 8
        n = max(1, -(-(len(text) - overlap) // size))
        chunks = [text[i * size : None if i + 1 == n else (i + 1) * size + overlap] for i in range(n)]
        near = [byte_bpe.boundaries(c, i * size, i * size, i * size + max(size, len(c)), i + 1 == n) for i, c in enumerate(chunks)]
        cut = byte_bpe.stitch(chunks, [[b for b in x if b <= i * size + overlap] for i, x in enumerate(near)], [[b for b in x if b >= (i + 1) * size] for i, x in enumerate(near)], size, overlap)
        assert "".join(cut) == text
        whole = [m.group() for m in byte_bpe._pattern().finditer(text)]
        assert [m.group() for p in cut for m in byte_bpe._pattern().finditer(p)] == whole


def test_compression(spark, sf_dir, texts):
    for r in compression.op5_compression_bands(spark, sf_dir).collect():
        t = texts[r["doc_id"]]
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count: dict = {}
        for x in windows:
            count[x] = count.get(x, 0) + 1
        repeated = len({i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated)
        assert r["base_failed"] == (len(w) < 50 or 100 * repeated > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def plain_spans(text):
    def ok(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": kind == "card" and 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    return sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, text) if ok(pii.KINDS[k], m.group()))


def test_pii(spark, sf_dir, texts):
    tricky = ["a@b@c.com. x@y..z 1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.256", "4111 1111-1111 1111 and +1 (555) 010-9999 2", "me@x.y-z.com,you@a.b", "+49 30 (1234) 5678 +12 " + "9" * 40]
    for t in [*tricky, *texts.values()]:
        assert pii.base_spans(t) == plain_spans(t)
    for r in pii.op6_weak_pii(spark, sf_dir).collect():
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= {*r["spans"].split(","), ""}


def test_pii_adds_what_looks_like_it(spark):
    rows = [(i, f"please call ({200 + i}) 555-01{i:02d} or +1 (555) 555-01{i:02d}, mail me{i}@example.com") for i in range(40)]
    got = pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r["n_phone"] == 1 and r["spans"].count("phone:") == 2 for r in got)


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def same_components(spark, texts, **options):
    sets = {d: shingle_set(t) for d, t in texts.items()}
    ids = list(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (n := len(sets[a] & sets[b])) and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    want = roots_of(ids, links)
    got = {r["doc_id"]: r for r in jaccard.join(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), **options).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == {d: (len(s), want[d]) for d, s in sets.items()}


def test_jaccard(spark, texts):
    same_components(spark, texts)


def test_jaccard_with_long_lists_and_chains(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choice(vocabulary, 30))
    texts, base = {}, list(rng.choice(vocabulary, 90))
    for i in range(60):  # a chain of near copies, and others that share a passage
        base[rng.integers(len(base))] = f"new{i}"
        texts[i] = " ".join(base)
        texts[100 + i] = common + " " + " ".join(rng.choice(vocabulary, rng.integers(4, 60)))
        texts[200 + i] = common + " tail" * (i % 3)
    same_components(spark, texts, long=3)


def test_jaccard_in_dense_groups_around_the_limit(spark):
    """Near copies of one text with similarities on both sides of the limit, in lists that are cut into cells."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(160)]
    texts = {}
    for i in range(150):
        own = list(base[: 160 - int(rng.integers(0, 12))])
        for at in rng.choice(len(own), int(rng.integers(1, 9)), replace=False):
            own[at] = f"x{rng.integers(4000)}"
        texts[i] = " ".join(own)
    same_components(spark, texts, long=3, wide=4, cell=32)
    same_components(spark, texts)


def test_t_occurrence_search_is_exact():
    rng = np.random.default_rng(12)
    for trial in range(200):
        base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
        draw = lambda: np.unique(np.r_[rng.choice(base, rng.integers(1, 60)), rng.integers(0, 1 << 40, rng.integers(0, 8)).astype(np.uint64)])  # noqa: E731, B023
        probe, candidates = np.unique(base), [draw() for _ in range(rng.integers(1, 30))]
        percent = int(rng.choice([30, 50, 80, 100]))
        want = [i for i, c in enumerate(candidates) if 100 * len(np.intersect1d(probe, c)) >= percent * len(np.union1d(probe, c))]
        assert jaccard.search(probe, candidates, percent) == want


def test_heap_merge_counts_occurrences():
    rng = np.random.default_rng(13)
    for _ in range(200):
        lists_ = [sorted(set(rng.integers(0, 20, rng.integers(0, 12)).tolist())) for _ in range(rng.integers(0, 9))]
        for least in (1, 2, 3, 5):
            want = [(v, n) for v in range(20) if (n := sum(v in x for x in lists_)) >= least]
            assert jaccard.merge([x for x in lists_ if x], least) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 150: 100, 200: 100}


def near_lines(texts, blocks=(line_dedup.TABLES, line_dedup.WIDTH)):
    """Occurrences (doc, number, key), the text of each key, and its packed SimHash."""
    where, line, code = [], {}, {}
    for d in sorted(texts):
        data, at = textkit.text_buffer(pa.array([texts[d]]))
        f = line_dedup.lines_of(data, at, blocks=blocks)
        for i, (n, k, b, e) in enumerate(zip(*(f[c].tolist() for c in ("number", "key", "begin", "end")), strict=True)):
            where.append((d, n, k))
            line.setdefault(k, line_dedup.normal(data[b:e].tobytes()))
            if i < len(f["code"]):
                code.setdefault(k, f["code"][i])
    return where, line, code


def removed_lines(where, links):
    root, stay = roots_of({k for *_, k in where}, links), {}
    for d, n, k in where:
        stay[root[k]] = min(stay.get(root[k], (1 << 60, 0)), (d, n))
    return {(d, n) for d, n, k in where if stay[root[k]] != (d, n)}


def test_line_dedup(spark, sf_dir, texts):
    tables, width = line_dedup.TABLES, line_dedup.WIDTH
    where, line, code = near_lines(texts)
    met: dict = {}
    for k, c in code.items():
        bits = [int(x) for x in np.unpackbits(c[: tables * width // 8])]
        for t in range(tables):
            own, check = bits[t * width : t * width + width], [bits[((t + 1) * width + i) % (tables * width)] for i in range(64)]
            for flip in (None, *c[tables * width // 8 + 3 * t :][:3].tolist()):
                met.setdefault((t, *(b ^ (i == flip) for i, b in enumerate(own))), []).append((k, np.array(check)))
    pairs = {(a, b) for x in met.values() for i, (a, p) in enumerate(x) for b, q in x[:i] if (p != q).sum() <= line_dedup.CLOSE}
    links = [(a, b) for a, b in pairs if line_dedup.similar(line[a], line[b])]
    assert links
    got = {(r["doc_id"], int(n)) for r in line_dedup.op3_line_dedup(spark, sf_dir).collect() for n in r["removed_lines"].split(",") if n}
    assert got == removed_lines(where, links)
    # all pairs that share three words in a row or, if short, a word
    shared: dict = {}
    for k, x in line.items():
        w = x.split()
        for g in {tuple(w[i : i + 3]) for i in range(len(w) - 2)} | ({(y,) for y in w} if len(w) < 6 else set()):
            shared.setdefault(g, []).append(k)
    every = {(a, b) for x in shared.values() for i, a in enumerate(x) for b in x[:i] if line_dedup.similar(line[a], line[b])}
    want = removed_lines(where, every)
    assert len(got & want) >= 0.8 * len(want) and got <= want


def test_near_lines_meet_at_every_size():
    """One or two words of a line of 20 to 60 are replaced: the share that meets, by the width of the blocks."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(5000)]
    base = [[*rng.choice(words, rng.integers(20, 60))] for _ in range(400)]
    other = [[*x] for x in base]
    for x in other:
        for at in rng.choice(len(x), rng.integers(1, 3), replace=False):
            x[at] = str(rng.choice(words))
    for lines_, least in ((1 << 20, 0.65), (1 << 32, 0.65), (1 << 38, 0.6)):
        blocks = line_dedup.blocks_for(lines_)
        code = [line_dedup.lines_of(*textkit.text_buffer(pa.array(["\n".join(map(" ".join, x))])), blocks=blocks)["code"] for x in (base, other)]
        (s, p), (t, q) = (line_dedup.addresses(c, blocks) for c in code)
        near = [any(t[i, k] == s[i, j] and int(np.bitwise_count((p[i, j] ^ q[i, k]).view(np.uint64))) <= line_dedup.CLOSE for j in range(s.shape[1]) for k in range(s.shape[1]) if s[i, j] == t[i, k]) for i in range(len(base))]
        assert np.mean(near) >= least, (lines_, np.mean(near))


def test_short_lines_and_lines_without_spaces_go(spark):
    repeated = ["Share this article", "next", "-----", "東京都は日本の首都であり人口が最も多い", "วันนี้อากาศดีมาก"]
    docs = [(d, "\n".join([f"own{d} line", *repeated, "", "   ", f"東京{'甲乙丙'[d]}"])) for d in range(3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r["doc_id"], r["number"]) for r in line_dedup.removed(df).collect()}
    want = {(d, n) for d in (1, 2) for n in range(1, 1 + len(repeated))}
    # digits are alike, so the first line is the same in all
    assert got == want | {(1, 0), (2, 0)}


def test_short_lines_differ_in_many_bits():
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    data, at = textkit.text_buffer(pa.array(["\n".join(f"{x} {y}" for x, y in zip(words, words[1:], strict=False))]))
    code = line_dedup.lines_of(data, at, blocks=(4, 24))["code"][:, :12]
    assert len(code) == 99 and 0.4 < np.unpackbits(code).mean() < 0.6 and len(np.unique(code, axis=0)) == 99


def test_shared_lists_keep_what_meets(spark):
    """Lists of any length over batches of few rows: members that meet another stay, and so do all of wide lists."""
    rows = [(t, s, (t * 7 + s * s) % 11) for t, size in enumerate((1, 2, 3, 16, 17, 40, 5, 90, 2)) for s in range(size)]
    meets = lambda n, m: n == m
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted((r["token"], r["sig"], r["lead"]) for r in lists.shared_lists(spark.createDataFrame(rows, "token bigint, sig bigint, n bigint"), meets).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    of = {t: [r for r in rows if r[0] == t] for t, *_ in rows}
    assert got == sorted((t, s, 0) for t, s, n in rows if len(of[t]) > lists.WIDE or sum(x[2] == n for x in of[t]) > 1)


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = np.random.default_rng(1)
    for _ in range(500):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 12))) for _ in "xx")
        most = int(rng.integers(0, 12))
        assert line_dedup.distance(a, b, most) == min(plain(a, b), most + 1)


def test_decontamination_recall(spark, sf_dir, duck, texts):
    items = dict(duck.sql("SELECT item_id, text FROM benchmark").fetchall())
    holds = {(d, i) for i, x in items.items() for d, t in texts.items() if " ".join(x.lower().split()) in " ".join(t.lower().split())}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op8_latent_decontamination(spark, sf_dir).collect()}
    assert len(got & holds) >= 0.9 * len(holds) and got <= holds


def test_vocabulary_knows_all_terms():
    h = textkit.mix(np.arange(60_000, dtype=np.uint64))
    v = decontaminate.Vocabulary(h)
    assert len(v) == len(h) and np.array_equal(v.hashes[v.find(h)], h)
    assert (v.find(textkit.mix(np.arange(60_000, 90_000, dtype=np.uint64))) == -1).all()
    assert (decontaminate.Vocabulary(h[:0]).find(h[:5]) == -1).all()


def test_windows_are_sums_of_their_terms():
    rng = np.random.default_rng(5)
    rows = np.repeat(np.arange(9), [0, 1, 3, 8, 9, 31, 64, 65, 200])
    place, weights = rng.integers(-1, 20, len(rows)), rng.random((20, 3)).astype(np.float32)
    for size, of, start, end, got in decontaminate.windows(place, rows, 9, weights, [8, 16, 32, 64]):
        assert all(np.array_equal(x, y) for x, y in zip((of, start, end), decontaminate.passages(rows, 9, size), strict=True))
        assert np.allclose(got, [weights[[p for p in place[a:b] if p >= 0]].sum(axis=0) for a, b in zip(start, end, strict=True)], atol=1e-4)


def test_decontamination_finds_every_verbatim_copy(spark, texts):
    """Items of any length, in texts that hold the benchmark's own words all around."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    items = {i: [*rng.choice(words, size)] for i, size in enumerate([1, 2, 3, 5, 7, 8, 9, 12, 16, 17, 20, 33, 50, 64, 65, 100])}
    docs = [(1000 + 10 * i + k, " ".join([*rng.choice(words, before), *x, *rng.choice(words, 150)])) for i, x in items.items() for k, before in enumerate((0, 37, 90))]
    docs += [(d, t) for d, t in list(texts.items())[:40]]
    holds = {(d, i) for d, t in docs for i, x in items.items() if f" {' '.join(x)} " in f" {t} "}
    bench = spark.createDataFrame([*((i, " ".join(x)) for i, x in items.items()), *((100 + i, " ".join(words[40 * i : 40 * i + 40])) for i in range(75))], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert got == holds and len(holds) >= 3 * len(items)


def test_decontamination_finds_paraphrases(spark, texts, duck):
    item = max((t for t, in duck.sql("SELECT text FROM benchmark").fetchall()), key=len)
    w = item.split()
    other = " ".join("zz" if i % 7 == 3 and i < 0.7 * len(w) else x for i, x in enumerate(w))
    docs = spark.createDataFrame([*list(texts.items())[:60], (9000, f"{list(texts.values())[70][:300]} {other} {list(texts.values())[71][:300]}")], "doc_id bigint, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame([(5, item)], "item_id bigint, text string")).collect()
    assert 9000 in {r["doc_id"] for r in got}


def test_decontamination_recall_of_paraphrases(spark, texts, duck):
    """Items of 20 words or more with every eighth word replaced and one word in ten left out, inside other texts; ids are texts."""
    rng = np.random.default_rng(21)
    items = [(f"item {i}", t) for i, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall() if len(t.split()) >= 20]
    around = [t for t in texts.values() if len(t) > 600 and not any(x in t for _, x in items)]
    docs, want = [], set()
    for n, (i, t) in enumerate(items):
        w = t.split()
        w = [f"zq{rng.integers(1000)}" if k % 8 == 3 and k < 0.8 * len(w) else x for k, x in enumerate(w) if rng.random() > 0.1 or k > 0.8 * len(w)]
        docs.append((n, f"{around[n % len(around)][:250]} {' '.join(w)} {around[(n + 1) % len(around)][250:500]}"))
        want.add((n, i))
    docs += [(1000 + n, t) for n, t in enumerate(around)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert len(got & want) >= 0.9 * len(want) and not {d for d, _ in got - want if d >= 1000}


def test_lcs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 15)).tolist(), rng.integers(0, 5, rng.integers(0, 20)).tolist()
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontaminate.lcs(masks, len(a), b) == t[-1, -1]


def test_block_max_is_exact():
    rng = np.random.default_rng(6)
    x = rng.random((300, 40)) * (rng.random((300, 40)) < 0.2)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    row, term = np.nonzero(x)
    index = toxicity.BlockMax(row, term, x[row, term], 300, 40, 16)
    q = rng.random((50, 40)) * (rng.random((50, 40)) < 0.1)
    row, term = np.nonzero(q)
    near, sims = index.search(row, term, q[row, term], 50, 10)
    want = q @ x.T
    for i in range(50):
        best = np.sort(want[i])[::-1][:10]
        assert np.allclose(sims[i], best)
        assert all(np.isclose(want[i, a], s) for a, s in zip(near[i], sims[i], strict=True) if s > 0)


def lower(text):
    """Terms are in lower case in all scripts of two bytes, as ÉTÉ and été are the same word."""
    return "".join(c.lower() if len(c.encode()) == len(c.lower().encode()) <= 2 else c for c in text)


def test_toxicity_neighbours_and_scores(spark, sf_dir, texts, duck):
    """The whole query against dense cosines in plain Python."""
    import collections
    import math

    docs = textkit.documents(spark, sf_dir)
    labels = textkit.labelled(spark, sf_dir, "toxic")
    model = toxicity.learn(docs, labels, indexed=24)
    words = {d: collections.Counter(re.findall(r"[^\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t))) for d, t in texts.items()}
    df = collections.Counter(w for c in words.values() for w in c)
    known = {r["doc_id"]: r["label"] for r in labels.collect()}
    rows, _ = textkit.sample_by_class(labels, toxicity.EACH)
    chosen = [r[0] for c in (0, 1) for r in [r for r in rows if r[1] == c][:24]]
    seen = {(texts[d], known[d]) for d, _ in rows}
    n = [sum(y == c for _, y in seen) for c in (0, 1)]
    of = {t: d for d, t in texts.items()}
    have = [collections.Counter(w for t, y in seen if y == c for w in words[of[t]]) for c in (0, 1)]
    vocabulary = {w for d in chosen for w in words[d]}

    def worth(w):
        ratio = have[1][w] / n[1] / max(have[0][w], 1) * n[0]
        more = math.log2(2 + ratio) ** 2 if have[0][w] + have[1][w] >= toxicity.SUPPORT and ratio > 1 else 1.0
        return max(math.log((1 + len(texts)) / (1 + df[w])), 1e-3) * more

    def vector(d):
        v = {w: (1 + math.log(k)) * worth(w) for w, k in words[d].items() if w in vocabulary}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    examples = {d: vector(d) for d in chosen}
    a, b = model["line"]
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for d in list(texts)[:60]:
        own = vector(d)
        sims = sorted(((sum(x * v.get(w, 0) for w, x in own.items()), known[e]) for e, v in examples.items()), reverse=True)[: toxicity.NEIGHBOURS]
        near = sorted((e["similarity"] for e in got[d]["evidence"]), reverse=True)
        assert np.allclose(near, [s for s, _ in sims[: len(near)] if s > 0], atol=1e-9)
        votes = sum(s for s, _ in sims)
        p = 1 / (1 + math.exp(-(a + b * sum(s * y for s, y in sims) / votes))) if votes else model["share"]
        assert abs(p - got[d]["score"]) < 1e-6
    assert np.mean([bool(got[d]["evidence"]) for d, t in texts.items() if t.split()]) > 0.9


def test_held_out_accuracy(spark, duck):
    sf_dir = "/root/testdata/sf0.01"
    lang = dict(duck.sql(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall())
    labels = {d: (q, t) for d, q, t in duck.sql(f"SELECT doc_id, quality, toxic FROM '{sf_dir}/labels.parquet'").fetchall()}
    rows = language.op2_language_id(spark, sf_dir).where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.97
    for op, i in ((quality.op1_attention_quality, 0), (toxicity.op7_nearest_toxicity, 1)):
        rows = [r for r in op(spark, sf_dir).where("held_out").collect() if r["doc_id"] in labels]
        assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
        assert np.mean([r["predicted"] == labels[r["doc_id"]][i] for r in rows]) > 0.9


def test_em_finds_the_unreliable_labeler():
    rng = np.random.default_rng(8)
    real = rng.random(4000) < 0.4
    right = rng.random((4000, pii.LABELERS)) < np.array([0.95, 0.9, 0.9, 0.85, 0.8, 0.5])
    v = np.where(right == real[:, None], 1, -1) + 1
    code = v @ 3 ** np.arange(pii.LABELERS)[::-1]
    pattern, n = np.unique(code, return_counts=True)
    p, table, prior = pii.reliabilities(pattern, n.astype(float))
    assert abs(prior - 0.4) < 0.05 and abs(table[1, 5, 2] - 0.5) < 0.08 and table[1, 0, 2] > 0.9
    assert np.mean((p[np.searchsorted(pattern, code)] > 0.5) == real) > 0.95


def test_preference_sql(spark, sf_dir, duck):
    df = preference.op10_preference_pairs(spark, sf_dir)
    want = duck.sql(preference.OP10_SQL)
    key = sorted(df.columns)
    assert key == sorted(want.columns)
    assert sorted(tuple(r[c] for c in key) for r in df.collect()) == sorted(map(tuple, want.select(*key).fetchall()))


def test_lists_without_end_and_codes_given_once(spark, monkeypatch):
    """Lists that are passed on in pieces keep all members under one lead; a key's code is given once by a task."""
    monkeypatch.setattr(lists, "HELD", 8)
    rows = [(t, (s * 37) % 101, 0) for t, size in enumerate((1, 3, 100, 2, 9, 1, 64)) for s in range(size)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("token", "sig", "n"), r, strict=True)) for r in rows[i : i + 5]]) for i in range(0, len(rows), 5)]

    class Plan:
        def mapInArrow(self, run, schema):
            return [r for b in run(iter(batches)) for r in b.to_pylist()]

    monkeypatch.setattr(lists, "by_token", lambda tokens: Plan())
    got = lists.shared_lists(None, lambda n, m: n == m, 4)
    members, leads = {}, {}
    for r in got:
        members.setdefault(r["token"], []).append(r["sig"])
        leads.setdefault(r["token"], set()).add(r["lead"])
    want = {t: sorted(s for u, s, _ in rows if u == t) for t, *_ in rows}
    assert {t: sorted(m) for t, m in members.items()} == {t: m for t, m in want.items() if len(m) > 1}
    assert all(len(v) == 1 and v <= set(want[t]) for t, v in leads.items())
    assert all(min(want[t]) in v for t, v in leads.items() if len(want[t]) < 8)

    docs = spark.createDataFrame([(i, f"the same line\nline number {'abcdefgh'[i]}\n...") for i in range(8)], "doc_id bigint, text string").coalesce(1)
    found = line_dedup.occurrences(docs).collect()
    assert len(found) == 24 and sum(r["code"] is not None for r in found) == 9
    data, at = textkit.text_buffer(pa.array([f"the same line\nline number {x}" for x in "abcdefgh"]))
    plain = line_dedup.lines_of(data, at, blocks=(line_dedup.TABLES, line_dedup.WIDTH))
    codes = dict(zip(plain["key"].tolist(), (x.tobytes() for x in plain["code"]), strict=True))
    assert {r["key"]: bytes(r["code"]) for r in found if r["code"]} == codes
