"""The filter audit, the secret scan and the Merkle manifest against plain Python, SQL and odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest

import pyarrow as pa

from opinara.llm import byte_bpe, decontaminate, filter_audit, jaccard, line_dedup, merkle, queries, secret_scan, textkit
from pyspark.sql import functions as F

LONG = "the quick brown fox jumps over the lazy dog again and again until night falls " * 3000
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, place int, part string, kind int"


def same(got, want):
    value = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(value, r)) for r in got) == sorted(tuple(map(value, r)) for r in want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(name, spark, sf_dir, duck):
    df = queries.QUERIES[name](spark, sf_dir)
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert same(df.select(columns).collect(), want.select(*columns).fetchall())


# filters


def odd_rows(texts):
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "x", 1, "y", 2) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, "twin", "en", None, 4, "x", 1, "y", 2), (None, None, "", None, None, None, None, None, None), (None, "twin", None, None, 4, "x", 1, "y", 2)]


TEXTS = [None, "", "twin", "one two", "twin", LONG, "A B C D", "no. #1", "one two", "x" * 70_000, " \t\n", LONG, "été À 東京 🎉 " * 40]


def plain_audit(rows, labels):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    least, seen = {}, Counter()
    for key, text, *_ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    for key, text, lang, *_ in rows:
        t, w = text or "", words.findall(text or "")
        fails = ""
        fails += "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * (key is not None and least[t] < key)
        seen[lang or "", fails, labels.get(key, (0, 0))] += 1
    out = []
    for part in {p for p, *_ in seen}:
        own = {k[1:]: n for k, n in seen.items() if k[0] == part}
        shapley, lines = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                f, before = order[step - 1], order[: step - 1]
                gone = {k: n for k, n in own.items() if f in k[0] and not set(before) & set(k[0])}
                shapley[f] += sum(gone.values())
                lines.append((part, order, step, f, sum(n for k, n in own.items() if not set(order[:step]) & set(k[0])), sum(gone.values()), sum(n for k, n in own.items() if f in k[0]) - sum(gone.values()), sum(n for k, n in own.items() if k[0] == f), sum(n for k, n in gone.items() if k[1][0]), sum(n for k, n in gone.items() if k[1][1])))
        out += [(p, o, s, *rest, shapley[f]) for p, o, s, f, *rest in lines]
    return out


@pytest.mark.parametrize(("partitions", "hold"), [(1, 1), (5, 500), (3, 1 << 24)])
def test_filter_audit_on_odd_rows(spark, partitions, hold):
    rows = odd_rows(TEXTS)
    labels = [(0, 1, 0), (4, 0, 1), (4, 1, 0), (8, 1, None), (None, 1, 1), (99, 1, 1)]
    known = {0: (1, 0), 4: (1, 1), 8: (1, 0)}
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), partitions, hold)
    assert same(got.collect(), plain_audit(rows, known))


def test_filter_audit_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    rows = filter_audit.audit(spark.createDataFrame([(1, "hello", "en", None, None, None, None, None, None)], DOCS), labels).collect()
    assert len(rows) == 600 and all(r["good_lost"] == 0 for r in rows)


def test_texts_of_one_hash_are_told_apart():
    chain = filter_audit.Chain()
    said = [x for key, text in ((5, b"a"), (3, b"b"), (7, b"a"), (3, b"b"), (1, b"a"), (9, b"b")) for x in chain.add(text, 0, key, {"en": 1})]
    assert said == [(7, "en", 16, 1), (5, "en", 16, 1), (9, "en", 16, 1)]
    assert [(x[0], x[2], x[3]["en"]) for x in chain.links] == [(b"a", 1, 1), (b"b", 3, 2)]


def test_portions_send_a_text_once():
    rows = [(i, "the same text", "en") for i in range(1000)] + [(5000, "another", "en")]
    routed = list(filter_audit.route(rows))
    assert sum(v[0] is not None for _, v in routed) == 2 and len(routed) == 1001
    assert sum(n for _, v in routed for n in v[3].values()) == 1001
    assert len({h % 64 for h, v in routed if v[0] is None}) > 48


# secrets


def plain_secrets(text):
    assign = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(spans)


SECRETS = [
    "token: secret: abcdefghij", 'API_KEY = "abcdefgh"', "apikey:=12345678 passwd : 'x'", "AKIAAKIAAKIA1234 akia AKIA12", "passſword=abcdefgh Ktoken=abcdefgh", "f" * 31 + " " + "f" * 32 + "g",
    "secret=" + "0123456789abcdef" * 3, "été token\"  =  '" + "é", "password=abc password=abcdefgh", "x" * 5000, "TOKEN=aaaaaaaa" * 400, "secret\n=abcdefgh", "api__key=abcdefgh api_key=....----",
]


def test_base_spans_as_plain_patterns(spark, sf_dir, duck):
    texts = SECRETS + [t or "" for (t,) in duck.sql("SELECT text FROM documents").fetchall()]
    for t in texts:
        assert [x[:3] for x in secret_scan.base_spans(t)] == plain_secrets(t)
    got = {r["doc_id"]: r for r in secret_scan.op12_secret_grammars(spark, sf_dir).collect()}
    for key, t in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        spans = plain_secrets(t or "")
        said = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        r = got[key]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert {x for x in r["spans"].split(",") if x} >= {x for x in said.split(",") if x}


def key_of(seed, n=24):
    h = hashlib.sha256(str(seed).encode()).digest()
    return "ghp_" + "".join("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789"[b % 57] for b in h[:n])


def test_grammars_find_what_patterns_do_not(spark):
    rows = [(i, f"token={key_of(i)} and some words, extraordinarily_long words of counterrevolutionary{i % 7}s") for i in range(300)]
    rows += [(1000 + i, f"left here: {key_of(5000 + i)} by mistake, see www.internationalisation{i % 5}.example.com") for i in range(100)]
    parts = "extra ordinary counter revolution nation less ness over under stand ing interest photo graph hydro meter data center".split()
    rows += [(2000 + i, "".join(parts[b % len(parts)] for b in hashlib.md5(bytes([i % 256, i // 256])).digest()[:4]) + f"-{i % 9}.html") for i in range(1000)]
    got = {r["doc_id"]: r for r in secret_scan.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    found = sum(f"assign:{len('left here: ')}:{len('left here: ') + 28}" == got[1000 + i]["spans"] for i in range(100))
    assert found >= 85
    assert sum(len(r["added_log_odds"]) for k, r in got.items() if not 1000 <= k < 2000) == 0


def test_automata_merge_alike_states_only():
    abc = secret_scan.Automaton([v for n in range(1, 10) for v in ["ab" * n] * 2 ** (9 - n)])
    assert abc.states <= 4 and abc.log_likelihood("ababab") > abc.log_likelihood("aaabbb") + 5
    flat = secret_scan.Automaton([hashlib.sha1(bytes([i])).hexdigest() for i in range(200)])
    assert flat.states < 5 and flat.log_likelihood("0123456789abcdef") > flat.log_likelihood("ghijklmnopqrstuv") + 20
    assert 0.9 < sum(math.exp(p) for _, p in abc.step[0].values()) < 1


def test_secrets_in_odd_rows(spark):
    rows = odd_rows(TEXTS)
    got = secret_scan.find(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and all(r["spans"] == "" and r["n_hex"] == 0 for r in got)
    assert secret_scan.find(spark.createDataFrame([], DOCS)).count() == 0


# manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_proof(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i // 16 * 16
        out.append((nodes[first:i], nodes[i + 1 : first + 16]))
        i //= 16
    return out


def plain_manifest(rows):
    """(id, leaf, subroot, root, hash of the proof, folded root) of each row, sorted."""
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*map(shown, (r[0], r[3], r[2], r[4], text)))
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    for k in by:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {k: plain_tree([leaf(r, r[1]) for r in by[k]]) for k in by}
    top = plain_tree([trees[k][-1][0] for k in order])
    out = []
    for j, k in enumerate(order):
        for i, r in enumerate(by[k]):
            proof = plain_proof(trees[k], i) + plain_proof(top, j)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r, re.sub("[A-Z]", lambda m: m.group().lower(), r[1]) if tampered and r[1] is not None else r[1])
            for left, right in proof:
                node = h(*left, node, *right)
            out.append((r[0], trees[k][0][i], trees[k][-1][0], top[-1][0], h(*(x for pair in proof for side in pair for x in side)), node))
    return sorted(out, key=str)


def audited(df):
    low = merkle.lower_ascii(F.col("text"))
    out = merkle.audit(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, low)
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings("proof"), 256), "folded_root").collect()), key=str)


def test_manifest_on_odd_rows(spark):
    rows = odd_rows([*TEXTS, *(f"Text Number {i} ÀÉ" for i in range(400))])
    rows += [(7000 + i, f"Source {i}", None, f"s{i}", i, None, None, None, None) for i in range(40)]
    assert audited(spark.createDataFrame(rows, DOCS).repartition(5)) == plain_manifest(rows)
    assert audited(spark.createDataFrame(rows[3:4], DOCS)) == plain_manifest(rows[3:4])
    assert audited(spark.createDataFrame([], DOCS)) == []


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257, 300])
def test_trees_are_the_same_in_blocks_of_any_size(spark, n):
    rows = spark.createDataFrame([(i, h(str(i)), "k") for i in range(n)], "id bigint, leaf string, key string")
    want = plain_tree([h(str(i)) for i in range(n)])
    for levels in (1, 2, 3):
        got = sorted(merkle.manifest(rows, "key", "id", levels=levels).collect())
        assert {r["root"] for r in got} == {want[-1][0]}
        for i, r in enumerate(got):
            assert [(s["left"], s["right"]) for s in r["proof"]] == [("".join(a), "".join(b)) for a, b in plain_proof(want, i)]


def test_changed_rows_are_not_verified(spark):
    rows = spark.createDataFrame([(i, f"Text {i}", "en", "s", 6, None, None, None, None) for i in range(50)], DOCS)
    out = merkle.audit(rows, F.col("doc_id") % 2 == 0, F.lower("text")).collect()
    assert all(r["verified"] == (r["doc_id"] % 2 == 1) for r in out)


# rows that share an id


SHARED = [(1, "a line that two of the texts have in common here\nand an ending of the first one only"), (2, "a line that two of the texts have in common here\nwhat only the second text says at its end"), (2, "a wholly unique first line that nobody else has written\nand one more of its own"), (None, "what stands here has no id and stands alone"), (None, "a line that two of the texts have in common here\nbut no id comes with it at all"), (None, None)]


def test_lines_of_rows_that_share_an_id_stay(spark):
    docs = spark.createDataFrame(SHARED, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in line_dedup.dedup(docs).collect()), key=str)
    first = SHARED[4][1]  # the null id sorts first and keeps the line
    assert got == sorted([(1, SHARED[0][1].split("\n")[1]), (2, SHARED[1][1].split("\n")[1]), SHARED[2], SHARED[3], (None, first), (None, None)], key=str)


def test_one_row_of_each_component_stays(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(5, words), (5, words + " more"), (5, "quite another text under the same id as these"), (None, words + " end"), (None, "alone without an id but with enough words"), (None, "alone without an id but with enough words"), (7, None), (7, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard.keep_one(spark, docs, str(tmp_path)).collect()
    near = [r for r in got if r["text"] and r["text"].startswith("word0 ")]
    assert len(near) == 1 and near[0]["doc_id"] == 5
    rest = sorted(((r["doc_id"], r["text"]) for r in got if r not in near), key=str)
    assert rest[:2] == [(5, rows[2][1]), (7, rest[1][1])] and (None, rows[4][1]) in rest and (None, None) in rest and len(rest) == 4


def test_letters_are_folded_beyond_ascii():
    import numpy as np

    said = "ÀÉÎÕÜ ×÷ßÿ ŁŹŠĐ ΑΒΓΔΩ АБВЯЁЇ 東京 É"
    got = textkit.fold_letters(np.frombuffer(said.encode(), np.uint8)).tobytes().decode()
    assert got == said.lower()
    h = lambda t: textkit.words(*textkit.text_buffer(pa.array([t])), sep=textkit.TERM_SEP)[0].tolist()
    assert h(said) == h(said.lower()) and line_dedup.normal(said.encode()) == line_dedup.normal(said.lower().encode())


def test_leaks_in_capitals(spark):
    items = ["L'été à Paris est très agréable pour les élèves et leurs nombreux amis étrangers", "Die schöne Müllerin wäscht täglich früh am großen Fluß ihre Kleider und Tücher", "Ο γρήγορος σκύλος τρέχει πάνω από τον τεμπέλη γάτο κάθε πρωί στις εννέα", "Быстрая лиса прыгает через ленивую собаку каждое утро возле старого дома у реки"]
    docs = [(i, f"Before it some words. {t.upper().replace('SS', 'ß')} And after it others follow here.") for i, t in enumerate(items)] + [(10, "nothing of the kind is said in this text at all, not in any way")]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in (0, 1, 3)} or {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in range(4)}


def test_long_texts_are_cut_once(spark):
    text = "Zürich 東京 and some 'words' 123  \n" * 4000
    docs = spark.createDataFrame([(1, text), (1, text), (2, text + "x"), (3, "short")], "doc_id bigint, text string")
    got = byte_bpe.decode(byte_bpe.encode(docs, chunk=3000, overlap=100)).collect()
    assert sorted((r["doc_id"], bytes(r["data"]).decode()) for r in got) == sorted((r["doc_id"], r["text"]) for r in docs.collect())
