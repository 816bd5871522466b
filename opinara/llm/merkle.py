"""Merkle manifest of a table: a hash tree over the rows of each key, and one over the keys.

A node is the lowercase hex SHA-256 of the hex digests below it, up to FANOUT of them in order. Rows are put in order by a
range shuffle of digests and ids only; every BLOCK rows of a key become one array, whose levels are collapsed by higher-order
functions (sequence, transform, slice, aggregate) within its row. The roots of blocks are the leaves of the next round,
until each key has one root; the roots of the keys are then the leaves of one more tree. No task holds a key: it holds
ranges and blocks of fixed size, so a key with most of the rows is as many blocks as it fills.

A proof is an array of (left, right): what stands before and after the node in its run, a pair for each level from the row
to the root. Folding it with a row's digest gives the root exactly if the row is unchanged.

Nulls: a null value has a mark of its own in a digest; a null key comes first and is a key like others; null ids come
first. Repeated rows are leaves each; rows that share an id are ordered by digest. Texts are hashed whole. An empty table
gives an empty manifest. Columns that are not named are not read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinara.llm import textkit as tk

FANOUT, LEVELS = 16, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*values: Column) -> Column:
    """Of each value `-` if it is null, else its number of UTF-8 bytes, `:` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def joined(nodes: str) -> str:
    return f"array_join({nodes}, '')"


#: Of (acc, x): acc with one more level, in which each run of the last one is a node.
COLLAPSE = f"""concat(acc, array(transform(sequence(0, (size(element_at(acc, -1)) - 1) DIV {FANOUT}),
    r -> sha2({joined(f"slice(element_at(acc, -1), r * {FANOUT} + 1, {FANOUT})")}, 256))))"""


def _levels(depth: str, block: int) -> Column:
    """All levels of a block, leaves first; `depth` of them above the leaves."""
    steps = [n for n in range(1, 64) if FANOUT**n <= block]
    return F.expr(f"aggregate(slice(array({', '.join(map(str, steps))}), 1, {depth}), array(transform(items, x -> x.leaf)), (acc, x) -> {COLLAPSE})")


#: Of a row at place i in its block: what stands left and right of its node on each level.
SIBLINGS = f"""transform(slice(levels, 1, size(levels) - 1), (nodes, k) -> named_struct(
    'left', {joined(f"slice(nodes, shiftright(i, 4 * k) DIV {FANOUT} * {FANOUT} + 1, shiftright(i, 4 * k) % {FANOUT})")},
    'right', {joined(f"slice(nodes, shiftright(i, 4 * k) + 2, {FANOUT} - 1 - shiftright(i, 4 * k) % {FANOUT})")}))"""


def ordered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds place (from 0) of each row among those of its key, and n_key, their number. The rows are range-partitioned and
    stored once, so that places never depend on how often a task runs; offsets are counts of (partition, key)."""
    spark = rows.sparkSession
    count = rows.count()
    sorted_rows = rows.repartitionByRange(tk.parts(count), key, *order).sortWithinPartitions(key, *order)
    # the upper bits of the id are the partition's number, the lower ones count its rows in their order
    held = tk.stored(sorted_rows.withColumn("serial_", F.monotonically_increasing_id()))
    part = F.shiftright("serial_", 33).alias("part_")
    sizes = held.groupBy(part, key).agg(F.count("*").alias("n"), F.min("serial_").alias("first_"))  # a row a partition, and one a key
    earlier = Window.partitionBy(key).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part_", key, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first_")).alias("shift_"), F.sum("n").over(Window.partitionBy(key)).alias("n_key"))
    placed = held.withColumn("part_", part).join(offsets, ["part_", key])
    return placed.withColumn("place", F.col("serial_") + F.col("shift_")).drop("part_", "serial_", "shift_")


def climb(rows: DataFrame, key: str, levels: int = LEVELS) -> DataFrame:
    """rows: key (not null), place (from 0), n_key, leaf and more. Gives them with root, the key's, and proof."""
    block = FANOUT**levels
    rest = [c for c in rows.columns if c not in (key, "place", "n_key")]
    # the place comes first, so an item's own order is that of the leaves
    grouped = rows.groupBy(key, F.expr(f"place DIV {block}").alias("block"), "n_key").agg(F.array_sort(F.collect_list(F.struct("place", *rest))).alias("items"))
    needed = " + ".join(f"cast(n_key > {FANOUT**n} AS int)" for n in range(levels))
    grouped = tk.stored(grouped.withColumn("levels", _levels(f"({needed})", block)))
    roots = grouped.select(key, "block", "n_key", F.expr("element_at(levels, -1)[0]").alias("leaf"))
    if grouped.where(F.col("n_key") > block).isEmpty():
        above = roots.select(key, "block", F.col("leaf").alias("root"), F.expr("cast(array() AS array<struct<left: string, right: string>>)").alias("proof_above"))
    else:
        above = climb(roots.select(key, F.col("block").alias("place"), F.expr(f"(n_key - 1) DIV {block} + 1").alias("n_key"), "leaf"), key, levels)
        above = above.select(key, F.col("place").alias("block"), "root", F.col("proof").alias("proof_above"))
    own = F.expr(f"transform(items, (x, i) -> named_struct('x', x, 'proof', {SIBLINGS}))")
    each = grouped.join(above, [key, "block"]).select(key, "n_key", "root", "proof_above", F.explode(own).alias("o"))
    return each.select(key, "o.x.place", "n_key", *(f"o.x.{c}" for c in rest), "root", F.concat("o.proof", "proof_above").alias("proof"))


def manifest(rows: DataFrame, key: str, order: str, leaf: str = "leaf", *carried: str, levels: int = LEVELS) -> DataFrame:
    """leaf and carried columns of each row with subroot (of its key), root (of all) and proof (to the root)."""
    rows = rows.select(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("key_"), F.col(order).alias("id_"), F.col(leaf).alias("leaf"), *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carried)))
    rows = tk.stored(rows)  # texts are hashed once, not again for the ranges
    low = climb(ordered(rows, "key_", "id_", "leaf"), "key_", levels).withColumnsRenamed({"root": "subroot", "proof": "proof_below"})
    roots = low.where("place = 0").select("key_", F.col("subroot").alias("leaf"))
    roots = tk.stored(roots.withColumn("tree_", F.lit("")))
    high = climb(ordered(roots, "tree_", "key_"), "tree_", levels).select("key_", "root", F.col("proof").alias("proof_above"))
    return low.join(high, "key_").select(F.col("id_").alias(order), "leaf", *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carried)), "subroot", "root", F.concat("proof_below", "proof_above").alias("proof"))


def fold(leaf: Column, proof: str) -> Column:
    """The root that a digest and a proof give."""
    return F.aggregate(F.col(proof), leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings(proof: str) -> Column:
    """All digests of a proof, level by level, as one text."""
    return F.array_join(F.transform(F.col(proof), lambda s: F.concat(s["left"], s["right"])), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; a text of ASCII alone takes the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def audit(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """Proves each row against the manifest of all, after `text` became `changed` in the rows that `tampered` picks."""
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    rows = docs.select("doc_id", "source", digest(*head, F.col("text")).alias("leaf"), F.when(tampered & (changed != F.col("text")), digest(*head, changed)).alias("other_leaf"))
    out = manifest(rows, "source", "doc_id", "leaf", "other_leaf")
    return out.withColumn("folded_root", fold(F.coalesce("other_leaf", "leaf"), "proof")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; where 5 divides the id's crc32, against the text in lower case."""
    docs = tk.documents(spark, sf_dir)
    proven = audit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lower_ascii(F.col("text")))
    return proven.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings("proof"), 256).alias("proof_sha256"), "folded_root", "verified")


def _sql(depth: int = 6, top: int = 4) -> str:
    """The same for at most 16^depth rows a key and 16^top keys, a level a query."""
    shown = lambda c: f"coalesce(strlen(cast({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(shown, ('doc_id', 'source', 'lang', 'n_chars')))} || {shown(text)})"
    crc32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"""
    parts = [
        f"leaves AS (SELECT doc_id, coalesce('=' || source, '') AS key, {leaf('text')} AS leaf, CASE WHEN {crc32} % 5 = 0 THEN {leaf(f'''translate(text, '{UPPER}', '{LOWER}')''')} END AS other FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM leaves)",
    ]

    def levels(name: str, count: int) -> None:
        for k in range(count):
            run = f"OVER (PARTITION BY key, i // {FANOUT} ORDER BY i ROWS BETWEEN"
            parts.append(f"{name}{k} AS (SELECT *, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}_{k} WHERE n > 1)")
            parts.append(f"{name}_{k + 1} AS (SELECT key, i // {FANOUT} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (max(n) + {FANOUT - 1}) // {FANOUT} AS n FROM {name}{k} GROUP BY key, i // {FANOUT})")
        parts.append(f"{name}_roots AS (" + " UNION ALL ".join(f"SELECT key, h FROM {name}_{k} WHERE n = 1" for k in range(count + 1)) + ")")

    parts.append("s_0 AS (SELECT key, i, leaf AS h, n FROM placed)")
    levels("s", depth)
    parts.append("tops AS (SELECT key AS sub, h, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM s_roots)")
    parts.append("t_0 AS (SELECT '' AS key, i, h, n FROM tops)")
    levels("t", top)
    parts.append("p0 AS (SELECT p.doc_id, p.key, p.leaf, p.i, coalesce(p.other, p.leaf) AS f, '' AS proof, tops.i AS ti, tops.h AS subroot FROM placed p JOIN tops ON tops.sub = p.key)")
    for k in range(depth + top):
        name, j, place = ("s", k, "i") if k < depth else ("t", k - depth, "ti")
        key = "s.key = p.key AND " if name == "s" else ""
        parts.append(f"p{k + 1} AS (SELECT p.* REPLACE (CASE WHEN s.h IS NULL THEN p.f ELSE sha256(s.l || p.f || s.r) END AS f, p.proof || coalesce(s.l || s.r, '') AS proof) FROM p{k} p LEFT JOIN {name}{j} s ON {key}s.i = p.{place} // {FANOUT**j})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM p{depth + top}, t_roots t"


OP13_SQL = _sql()
