"""Merkle manifest of a dataset: a digest for every row, a tree for every group, one root. DataFrame functions only.

Plan: rows are ranked in their group (range partitions and their counts) and gathered in blocks of 512
consecutive leaves. One row holds a block: an ordered array, which ``sequence``, ``transform``, ``slice``
and ``aggregate`` collapse three levels at once; the block roots, 1/512 of the rows, are blocked again until every group has
one. Group roots are the leaves of one more tree. Proofs come down the same blocks: every block hands its path to
the root to its children, so leaves meet a path already joined at the level of blocks.

Defined results: any field may be null; a null group comes first; rows without an id come before all others of their
group and are never tampered with; rows that repeat an id follow each other in the order of their leaves; an empty
table gives an empty result; columns that are not named as fields are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_SQL, Scratch, crc32_sql, ranked

#: Children of a node, and levels that a block collapses.
WIDTH, DEPTH = 8, 3
BLOCK = WIDTH**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The levels of the array ``nodes``, lowest first: ``levels`` times, eight consecutive nodes become their digest.
LEVELS = f"""aggregate(slice(sequence(1, {DEPTH}), 1, levels), array(nodes), (all, k) -> concat(all, array(
  transform(sequence(0, cast((size(element_at(all, -1)) + {WIDTH - 1}) div {WIDTH} as int) - 1),
            i -> sha2(array_join(slice(element_at(all, -1), i * {WIDTH} + 1, {WIDTH}), ''), 256)))))"""

#: The siblings of node i on its way up in ``tree``: for each level those left and right of it in their run.
PATH = f"""transform(slice(sequence(1, {DEPTH}), 1, levels), k -> named_struct(
  'l', array_join(slice(tree[k - 1], cast(i div cast(pow({WIDTH}, k) as int) as int) * {WIDTH} + 1,
                        cast(i div cast(pow({WIDTH}, k - 1) as int) as int) % {WIDTH}), ''),
  'r', array_join(slice(tree[k - 1], cast(i div cast(pow({WIDTH}, k - 1) as int) as int) + 2,
                        {WIDTH} - 1 - cast(i div cast(pow({WIDTH}, k - 1) as int) as int) % {WIDTH}), '')))"""


def leaf(fields: Sequence[Column]) -> Column:
    """sha256 over the fields: ``-`` for null, else byte count, ``:`` and value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in fields]), 256)


def _collapsed(nodes: DataFrame, scratch: Scratch, *carried: str) -> DataFrame:
    """``nodes(g, pos, left, digest, *carried)``, left: levels still to come, as blocks ``(g, b, levels, left, rows, tree, root)``."""
    row = F.struct("pos", "digest", *carried)
    blocks = nodes.groupBy("g", F.floor(F.col("pos") / BLOCK).alias("b")).agg(F.max("left").alias("left"), F.array_sort(F.collect_list(row)).alias("rows"))
    blocks = blocks.withColumn("levels", F.least(F.lit(DEPTH), "left").cast("int")).withColumn("left", F.col("left") - F.col("levels"))
    tree = blocks.withColumn("nodes", F.expr("transform(rows, x -> x.digest)")).withColumn("tree", F.expr(LEVELS)).drop("nodes")
    return scratch.write(tree.withColumn("root", F.expr("element_at(tree, -1)[0]")), "blocks")


def trees(leaves: DataFrame, scratch: Scratch, *carried: str) -> list[DataFrame]:
    """Blocks of ``leaves(g, pos, n, digest, *carried)``, leaves first, up to one block for every g."""
    need = sum((F.when(F.col("n") > WIDTH**k, 1).otherwise(0) for k in range(21)), F.lit(0))  # levels until one node is left
    up = [_collapsed(leaves.withColumn("left", need), scratch, *carried)]
    while up[-1].where("b > 0").limit(1).count():
        up.append(_collapsed(up[-1].select("g", F.col("b").alias("pos"), "left", F.col("root").alias("digest")), scratch))
    return up


def _handed_down(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``above(g, b, up)``, the path from each block's root, carried to its children: ``(g, b, up)`` of the blocks below."""
    each = blocks.join(above, ["g", "b"]).withColumn("down", F.expr(f"transform(rows, (x, i) -> named_struct('b', x.pos, 'up', concat({PATH}, up)))"))
    return each.select("g", F.inline("down"))


#: The digest that a leaf's path leads to, and its siblings as one text.
FOLD = "aggregate(concat({path}, up), {start}, (h, s) -> sha2(concat(s.l, h, s.r), 256))"


def manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", fields: Sequence[str] = FIELDS, tampered: Column | None = None) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row.

    ``tampered``: what the text is taken for when a row is checked; the root folded from it and from the original
    siblings shows whether the row is as the manifest has it. Without it rows are checked as they are."""
    scratch = Scratch(docs.sparkSession, "merkle")
    columns = [F.col(c) for c in fields]
    seen = [F.col(c) if c != text_col or tampered is None else tampered for c in fields]
    # a prefix keeps the order of the groups and puts the null one first
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("g"), F.col(id_col).alias("id"), leaf(columns).alias("digest"), leaf(seen).alias("seen"))
    rows = rows.withColumn("seen", F.when(F.col("seen") != F.col("digest"), F.col("seen")))
    rows = scratch.write(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")  # identical rows are parted too
    order = [F.col("g").asc(), F.col("id").asc_nulls_first(), F.col("digest").asc(), F.col("tie").asc()]
    leaves = ranked(rows, order, scratch, within="g").drop("tie")
    up = trees(leaves, scratch, "id", "seen")
    groups = ranked(up[-1].select("g", F.col("root").alias("digest")), [F.col("g").asc()], scratch)
    tops = trees(groups.select(F.lit(0).alias("g"), "pos", "n", "digest", F.col("g").alias("group")), scratch, "group")
    roots = tops[-1].select("g", "root")  # one row, or none of an empty table
    above = roots.select("g", F.lit(0).cast("long").alias("b"), F.lit(None).cast("array<struct<l:string,r:string>>").alias("up"))
    above = above.withColumn("up", F.coalesce("up", F.expr("filter(array(named_struct('l', '', 'r', '')), x -> false)")))
    for level in reversed(tops[1:]):
        above = _handed_down(level, above)
    last = tops[0].join(above, ["g", "b"]).join(roots.withColumnRenamed("root", "whole"), "g")
    last = last.withColumn("down", F.expr(f"transform(rows, (x, i) -> named_struct('g', x.group, 'subroot', x.digest, 'up', concat({PATH}, up)))"))
    per_group = scratch.write(last.select("whole", F.inline("down")), "groups")
    above = per_group.select("g", F.lit(0).cast("long").alias("b"), "up")
    for level in reversed(up[1:]):
        above = _handed_down(level, above)
    above = scratch.write(above.join(per_group.select("g", "subroot", F.col("whole").alias("root")), "g"), "paths")
    path = f"concat({PATH}, up)"
    each = f"""transform(rows, (x, i) -> named_struct('id', x.id, 'leaf', x.digest,
      'proof_sha256', sha2(array_join(transform({path}, s -> concat(s.l, s.r)), ''), 256), 'folded_root', {FOLD.format(path=PATH, start="coalesce(x.seen, x.digest)")}))"""
    done = up[0].drop("root").join(above, ["g", "b"]).withColumn("each", F.expr(each)).select("subroot", "root", F.inline("each"))
    return done.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's checksum 3 divides are checked with their text in lower case (A-Z)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    done = manifest(docs, tampered=F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text")))
    return done.withColumnRenamed("id", "doc_id")


def _sql(levels: int = 7, top: int = 4) -> str:
    """The query in DuckDB for groups of up to 8**levels rows: every level is a table of nodes and a step of each row's way up."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf_of = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [
        CRC_SQL,
        f"""d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf_of("text")} AS d,
 CASE WHEN doc_id IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN {leaf_of(low)} ELSE {leaf_of("text")} END AS seen FROM documents, crc)""",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM d)",
        "n0 AS (SELECT g, pos, d FROM a0)",
        "f0 AS (SELECT doc_id, g, d AS leaf, pos, seen AS h, '' AS proof FROM a0)",
    ]

    def step(n: str, f: str, after_n: str, after_f: str, columns: str) -> None:
        run = "PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN"
        parts.append(f"""s_{n} AS (SELECT g, pos, count(*) OVER (PARTITION BY g) AS many, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
 coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {n})""")
        parts.append(f"{after_n} AS (SELECT g, pos // 8 AS pos, CASE WHEN any_value(many) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d FROM {n} JOIN (SELECT g, pos, many FROM s_{n}) USING (g, pos) GROUP BY 1, 2)")
        parts.append(f"{after_f} AS (SELECT {columns}, g, pos // 8 AS pos, CASE WHEN many > 1 THEN sha256(l || h || r) ELSE h END AS h, CASE WHEN many > 1 THEN proof || l || r ELSE proof END AS proof FROM {f} JOIN s_{n} USING (g, pos))")

    for k in range(levels):
        step(f"n{k}", f"f{k}", f"n{k + 1}", f"f{k + 1}", "doc_id, leaf")
    parts.append(f"u AS (SELECT g AS lang, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM n{levels})")
    parts.append("m0 AS (SELECT 0 AS g, pos, subroot AS d FROM u)")
    parts.append(f"e0 AS (SELECT doc_id, leaf, subroot, 0 AS g, u.pos, h, proof FROM f{levels} f JOIN u ON f.g = u.lang)")
    for k in range(top):
        step(f"m{k}", f"e{k}", f"m{k + 1}", f"e{k + 1}", "doc_id, leaf, subroot")
    return f"WITH {',\n'.join(parts)}\nSELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = d AS verified FROM e{top}, (SELECT d FROM m{top})"


OP13_SQL = _sql()
