"""Merkle manifest of a data set, collapsed block by block with higher-order SQL functions.

A document's leaf is the SHA-256 of its columns. Leaves get their places within their language by one range shuffle;
runs of 1024 of them become one array, whose levels ``sequence``, ``transform``, ``slice`` and ``aggregate`` collapse
natively, and the blocks' roots are collapsed by the same step again, then the languages' subroots. On the way back each
block hands its own path down to its members, joined by block, so that no language is a hot key and nothing larger than a
block is ever gathered. A path is the list of a node's siblings up to the root; ``fold`` recomputes a root from it.

Defined cases: a null column is ``-``, an empty one ``0:``; null ids come first in their language and are never tampered
with; rows of one id go by their leaves, so wholly equal rows are interchangeable; the null language comes first; an
empty table has no leaves and no root; very long texts are hashed as they are; other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchengine.llm.store import materialise

BITS = 10  # levels a block collapses, so that it has 1024 members at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# levels of a block from its ``leaves`` up, ``depth`` of them above the leaves
LEVELS = """aggregate(slice(sequence(0, depth), 2, depth), array(leaves), (done, k) -> concat(done, array(
    transform(sequence(0, (size(element_at(done, -1)) - 1) div 2), j -> sha2(cast(array_join(slice(element_at(done, -1), 2 * j + 1, 2), '') as binary), 256)))))"""
# siblings of the member ``at`` of a block; a null hash where a run has no other
SIBLINGS = """transform(slice(sequence(0, depth), 1, depth), k ->
    named_struct('hash', get(levels[k], (shiftright(at, k) ^ 1)), 'left', (shiftright(at, k) & 1) = 1))"""


def leaf(**values: Column) -> Column:
    """H of FIELDS; ``values`` stand in for columns of these names."""

    def field(c: str) -> Column:
        text = values.get(c, F.col(f"`{c}`")).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)).cast("binary"), 256)


def placed(nodes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of each row within its ``key`` by ``order``, and ``many``, the rows of the key.

    One range shuffle; a row's place in its partition and the sum of its key's rows in the partitions before make its
    place. ``tie`` parts equal rows, so that many copies of one row are no hot partition."""
    names = nodes.columns
    cut = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(key, *order, "tie").sortWithinPartitions(key, *order, "tie")
    rows = materialise(cut.select(*names, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line")), "ordered")
    parts = rows.groupBy(key, "part").agg(F.count("*").alias("here"), F.min("line").alias("first"))
    w = Window.partitionBy(key)
    before = F.coalesce(F.sum("here").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col(key).alias("_key"), F.col("part").alias("_part"), (before - F.col("first")).alias("_shift"), F.sum("here").over(w).alias("many"))
    both = rows.join(parts, (F.col(key) == F.col("_key")) & (F.col("part") == F.col("_part")))
    return both.select(*names, (F.col("line") + F.col("_shift")).alias("pos"), "many")


def _paths(nodes: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(tree, pos, hash, *keep, path) of nodes (tree, pos, many, hash, *keep), the siblings up to each tree's top; and
    (tree, hash) of the tops."""
    block = 1 << BITS
    members = F.array_sort(F.collect_list(F.struct("pos", "hash", *keep)))
    blocks = nodes.groupBy("tree", F.shiftright("pos", BITS).alias("block"), "many").agg(members.alias("members"))
    levels = "if(many > 1, if(many > {0}, {1}, length(bin(many - 1))), 0)".format(block, BITS)
    blocks = blocks.withColumn("depth", F.expr(f"cast({levels} as int)")).withColumn("leaves", F.expr("members.hash")).withColumn("levels", F.expr(LEVELS)).drop("leaves")
    blocks = materialise(blocks.withColumn("hash", F.expr("element_at(levels, -1)[0]")), "blocks")
    if blocks.filter(F.col("many") > block).isEmpty():
        above, tops = blocks.withColumn("up", F.array().cast("array<struct<hash:string,left:boolean>>")), blocks.select("tree", "hash")
    else:
        higher = blocks.select("tree", F.col("block").alias("pos"), F.expr(f"(many + {block - 1}) div {block}").alias("many"), "hash")
        found, tops = _paths(higher, [])
        found = found.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("path").alias("up"))
        above = blocks.join(found, (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_pos")))
    one = above.select("tree", "depth", "levels", "up", F.posexplode("members").alias("at", "m"))
    return one.select("tree", "m.pos", "m.hash", *[f"m.{c}" for c in keep], F.concat(F.expr(SIBLINGS), F.col("up")).alias("path")), tops


def manifest(leaves: DataFrame, key: str, order: list[str], hash_: str = "leaf") -> DataFrame:
    """``leaves`` with ``path`` up to the root, ``subroot`` of their ``key`` and ``root``.

    Leaves ascend by ``order`` in their key, keys as UTF-8 with null first. The columns of ``leaves`` come back as they
    are; none may be named as a result."""
    names = [f"c{i}" for i in range(len(leaves.columns))]
    own = dict(zip(leaves.columns, names, strict=True))
    rows = leaves.toDF(*names).withColumnRenamed(own[hash_], "hash")
    own[hash_] = "hash"
    rows = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col(own[key])), F.lit("")))
    inner, tops = _paths(placed(rows, "tree", [own[c] for c in order]), [c for c in own.values() if c != "hash"])
    outer = placed(tops.select(F.lit("").alias("all"), "tree", "hash"), "all", ["tree"])
    outer, root = _paths(outer.select(F.col("all").alias("tree"), "pos", "many", "hash", F.col("tree").alias("own")), ["own"])
    outer = outer.join(F.broadcast(root.select("tree", F.col("hash").alias("root"))), "tree")  # one row
    outer = outer.select(F.col("own").alias("_own"), F.col("hash").alias("subroot"), F.col("path").alias("up"), "root")
    both = inner.join(outer, F.col("tree") == F.col("_own"))
    return both.select(*[F.col(c).alias(n) for n, c in own.items()], "subroot", "root", F.concat("path", "up").alias("path"))


def fold(node: str, path: str = "path") -> Column:
    """The root that a node's hash and its path lead to."""
    return F.aggregate(path, F.col(node), lambda h, s: F.sha2(F.when(s["hash"].isNull(), h).when(s["left"], F.concat(s["hash"], h)).otherwise(F.concat(h, s["hash"])).cast("binary"), 256))


def verified(found: DataFrame, leaves: DataFrame, on: str) -> DataFrame:
    """``leaves`` (``on``, leaf) that a later reading gave, with ``folded_root`` and whether it is the manifest's root;
    a row that the manifest has not, or that has another content, is not verified."""
    m = found.select(F.col(on).alias("_on"), "path", "root")
    both = leaves.join(m, F.col(on).eqNullSafe(F.col("_on")), "left").withColumn("folded_root", fold("leaf"))
    return both.select(*leaves.columns, "folded_root", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)).alias("verified"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The contract's row of every document; a seventh of the leaves are folded as tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select(F.col("doc_id").cast("long"), "source", "lang", F.col("n_chars").cast("long"), "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(n_chars=F.col("n_chars") + 1))
    leaves = docs.select("doc_id", "lang", leaf().alias("leaf"), tampered.alias("tampered"))
    found = manifest(leaves, "lang", ["doc_id", "leaf"]).withColumn("candidate", F.coalesce("tampered", "leaf"))
    proof = F.sha2(F.array_join("path.hash", "").cast("binary"), 256)
    out = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold("candidate").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# crc32 takes one step a bit; a step's number is the next byte at the first bit of each
SQL = """with recursive f as (select doc_id, lang, n_chars, coalesce(strlen(source) || ':' || source, '-') as a, coalesce(strlen(lang) || ':' || lang, '-') as b,
    coalesce(strlen(text) || ':' || text, '-') as t, coalesce(length(doc_id::varchar) || ':' || doc_id, '-') as d from documents),
crc as (select doc_id, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: [ascii(substr(doc_id::varchar, i::bigint, 1))::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, case when xor(c, b) & 1 = 1 then 3988292384::bigint else 0::bigint end))) % 7 = 0 as hit from (select distinct doc_id from documents where doc_id is not null)),
l as (select f.doc_id, lang, sha256(d || a || b || coalesce(length(n_chars::varchar) || ':' || n_chars, '-') || t) as leaf,
    case when hit then sha256(d || a || b || coalesce(length((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || t) end as bad from f left join crc on f.doc_id = crc.doc_id),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from l),
up as (select lang, 0 as k, pos as i, n, leaf as h from p
    union all select lang, k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from up where n > 1 group by lang, k, i // 2, n),
s as (select lang, h as subroot, k as depth, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from up where n = 1),
top as (select 0 as k, pos as i, n, subroot as h from s
    union all select k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from top where n > 1 group by k, i // 2, n),
r as (select h as root from top where n = 1),
path as (select p.lang, p.pos, up.k, p.pos >> up.k as spot, sib.h from p join up on up.lang is not distinct from p.lang and up.i = p.pos >> up.k and up.n > 1
    left join up sib on sib.lang is not distinct from p.lang and sib.k = up.k and sib.i = xor(p.pos >> up.k, 1)
    union all select p.lang, p.pos, s.depth + top.k, s.pos >> top.k, sib.h from p join s on s.lang is not distinct from p.lang join top on top.i = s.pos >> top.k and top.n > 1
    left join top sib on sib.k = top.k and sib.i = xor(s.pos >> top.k, 1)),
proof as (select lang, pos, coalesce(string_agg(h, '' order by k), '') as sibs, list(struct_pack(h := coalesce(h, ''), l := spot % 2) order by k) as steps from path group by lang, pos),
o as (select p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(sibs, '')) as proof_sha256,
    list_reduce(list_prepend(struct_pack(h := coalesce(p.bad, p.leaf), l := 0::bigint), coalesce(steps, [])), lambda a, b: struct_pack(h := sha256(case when b.l = 1 then b.h || a.h else a.h || b.h end), l := 0::bigint)).h as folded_root
    from p join s on s.lang is not distinct from p.lang cross join r left join proof on proof.lang is not distinct from p.lang and proof.pos = p.pos)
select *, folded_root = root as verified from o"""
