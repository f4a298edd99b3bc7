"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's quota of word blocks is split exactly among output shards by hypergeometric draws down a binary tree;
each shard then draws its quota from its own permuted blocks, so no two draws meet and no shard sees another's rows.
A source's hot third of all rows is spread over all shards. Only DataFrame functions; no Python on executors.

Defined cases: null or blank texts have size 0 and take 0; a null source is a source of its own, the last; repeated
rows are one document each, told apart by ``occurrence``; an empty table gives no rows; mix() looks at
no other columns, mixed_documents() gives them back as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchengine.llm.columns import renamed
from matchengine.llm.store import materialise

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 32  # words
SHARDS = 512  # at least; a power of two
MOST_SHARDS = 1 << 17  # a source's row holds a number for each: 1 MB
SHARD_BLOCKS = 1 << 18  # that a shard should hold: some 8 million words
MOST = 3  # times that a document may be taken


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``size``: words between ASCII white space, 0 of a null."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, key, source_size, nb, target of a frame of (source, key, size, nb): one row a source.

    Water filling in closed form: with sources in ascending order of most/weight, the level is the largest of
    (all words - the caps before) / (the weights from here on).
    """
    per = sizes.groupBy("source", "key").agg(F.sum("size").alias("source_size"), F.sum("nb").alias("nb"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", w).withColumn("_r", MOST * F.col("source_size") / F.col("_w"))
    every = Window.partitionBy()
    rising = Window.orderBy("_r", F.col("source").asc_nulls_last())
    before, upward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn(
        "_level", (F.sum("source_size").over(every) - F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0))) / F.sum("_w").over(upward)
    )
    level = F.max("_level").over(every)
    return per.withColumn("target", F.least((MOST * F.col("source_size")).cast("double"), level * F.col("_w"))).drop("_w", "_r", "_level")


def _uniform(*key: Column) -> Column:
    """In (0, 1), the same for the same key in every run."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)


def _draws(nodes: Column, *key: Column) -> Column:
    """Hypergeometric, for each node {n blocks, k of them to the left, q drawn, i}: how many drawn fall to the left.

    Exact inversion at every size, over ten standard deviations about the mean: the chance of what lies beyond is under
    1e-22, less than a double can tell. The steps grow with the square root of the blocks, some 300,000 at a tree's root
    for 10^9 blocks. The two children's quotas add up to their parent's.
    """

    def bounds(d: Column) -> Column:
        n, k, q = (d[x].cast("double") for x in "nkq")
        share = k / F.greatest(n, F.lit(1.0))
        mean = q * share
        sd = F.sqrt(F.greatest(mean * (1 - share) * (n - q) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
        least, most = F.greatest(F.lit(0).cast("long"), d["q"] - (d["n"] - d["k"])), F.least(d["q"], d["k"])
        return F.struct(n.alias("n"), k.alias("k"), q.alias("q"), d["i"].alias("i"), mean.alias("mean"), sd.alias("sd"), least.alias("least"), most.alias("most"))

    def limits(d: Column) -> Column:
        lo = F.greatest(d["least"], F.floor(d["mean"] - 10 * d["sd"] - 2).cast("long"))
        hi = F.least(d["most"], F.ceil(d["mean"] + 10 * d["sd"] + 2).cast("long"))
        return F.struct(d.alias("d"), lo.alias("lo"), F.greatest(lo, hi).alias("hi"), _uniform(F.lit(1), *key, d["i"]).alias("u"))

    def ratio(d: Column, x: Column) -> Column:  # probability of x + 1 to that of x
        return (d["k"] - x) * (d["q"] - x) / ((x + 1) * F.greatest(d["n"] - d["k"] - d["q"] + x + 1, F.lit(1.0)))

    def total(e: Column) -> Column:
        step = lambda a, x: F.struct((a["w"] * ratio(e["d"], x.cast("double"))).alias("w"), (a["c"] + a["w"]).alias("c"))
        return F.struct(e.alias("e"), F.aggregate(F.sequence(e["lo"], e["hi"]), F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("c")), step, lambda a: a["c"]).alias("total"))

    def pick(g: Column) -> Column:
        e, d = g["e"], g["e"]["d"]
        step = lambda a, x: F.struct(
            (a["w"] * ratio(d, x.cast("double"))).alias("w"), (a["c"] + a["w"]).alias("c"), (a["i"] + (a["c"] < e["u"] * g["total"]).cast("long")).alias("i")
        )
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("c"), F.lit(-1).cast("long").alias("i"))
        found = e["lo"] + F.greatest(F.lit(0).cast("long"), F.aggregate(F.sequence(e["lo"], e["hi"]), start, step, lambda a: a["i"]))
        return F.greatest(d["least"], F.least(d["most"], found))

    return F.transform(F.transform(F.transform(F.transform(nodes, bounds), limits), total), pick)


def quotas(leaves: DataFrame, source_quota: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(key, shard, quota) of leaves (key, shard, blocks) and source_quota (key, q): the splitting tree.

    A row a source carries its ``shards`` counts; each level halves every node, without a shuffle.
    """
    zero = F.lit(0).cast("long")
    full = leaves.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("shard", "blocks"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.try_element_at("m", i), zero))

    def halve(a: Column, level: Column) -> Column:
        width = F.lit(float(shards)) / F.pow(F.lit(2.0), level)  # leaves below a node
        total = lambda i, many: F.aggregate(F.slice(a["n"], (i * width + 1).cast("int"), many.cast("int")), zero, lambda s, x: s + x)
        nodes = F.transform(a["q"], lambda q, i: F.struct(total(i, width).alias("n"), total(i, width / 2).alias("k"), q.alias("q"), i.alias("i")))
        split = F.zip_with(_draws(nodes, F.lit(seed), level, F.col("key")), a["q"], lambda x, q: F.array(x, q - x))
        return F.struct(a["n"].alias("n"), F.flatten(split).alias("q"))

    start = F.struct(counts.alias("n"), F.array("q").alias("q"))
    levels = F.sequence(F.lit(0), F.lit(shards.bit_length() - 2))
    tree = full.join(source_quota, "key").select("key", F.aggregate(levels, start, halve, lambda a: a["q"]).alias("q"))
    return tree.select("key", F.posexplode("q").alias("shard", "quota"))


def shards_for(blocks: int) -> int:
    """Output shards for so many blocks."""
    return min(MOST_SHARDS, max(SHARDS, 1 << max(0, (blocks // SHARD_BLOCKS - 1).bit_length())))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), shards: int | None = None, seed: int = 0, text: str = "text") -> DataFrame:
    """A row for each document: doc_id, tie (tells rows of one id apart), source, size, source_size, target, passes
    (whole copies taken), blocks (numbers of the blocks taken once more, ``BLOCK`` words each, a text's last block
    shorter), taken (words), shard, position (its random place in the shard). Shards are as many as shards_for() says.
    """
    sizes = sized(docs, text).select(
        "doc_id", F.xxhash64("source", text).alias("tie"), "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), "size"
    )
    sizes = materialise(sizes.withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("long")), "mix-sizes")
    shards = shards or shards_for(sizes.agg(F.coalesce(F.sum("nb"), F.lit(0)).alias("nb")).first().nb)
    sizes = sizes.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tie"), F.lit(shards)).cast("int"))
    aim = targets(sizes.select("source", "key", "size", "nb"), weights)
    aim = aim.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    aim = materialise(aim.withColumn("q", F.when(F.col("source_size") > 0, F.round(F.col("nb") * rest / F.col("source_size"))).otherwise(0).cast("long")), "mix-sources")
    quota = quotas(sizes.groupBy("key", "shard").agg(F.sum("nb").alias("blocks")), aim.select("key", "q"), shards, seed)
    quota = quota.join(aim.select("key", "source_size", "target", "passes"), "key")
    leaf = sizes.repartition("key", "shard").join(quota, ["key", "shard"])
    leaf = leaf.withColumn("occurrence", F.row_number().over(Window.partitionBy("key", "shard", "doc_id", "tie").orderBy("size")))
    blocks = leaf.withColumn("block", F.explode_outer(F.when(F.col("nb") > 0, F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))))
    blocks = blocks.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "tie", "occurrence", "block"))
    order = Window.partitionBy("key", "shard").orderBy(F.col("block").isNull(), "_h", "doc_id", "tie", "occurrence", "block")
    blocks = blocks.withColumn("_in", F.col("block").isNotNull() & (F.row_number().over(order) <= F.col("quota")))
    words = F.when(F.col("_in"), F.least(F.lit(BLOCK), F.col("size") - F.col("block") * BLOCK)).otherwise(0)
    same = ["source", "size", "source_size", "target", "passes"]
    whole = blocks.groupBy("key", "shard", "doc_id", "tie", "occurrence").agg(
        *[F.first(c).alias(c) for c in same], F.sort_array(F.collect_list(F.when(F.col("_in"), F.col("block")))).alias("blocks"), F.sum(words).cast("long").alias("_extra")
    )
    place = F.xxhash64(F.lit(seed + 1), "doc_id", "tie", "occurrence")
    return whole.select("doc_id", "tie", *same, "blocks", (F.col("passes") * F.col("size") + F.col("_extra")).alias("taken"), "shard", place.alias("position"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: a row for each whole copy taken, and one with the text of
    the blocks taken once more, in text order. Documents of which nothing is taken are gone. Rows leave each partition
    shard by shard, shuffled in each: by a hash of their position and the copy's number."""
    plan = mix(docs, **options).filter("taken > 0").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "passes", "blocks", F.col("shard").alias("_shard"), F.col("position").alias("_at"))
    plan = plan.withColumn("_o", F.row_number().over(Window.partitionBy("_id", "_tie").orderBy("passes", F.size("blocks"))))
    inner, own = renamed(docs)
    id_, text = own["doc_id"], own["text"]
    keyed = inner.withColumn("_t", F.xxhash64(own["source"], text))
    keyed = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(id_, "_t").orderBy("_t")))
    both = keyed.join(plan, keyed[id_].eqNullSafe(plan["_id"]) & (keyed["_t"] == plan["_tie"]) & (keyed["_n"] == plan["_o"]))
    words = F.regexp_extract_all(F.col(text), F.lit(f"[\\x20\\x09-\\x0D]*{WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))
    both = both.withColumn("_words", F.when(F.size("blocks") > 0, words))
    part = F.concat_ws("", F.flatten(F.transform("blocks", lambda b: F.slice("_words", (b * BLOCK + 1).cast("int"), F.lit(BLOCK)))))
    pieces = F.concat(F.array_repeat(F.col(text), F.col("passes").cast("int")), F.when(F.size("blocks") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = both.select("*", F.posexplode(pieces).alias("_copy", "_piece")).sortWithinPartitions("_shard", F.xxhash64("_at", "_copy"))
    fixed = {"text": F.col("_piece"), "n_chars": F.length("_piece").cast("long")}
    return out.select(*[fixed.get(n, F.col(c)).alias(n) for n, c in own.items()])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: what the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "shard", "position", F.size("blocks").alias("extra_blocks"), "passes")
