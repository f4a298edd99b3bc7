"""Vector search in cells: an inverted-file index, and exact search as its case of one cell.

Queries and vectors of one cell meet in tiles: the vectors of a cell are dealt to blocks, its queries too, and each pair of
blocks is one matrix product in one task, which sends on the best ``k`` of each query alone. Nothing is collected, and a
cell or a query set of any size is many bounded tiles.

An index is a table partitioned by cell. Its cells are those of a spherical k-means that ``fit`` runs in the driver over
``SAMPLE`` vectors at most, those with the smallest hash of their ids; every vector is stored with its nearest cell. A
search takes the ``probes`` nearest cells of each query and reads these partitions alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE = 20_000  # vectors that cells are fitted on
MOST_CELLS = 4096  # their centres are sent to every task: 8 MB at 256 dimensions
QUERIES = 1024  # of a tile
PRODUCTS = 1 << 22  # of a tile, so that few queries meet more vectors at once
HELD = 1 << 22  # numbers of a tile's left vectors, 32 MB, that stay while its right ones come by
COLUMNS = 8  # tiles that a left vector goes to


def unit(rows: pa.Array | pa.ChunkedArray, many: int) -> np.ndarray:
    """[many, size] vectors of length one; a zero vector stays."""
    flat = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    m = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(many, -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` largest of each row; ties with the last stay in."""
    few = min(k, scores.shape[1])
    bar = np.partition(scores, scores.shape[1] - few, axis=1)[:, scores.shape[1] - few][:, None]
    return np.nonzero((scores >= bar) & np.isfinite(scores))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, itself: bool = False) -> DataFrame:
    """(query_id, id, score, rank): of queries (q, v, cell) and vectors (id, v, cell) those of one cell, the ``k`` nearest
    of each query by cosine, ties by id."""
    size = queries.groupBy("cell").agg(F.count("*").alias("nq")).join(vectors.groupBy("cell").agg(F.count("*").alias("nv")), "cell")
    wide = F.least(F.lit(1 << 16), F.greatest(F.lit(QUERIES * 4), F.floor(PRODUCTS / F.col("nq"))))
    size = F.broadcast(size.select("cell", F.ceil(F.col("nq") / QUERIES).alias("high"), F.ceil(F.col("nv") / wide).alias("wide")))  # a row a probed cell, MOST_CELLS at most
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    q = queries.join(size, "cell").select("q", "v", "cell", block("q", "high").alias("row"), every("wide").alias("col"))
    c = vectors.join(size, "cell").select("id", "v", "cell", block("id", "wide").alias("col"), every("high").alias("row"))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        mine, theirs = left.column("q").to_numpy(), right.column("id").to_numpy()
        s = unit(left.column("v"), len(mine)) @ unit(right.column("v"), len(theirs)).T
        if not itself:
            s[mine[:, None] == theirs[None, :]] = -np.inf
        i, j = best(s, k)
        return pa.table({"query_id": mine[i], "id": theirs[j], "score": s[i, j]})

    key = ["cell", "row", "col"]
    found = q.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(near, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def exact(queries: DataFrame, corpus: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", itself: bool = False) -> DataFrame:
    """top_k() over all of the corpus."""
    one = lambda d, name: d.select(F.col(id_).cast("long").alias(name), F.col(vector).alias("v"), F.lit(0).alias("cell"))
    return top_k(one(queries, "q"), one(corpus, "id"), k, itself)


@dataclass(frozen=True)
class Cells:
    """The centres of the cells, [many, size], of length one."""

    centres: np.ndarray


def fit(corpus: DataFrame, cells: int | None = None, id_: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, rounds: int = 12, seed: int = 42) -> Cells:
    """Cells for a corpus, the square root of its rows unless told otherwise, MOST_CELLS at most."""
    cells = min(cells or max(1, int(corpus.count() ** 0.5)), MOST_CELLS)
    rows = corpus.select(F.col(vector).alias("v")).orderBy(F.xxhash64(F.lit(seed), F.col(id_)), id_).limit(sample).collect()
    if not rows:
        return Cells(np.zeros((1, 0)))
    x = np.array([r.v for r in rows], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-300), centres)  # an empty cell keeps its centre
    return Cells(centres)


def assigned(rows: DataFrame, cells: Cells, name: str, id_: str = "vec_id", vector: str = "embedding", probes: int = 1) -> DataFrame:
    """(name, v, cell, place): each vector with its ``probes`` nearest cells, the nearest in place 1."""
    sent = rows.sparkSession.sparkContext.broadcast(cells.centres)
    many = min(probes, len(cells.centres))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = unit(b.column(1), b.num_rows) @ sent.value.T
            near = np.argpartition(-s, many - 1, axis=1)[:, :many]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
            place = np.tile(np.arange(1, many + 1, dtype=np.int32), b.num_rows)
            index = pa.array(np.repeat(np.arange(b.num_rows), many))
            yield pa.RecordBatch.from_arrays([b.column(0).take(index), b.column(1).take(index), pa.array(near.ravel().astype(np.int32)), pa.array(place)], [name, "v", "cell", "place"])

    values = rows.select(F.col(id_).cast("long").alias(name), F.col(vector).cast("array<float>").alias("v"))
    return values.mapInArrow(run, f"{name} long, v array<float>, cell int, place int")


def probes_for(corpus: DataFrame, cells: Cells, k: int, least: float, id_: str = "vec_id", vector: str = "embedding", sample: int = 500, seed: int = 7) -> int:
    """The fewest probes with which ``sample`` of the vectors, those with the smallest hash of their ids, find that share
    of their exact ``k`` nearest. The driver gets ``k`` rows for each of them."""
    asked = corpus.orderBy(F.xxhash64(F.lit(seed), F.col(id_)), id_).limit(sample)
    own = assigned(corpus, cells, "id", id_, vector).select("id", "cell")
    places = assigned(asked, cells, "query_id", id_, vector, len(cells.centres)).select("query_id", "cell", "place")
    placed = exact(asked, corpus, k, id_, vector).join(own, "id").join(places, ["query_id", "cell"])
    places = sorted(r.place for r in placed.select("place").collect())
    return places[min(len(places) - 1, int(np.ceil(least * len(places))) - 1)] if places else 1


def build(corpus: DataFrame, cells: Cells, path: str, id_: str = "vec_id", vector: str = "embedding") -> None:
    """Writes the index: every vector, in the folder of its cell. A large cell is written by several tasks."""
    rows = assigned(corpus, cells, "id", id_, vector).select("id", "v", "cell")
    rows.repartitionByRange("cell", F.xxhash64("id")).write.partitionBy("cell").parquet(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(id, v, cell) of an index."""
    return spark.read.schema("id long, v array<float>, cell int").parquet(path)


def search(queries: DataFrame, vectors: DataFrame, cells: Cells, k: int, probes: int, id_: str = "vec_id", vector: str = "embedding", itself: bool = False) -> DataFrame:
    """top_k() over the ``probes`` nearest cells of each query, of an index's ``vectors``."""
    return top_k(assigned(queries, cells, "q", id_, vector, probes), vectors, k, itself)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(queries, recall): the share of the true (query_id, id) that were found."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    both = truth.select("query_id", "id").join(hit, ["query_id", "id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def vector_sets(rows: DataFrame, set_: str, item: str, vector: str, most: int = 1024) -> DataFrame:
    """(set, items, v): each set's vectors behind one another in one array, ``most`` about a row."""
    names = rows.select(F.col(set_).alias("set"), F.col(item).alias("item"), F.col(vector).alias("x"))
    many = names.groupBy("set").agg(F.ceil(F.count("*") / most).alias("parts"))
    dealt = names.join(many, "set").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")))
    own = dealt.groupBy("set", "part").agg(F.array_sort(F.collect_list(F.struct("item", "x"))).alias("m"))
    return own.select("set", F.col("m.item").alias("items"), F.flatten("m.x").alias("v"))


def best_matches(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, item, b, similarity): for pairs (a, b) of vector_sets() the largest cosine of each of a's items with any of b's.

    A pair's vectors are dealt to tiles. A task holds a tile's left vectors, ``HELD`` numbers at most, and its right ones
    come by, a row at a time. A left vector is sent to ``COLUMNS`` tiles at most, a right one to one for every ``HELD``
    numbers of the left set, so that what is shuffled grows with the sets and not with their product."""
    x = left.select(F.col("set").alias("a"), "items", F.col("v").alias("v"))
    y = right.select(F.col("set").alias("b"), F.size("items").alias("n"), F.col("v").alias("v"))
    tall = x.groupBy("a").agg(F.ceil(F.sum(F.size("v").cast("long")) / HELD).alias("rows"))
    wide = y.groupBy("b").agg(F.least(F.lit(COLUMNS), F.count("*")).alias("cols"))
    sizes = pairs.select("a", "b").distinct().join(tall, "a").join(wide, "b")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    key = ["a", "b", "row", "col"]
    l = x.join(sizes, "a").withColumn("row", of("items", "rows")).withColumn("col", every("cols")).select(*key, F.lit(0).alias("side"), "items", F.size("items").alias("n"), "v")  # noqa: E741
    r = y.join(sizes, "b").withColumn("col", of("v", "cols")).withColumn("row", every("rows")).select(*key, F.lit(1).alias("side"), F.lit(None).cast(x.schema["items"].dataType).alias("items"), "n", "v")
    schema = l.select("a", F.explode("items").alias("item"), "b").schema.add("similarity", "double")

    def run(batches):
        key, ends, items, held, top = None, None, [], [], None

        def found():
            many = pa.array(np.zeros(len(top), np.int64))
            return pa.RecordBatch.from_arrays([ends[0].take(many), pa.concat_arrays(items), ends[1].take(many), pa.array(top)], ["a", "item", "b", "similarity"])

        for b in batches:
            n, side = b.column(6).to_pylist(), b.column(4).to_pylist()
            for i, k in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)):
                if k != key:
                    if top is not None:
                        yield found()
                    key, ends, items, held, top = k, (b.column(0).slice(i, 1), b.column(1).slice(i, 1)), [], [], None
                v = unit(b.column(7).slice(i, 1), n[i])
                if side[i] == 0:
                    items.append(b.column(5)[i].values)
                    held.append(v)
                elif held:
                    if top is None:
                        held = [np.concatenate(held)]
                        top = np.full(len(held[0]), -np.inf)
                    step = max(1, PRODUCTS // n[i])
                    for at in range(0, len(top), step):
                        np.maximum(top[at : at + step], (held[0][at : at + step] @ v.T).max(1), out=top[at : at + step])
        if top is not None:
            yield found()

    some = l.unionByName(r).repartition(*key).sortWithinPartitions(*key, "side")
    return some.mapInArrow(run, schema).groupBy("a", "item", "b").agg(F.max("similarity").alias("similarity"))


def credits(matches: DataFrame, credit: Column) -> DataFrame:
    """(a, b, semantic): best_matches() of skills as the map that scoring.skill_coverage() takes; ``credit`` is made of
    ``similarity``, as by scoring.semantic_credit()."""
    return matches.groupBy("a", "b").agg(F.map_from_entries(F.collect_list(F.struct("item", credit.alias("credit")))).alias("semantic"))
