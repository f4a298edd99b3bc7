"""The splitting tree's draws: their distribution, and quotas that add up."""

import math

from pyspark.sql import functions as F

from matchengine.llm import mixing


def pmf(n, k, q, x):
    c = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    return math.exp(c(k, x) + c(n - k, q - x) - c(n, q))


def test_draws_are_hypergeometric_at_every_size(spark):
    for n, k, q, many in ((10, 4, 5, 4000), (60_000, 20_000, 30_000, 4000)):  # deviations of 1.1 and 82
        nodes = F.array(F.struct(F.lit(n).cast("long").alias("n"), F.lit(k).cast("long").alias("k"), F.lit(q).cast("long").alias("q"), F.lit(0).alias("i")))
        got = [r.x for r in spark.range(many).select(mixing._draws(nodes, F.lit(7), F.col("id"))[0].alias("x")).collect()]
        mean, sd = q * k / n, math.sqrt(q * k / n * (1 - k / n) * (n - q) / (n - 1))
        assert abs(sum(got) / many - mean) < 5 * sd / math.sqrt(many)
        assert abs(math.sqrt(sum((x - mean) ** 2 for x in got) / many) / sd - 1) < 0.06
        # Kolmogorov's distance from the exact distribution
        below, seen, worst = 0.0, 0, 0.0
        for x in range(min(got), max(got) + 1):
            below, seen = below + pmf(n, k, q, x), seen + got.count(x)
            worst = max(worst, abs(seen / many - below))
        assert worst < 2 / math.sqrt(many)


def test_quotas_add_up_and_fit(spark):
    leaves = [("a", s, (s * 37) % 11 * 1000) for s in range(16)] + [("b", 3, 5), ("c", 0, 1)]
    asked = {"a": 31_000, "b": 5, "c": 0}
    rows = mixing.quotas(spark.createDataFrame(leaves, "key string, shard int, blocks long"), spark.createDataFrame(list(asked.items()), "key string, q long"), 16).collect()
    blocks = {(k, s): n for k, s, n in leaves}
    assert {k: sum(r.quota for r in rows if r.key == k) for k in asked} == asked
    assert all(0 <= r.quota <= blocks.get((r.key, r.shard), 0) for r in rows)


def test_shards_grow_with_the_corpus():
    from matchengine.llm import mixing

    assert mixing.shards_for(0) == mixing.shards_for(10**6) == mixing.SHARDS
    many = [mixing.shards_for(10**k) for k in range(6, 14)]
    assert many == sorted(many) and all(s & (s - 1) == 0 for s in many) and max(many) == mixing.MOST_SHARDS
    assert 10**9 / mixing.shards_for(10**9) <= mixing.SHARD_BLOCKS


def test_any_number_of_shards_takes_the_quotas(spark):
    from pyspark.sql import functions as F

    from matchengine.llm import mixing

    d = spark.createDataFrame([(i, f"s{i % 3}", "w " * (i % 90)) for i in range(300)], "doc_id long, source string, text string")
    taken = [mixing.mix(d, shards=n).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("a")).collect() for n in (2, 16, 1024)]
    for rows in taken:
        assert all(abs(r.t - r.a) <= max(64, 0.05 * r.a) for r in rows)
