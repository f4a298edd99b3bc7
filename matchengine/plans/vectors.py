"""Queries of vectors: means, cosine top-k, hybrid search, label lookup and the two-stage shortlist."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchengine.functions import scoring
from matchengine.operators import cells
from matchengine.operators import vectors as V
from matchengine.registry import query, table
from matchengine.sources.shared import shared_dir

# the query set of searches: ids divisible by 100, each against all rows
TOP = """(select *, row_number() over (partition by query_id order by sim desc, id) as rank from
    (select q.vec_id as query_id, c.vec_id as id, list_cosine_similarity(q.embedding::double[], c.embedding::double[]) as sim
     from embeddings q join embeddings c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id))"""
LEXICAL = "(id % 11) * 10.0"


def top(spark, d, k):
    e = table(spark, d, "embeddings")
    return V.cosine_top_k(e.filter("vec_id % 100 = 0"), e, k)


def r6(c):
    return F.round(c + 1e-9, 6)


@query("e_vector_mean", """with m as (select label, p, avg(x) as x from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as p from embeddings) group by 1, 2),
    n as (select label, sqrt(sum(x * x)) as n from m group by 1) select label, cast(p - 1 as int) as pos, round(x / n + 1e-9, 6) as x from m join n using (label)""")
def e_vector_mean(spark, d):
    m = V.mean_vectors(table(spark, d, "embeddings"), "label", "embedding", 64)
    return m.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", r6(F.col("x")).alias("x"))


@query("i_cosine_topk", f"select query_id, id, rank::int as rank, round(sim + 1e-9, 6) as score from {TOP} where rank <= 10")
def i_cosine_topk(spark, d):
    return top(spark, d, 10).select("query_id", "id", "rank", r6(F.col("score")).alias("score"))


@query("i_search_hybrid", f"select query_id, id, round(greatest(0.0, sim) * 100 * 0.3 + {LEXICAL} * 0.7 + 1e-9, 5) as score from {TOP} where rank <= 20 and greatest(0.0, sim) * 100 * 0.3 + {LEXICAL} * 0.7 >= 40")
def i_search_hybrid(spark, d):
    hits = V.search(top(spark, d, 20), F.expr(LEXICAL).cast("double"), min_score=40)
    return hits.select("query_id", "id", F.round(F.col("hybrid_score") + 1e-9, 5).alias("score"))


@query("f_vector_rank", f"select query_id, id, rank::int as rank, case when rank <= 5 then 'full' else 'vector' end as stage from {TOP} where rank <= 25")
def f_vector_rank(spark, d):
    return V.shortlist(top(spark, d, 25), 5).select("query_id", "id", "rank", "stage")


@query("i_taxonomy_lookup", f"""with h as (select 'term' || query_id as term, 'uri' || (id % 40) as uri, max(sim) as score from {TOP} where rank <= 25 and sim >= 0.2 and query_id % 200 <> 0 group by 1, 2),
    x as (select 'term' || vec_id as term, 'uri' || vec_id % 40 as uri, 1.0::double as score from embeddings where vec_id % 200 = 0),
    r as (select *, row_number() over (partition by term order by score desc, uri) as rank from (select * from h union all select * from x))
    select term, uri, rank::int as rank, round(score + 1e-9, 6) as score from r where rank <= 5""")
def i_taxonomy_lookup(spark, d):
    """Terms whose number is divisible by 200 have an exact label; the others take their nearest labels."""
    e = table(spark, d, "embeddings")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    terms = e.filter("vec_id % 100 = 0").select(name("term", F.col("vec_id")).alias("term"))
    labels = e.filter("vec_id % 200 = 0").select(name("TERM", F.col("vec_id")).alias("label"), name("uri", F.col("vec_id") % 40).alias("uri"))
    hits = top(spark, d, 25).select(name("term", F.col("query_id")).alias("term"), name("uri", F.col("id") % 40).alias("uri"), "score")
    return V.label_lookup(terms, labels, hits, 5, 0.2).select("term", "uri", "rank", r6(F.col("score")).alias("score"))



def indexed(spark, d):
    """The index of all vectors, written and opened, and what it finds for the query set."""
    e = table(spark, d, "embeddings")
    c = cells.fit(e)
    path = shared_dir(spark, "vector-index")
    cells.build(e, c, path)
    return cells.search(e.filter("vec_id % 100 = 0"), cells.index(spark, path), c, 10, cells.probes_for(e, c, 10, 0.96))


@query("i_ivf_topk")
def i_ivf_topk(spark, d):
    return indexed(spark, d).select("query_id", "id", "rank", r6(F.col("score")).alias("score"))


@query("i_ivf_recall", f"""select count(distinct query_id) as queries, true as enough, true as same_scores from {TOP} where rank <= 10""")
def i_ivf_recall(spark, d):
    """Whether nine tenths of the exact ten nearest are found, all with their exact scores."""
    found = indexed(spark, d).select("query_id", "id", F.col("score").alias("found"))
    both = top(spark, d, 10).join(found, ["query_id", "id"], "left")
    enough, same = F.avg(F.col("found").isNotNull().cast("double")) >= 0.9, F.bool_and(F.abs(F.col("found") - F.col("score")) < 1e-6)
    return both.agg(F.count_distinct("query_id").alias("queries"), enough.alias("enough"), same.alias("same_scores"))


PAIRS_OF_SETS = "embeddings e join embeddings f on f.label in ((e.label + 1) % 10, (e.label + 3) % 10)"
COSINE = "list_cosine_similarity(e.embedding::double[], f.embedding::double[])"


def matched(spark, d):
    e = table(spark, d, "embeddings")
    sets = cells.vector_sets(e, "label", "vec_id", "embedding", 64)
    pairs = e.select("label").distinct().select(F.col("label").alias("a"), F.explode(F.array((F.col("label") + 1) % 10, (F.col("label") + 3) % 10)).alias("b"))
    return cells.best_matches(pairs, sets, sets)


@query("d_best_match", f"select e.label as a, e.vec_id as item, f.label as b, round(max({COSINE}) + 1e-9, 6) as similarity from {PAIRS_OF_SETS} group by 1, 2, 3")
def d_best_match(spark, d):
    """Each vector's nearest one in two other sets, sets being labels."""
    return matched(spark, d).withColumn("similarity", r6(F.col("similarity")))


@query("e_best_of_sets", f"select e.label as a, f.label as b, round(max({COSINE}) + 1e-9, 6) as similarity from {PAIRS_OF_SETS} group by 1, 2")
def e_best_of_sets(spark, d):
    return matched(spark, d).groupBy("a", "b").agg(r6(F.max("similarity")).alias("similarity"))


@query("i_semantic_coverage", f"""with m as (select e.label as a, e.vec_id as item, f.label as b, max({COSINE}) as s from {PAIRS_OF_SETS} group by 1, 2, 3)
    select a, b, round(avg(case when s >= 0.2 then 0.8 * least(1.0, (s - 0.2) / 0.8) else 0 end) + 1e-9, 6) as coverage from m group by a, b""")
def i_semantic_coverage(spark, d):
    """Coverage of one set's items as skills that the other lacks, by the credit that their nearest ones earn."""
    m = matched(spark, d).withColumn("item", F.col("item").cast("string"))
    maps = cells.credits(m, scoring.semantic_credit(F.col("similarity"), 0.2))
    none, other = F.array().cast("array<string>"), F.array(F.lit("another"))
    got = scoring.skill_coverage(other, F.map_keys("semantic"), none, none, none, F.col("semantic"))[0]
    return maps.select("a", "b", r6(got).alias("coverage"))
