"""The test tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchengine.registry import table

MATCHES = (
    "select l_orderkey * 10 + l_linenumber as id, l_orderkey as job_id, l_partkey as cv_id, l_extendedprice / 1000 as score, "
    "case when l_linestatus = 'F' then l_discount end as score_skills, l_tax as score_experience, l_quantity / 50 as score_education, l_shipdate as created_at, "
    "l_returnflag, l_suppkey from lineitem"
)
JOBS = "select o_orderkey as id, o_custkey as owner_id, case when o_orderstatus = 'F' then o_custkey % 50 end as session_id, o_orderpriority as title, o_orderdate as created_at, o_orderstatus as status from orders"
CVS = "select p_partkey as id, case when p_size > 40 then p_size end as session_id, p_name as name, p_brand as person_key, p_size as years, p_type as kind from part"
FEEDBACK = (
    "select l_orderkey * 10 + l_linenumber as match_id, case l_returnflag when 'A' then 'accept' when 'R' then 'reject' else 'review' end as decision, "
    "case when l_linenumber > 1 then cast(l_quantity as int) % 5 + 1 end as rating, l_discount as skills, l_tax as experience, l_extendedprice / 1000 as score, p_brand as domain "
    "from lineitem join part on l_partkey = p_partkey"
)


def _sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    names = {t: table(spark, sf_dir, t) for t in tables}
    for t in tables:
        sql = sql.replace(f" {t}", f" {{{t}}}")
    return spark.sql(sql, **names)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, MATCHES, "lineitem")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, JOBS, "orders")


def cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CVS, "part")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, FEEDBACK, "lineitem", "part")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback rows from events: several a match."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("match_id"), F.col("event_type").alias("decision"), F.col("value").alias("rating"), F.col("ts").alias("created_at"))
