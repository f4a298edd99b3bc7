"""Uploads, document records and archive sessions as rewrites of plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchengine.operators.merge import latest

SUFFIXES = (".pdf", ".docx", ".txt")
MOST_BYTES = 20 << 20


def refusal(folder: Column, name: Column, size: Column, keywords: Column, most: int = MOST_BYTES) -> Column:
    """Why an upload is refused, null of one that is taken: its folder, keywords on what is no offer, its name, its
    ending or its size."""
    return (
        F.when(~F.coalesce(folder.isin("cv", "job"), F.lit(False)), "folder")
        .when(keywords.isNotNull() & (folder != "job"), "keywords")
        .when(F.coalesce(F.trim(name), F.lit("")) == "", "name")
        .when(~F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1)).isin(*SUFFIXES), "suffix")
        .when(size > most, "size")
    )


def resolve_names(uploads: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds ``path`` to uploads (upload_id, name, owner_id): the name, or where another owner or nobody has it, the first
    of <stem>__u<owner>, <stem>__u<owner>-2, ... that no one else has. docs: (path, owner_id).

    Uploads of one batch count for each other: a free name goes to the owner whose upload of it has the least id, and is
    taken for the others. Uploads of one owner and name share a path; ingest() ranks them."""
    free = _taken(uploads, docs).filter(~F.array_contains("_taken", 0))
    first = free.groupBy(F.col("name").alias("path")).agg(F.min_by("owner_id", "upload_id").alias("owner_id"))
    out = _taken(uploads, docs.select("path", "owner_id").unionByName(first))
    number = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("_taken")), "_taken"))
    stem, suffix = F.regexp_extract("name", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("name", r"(\.[^./]*)$", 1)
    own = F.concat(stem, F.lit("__u"), F.col("owner_id").cast("string"), F.when(number > 1, F.concat(F.lit("-"), number.cast("string"))).otherwise(""), suffix)
    return out.withColumn("path", F.when(number == 0, F.col("name")).otherwise(own)).drop("_taken")


def _taken(uploads: DataFrame, docs: DataFrame) -> DataFrame:
    """Uploads with ``_taken``: 0 if another has the plain name, and the numbers of the owner's forms of it that others have.

    Every record's path is read as a plain name and, where it has that form, as a numbered one of the owner it names. Plain
    names meet by name, numbered ones by name and owner, so that a name that everyone uses is no product."""
    form = r"^(.*)__u(\d+)(?:-(\d+))?(\.[^./]*)?$"
    part = lambda i: F.regexp_extract("path", form, i)
    plain = docs.select(F.col("path").alias("_name"), F.lit(0).alias("_k"), F.col("owner_id").alias("_owner"))
    numbered = docs.filter(F.col("path").rlike(form)).select(
        F.concat(part(1), part(4)).alias("_name"), part(2).try_cast("long").alias("_u"), F.coalesce(part(3).try_cast("int"), F.lit(1)).alias("_k"), F.col("owner_id").alias("_owner")
    )
    other = ~F.col("_owner").eqNullSafe(F.col("owner_id"))
    a = uploads.join(plain, F.col("name") == F.col("_name")).filter(other).select("upload_id", "_k")
    b = uploads.join(numbered, (F.col("name") == F.col("_name")) & (F.col("owner_id") == F.col("_u"))).filter(other).select("upload_id", "_k")
    taken = a.unionByName(b).groupBy("upload_id").agg(F.collect_set("_k").alias("_taken"))
    out = uploads.join(taken, "upload_id", "left")
    return out.withColumn("_taken", F.coalesce("_taken", F.array().cast("array<int>")))


def ingest(docs: DataFrame, uploads: DataFrame) -> DataFrame:
    """Records (path, owner_id, status, session_id, priority_keywords) after uploads (path, owner_id, priority_keywords, and
    upload_id if there is one): a new one is pending; one that was there is active again and its uploader's, and keeps its
    keywords where the upload has none. Of several uploads of a path the last by upload_id counts."""
    one = latest(uploads, ["path"], "upload_id" if "upload_id" in uploads.columns else None)
    one = one.select("path", F.col("owner_id").alias("_owner"), F.col("priority_keywords").alias("_words"), F.lit(True).alias("_new"))
    both = docs.join(one, "path", "full_outer")
    up = F.coalesce("_new", F.lit(False))
    return both.select(
        "path",
        F.when(up, F.col("_owner")).otherwise(F.col("owner_id")).alias("owner_id"),
        F.coalesce("status", F.lit("pending")).alias("status"),
        F.when(~up, F.col("session_id")).alias("session_id"),
        F.coalesce("_words", "priority_keywords").alias("priority_keywords"),
    )


def upsert_extracted(docs: DataFrame, extracted: DataFrame) -> DataFrame:
    """Records (path, content_hash, status, last_error, session_id) after extractions (path, content_hash, success,
    error): ready or failed, with the error's text; archived ones whose content is another now are active again."""
    e = extracted.select("path", F.col("content_hash").alias("_hash"), "success", "error", F.lit(True).alias("_new"))
    both = docs.join(e, "path", "full_outer")
    up, good = F.coalesce("_new", F.lit(False)), F.coalesce("success", F.lit(False))
    same = F.col("content_hash").eqNullSafe(F.col("_hash"))
    return both.select(
        "path",
        F.when(up, F.col("_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(up, F.when(good, "ready").otherwise("failed")).otherwise(F.col("status")).alias("status"),
        F.when(up, F.when(~good, F.coalesce("error", F.lit("extraction failed")))).otherwise(F.col("last_error")).alias("last_error"),
        F.when(~up | same, F.col("session_id")).alias("session_id"),
    )


def assign(docs: DataFrame, chosen: DataFrame, session_id: int) -> DataFrame:
    """Records with those of ``chosen`` (id) in the session; unknown() tells ids that have no record."""
    c = chosen.select("id").distinct().withColumn("_in", F.lit(True))
    out = docs.join(c, "id", "left").withColumn("session_id", F.when(F.col("_in"), F.lit(session_id)).otherwise(F.col("session_id")))
    return out.drop("_in")


def unknown(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    return chosen.select("id").distinct().join(docs.select("id"), "id", "left_anti")


def dissolve(docs: DataFrame, sessions: DataFrame, session_id: int) -> tuple[DataFrame, DataFrame]:
    """(records, sessions) once the owner has unarchived a session: its records are active, and it is gone."""
    active = docs.withColumn("session_id", F.when(~F.col("session_id").eqNullSafe(F.lit(session_id)), F.col("session_id")))
    return active, sessions.filter(F.col("id") != session_id)


def clone(docs: DataFrame, session_id: int, owner_id: int) -> DataFrame:
    """Active copies of a session's records for someone who is not its owner, under names resolved for them: (source_id,
    path, owner_id, content_hash, session_id). The originals stay as they are."""
    mine = docs.filter(F.col("session_id") == session_id).select(F.col("id").alias("upload_id"), F.col("path").alias("name"), F.lit(owner_id).cast("long").alias("owner_id"), "content_hash")
    named = resolve_names(mine, docs.select("path", "owner_id"))
    return named.select(F.col("upload_id").alias("source_id"), "path", "owner_id", "content_hash", F.lit(None).cast("long").alias("session_id"))


def append_history(rows: DataFrame, path: str, batch: int) -> None:
    """Adds rows to a history as the part of their batch; a batch that is run again replaces its own part alone."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def event_log(events: DataFrame, files: DataFrame, source: str = "watcher") -> DataFrame:
    """(source, event_type, path, fingerprint, observed_at) of events (event_type, path, observed_at); the fingerprint is
    the SHA-256 of the file (path, content), null of one that is gone."""
    prints = files.select("path", F.sha2("content", 256).alias("fingerprint"))
    return events.join(prints, "path", "left").select(F.lit(source).alias("source"), "event_type", "path", "fingerprint", "observed_at")


def newest(events: DataFrame, most: int = 1000, ts: str = "ts", id_: str = "event_id") -> DataFrame:
    """A bounded queue's content: the ``most`` newest events; older ones are dropped."""
    return events.orderBy(F.col(ts).desc(), F.col(id_).desc()).limit(most)


def stale(deliveries: DataFrame, now: Column, idle_s: float = 300.0) -> DataFrame:
    """Deliveries (id, delivered_at, done) to be delivered again: not done, the last one longer ago than ``idle_s``."""
    w = Window.partitionBy("id").orderBy(F.col("delivered_at").desc())
    last = deliveries.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("delivered_at").cast("timestamp"))) / 1_000_000
    return last.filter(~F.coalesce("done", F.lit(False)) & (age > idle_s))


def prometheus(counters: DataFrame, prefix: str = "matchengine_") -> DataFrame:
    """(line) of counters (name, value) in the text exposition format, a type line before each."""
    name = F.concat(F.lit(prefix), F.col("name"))
    both = F.array(F.concat(F.lit("# TYPE "), name, F.lit(" gauge")), F.concat(name, F.lit(" "), F.col("value").cast("string")))
    return counters.select("name", F.posexplode(both).alias("part", "line"))
