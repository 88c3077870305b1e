"""Logs: reading, appending, lookups and scans (S), and the adapters from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keep import kept

#: About how many keys of a session are numbered in one task.
NUMBERED = 2_000_000
LOG_SCHEMA = "session_id string, id long, participant string, text string"


def by_id() -> Window:
    return Window.partitionBy("session_id").orderBy("id")


def newest_first() -> Window:
    return Window.partitionBy("session_id").orderBy(F.col("id").desc())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short sessions: session_id, id, participant, text."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("id"), F.col("role").alias("participant"), "text")


def places(keys: DataFrame, session: str, order: str, rows: int = NUMBERED) -> DataFrame:
    """``keys`` (with ``n``, how many rows a key stands for) with ``id``: how many rows of its session come before it by the long column
    ``order``, nulls first; keys of equal order in any order.

    A session is summed by slices of the order's range, so that a long one isn't sorted in one task, and the sums of the slices before are
    added. A session without a name is one too.
    """
    least, most, total = keys.agg(F.min(order), F.max(order), F.sum("n")).first()
    width = max(1, ((most or 0) - (least or 0) + 1) * rows // max(total or 0, 1))
    cut = keys.withColumn("_cut", F.coalesce(F.floor((F.col(order) - F.lit(least or 0)) / width), F.lit(-1)).cast("long"))
    earlier = lambda by: F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = cut.groupBy(session, "_cut").agg(F.sum("n").alias("n")).withColumn("_before", earlier(Window.partitionBy(session).orderBy("_cut")))
    sums = sums.select(F.struct(session, "_cut").alias("_slice"), "_before")
    at = cut.withColumn("_slice", F.struct(session, "_cut")).withColumn("_at", earlier(Window.partitionBy("_slice").orderBy(F.col(order).asc_nulls_first())))
    return at.join(sums.hint("merge"), "_slice").withColumn("id", (F.col("_at") + F.col("_before")).cast("long")).drop("_cut", "_slice", "_before", "_at")


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sessions: the documents of a source, in doc_id order; those without a source are a session without a name.

    Only keys are numbered: a source, a doc_id and a hash of the row. Rows that share all three take the places from their key's on; a
    key that very many rows share is dealt out in one task, row by row.
    """
    key = F.struct("source", "doc_id", F.xxhash64("lang", "text").alias("h")).alias("_key")
    docs = table(spark, sf_dir, "documents").select(key, "source", "doc_id", "lang", "text")
    sized = docs.groupBy("_key").agg(F.count("*").alias("n")).select("_key", F.col("_key.source").alias("source"), F.col("_key.doc_id").alias("doc_id"), "n")
    named = places(sized, "source", "doc_id").select("_key", "id")
    alike = F.row_number().over(Window.partitionBy("_key").orderBy("doc_id")) - 1
    met = docs.join(named.hint("merge"), "_key").withColumn("id", F.col("id") + alike)
    return met.select(F.col("source").alias("session_id"), "id", F.col("lang").alias("participant"), "text", "doc_id")


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_log_tolerant(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """The good records. A file's broken last line is let go; any other broken line is an error that names its place."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_k")).where(F.trim("value") != "")
    kinds = f"{schema}, _corrupt_record string"
    raw = lines.withColumn("r", F.from_json("value", kinds, {"mode": "PERMISSIVE"})).select("_f", "_k", "r.*")
    ends = raw.groupBy("_f").agg(F.max("_k").alias("_end"))
    broken = raw.where("_corrupt_record is not null").join(ends, "_f").where("_k < _end").select("_f", "_corrupt_record").limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0][0]} has a broken line before its end: {broken[0][1][:80]}")
    return raw.where("_corrupt_record is null").drop("_f", "_k", "_corrupt_record")


def append_ids(log: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """``fresh`` with the ids that continue each session's log."""
    ends = log.groupBy("session_id").agg(F.max("id").alias("_end"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(order))
    return fresh.withColumn("_k", place).join(ends.hint("merge"), "session_id", "left").withColumn("id", F.coalesce("_end", F.lit(-1)) + F.col("_k")).drop("_k", "_end")


def last(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id").agg(F.max("id").alias("id"), F.max_by("text", "id").alias("text"))


def first(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id").agg(F.min("id").alias("id"), F.min_by("text", "id").alias("text"))


def count(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id").agg((F.max("id") + 1).alias("n"))


def get(log: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of (session_id, id) keys, and the keys that the log lacks."""
    return log.join(keys.hint("merge"), ["session_id", "id"], "left_semi"), keys.join(log.hint("merge"), ["session_id", "id"], "left_anti")


def span(log: DataFrame, first_id: int, last_id: int) -> DataFrame:
    return log.where(F.col("id").between(first_id, last_id))


def page(log: DataFrame, newest: int | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """The newest records of each session, or those with ids from ``start`` to ``stop``; an end left out is open."""
    if newest is None:
        return log.where(F.col("id").between(F.lit(0 if start is None else start), F.lit(2**63 - 1 if stop is None else stop)))
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("id").desc()))
    return log.withColumn("back", back).where(F.col("back") <= newest)


def ancestors(forks: DataFrame) -> DataFrame:
    """Each fork's ancestors (session_id, ancestor, cut), however many: the cut is the tightest fork message on the way.

    Steps double, so a chain of n forks takes log2(n) rounds; a round writes its tables for the next. A fork that is its own ancestor has
    no end: the sessions on such a ring are an error.
    """
    forks = kept(forks.select("session_id", F.col("parent_id").alias("ancestor"), F.col("at").cast("long").alias("cut")))
    found = jump = forks
    rounds = forks.count().bit_length()  # a chain can be as long as there are forks, unless it is a ring
    while rounds and not jump.isEmpty():
        step = jump.select(F.col("session_id").alias("ancestor"), F.col("ancestor").alias("_b"), F.col("cut").alias("_c"))
        on = lambda rows, step=step: rows.join(step.hint("merge"), "ancestor").select("session_id", F.col("_b").alias("ancestor"), F.least("cut", "_c").alias("cut"))
        found, jump, rounds = kept(found.unionByName(on(found))), kept(on(jump)), rounds - 1
    rings = jump.where("session_id = ancestor").union(found.where("session_id = ancestor")).select("session_id").limit(3).collect()
    if rings:
        raise ValueError(f"forks that come from themselves: {', '.join(r[0] for r in rings)}")
    return found


def resolve_forks(log: DataFrame, forks: DataFrame) -> DataFrame:
    """A fork sees its ancestors' records through the fork message, then its own; through any number of ancestors."""
    own = log.select("session_id", F.col("session_id").alias("owner"), "id", "participant")
    above = ancestors(forks).withColumnRenamed("session_id", "_s")
    seen = log.join(above.hint("merge"), log["session_id"] == above["ancestor"]).where(F.col("id") <= F.col("cut"))
    return own.unionByName(seen.select(F.col("_s").alias("session_id"), F.col("session_id").alias("owner"), "id", "participant"))


def fork_shared_counts(items: DataFrame, forks: DataFrame) -> DataFrame:
    """How many of the parent's items (session_id, level, last) end by the fork message, per layer."""
    named = items.withColumnRenamed("session_id", "parent_id")
    return forks.join(named.hint("merge"), "parent_id").groupBy("session_id", "level").agg(F.count_if(F.col("last") <= F.col("at")).alias("shared"))


def catalog(log: DataFrame, forks: DataFrame) -> DataFrame:
    return log.groupBy("session_id").agg(F.count("*").alias("messages")).join(forks.hint("merge"), "session_id", "left").select("session_id", "messages", "parent_id", "at")


def surviving_prefix(frontier: DataFrame, shared: DataFrame) -> DataFrame:
    """The frontier nodes (session_id, pos, level, id) of a parent that a fork keeps: those before the first that isn't shared
    (fork, session_id, level, shared: how many of the level's items end by the fork message)."""
    met = frontier.join(shared.hint("merge"), ["session_id", "level"])
    gone = F.max((F.col("id") >= F.col("shared")).cast("int")).over(Window.partitionBy("fork").orderBy("pos"))
    return met.withColumn("_g", gone).where("_g = 0").select("fork", "pos", "level", "id")


def write_layers(items: DataFrame, path: str) -> None:
    """All layers as one table, a folder for each level."""
    items.write.mode("append").partitionBy("level").parquet(path)


def layers(spark: SparkSession, path: str, level: int) -> DataFrame:
    """One layer of that table; other levels' folders aren't read."""
    return spark.read.parquet(path).where(F.col("level") == level)


def append(log_path: str, fresh: DataFrame, order: str, buckets: int = 64, schema: str = LOG_SCHEMA) -> None:
    """Add ``fresh`` at the end of each session's log, a table by bucket of session, with the ids that continue it. One writer
    at a time: two appends at once would give the same ids."""
    spark = fresh.sparkSession
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")
    folder = spark._jvm.org.apache.hadoop.fs.Path(log_path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    log = spark.read.schema(f"{schema}, bucket int").parquet(log_path) if there else spark.createDataFrame([], f"{schema}, bucket int")
    names = [c.split()[0] for c in schema.split(", ")]
    append_ids(log, fresh, order).select(*names).withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(log_path)
