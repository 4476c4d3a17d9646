"""Queries with state over ordered events, in batch and as streams drained once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.plans.registry import Registry, Tables
from lexmill.runtime import shared_dir
from lexmill.streaming import stateful

query = Registry()

_E = "e AS (SELECT DISTINCT event_id, user_id, event_type, CAST(epoch_ms(ts) AS BIGINT) AS at, value FROM events)"


_ADMITTED = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment, id) AS k FROM (SELECT DISTINCT event_id AS id, user_id, epoch_us(ts) // 1000 AS moment FROM events)),
    r AS (SELECT id, user_id, moment, k, TRUE AS admitted, [moment] AS recent FROM e WHERE k = 1
      UNION ALL SELECT e.id, e.user_id, e.moment, e.k, len(list_filter(recent, lambda x: e.moment - x < 3600000)) < 3,
        CASE WHEN len(list_filter(recent, lambda x: e.moment - x < 3600000)) < 3 THEN list_append(list_filter(recent, lambda x: e.moment - x < 3600000), e.moment) ELSE recent END
      FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
    SELECT user_id, moment AS "at", id, admitted FROM r"""


def _events(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "value").distinct()
    return e


def _stream(t: Tables, name: str) -> DataFrame:
    """A table's files as a stream, read once over."""
    path = f"{t.sf_dir}/{name}.parquet"
    jvm, conf = t.spark.sparkContext._jvm, t.spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    reader = t.spark.readStream.schema(getattr(t, name).schema)
    if at.getFileSystem(conf).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)


def drained(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all there is and read its result: appended rows, or, with keys, the last state of every key.

    With keys each batch writes only the rows it changed, under its number, so a batch that is run again overwrites itself.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    if keys is None:
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in stream.columns if c not in keys)), "batch").alias("x"))
    return last.select(*keys, "x.*")


@query(_ADMITTED)
def admitted_requests(t: Tables) -> DataFrame:
    """Sliding limiter over every user's events: at most three admitted an hour."""
    return stateful.admitted(_events(t).withColumnRenamed("event_id", "id"), 3_600_000, 3)


@query(_ADMITTED)
def admitted_requests_stream(t: Tables) -> DataFrame:
    """The same limiter as a stateful stream."""
    e = _stream(t, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    return drained(stateful.admitted_stream(e, 3_600_000, 3))


@query(
    """SELECT user_id, CAST(floor(created_at / 86400000.0) AS BIGINT) AS day, CAST(sum(CAST(cost_usd AS DECIMAL(18,9))) AS DOUBLE) AS total, count(*) AS n FROM fetch_usage
    WHERE created_at % 86400000 <> 0 GROUP BY ALL"""
)
def fetch_days_stream(t: Tables) -> DataFrame:
    """Fetch spend per user and UTC day, kept up over a stream of ledger rows (as delivered, repeated rows included)."""
    return drained(stateful.daily_totals(_stream(t, "fetch_usage"), "user_id", "created_at", "cost_usd"), ["user_id", "day"])


@query(f"WITH {_E} SELECT user_id, count(*) AS pending FROM e WHERE event_type IN (SELECT DISTINCT event_type FROM e ORDER BY 1 LIMIT 2) GROUP BY user_id")
def pending_operations(t: Tables) -> DataFrame:
    """Pending write operations per user (events of two kinds stand for them)."""
    e = _events(t)
    kinds = F.broadcast(e.select("event_type").distinct().orderBy("event_type").limit(2))  # two rows
    return e.join(kinds, "event_type", "left_semi").groupBy("user_id").agg(F.count("*").alias("pending"))


@query(
    f"""WITH {_E}, s AS (SELECT *, 200 + CAST((event_id * 37) % 400 AS INTEGER) AS status FROM e)
    SELECT CASE WHEN status BETWEEN 400 AND 499 AND status NOT IN (401, 408, 425, 429) THEN 'drop' ELSE 'retry' END AS outcome, count(*) AS n FROM s WHERE status >= 300 GROUP BY 1"""
)
def outcome_classes(t: Tables) -> DataFrame:
    """Outcome of failed operations by their status."""
    status = (F.lit(200) + (F.col("event_id") * 37) % 400).cast("int")
    return _events(t).withColumn("status", status).where("status >= 300").groupBy(X.outcome(F.col("status")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT user_id, max(event_id) AS generation, max_by(event_type, event_id) AS event_type FROM e GROUP BY user_id")
def latest_generation(t: Tables) -> DataFrame:
    """Single flight: of all jobs of a key the latest generation stands."""
    return _events(t).groupBy("user_id").agg(F.max("event_id").alias("generation"), F.max_by("event_type", "event_id").alias("event_type"))


QUERIES, SQL = query.queries, query.sql
