"""Usage reports over the ledgers (translations, ai_usage, fetch_usage)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators import ledger
from lexmill.plans.registry import Registry, Tables

query = Registry()

_OWN = "own AS (SELECT DISTINCT c.id AS chapter_id, c.book_id, b.user_id AS owner FROM chapters c JOIN (SELECT DISTINCT id, user_id FROM books) b ON c.book_id = b.id)"
_T = "t AS (SELECT DISTINCT * FROM translations)"
_A = "a AS (SELECT DISTINCT * FROM ai_usage)"
_F = "f AS (SELECT DISTINCT * FROM fetch_usage)"
_AT = (
    "att AS (SELECT a.user_id AS owner, NULL::VARCHAR AS book_id, kind, model, prompt_tokens, cached_tokens, completion_tokens, cost_usd, created_at FROM a "
    "WHERE kind <> 'map' AND chapter_id IS NULL AND user_id IS NOT NULL UNION ALL "
    "SELECT own.owner, own.book_id, kind, model, prompt_tokens, cached_tokens, completion_tokens, cost_usd, created_at FROM a JOIN own USING (chapter_id) WHERE kind <> 'map')"
)
_SUMS = (
    "count(*) AS calls, CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(18,9))), 0) AS DOUBLE) AS cost, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt, "
    "CAST(coalesce(sum(cached_tokens), 0) AS BIGINT) AS cached, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion"
)


def _own(t: Tables) -> DataFrame:
    return ledger.owners(t.chapters, t.books)


# Ledger rows delivered twice count once; only the columns reports use are read, the row's id among them.
def _runs(t: Tables) -> DataFrame:
    return t.once("translations", "id", "chapter_id", "model", "prompt_tokens", "cached_tokens", "completion_tokens", "cost_usd", "created_at")


def _calls(t: Tables) -> DataFrame:
    return t.once("ai_usage", "id", "kind", "host", "user_id", "chapter_id", "model", "prompt_tokens", "cached_tokens", "completion_tokens", "cost_usd", "created_at")


def _fetches(t: Tables) -> DataFrame:
    return t.once("fetch_usage", "id", "user_id", "chapter_id", "provider", "cost_usd", "created_at")


@query(f"WITH {_OWN}, {_T} SELECT owner, {_SUMS} FROM t JOIN own USING (chapter_id) GROUP BY owner")
def usage_body(t: Tables) -> DataFrame:
    """Translation runs per owner (two-hop ownership join)."""
    return ledger.chained(_runs(t), _own(t)).groupBy("owner").agg(*ledger.amounts())


@query(f"WITH {_OWN}, {_A}, {_AT} SELECT owner, kind, {_SUMS} FROM att GROUP BY owner, kind")
def usage_by_kind(t: Tables) -> DataFrame:
    """Pipeline calls per owner and kind: standalone rows and rows chained through a chapter."""
    return ledger.attributed(_calls(t), _own(t)).groupBy("owner", "kind").agg(*ledger.amounts())


@query(f"WITH {_A} SELECT user_id AS owner, {_SUMS} FROM a WHERE kind = 'map' AND user_id IS NOT NULL GROUP BY user_id")
def usage_map(t: Tables) -> DataFrame:
    """The map bucket: rows by the stamped user."""
    rows = _calls(t).where("kind = 'map' AND user_id IS NOT NULL")
    return rows.withColumnRenamed("user_id", "owner").groupBy("owner").agg(*ledger.amounts())


@query(f"WITH {_F} SELECT user_id AS owner, provider, count(*) AS calls, CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(18,9))), 0) AS DOUBLE) AS cost FROM f GROUP BY user_id, provider")
def usage_by_provider(t: Tables) -> DataFrame:
    """Fetches per user and provider."""
    return _fetches(t).groupBy(F.col("user_id").alias("owner"), "provider").agg(F.count("*").alias("calls"), ledger.money("cost_usd").alias("cost"))


@query(
    f"""WITH {_OWN}, {_T}, {_A}, {_F}, b AS (SELECT DISTINCT id, user_id, title, title_target FROM books),
    tb AS (SELECT book_id, sum(CAST(cost_usd AS DECIMAL(18,9))) AS c, sum(prompt_tokens) AS p, count(*) AS n FROM t JOIN own USING (chapter_id) GROUP BY book_id),
    ab AS (SELECT book_id, sum(CAST(cost_usd AS DECIMAL(18,9))) AS c, sum(prompt_tokens) AS p FROM a JOIN own USING (chapter_id) WHERE kind <> 'map' GROUP BY book_id),
    fb AS (SELECT book_id, sum(CAST(cost_usd AS DECIMAL(18,9))) AS c FROM f JOIN own USING (chapter_id) GROUP BY book_id)
    SELECT b.id AS book_id, b.user_id AS owner, coalesce(b.title_target, b.title) AS title, coalesce(tb.n, 0) AS runs,
      CAST(coalesce(tb.c, 0) + coalesce(ab.c, 0) + coalesce(fb.c, 0) AS DOUBLE) AS cost, CAST(coalesce(tb.p, 0) + coalesce(ab.p, 0) AS BIGINT) AS prompt
    FROM b LEFT JOIN tb ON b.id = tb.book_id LEFT JOIN ab ON b.id = ab.book_id LEFT JOIN fb ON b.id = fb.book_id"""
)
def usage_by_book(t: Tables) -> DataFrame:
    """Every owned book with its runs and all costs, zero where nothing was spent; sums are made before the merge."""
    own = _own(t)
    per = lambda x, *aggs: ledger.chained(x, own).groupBy("book_id").agg(*aggs)
    body = per(_runs(t), ledger.exact("cost_usd").alias("tc"), F.sum("prompt_tokens").alias("tp"), F.count("*").alias("runs"))
    ai = per(_calls(t).where("kind <> 'map'"), ledger.exact("cost_usd").alias("ac"), F.sum("prompt_tokens").alias("ap"))
    fetch = per(_fetches(t), ledger.exact("cost_usd").alias("fc"))
    b = t.books.select(F.col("id").alias("book_id"), F.col("user_id").alias("owner"), F.coalesce("title_target", "title").alias("title")).distinct()
    x = b.join(body, "book_id", "left").join(ai, "book_id", "left").join(fetch, "book_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    cost = (zero("tc") + zero("ac") + zero("fc")).cast("double").alias("cost")
    return x.select("book_id", "owner", "title", zero("runs").alias("runs"), cost, (zero("tp") + zero("ap")).cast("long").alias("prompt"))


@query(
    f"""WITH {_OWN}, {_T}, {_A}, {_AT}, m AS (SELECT owner, model, prompt_tokens, cached_tokens, completion_tokens, cost_usd FROM t JOIN own USING (chapter_id)
      UNION ALL SELECT owner, model, prompt_tokens, cached_tokens, completion_tokens, cost_usd FROM att
      UNION ALL SELECT user_id, model, prompt_tokens, cached_tokens, completion_tokens, cost_usd FROM a WHERE kind = 'map' AND chapter_id IS NULL AND user_id IS NOT NULL)
    SELECT owner, model, {_SUMS} FROM m GROUP BY owner, model"""
)
def usage_by_model(t: Tables) -> DataFrame:
    """All token-metered calls per owner and model, standalone map rows included."""
    own, ai = _own(t), _calls(t)
    columns = ["owner", "model", "prompt_tokens", "cached_tokens", "completion_tokens", "cost_usd"]
    maps = ai.where("kind = 'map' AND chapter_id IS NULL AND user_id IS NOT NULL").withColumnRenamed("user_id", "owner")
    parts = [ledger.chained(_runs(t), own), ledger.attributed(ai, own), maps]
    return reduce(DataFrame.unionAll, (p.select(*columns) for p in parts)).groupBy("owner", "model").agg(*ledger.amounts())


@query(
    f"""WITH {_OWN}, {_T}, {_A}, {_AT}, {_F}, m AS (SELECT owner, prompt_tokens p, cached_tokens ca, completion_tokens co, cost_usd c, 'body' s FROM t JOIN own USING (chapter_id)
      UNION ALL SELECT owner, prompt_tokens, cached_tokens, completion_tokens, cost_usd, 'pipeline' FROM att
      UNION ALL SELECT user_id, prompt_tokens, cached_tokens, completion_tokens, cost_usd, 'map' FROM a WHERE kind = 'map' AND user_id IS NOT NULL
      UNION ALL SELECT user_id, 0, 0, 0, cost_usd, 'fetch' FROM f),
    g AS (SELECT owner, CAST(coalesce(sum(CAST(c AS DECIMAL(18,9))), 0) AS DOUBLE) AS total_cost, count(CASE WHEN s = 'body' THEN 1 END) AS body_runs, count(CASE WHEN s IN ('pipeline', 'map') THEN 1 END) AS calls,
      count(CASE WHEN s = 'fetch' THEN 1 END) AS fetches, CAST(coalesce(sum(p), 0) AS BIGINT) AS prompt, CAST(coalesce(sum(ca), 0) AS BIGINT) AS cached, CAST(coalesce(sum(co), 0) AS BIGINT) AS completion FROM m GROUP BY owner)
    SELECT *, prompt + completion AS total_tokens, CASE WHEN prompt > 0 THEN round(cached::DOUBLE / prompt, 6) ELSE 0.0 END AS hit_rate FROM g"""
)
def usage_totals(t: Tables) -> DataFrame:
    """The all-in rollup per owner with its ratios."""
    own, ai = _own(t), _calls(t)
    columns = ["owner", "prompt_tokens", "cached_tokens", "completion_tokens", "cost_usd"]
    fetch = _fetches(t).select(F.col("user_id").alias("owner"), *(F.lit(0).alias(c) for c in columns[1:4]), "cost_usd")
    parts = {
        "body": ledger.chained(_runs(t), own), "pipeline": ledger.attributed(ai, own),
        "map": ai.where("kind = 'map' AND user_id IS NOT NULL").withColumnRenamed("user_id", "owner"), "fetch": fetch,
    }
    rows = reduce(DataFrame.unionAll, (p.select(*columns, F.lit(s).alias("s")) for s, p in parts.items()))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    g = rows.groupBy("owner").agg(
        ledger.money("cost_usd").alias("total_cost"), F.count_if(F.col("s") == "body").alias("body_runs"),
        F.count_if(F.col("s").isin("pipeline", "map")).alias("calls"), F.count_if(F.col("s") == "fetch").alias("fetches"),
        zero("prompt_tokens").alias("prompt"), zero("cached_tokens").alias("cached"), zero("completion_tokens").alias("completion"),
    )
    rate = F.when(F.col("prompt") > 0, F.round(F.col("cached") / F.col("prompt"), 6)).otherwise(F.lit(0.0))
    return g.withColumns({"total_tokens": F.col("prompt") + F.col("completion"), "hit_rate": rate})


@query(
    f"""WITH {_OWN}, {_T}, {_A}, {_F}, m AS (SELECT owner, created_at, cost_usd FROM t JOIN own USING (chapter_id)
      UNION ALL SELECT user_id, created_at, cost_usd FROM a WHERE chapter_id IS NULL AND user_id IS NOT NULL
      UNION ALL SELECT owner, created_at, cost_usd FROM a JOIN own USING (chapter_id) WHERE kind <> 'map'
      UNION ALL SELECT user_id, created_at, cost_usd FROM f)
    SELECT owner, CAST(floor(created_at / 86400000.0) AS BIGINT) AS day, CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(18,9))), 0) AS DOUBLE) AS spend FROM m WHERE created_at % 86400000 <> 0 GROUP BY ALL"""
)
def spend_by_day(t: Tables) -> DataFrame:
    """Spend per owner and UTC day; a row stamped exactly at midnight opens no day (strict lower bound)."""
    own, ai = _own(t), _calls(t)
    columns = ["owner", "created_at", "cost_usd"]
    alone = ai.where("chapter_id IS NULL AND user_id IS NOT NULL").withColumnRenamed("user_id", "owner")
    parts = [ledger.chained(_runs(t), own), alone, ledger.chained(ai.where("kind <> 'map'"), own), _fetches(t).withColumnRenamed("user_id", "owner")]
    rows = reduce(DataFrame.unionAll, (p.select(*columns) for p in parts)).where(F.pmod("created_at", F.lit(ledger.DAY_MS)) != 0)
    return rows.groupBy("owner", ledger.day(F.col("created_at")).alias("day")).agg(ledger.money("cost_usd").alias("spend"))


@query(
    f"""WITH {_T} SELECT chapter_id, count(*) AS runs, CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(18,9))), 0) AS DOUBLE) AS cost, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt,
      max_by(model, (created_at, id)) AS latest_model, max(created_at) AS latest_at, array_to_string(list_sort(list(DISTINCT model)), ',') AS models FROM t GROUP BY chapter_id"""
)
def run_history(t: Tables) -> DataFrame:
    """Per chapter the sums over its runs, the latest run and the distinct models."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return _runs(t).groupBy("chapter_id").agg(
        F.count("*").alias("runs"), ledger.money("cost_usd").alias("cost"), total("prompt_tokens").cast("long").alias("prompt"),
        F.max_by("model", F.struct("created_at", "id")).alias("latest_model"), F.max("created_at").alias("latest_at"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
    )


@query(
    f"""WITH {_A}, n AS (SELECT * FROM a WHERE NOT (prompt_tokens = 0 AND completion_tokens = 0 AND cost_usd = 0))
    SELECT coalesce(regexp_replace(lower(host), '^www\\.', ''), 'unknown') AS host, count(*) AS calls, count(DISTINCT user_id) AS users FROM n GROUP BY 1"""
)
def ledger_hosts(t: Tables) -> DataFrame:
    """Ledger rows that used anything, per host; zero-usage rows are not recorded."""
    used = _calls(t).where("NOT (prompt_tokens = 0 AND completion_tokens = 0 AND cost_usd = 0)")
    host = F.coalesce(F.regexp_replace(F.lower("host"), r"^www\.", ""), F.lit("unknown"))
    return used.groupBy(host.alias("host")).agg(F.count("*").alias("calls"), F.count_distinct("user_id").alias("users"))


@query(
    f"""WITH {_A} SELECT chapter_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt, CAST(sum(completion_tokens) AS BIGINT) AS completion,
      max_by(nullif(model, ''), (id)) AS model FROM a WHERE chapter_id IS NOT NULL GROUP BY chapter_id"""
)
def usage_added_up(t: Tables) -> DataFrame:
    """Usage as a monoid: fields add, the last non-empty model stays."""
    return _calls(t).where("chapter_id IS NOT NULL").groupBy("chapter_id").agg(
        F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"), F.max_by(F.nullif("model", F.lit("")), "id").alias("model")
    )


@query(
    f"""WITH {_OWN}, {_T}, g AS (SELECT owner, book_id, CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(18,9))), 0) AS DOUBLE) AS cost FROM t JOIN own USING (chapter_id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY cost DESC, book_id) AS rank FROM g) SELECT owner, book_id, cost, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def costliest_books(t: Tables) -> DataFrame:
    """The five costliest books of every owner, ties by id."""
    g = ledger.chained(_runs(t), _own(t)).groupBy("owner", "book_id").agg(ledger.money("cost_usd").alias("cost"))
    return top_k(g, "owner", [F.col("cost").desc(), F.col("book_id")], 5)


def top_k(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of every group with their rank: salted groups are cut to k before the group meets in one task."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(32))
    first = df.withColumn("_s", salt).withColumn("_r", F.row_number().over(Window.partitionBy(key, "_s").orderBy(*order))).where(F.col("_r") <= k).drop("_s", "_r")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


@query(
    """WITH e AS (SELECT DISTINCT event_id, user_id, CAST(epoch_ms(ts) AS BIGINT) AS ms, value FROM events)
    SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS high FROM e"""
)
def progress_high_water(t: Tables) -> DataFrame:
    """Monotonic progress: the running maximum of each user's values in time order."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = t.events.select("event_id", "user_id", ms.alias("ms"), "value").distinct()
    key = (F.col("ms") * 1).alias("ms")
    e = e.select("event_id", "user_id", key, "value").withColumn("at", F.struct("ms", "event_id"))
    return _high(e).select("event_id", "user_id", "high")


def _high(e: DataFrame) -> DataFrame:
    hour = 3_600_000
    x = e.withColumn("_b", F.floor(F.col("ms") / hour))
    tops = x.groupBy(F.col("user_id").alias("_k"), F.col("_b").alias("_kb")).agg(F.max("value").alias("_top"))
    tops = tops.select("_k", "_kb", F.max("_top").over(Window.partitionBy("_k").orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = Window.partitionBy("user_id", "_b").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    out = x.withColumn("_here", F.max("value").over(inside)).join(tops, F.col("user_id").eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    return out.withColumn("high", F.greatest("_here", "_before"))


QUERIES, SQL = query.queries, query.sql
