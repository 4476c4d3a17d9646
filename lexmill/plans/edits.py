"""Queries over appends, partial updates, filters of lists, term lines, and event streams put together again."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import html as H
from lexmill.functions import prose as P
from lexmill.functions import text as X
from lexmill.functions.arrow import column
from lexmill.operators import library, ordered
from lexmill.plans.documents import _PARSED, _page
from lexmill.plans.matching import _EDGE, _EFF, _found
from lexmill.plans.registry import Registry, Tables
from lexmill.plans.shelf import _B, _C, _G, _chapters, _terms
from lexmill.plans.usage import top_k

query = Registry()

#: Terms of a dictionary that fit a prompt.
CONTEXT_TERMS = 120


@query(
    f"""WITH {_C}, m AS (SELECT book_id, max(seq) + 1 AS base FROM c GROUP BY book_id), n AS (SELECT * FROM c WHERE trim(title_source) <> '')
    SELECT n.id AS chapter_id, m.base + row_number() OVER (PARTITION BY n.book_id ORDER BY n.seq) - 1 AS new_seq FROM n JOIN m USING (book_id)"""
)
def appended_chapters(t: Tables) -> DataFrame:
    """Every book appended to itself: new chapters are numbered on from its last one."""
    c = _chapters(t).select(F.col("id").alias("chapter_id"), "book_id", "seq", "title_source")
    base = c.groupBy("book_id").agg((F.max("seq") + 1).cast("long").alias("base"))
    return ordered.numbered(c.where(F.trim("title_source") != ""), "book_id", "seq", base).select("chapter_id", "new_seq")


@query(
    f"""WITH {_C}, p AS (SELECT *, (seq % 11) / 10.0 AS read FROM c)
    SELECT id AS chapter_id, CASE WHEN translated THEN 'translated' ELSE 'untranslated' END AS status, read >= 0.9 AS finished, read > 0.02 AND read < 0.9 AS partial FROM p WHERE lower(title_source) LIKE '%1%'"""
)
def chapter_status(t: Tables) -> DataFrame:
    """Chapters of a list by translation and reading state, with a title search."""
    read = (F.col("seq") % 11) / F.lit(10.0)
    c = _chapters(t).where(F.lower("title_source").contains("1")).withColumn("read", read)
    status = F.when(F.col("translated"), "translated").otherwise("untranslated")
    return c.select(F.col("id").alias("chapter_id"), status.alias("status"), (F.col("read") >= 0.9).alias("finished"), ((F.col("read") > 0.02) & (F.col("read") < 0.9)).alias("partial"))


@query(
    f"""WITH {_B}, {_C}, l AS (SELECT b.user_id, c.book_id, c.id AS chapter_id, c.translated_at FROM c JOIN b ON c.book_id = b.id WHERE translated)
    SELECT user_id, max_by(book_id, (translated_at, chapter_id)) AS book_id, max_by(chapter_id, (translated_at, chapter_id)) AS chapter_id FROM l WHERE translated_at IS NOT NULL GROUP BY user_id"""
)
def continue_reading(t: Tables) -> DataFrame:
    """The one book each user used last and where."""
    b = t.once("books", F.col("id").alias("book_id"), "user_id")
    last = _chapters(t).where("translated AND translated_at IS NOT NULL").join(b, "book_id")
    at = F.struct("translated_at", "id")
    return last.groupBy("user_id").agg(F.max_by("book_id", at).alias("book_id"), F.max_by("id", at).alias("chapter_id"))


@query(
    f"""WITH {_G}, p AS (SELECT id, context, tags, category, id % 3 AS k FROM g)
    SELECT id, CASE WHEN k = 0 THEN context WHEN k = 1 THEN NULL ELSE 'new' END AS context, tags FROM p"""
)
def patched_terms(t: Tables) -> DataFrame:
    """Partial update: an absent field stays, an empty one becomes null, a value replaces."""
    k = F.col("id") % 3
    has, value = k > 0, F.when(k == 1, "").otherwise("new")
    g = t.once("glossary", "id", "context", "tags")
    return g.select("id", F.when(has, F.nullif(value, F.lit(""))).otherwise(F.col("context")).alias("context"), "tags")


@query(
    f"""WITH {_C}, e AS (SELECT id, translated_at, CASE WHEN id % 5 = 0 THEN title_source || '!' ELSE title_source END AS new_title, title_source FROM c)
    SELECT id AS chapter_id, new_title AS title, CASE WHEN new_title IS DISTINCT FROM title_source THEN NULL ELSE translated_at END AS translated_at FROM e"""
)
def edited_sources(t: Tables) -> DataFrame:
    """An edit of the source takes its translation away; an equal value does not."""
    new = F.when(F.col("id") % 5 == 0, F.concat("title_source", F.lit("!"))).otherwise(F.col("title_source"))
    c = _chapters(t).withColumn("title", new)
    kept = F.when(F.col("title").eqNullSafe(F.col("title_source")), F.col("translated_at"))
    return c.select(F.col("id").alias("chapter_id"), "title", kept.alias("translated_at"))


@query(
    """WITH u AS (SELECT DISTINCT id, email, created_at FROM users), i AS (SELECT id, CASE WHEN created_at % 2 = 0 THEN email ELSE upper(email) END AS email FROM u)
    SELECT u.id, i.email, u.email IS DISTINCT FROM i.email AS changed FROM u JOIN i USING (id)"""
)
def changed_users(t: Tables) -> DataFrame:
    """Upsert only where the profile changed (null-safe comparison)."""
    u = t.once("users", "id", "email", "created_at")
    new = F.when(F.col("created_at") % 2 == 0, F.col("email")).otherwise(F.upper("email"))
    return u.select("id", new.alias("email"), (~F.col("email").eqNullSafe(new)).alias("changed"))


@query(
    """WITH f AS (SELECT DISTINCT * FROM fetch_usage WHERE host IS NOT NULL) SELECT host, count(*) AS version, max(created_at) AS updated_at, min(created_at) AS created_at FROM f GROUP BY host"""
)
def host_versions(t: Tables) -> DataFrame:
    """A record per host whose version grows with every write and whose birth stays."""
    f = t.fetch_usage.distinct().where("host IS NOT NULL")
    return f.groupBy("host").agg(F.count("*").alias("version"), F.max("created_at").alias("updated_at"), F.min("created_at").alias("created_at"))


_ORDERS = {"title": "lower(coalesce(nullif(title_target, ''), title))", "added": "created_at DESC", "size": "chapters DESC"}


@query(
    f"WITH {_B}, {_C}, n AS (SELECT book_id, count(*) AS chapters FROM c GROUP BY book_id), x AS (SELECT b.*, coalesce(n.chapters, 0) AS chapters FROM b LEFT JOIN n ON b.id = n.book_id), r AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS sort, user_id, id AS book_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at % 7 = 0 DESC, {o}, id) AS INTEGER) AS rank FROM x" for k, o in _ORDERS.items())
    + ") SELECT * FROM r WHERE rank <= 200"
)
def shelf_orders(t: Tables) -> DataFrame:
    """First page (200 books) of every user's shelf by title, age and size, pinned ones first."""
    n = _chapters(t).groupBy("book_id").agg(F.count("*").alias("n"))
    b = t.once("books", F.col("id").alias("book_id"), "user_id", "title", "title_target", "created_at").join(n, "book_id", "left")
    name = F.lower(F.coalesce(F.nullif("title_target", F.lit("")), "title"))
    x = b.select("book_id", "user_id", (F.col("created_at") % 7 == 0).alias("pinned"), name.alias("name"), "created_at", F.coalesce("n", F.lit(0)).alias("chapters"))
    orders = {"title": F.col("name"), "added": F.col("created_at").desc(), "size": F.col("chapters").desc()}
    parts = [top_k(x, "user_id", [F.col("pinned").desc(), o, F.col("book_id")], 200).select(F.lit(k).alias("sort"), "user_id", "book_id", "rank") for k, o in orders.items()]
    return reduce(DataFrame.unionAll, parts)


@query(
    f"""WITH {_EFF}, r AS (SELECT eff.book_id, eff.source, CAST(row_number() OVER (PARTITION BY eff.book_id ORDER BY g.pinned DESC, eff.source, eff.id) AS INTEGER) AS rank FROM eff JOIN g ON eff.id = g.id)
    SELECT book_id, source, rank FROM r WHERE rank <= {CONTEXT_TERMS}"""
)
def context_terms(t: Tables) -> DataFrame:
    """Terms of each book's dictionary that go along with a prompt: pinned first, at most the cap (a top-k report)."""
    e = library.effective_terms(_terms(t), t.books).select("book_id", "source", "id", "pinned")
    return top_k(e, "book_id", [F.col("pinned").desc(), F.col("source"), F.col("id")], CONTEXT_TERMS).select("book_id", "source", "rank")


@query(
    f"""WITH {_G}, x AS (SELECT id, CASE WHEN pinned THEN '★ ' ELSE '' END || source || ' = ' || target || CASE WHEN gender IN ('masculine', 'feminine') THEN ' [' || gender || ']' ELSE '' END
      || CASE WHEN trim(coalesce(context, '')) <> '' THEN ' — ' || trim(context) ELSE '' END AS line FROM g) SELECT id, line FROM x"""
)
def term_lines(t: Tables) -> DataFrame:
    """Terms as lines of a prompt: pinned ones starred, gender and note where known."""
    g = t.once("glossary", "id", "source", "target", "gender", "context", "pinned")
    sex = F.when(F.col("gender").isin("masculine", "feminine"), F.concat(F.lit(" ["), "gender", F.lit("]"))).otherwise("")
    note = F.when(F.trim(F.coalesce("context", F.lit(""))) != "", F.concat(F.lit(" — "), F.trim("context"))).otherwise("")
    return g.select("id", F.concat(F.when(F.col("pinned"), "★ ").otherwise(""), "source", F.lit(" = "), "target", sex, note).alias("line"))


@query(f"WITH {_G} SELECT id, source, regexp_matches(source, '[村城鎮鄉山峰谷嶺崖島洲灣河湖塘原]$') AS place FROM g")
def place_terms(t: Tables) -> DataFrame:
    """Whether a term names a place by its last character."""
    return t.once("glossary", "id", "source").select("id", "source", F.col("source").rlike("[村城鎮鄉山峰谷嶺崖島洲灣河湖塘原]$").alias("place"))


@query(
    """WITH c AS (SELECT DISTINCT id, length(content_source) AS s, length(content_target) AS t FROM chapters)
    SELECT id AS chapter_id, CAST(ceil(s / 2.0) AS BIGINT) AS prompt, CAST(ceil(coalesce(t, 0) / 4.0) AS BIGINT) AS completion, (s // 1000) || '.' || (s % 1000 // 100) || 'k' AS label FROM c"""
)
def token_estimates(t: Tables) -> DataFrame:
    """Token estimates where no usage is known, and a short label."""
    s, c = F.length("content_source"), F.coalesce(F.length("content_target"), F.lit(0))
    x = t.chapters.select("id", s.alias("s"), c.alias("c")).distinct()
    return x.select(F.col("id").alias("chapter_id"), F.ceil(F.col("s") / 2).alias("prompt"), F.ceil(F.col("c") / 4).alias("completion"), F.concat(F.floor(F.col("s") / 1000), F.lit("."), F.floor(F.col("s") % 1000 / 100), F.lit("k")).alias("label"))


@query(f"WITH {_C} SELECT id AS chapter_id, TRY_CAST(nullif(regexp_extract(chapter_url, '([0-9]+)[.]html$', 1), '') AS BIGINT) AS page FROM c")
def page_numbers(t: Tables) -> DataFrame:
    """Numeric ids out of addresses; null where there is none."""
    return _chapters(t).select(F.col("id").alias("chapter_id"), F.regexp_extract("chapter_url", r"([0-9]+)[.]html$", 1).try_cast("bigint").alias("page"))


@query(
    """WITH e AS (SELECT DISTINCT event_id, user_id, CAST(epoch_ms(ts) AS BIGINT) AS ms FROM events), n AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS next_ms FROM e)
    SELECT user_id, event_id FROM n WHERE next_ms IS NULL OR next_ms - ms >= 60000"""
)
def debounced_events(t: Tables) -> DataFrame:
    """Debounce: an event counts if its user is quiet for a minute after it."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    e = t.events.select("event_id", "user_id", at.alias("at")).distinct()
    key = F.col("at").cast("decimal(20,0)") * 1_000_000_000 + F.col("event_id")
    x = ordered.neighbours(e.withColumn("k", key.cast("decimal(30,0)")), "user_id", "k", "at", width=3_600_000 * 1_000_000_000)
    return x.where("next_at IS NULL OR next_at - at >= 60000").select("user_id", "event_id")


@query(
    """WITH e AS (SELECT DISTINCT event_id, user_id, event_type FROM events) SELECT user_id, event_id // 200 AS job, md5(string_agg(event_type || ' ', '' ORDER BY event_id)) AS digest FROM e GROUP BY ALL"""
)
def deltas_joined(t: Tables) -> DataFrame:
    """Deltas of a job in order, put together to its whole text."""
    e = t.events.select("event_id", "user_id", "event_type").distinct()
    parts = e.groupBy("user_id", F.floor(F.col("event_id") / 200).alias("job")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.concat("event_type", F.lit(" ")).alias("d")))).alias("p"))
    return parts.select("user_id", "job", F.md5(F.array_join(F.col("p.d"), "")).alias("digest"))


@query(
    f"""WITH {_EFF}, p AS (SELECT ch.book_id, ch.id, ch.seq, keys.key FROM ch JOIN keys USING (book_id)
      WHERE contains(t, key) AND (NOT bounded OR regexp_matches(t, '(^|{_EDGE})' || regexp_escape(key) || '($|{_EDGE})'))),
    f AS (SELECT book_id, key, min(seq) AS seq FROM p GROUP BY book_id, key) SELECT p.id AS chapter_id, p.key FROM p JOIN f ON p.book_id = f.book_id AND p.key = f.key AND p.seq = f.seq"""
)
def new_in_chapter(t: Tables) -> DataFrame:
    """Keys of each chapter no earlier chapter of the book holds."""
    place = t.chapters.select("id", "book_id", "seq").distinct()
    seen = _found(t).select("id", "key").distinct().join(place, "id")
    first = seen.groupBy("book_id", "key").agg(F.min("seq").alias("seq"))
    return seen.join(first, ["book_id", "key", "seq"], "left_semi").select(F.col("id").alias("chapter_id"), "key")


@query()
def pages_by_host_map(t: Tables) -> DataFrame:
    """Pages by the selector map of their host where one is known, else by density: (chapter_id, learned, chars)."""
    rules = '{"title":"#t","body":"#body","prev":{"sel":"","text":["前へ"]}}'
    maps = t.spark.createDataFrame([("example.org", rules)], "host string, mapping string")
    pages = _page(t).withColumn("host", F.when(F.col("id") % 2 == 0, X.host(F.col("url"))).otherwise("unknown")).join(F.broadcast(maps), "host", "left")
    f = column(lambda h, u, m: H.chapter(h, u, json.loads(m) if m else None), _PARSED)
    x = pages.select(F.col("id").alias("chapter_id"), F.col("mapping").isNotNull().alias("learned"), f("html", "url", "mapping").alias("p"))
    return x.select("chapter_id", "learned", F.length("p.content").alias("chars"))


@query()
def page_outlines(t: Tables) -> DataFrame:
    """Digest of every page for learning its selectors, and its cover."""
    kind = "struct<titles:array<string>,bodies:array<string>,links:array<string>>"
    x = _page(t).select(F.col("id").alias("chapter_id"), column(H.outline, kind)("html").alias("o"), column(H.cover, "string")("html", "url").alias("cover"))
    return x.select("chapter_id", F.size("o.titles").alias("titles"), F.size("o.bodies").alias("bodies"), F.size("o.links").alias("links"), "cover")


@query()
def salvaged_terms(t: Tables) -> DataFrame:
    """Term objects of cut-off JSON replies: what was complete comes out."""
    g = t.once("glossary", "id", "book_id", "source", "target").where("book_id IS NOT NULL")
    one = F.to_json(F.struct("source", "target"))
    replies = g.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("id", one.alias("j")))).alias("p"))
    broken = F.concat(F.lit('{"terms":['), F.array_join(F.col("p.j"), ","), F.lit(',{"source":"cut'))
    f = column(lambda s: [{"source": x.get("source"), "target": x.get("target")} for x in P.term_objects(s)], "array<struct<source:string,target:string>>")
    return replies.select("book_id", F.size("p").alias("sent"), F.size(f(broken)).alias("salvaged"))


QUERIES, SQL = query.queries, query.sql
