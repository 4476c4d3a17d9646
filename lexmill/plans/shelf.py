"""Queries over the library: shelf, chapter order, scoped glossary, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.web import site
from lexmill.operators import library, ordered
from lexmill.plans.registry import Registry, Tables
from lexmill.plans.usage import top_k

query = Registry()

_C = "c AS (SELECT DISTINCT id, uuid, book_id, seq, chapter_url, title_source, title_target, content_target IS NOT NULL AS translated, translated_at FROM chapters)"
_B = "b AS (SELECT DISTINCT id, user_id, source_type, source_lang, target_lang, title, title_target, author, source_url, created_at FROM books)"
_G = "g AS (SELECT DISTINCT * FROM glossary)"


def _terms(t: Tables) -> DataFrame:
    return t.once("glossary", "id", "user_id", "scope", "book_id", "source_lang", "target_lang", "source", "target", "aliases", "pinned", "updated_at")


def _chapters(t: Tables) -> DataFrame:
    return t.chapters.select(
        "id", "uuid", "book_id", "seq", "chapter_url", "title_source", "title_target", F.col("content_target").isNotNull().alias("translated"), "translated_at"
    ).distinct()


@query(
    f"""WITH {_C}, {_B}, s AS (SELECT book_id, count(*) AS n, count(CASE WHEN translated THEN 1 END) AS done, min_by(uuid, seq) AS first_uuid, max(translated_at) AS last_at FROM c GROUP BY book_id)
    SELECT b.id AS book_id, b.user_id, coalesce(nullif(b.title_target, ''), b.title) AS title, coalesce(n, 0) AS chapters, coalesce(done, 0) AS translated, first_uuid, last_at,
      CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE round(100.0 * done / n, 2) END AS percent FROM b LEFT JOIN s ON b.id = s.book_id"""
)
def shelf(t: Tables) -> DataFrame:
    """Every book with chapter count, first chapter and share translated, empty books included."""
    s = _chapters(t).groupBy("book_id").agg(
        F.count("*").alias("n"), F.count_if("translated").alias("done"), F.min_by("uuid", "seq").alias("first_uuid"), F.max("translated_at").alias("last_at")
    )
    b = t.once("books", "id", "user_id", "title", "title_target").withColumnRenamed("id", "book_id").join(s, "book_id", "left")
    n, done = F.coalesce("n", F.lit(0)), F.coalesce("done", F.lit(0))
    percent = F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * done / n, 2))
    title = F.coalesce(F.nullif("title_target", F.lit("")), "title")
    return b.select("book_id", "user_id", title.alias("title"), n.alias("chapters"), done.alias("translated"), "first_uuid", "last_at", percent.alias("percent"))


@query(
    f"""WITH {_B} SELECT id AS book_id, title FROM b WHERE source_type IN ('web', 'epub') AND (title ILIKE '%the\\_%' ESCAPE '\\' OR contains(lower(title), 'of')
      OR contains(lower(coalesce(title_target, '')), 'of') OR contains(lower(coalesce(author, '')), 'of') OR contains(lower(coalesce(source_url, '')), 'of'))"""
)
def shelf_search(t: Tables) -> DataFrame:
    """Shelf filter: source type and a case-insensitive needle over four columns, pattern characters taken literally."""
    b = t.once("books", "id", "source_type", "title", "title_target", "author", "source_url").where(F.col("source_type").isin("web", "epub"))
    hay = [F.lower(F.coalesce(c, F.lit(""))).contains("of") for c in ("title", "title_target", "author", "source_url")]
    return b.where(F.col("title").ilike("%the\\_%") | hay[0] | hay[1] | hay[2] | hay[3]).select(F.col("id").alias("book_id"), "title")


@query(
    f"""WITH {_C} SELECT id AS chapter_id, lag(uuid) OVER w AS prev_uuid, lead(uuid) OVER w AS next_uuid, row_number() OVER w AS position, count(*) OVER (PARTITION BY book_id) AS total
    FROM c WINDOW w AS (PARTITION BY book_id ORDER BY seq)"""
)
def chapter_neighbours(t: Tables) -> DataFrame:
    """Nearest chapter before and after in spite of gaps, position and size of the book."""
    c = _chapters(t).select("id", "uuid", "book_id", "seq")
    x = ordered.positions(ordered.neighbours(c, "book_id", "seq", "uuid"), "book_id", "seq", "uuid")
    return x.select(F.col("id").alias("chapter_id"), "prev_uuid", "next_uuid", "position", "total")


@query(
    f"""WITH {_C}, u AS (SELECT book_id, chapter_url, uuid, regexp_replace(chapter_url, '[0-9]+\\.html$', '') || CAST(CAST(nullif(regexp_extract(chapter_url, '([0-9]+)\\.html$', 1), '') AS BIGINT) + 1 AS VARCHAR) || '.html' AS next_url FROM c WHERE chapter_url IS NOT NULL)
    SELECT u.uuid, n.uuid AS next_uuid FROM u LEFT JOIN u n ON u.book_id = n.book_id AND u.next_url = n.chapter_url"""
)
def url_neighbours(t: Tables) -> DataFrame:
    """Neighbour by URL within the book: the page after this one, where it is held."""
    c = _chapters(t).where("chapter_url IS NOT NULL")
    number = F.nullif(F.regexp_extract("chapter_url", r"([0-9]+)\.html$", 1), F.lit("")).cast("long")
    u = c.select("book_id", "chapter_url", "uuid", F.concat(F.regexp_replace("chapter_url", r"[0-9]+\.html$", ""), (number + 1).cast("string"), F.lit(".html")).alias("next_url"))
    n = u.select("book_id", F.col("chapter_url").alias("next_url"), F.col("uuid").alias("next_uuid"))
    return u.join(n, ["book_id", "next_url"], "left").select("uuid", "next_uuid")


@query(
    f"""WITH {_C}, r AS (SELECT book_id, max_by(seq, (translated_at, seq)) AS rs FROM c WHERE translated_at IS NOT NULL GROUP BY book_id)
    SELECT c.book_id, count(*) AS read_through FROM c JOIN r ON c.book_id = r.book_id AND c.seq <= r.rs GROUP BY c.book_id"""
)
def read_through(t: Tables) -> DataFrame:
    """Chapters up to the resume point: a self-join with an inequality, kept to one row per book on the small side."""
    c = _chapters(t).select("book_id", "seq", "translated_at")
    r = c.where("translated_at IS NOT NULL").groupBy("book_id").agg(F.max_by("seq", F.struct("translated_at", "seq")).alias("rs"))
    return c.join(r, "book_id").where("seq <= rs").groupBy("book_id").agg(F.count("*").alias("read_through"))


@query(
    f"""WITH {_C}, {_B}, m AS (SELECT book_id, max(seq) AS s, min_by(id, seq) AS first_id FROM c GROUP BY book_id)
    SELECT b.id AS book_id, coalesce(s, -1) + 1 AS next_seq, first_id FROM b LEFT JOIN m ON b.id = m.book_id"""
)
def next_places(t: Tables) -> DataFrame:
    """Where the next chapter of each book goes."""
    m = _chapters(t).groupBy("book_id").agg(F.max("seq").alias("s"), F.min_by("id", "seq").alias("first_id"))
    return t.once("books", F.col("id").alias("book_id")).join(m, "book_id", "left").select("book_id", (F.coalesce("s", F.lit(-1)) + 1).alias("next_seq"), "first_id")


@query(
    f"""WITH {_C}, p AS (SELECT book_id, CAST(median(seq) AS BIGINT) AS at FROM c GROUP BY book_id)
    SELECT c.id AS chapter_id, CASE WHEN c.seq >= p.at THEN c.seq + 1 ELSE c.seq END AS new_seq FROM c JOIN p USING (book_id)"""
)
def place_in_middle(t: Tables) -> DataFrame:
    """Insert with shift: a place opened at the middle of every book."""
    c = _chapters(t).select(F.col("id").alias("chapter_id"), "book_id", "seq")
    at = c.groupBy("book_id").agg(F.rint(F.expr("percentile(seq, 0.5)")).cast("long").alias("at"))
    return library.insert_at(c, "book_id", "seq", at).select("chapter_id", "new_seq")


@query(
    f"""WITH {_C} SELECT id AS chapter_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY seq DESC) - 1 AS BIGINT) AS new_seq, TRUE AS valid FROM c"""
)
def reordered(t: Tables) -> DataFrame:
    """Dense re-sequence by a wanted order (here the reverse one), checked against the book's chapters."""
    c = _chapters(t).select(F.col("id").alias("chapter_id"), "book_id", (-F.col("seq")).alias("pos"))
    return library.reorder(c.select("book_id", "chapter_id"), "book_id", "chapter_id", c).select("chapter_id", "new_seq", "valid")


@query(
    f"""WITH {_G}, {_B}, u AS (SELECT g.book_id, source, g.id, target, scope, updated_at FROM g WHERE scope = 'book' UNION ALL
      SELECT b.id, source, g.id, target, scope, updated_at FROM g JOIN b ON g.user_id = b.user_id AND g.source_lang = b.source_lang AND g.target_lang = b.target_lang WHERE scope = 'global'),
    r AS (SELECT *, row_number() OVER (PARTITION BY book_id, source ORDER BY scope = 'book' DESC, updated_at DESC, id DESC) AS rn FROM u) SELECT book_id, source, id, target, scope FROM r WHERE rn = 1"""
)
def effective_glossary(t: Tables) -> DataFrame:
    """Global terms of the user and pair under the book's own, one row per book and source."""
    return library.effective_terms(_terms(t), t.books).select("book_id", "source", "id", "target", "scope")


@query(
    f"""WITH {_G}, k AS (SELECT DISTINCT user_id, source_lang, target_lang, source FROM g WHERE scope = 'global')
    SELECT g.id, g.source FROM g WHERE scope = 'book' AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = g.user_id AND k.source_lang = g.source_lang AND k.target_lang = g.target_lang AND k.source = g.source)"""
)
def new_terms(t: Tables) -> DataFrame:
    """Book terms the user's global glossary does not hold (anti-join)."""
    g = t.glossary.distinct()
    keys = ["user_id", "source_lang", "target_lang", "source"]
    return g.where("scope = 'book'").join(g.where("scope = 'global'").select(*keys), keys, "left_anti").select("id", "source")


@query(f"WITH {_G}, {_C} SELECT g.id, g.source, c.seq AS first_seq FROM g LEFT JOIN c ON g.first_chapter_id = c.id")
def terms_with_first_chapter(t: Tables) -> DataFrame:
    """Terms with the place of their first chapter, if that is known."""
    c = _chapters(t).select(F.col("id").alias("first_chapter_id"), F.col("seq").alias("first_seq"))
    return t.glossary.distinct().join(c, "first_chapter_id", "left").select("id", "source", "first_seq")


@query(
    f"""WITH {_G}, m AS (SELECT id, source, target FROM g WHERE source ILIKE '%a%' OR target ILIKE '%a%'), n AS (SELECT count(*) AS total FROM m)
    SELECT id, source, target, total FROM (SELECT * FROM m ORDER BY source, id LIMIT 50 OFFSET 50) p, n"""
)
def glossary_page(t: Tables) -> DataFrame:
    """Second page of fifty of a search, with the total over the same predicate."""
    m = t.glossary.distinct().where(F.col("source").ilike("%a%") | F.col("target").ilike("%a%")).select("id", "source", "target")
    total = F.broadcast(m.agg(F.count("*").alias("total")).withColumn("one", F.lit(1)))  # one row
    page = m.orderBy("source", "id").offset(50).limit(50).withColumn("one", F.lit(1))
    return page.join(total, "one").drop("one")


@query(
    f"""WITH {_G}, k AS (SELECT *, CASE WHEN scope = 'book' THEN book_id ELSE concat_ws('|', user_id, source_lang, target_lang) END AS owner_key FROM g),
    e AS (SELECT * FROM k WHERE id % 2 = 0), i AS (SELECT * FROM k WHERE id % 2 = 1),
    e1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_key, scope, source ORDER BY updated_at DESC, id DESC) rn FROM e) WHERE rn = 1),
    i1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_key, scope, source ORDER BY updated_at DESC, id DESC) rn FROM i) WHERE rn = 1)
    SELECT coalesce(e1.owner_key, i1.owner_key) AS owner_key, coalesce(e1.scope, i1.scope) AS scope, coalesce(e1.source, i1.source) AS source, coalesce(i1.target, e1.target) AS target,
      CASE WHEN e1.source IS NULL THEN i1.first_chapter_id ELSE e1.first_chapter_id END AS first_chapter_id, coalesce(e1.created_at, i1.created_at) AS created_at, coalesce(i1.updated_at, e1.updated_at) AS updated_at,
      CASE WHEN e1.source IS NULL THEN 'added' WHEN i1.source IS NULL THEN 'kept' ELSE 'updated' END AS outcome
    FROM e1 FULL JOIN i1 ON e1.owner_key = i1.owner_key AND e1.scope = i1.scope AND e1.source = i1.source"""
)
def glossary_merge(t: Tables) -> DataFrame:
    """Upsert of every other term (odd ids) into the rest: last wins, created_at and the first chapter stay."""
    g = t.glossary.distinct().select(*library.term_key(), "target", "first_chapter_id", "created_at", "updated_at", "id")
    keys, order = ["owner_key", "scope", "source"], [F.col("updated_at"), F.col("id")]
    old = ordered.last_by_key(g.where("id % 2 = 0"), keys, order)
    return library.upsert(old, g.where("id % 2 = 1"), keys, order, ["created_at", "first_chapter_id"]).drop("id")


@query(
    f"""WITH {_G}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, source ORDER BY id) AS rn FROM g) SELECT user_id, source, id, target FROM r WHERE rn = 1"""
)
def first_terms(t: Tables) -> DataFrame:
    """First-wins dedupe by key."""
    g = t.glossary.distinct().select("user_id", "source", "id", "target")
    return ordered.last_by_key(g, ["user_id", "source"], [F.col("id")], first=True)


@query(
    f"""WITH {_G}, {_C}, d AS (SELECT min_by(id, seq) AS gone FROM c GROUP BY book_id)
    SELECT 'chapters' AS tbl, count(*) AS n FROM c WHERE id NOT IN (SELECT gone FROM d)
    UNION ALL SELECT 'translations', count(*) FROM (SELECT DISTINCT * FROM translations) t WHERE chapter_id NOT IN (SELECT gone FROM d)
    UNION ALL SELECT 'glossary_linked', count(*) FROM g WHERE first_chapter_id IS NOT NULL AND first_chapter_id NOT IN (SELECT gone FROM d)
    UNION ALL SELECT 'glossary', count(*) FROM g"""
)
def delete_first_chapters(t: Tables) -> DataFrame:
    """Delete with cascade and set-null: what is left after each book's first chapter goes."""
    c = _chapters(t)
    gone = c.groupBy("book_id").agg(F.min_by("id", "seq").alias("id")).select("id")
    left = library.cascade(t.glossary.distinct(), gone, "first_chapter_id", set_null=True)
    parts = {
        "chapters": library.cascade(c, gone, "id"), "translations": library.cascade(t.translations.distinct(), gone, "chapter_id"),
        "glossary_linked": left.where("first_chapter_id IS NOT NULL"), "glossary": left,
    }
    rows = [p.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, p in parts.items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


@query(
    f"""WITH {_C}, r AS (SELECT book_id, max(seq) FILTER (WHERE translated) AS upto FROM c GROUP BY book_id)
    SELECT c.id AS chapter_id, CASE WHEN c.seq < r.upto THEN 1.0 ELSE 0.0 END AS read_progress FROM c JOIN r USING (book_id)"""
)
def mark_read(t: Tables) -> DataFrame:
    """Bulk update: everything before the last translated chapter counts as read, the rest as unread."""
    c = _chapters(t).select("id", "book_id", "seq", "translated")
    r = c.groupBy("book_id").agg(F.max(F.when(F.col("translated"), F.col("seq"))).alias("upto"))
    return c.join(r, "book_id").select(F.col("id").alias("chapter_id"), F.when(F.col("seq") < F.col("upto"), 1.0).otherwise(0.0).alias("read_progress"))


@query(
    f"""WITH {_C}, k AS (SELECT id, uuid, translated_at, seq FROM c WHERE translated), f AS (SELECT id, uuid, translated_at + 1 AS translated_at, seq FROM c WHERE seq % 3 = 0)
    SELECT id, uuid, translated_at FROM f UNION ALL SELECT id, uuid, translated_at FROM k WHERE id NOT IN (SELECT id FROM f)"""
)
def read_through_cache(t: Tables) -> DataFrame:
    """Cached rows under fresh ones: replaced by id, none lost, none twice."""
    c = _chapters(t).select("id", "uuid", "translated_at", "translated", "seq")
    cached, fresh = c.where("translated"), c.where("seq % 3 = 0").withColumn("translated_at", F.col("translated_at") + 1)
    both = cached.withColumn("fresh", F.lit(0)).unionByName(fresh.withColumn("fresh", F.lit(1)))
    return ordered.last_by_key(both, ["id"], [F.col("fresh")]).select("id", "uuid", "translated_at")


@query(
    f"""WITH {_B}, {_C}, m AS (SELECT b.user_id, c.book_id, max(c.translated_at) AS used_at FROM c JOIN b ON c.book_id = b.id WHERE translated GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY used_at DESC, book_id) AS INTEGER) AS rank FROM m) SELECT user_id, book_id, used_at, rank FROM r WHERE rank <= 5"""
)
def recent_books(t: Tables) -> DataFrame:
    """Most recently used books per user, five at most."""
    b = t.once("books", F.col("id").alias("book_id"), "user_id")
    m = _chapters(t).where("translated").join(b, "book_id").groupBy("user_id", "book_id").agg(F.max("translated_at").alias("used_at"))
    return top_k(m, "user_id", [F.col("used_at").desc_nulls_last(), F.col("book_id")], 5)


@query(
    """WITH s AS (SELECT regexp_replace(regexp_extract(lower(trim(source_url)), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '^www\\.', '') AS site, id, source_lang FROM (SELECT DISTINCT id, source_url, source_lang FROM books))
    SELECT nullif(site, '') AS site, count(*) AS books, count(DISTINCT source_lang) AS languages FROM s GROUP BY 1"""
)
def sites(t: Tables) -> DataFrame:
    """Books and languages per site; books without a site together under null."""
    b = t.once("books", "id", "source_url", "source_lang")
    return b.groupBy(site(F.coalesce("source_url", F.lit(""))).alias("site")).agg(F.count("*").alias("books"), F.count_distinct("source_lang").alias("languages"))


@query(
    f"""WITH {_G}, x AS (SELECT id, list_distinct(list_filter(list_transform(coalesce(TRY_CAST(aliases AS VARCHAR[]), []), lambda a: trim(a)), lambda a: a <> '')) AS l FROM (SELECT id, CASE WHEN json_valid(aliases) THEN json_transform(aliases, '["VARCHAR"]') END AS aliases FROM g))
    SELECT id, len(l) AS n_aliases, array_to_string(list_sort(l), '|') AS aliases FROM x"""
)
def term_aliases(t: Tables) -> DataFrame:
    """Aliases out of their JSON text: trimmed, none empty, none twice; malformed text gives none."""
    parsed = F.coalesce(F.from_json("aliases", "array<string>"), F.array().cast("array<string>"))
    own = F.array_distinct(F.filter(F.transform(parsed, F.trim), lambda a: a != ""))
    return t.glossary.distinct().select("id", F.size(own).cast("long").alias("n_aliases"), F.array_join(F.array_sort(own), "|").alias("aliases"))


@query(
    f"""WITH {_C}, {_B}, x AS (SELECT b.id, list_sort(list(c.id)) AS a, list_sort(list(c.id) FILTER (WHERE translated)) AS d FROM b JOIN c ON c.book_id = b.id GROUP BY b.id)
    SELECT id AS book_id, coalesce(a = d, FALSE) AS complete FROM x"""
)
def books_complete(t: Tables) -> DataFrame:
    """Set equality: is every chapter of the book among the translated ones?"""
    c = _chapters(t).join(t.once("books", F.col("id").alias("book_id")), "book_id", "left_semi")
    return c.groupBy("book_id").agg(F.bool_and("translated").alias("complete"))


QUERIES, SQL = query.queries, query.sql
