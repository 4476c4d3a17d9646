"""Queries of expressions with parameters, set differences, quotas, retries, write logs, imports and term coercion."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import languages
from lexmill.functions import text as X
from lexmill.operators import dictionary, library
from lexmill.plans.matching import _EDGE, _EFF, _found
from lexmill.plans.registry import Registry, Tables
from lexmill.plans.shelf import _B, _C, _G, _chapters, _terms
from lexmill.runtime import shared_dir
from lexmill.sources import readers
from lexmill.streaming import stateful

query = Registry()


@dataclass(frozen=True)
class Limits:
    """Parameters a deployment may set; prices are per million tokens (not cached, cached, produced)."""

    prices: tuple[tuple[str, float, float, float], ...] = (("deep-lite", 0.14, 0.0028, 0.28), ("deep-max", 0.435, 0.003625, 0.87))
    default_model: str = "deep-lite"
    daily_budget: float = 5.0
    requests: int = 30
    window_ms: int = 60_000
    body_chars: int = 4_000
    evict_ms: int = 30_000
    retries: int = 4
    first_delay_ms: int = 600
    longest_delay_ms: int = 10_000

    @staticmethod
    def read(settings: dict[str, str]) -> Limits:
        """From settings as text: an empty one keeps the default, a budget of 0 switches the budget off, fewer than one request keeps the default."""
        base = Limits()
        number = lambda key, default: float(settings[key]) if settings.get(key, "").strip() else default
        requests = int(number("requests", base.requests))
        return Limits(daily_budget=number("daily_budget", base.daily_budget), requests=requests if requests >= 1 else base.requests)


LIMITS = Limits()
_PRICE_SQL = "p(model, miss, hit, made) AS (VALUES " + ", ".join(f"('{m}', {a}, {b}, {c})" for m, a, b, c in LIMITS.prices) + ")"
_AI = "a AS (SELECT DISTINCT * FROM ai_usage)"


def resolved_model(model: F.Column, limits: Limits = LIMITS) -> F.Column:
    """The model itself if it is known, else the default."""
    return F.when(model.isin(*(p[0] for p in limits.prices)), model).otherwise(F.lit(limits.default_model))


def price(model: F.Column, prompt: F.Column, cached: F.Column, completion: F.Column, limits: Limits = LIMITS) -> F.Column:
    """Cost of one call: tokens not cached, cached and produced at the prices of its model; nulls count as none."""
    at = lambda k: F.create_map(*(F.lit(x) for p in limits.prices for x in (p[0], p[k])))[resolved_model(model, limits)]
    none = lambda c: F.coalesce(c, F.lit(0))
    miss = F.greatest(F.lit(0), none(prompt) - none(cached))
    return (miss * at(1) + none(cached) * at(2) + none(completion) * at(3)) / F.lit(1e6)


@query(
    f"""WITH {_PRICE_SQL}, {_AI}, r AS (SELECT *, CASE WHEN model IN ('deep-lite', 'deep-max') THEN model ELSE 'deep-lite' END AS priced_as FROM a)
    SELECT id, priced_as, round((greatest(0, coalesce(prompt_tokens, 0) - coalesce(cached_tokens, 0)) * miss + coalesce(cached_tokens, 0) * hit + coalesce(completion_tokens, 0) * made) / 1e6, 9) AS cost
    FROM r JOIN p ON p.model = r.priced_as"""
)
def priced_calls(t: Tables) -> DataFrame:
    """Every call at the prices of its model, unknown models at those of the default."""
    a = t.ai_usage.distinct()
    cost = price(F.col("model"), F.col("prompt_tokens"), F.col("cached_tokens"), F.col("completion_tokens"))
    return a.select("id", resolved_model(F.col("model")).alias("priced_as"), F.round(cost, 9).alias("cost"))


# HTTP status of each kind of fetch error.
ERROR_STATUS = {
    "invalid_url": 400, "blocked_private": 400, "unresolvable": 400, "blocked_bot": 502, "not_found": 404, "http_error": 502, "network": 502,
    "no_api_key": 503, "unsupported_site": 422, "parse_failed": 422, "too_large": 502,
}
_KINDS = [*ERROR_STATUS, "unknown"]


@query(
    f"""WITH k AS (SELECT DISTINCT id, [{", ".join(f"'{k}'" for k in _KINDS)}][CAST(id % {len(_KINDS)} AS INTEGER) + 1] AS kind FROM fetch_usage)
    SELECT kind, CASE {" ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in ERROR_STATUS.items())} ELSE 500 END AS status, count(*) AS n FROM k GROUP BY ALL"""
)
def error_statuses(t: Tables) -> DataFrame:
    """Status codes of error kinds (a kind is dealt to every fetch by its id), 500 for a kind nobody knows."""
    kind = F.array(*map(F.lit, _KINDS))[(F.col("id") % len(_KINDS)).cast("int")]
    status = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in ERROR_STATUS.items() for x in p)), F.col("kind")), F.lit(500))
    return t.fetch_usage.select("id").distinct().select(kind.alias("kind")).select("kind", status.alias("status")).groupBy("kind", "status").agg(F.count("*").alias("n"))


@query(f"WITH {_C}, {_B} SELECT b.id AS book_id FROM b WHERE title_target IS NULL AND EXISTS (SELECT 1 FROM c WHERE c.book_id = b.id AND translated)")
def titles_to_backfill(t: Tables) -> DataFrame:
    """Books that have translated chapters but no translated title."""
    done = _chapters(t).where("translated").select("book_id")
    return t.once("books", F.col("id").alias("book_id"), "title_target").where("title_target IS NULL").select("book_id").join(done, "book_id", "left_semi")


@query("SELECT DISTINCT c.id AS chapter_id, c.uuid FROM chapters c WHERE content_target IS NULL AND id IN (SELECT chapter_id FROM ai_usage WHERE kind = 'title')")
def running_untranslated(t: Tables) -> DataFrame:
    """Of the chapters some job runs for (calls for titles stand for the jobs) those without a translation."""
    jobs = t.ai_usage.where("kind = 'title' AND chapter_id IS NOT NULL").select(F.col("chapter_id").alias("id")).distinct()
    return t.chapters.where("content_target IS NULL").select("id", "uuid").distinct().join(jobs, "id", "left_semi").withColumnRenamed("id", "chapter_id")


@query(
    """WITH t AS (SELECT DISTINCT id, chapter_id, model FROM translations), s AS (SELECT chapter_id, list_sort(list_distinct(list(model) FILTER (id % 2 = 0))) AS a, list_sort(list_distinct(list(model) FILTER (id % 2 = 1))) AS b FROM t GROUP BY chapter_id)
    SELECT chapter_id, coalesce(a, []) <> coalesce(b, []) AS changed FROM s"""
)
def membership_changes(t: Tables) -> DataFrame:
    """Whether two sets of a key differ, whatever their order: the models of a chapter's even and odd runs."""
    runs = t.once("translations", "id", "chapter_id", "model")
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("id") % 2 == k, F.col("model"))))
    return runs.groupBy("chapter_id").agg((of(0) != of(1)).alias("changed"))


@query(
    f"""WITH {_C}, s AS (SELECT id, book_id FROM c WHERE translated), v AS (SELECT id, book_id FROM c WHERE title_source LIKE '%1%')
    SELECT 'union' AS kind, book_id, count(*) AS n FROM (SELECT * FROM s UNION SELECT * FROM v) GROUP BY book_id
    UNION ALL SELECT 'difference', book_id, count(*) FROM (SELECT * FROM s EXCEPT SELECT * FROM v) GROUP BY book_id"""
)
def selections(t: Tables) -> DataFrame:
    """Select all that a search shows, and deselect it again: union with and difference from a selection."""
    c = _chapters(t)
    chosen, visible = c.where("translated").select("id", "book_id"), c.where("title_source LIKE '%1%'").select("id", "book_id")
    count = lambda df, kind: df.groupBy("book_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "book_id", "n")
    return count(chosen.unionByName(visible).distinct(), "union").unionByName(count(chosen.subtract(visible), "difference"))


@query(f"WITH {_B} SELECT id AS book_id, concat_ws('-', 'web', user_id, md5(source_url)) AS site_book_id FROM b WHERE source_url IS NOT NULL AND source_type = 'web'")
def site_book_ids(t: Tables) -> DataFrame:
    """The id of a site's book for one user: the same book of another user has another one."""
    b = t.once("books", "id", "user_id", "source_type", "source_url").where("source_url IS NOT NULL AND source_type = 'web'")
    return b.select(F.col("id").alias("book_id"), F.concat_ws("-", F.lit("web"), "user_id", F.md5("source_url")).alias("site_book_id"))


def seen_fraction(height: F.Column, top: F.Column, shown: F.Column) -> F.Column:
    """Share of a page that has been seen; 0 of a page without height."""
    return F.when(height > 0, F.least(F.lit(1.0), (top + shown) / height)).otherwise(F.lit(0.0))


@query(
    """SELECT DISTINCT id AS chapter_id, round(CASE WHEN length(content_source) > 0 THEN least(1.0, (seq * 10 + 300) / length(content_source)) ELSE 0.0 END, 9) AS seen,
      greatest(0.0, least(1.0, seq / 50.0 - 0.1)) AS progress, round((seq * 10 + 300) / 1000.0, 1) || 'k' AS label FROM chapters WHERE content_source IS NOT NULL"""
)
def seen_fractions(t: Tables) -> DataFrame:
    """How much of every chapter was seen, a progress held between 0 and 1, and a label in thousands."""
    c = t.chapters.where("content_source IS NOT NULL").select("id", "seq", F.length("content_source").alias("n")).distinct()
    at = F.col("seq") * 10 + 300
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("seq") / F.lit(50.0) - F.lit(0.1)))
    return c.select(
        F.col("id").alias("chapter_id"), F.round(seen_fraction(F.col("n"), F.col("seq") * 10, F.lit(300)), 9).alias("seen"), progress.alias("progress"),
        F.concat(F.round((at / 1000).cast("decimal(12,3)"), 1).cast("string"), F.lit("k")).alias("label"),
    ).distinct()


@query(
    f"""SELECT DISTINCT id AS chapter_id, CASE WHEN octet_length(encode(content_source)) > {LIMITS.body_chars} THEN 'too_large' END AS error,
      CASE WHEN octet_length(encode(content_source)) <= {LIMITS.body_chars} THEN md5(content_source) END AS body FROM chapters WHERE content_source IS NOT NULL"""
)
def capped_bodies(t: Tables) -> DataFrame:
    """Bodies over the size cap become error rows, the others pass."""
    small = F.octet_length("content_source") <= LIMITS.body_chars
    c = t.chapters.where("content_source IS NOT NULL")
    return c.select(F.col("id").alias("chapter_id"), F.when(~small, "too_large").alias("error"), F.when(small, F.md5("content_source")).alias("body")).distinct()


@query(
    "SELECT code, name, script, tier, rtl, CAST(row_number() OVER (ORDER BY tier, name) AS INTEGER) AS place FROM (VALUES "
    + ", ".join(f"('{c}', '{n}', '{s}', {tier}, {c in languages.RIGHT_TO_LEFT})" for c, n, s, _, _, tier in languages.LANGUAGES)
    + ") l(code, name, script, tier, rtl)"
)
def target_languages(t: Tables) -> DataFrame:
    """The languages one may translate into, by tier and name."""
    place = F.row_number().over(Window.orderBy("tier", "name"))  # a row per language
    return languages.dimension(t.spark).select("code", "name", "script", "tier", "rtl", place.alias("place"))


@query(
    f"""WITH {_AI}, c AS (SELECT DISTINCT id, length(content_source) AS chars FROM chapters), s AS (SELECT chapter_id, sum(CAST(cost_usd AS DECIMAL(18,9))) AS cost, sum(cached_tokens) AS hit, sum(prompt_tokens) AS prompt FROM a WHERE chapter_id IS NOT NULL GROUP BY chapter_id)
    SELECT chapter_id, round(CAST(cost AS DOUBLE) * 1000 / nullif(chars, 0), 9) AS cost_per_1k, round(hit / nullif(prompt, 0), 9) AS cache_rate FROM s JOIN c ON c.id = s.chapter_id"""
)
def chapter_costs(t: Tables) -> DataFrame:
    """Per chapter what a thousand characters of its source cost, and the share of prompt tokens that came from the cache."""
    c = t.chapters.select(F.col("id").alias("chapter_id"), F.length("content_source").alias("chars")).distinct()
    s = t.ai_usage.distinct().where("chapter_id IS NOT NULL").groupBy("chapter_id").agg(
        F.sum(F.col("cost_usd").cast("decimal(18,9)")).cast("double").alias("cost"), F.sum("cached_tokens").alias("hit"), F.sum("prompt_tokens").alias("prompt")
    )
    over = lambda a, b: F.round(F.try_divide(a, F.nullif(b, F.lit(0))), 9)
    return s.join(c, "chapter_id").select("chapter_id", over(F.col("cost") * 1000, F.col("chars")).alias("cost_per_1k"), over(F.col("hit"), F.col("prompt")).alias("cache_rate"))


@query(
    f"""WITH {_G}, k AS (SELECT DISTINCT book_id, source, id % 3 = 0 AS incoming FROM g WHERE scope = 'book'), i AS (SELECT DISTINCT book_id, source FROM k WHERE incoming), e AS (SELECT DISTINCT book_id, source FROM k WHERE NOT incoming)
    SELECT i.book_id, count(*) FILTER (e.source IS NULL) AS added, count(*) FILTER (e.source IS NOT NULL) AS updated FROM i LEFT JOIN e ON i.book_id = e.book_id AND i.source = e.source GROUP BY i.book_id"""
)
def merge_counts(t: Tables) -> DataFrame:
    """Terms an import would add to every book and those it would update (every third term stands for the import)."""
    k = t.once("glossary", "id", "scope", "book_id", "source").where("scope = 'book'")
    old = k.where("id % 3 <> 0").select("book_id", "source").distinct().withColumn("known", F.lit(True))
    new = k.where("id % 3 = 0").select("book_id", "source").distinct().join(old, ["book_id", "source"], "left")
    return new.groupBy("book_id").agg(F.count_if(F.col("known").isNull()).alias("added"), F.count_if("known").alias("updated"))


@query(
    f"""WITH {_AI}, n AS (SELECT max(created_at) AS now FROM a), s AS (SELECT user_id, sum(CAST(cost_usd AS DECIMAL(18,9))) FILTER (created_at // 86400000 = now // 86400000) AS spent,
      count(*) FILTER (now - created_at < {LIMITS.window_ms}) AS used, any_value(now) AS now FROM a, n WHERE user_id IS NOT NULL GROUP BY user_id)
    SELECT user_id, coalesce(CAST(spent AS DOUBLE), 0) AS daily_spent, used AS requests_used, (now // 86400000 + 1) * 86400000 AS resets_at, coalesce(spent, 0) >= {LIMITS.daily_budget} OR used >= {LIMITS.requests} AS blocked FROM s"""
)
def quota_status(t: Tables) -> DataFrame:
    """Per user the spend of the current UTC day, the calls of the sliding window, and whether either limit is reached; now is the last call of all."""
    a = t.ai_usage.distinct()
    now = F.broadcast(a.agg(F.max("created_at").alias("now")))  # one row
    day = lambda c: F.floor(F.col(c) / 86_400_000)
    spent = F.sum(F.when(day("created_at") == day("now"), F.col("cost_usd").cast("decimal(18,9)")))
    s = a.where("user_id IS NOT NULL").join(now).groupBy("user_id").agg(
        F.coalesce(spent.cast("double"), F.lit(0.0)).alias("daily_spent"), F.count_if(F.col("now") - F.col("created_at") < LIMITS.window_ms).alias("requests_used"),
        ((F.max(day("now")) + 1) * 86_400_000).alias("resets_at"),
    )
    over = (F.col("daily_spent") >= LIMITS.daily_budget) if LIMITS.daily_budget > 0 else F.lit(False)
    return s.withColumn("blocked", over | (F.col("requests_used") >= LIMITS.requests))


_STATUS = "200 + CAST((event_id * 37) % 400 AS INTEGER)"


@query(
    f"""WITH e AS (SELECT DISTINCT event_id, {_STATUS} AS status, CAST(event_id % 6 AS INTEGER) AS attempt FROM events)
    SELECT event_id, CASE WHEN (status IN (408, 409, 429) OR status >= 500) AND attempt < {LIMITS.retries} THEN least({LIMITS.longest_delay_ms}, {LIMITS.first_delay_ms} * CAST(pow(2, attempt) AS BIGINT)) END AS delay_ms FROM e"""
)
def retry_delays(t: Tables) -> DataFrame:
    """Pause before the next attempt of a failed call, without its random part; none where no further attempt is due."""
    e = t.events.select("event_id").distinct().select("event_id", (F.lit(200) + (F.col("event_id") * 37) % 400).alias("status"), (F.col("event_id") % 6).cast("int").alias("attempt"))
    again = (F.col("status").isin(408, 409, 429) | (F.col("status") >= 500)) & (F.col("attempt") < LIMITS.retries)
    delay = F.least(F.lit(LIMITS.longest_delay_ms), LIMITS.first_delay_ms * F.pow(F.lit(2), "attempt").cast("long"))
    return e.select("event_id", F.when(again, delay).alias("delay_ms"))


@query(
    f"""WITH e AS (SELECT DISTINCT event_id, user_id, event_type, epoch_us(ts) // 1000 AS moment FROM events), n AS (SELECT max(moment) AS now FROM e), j AS (SELECT user_id, max(moment) AS moment, max_by(event_type, (moment, event_id)) AS state FROM e GROUP BY user_id)
    SELECT user_id, state, j.moment + {LIMITS.evict_ms} <= now AND state <> 'view' AS evicted FROM j, n"""
)
def evicted_jobs(t: Tables) -> DataFrame:
    """Jobs by key with their last state; a finished one is dropped some time after its end (the state view stands for running)."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    e = t.events.select("event_id", "user_id", "event_type", at.alias("at")).distinct()
    now = F.broadcast(e.agg(F.max("at").alias("now")))  # one row
    j = e.groupBy("user_id").agg(F.max("at").alias("at"), F.max_by("event_type", F.struct("at", "event_id")).alias("state"))
    return j.join(now).select("user_id", "state", ((F.col("at") + LIMITS.evict_ms <= F.col("now")) & (F.col("state") != "view")).alias("evicted"))


_OPS = f"""o AS (SELECT event_id AS id, user_id, epoch_us(ts) // 1000 AS moment, CASE WHEN event_id % 7 < 5 THEN 200 ELSE {_STATUS} END AS status, CAST(event_id % 3 AS INTEGER) AS attempts FROM (SELECT DISTINCT event_id, user_id, ts FROM events))"""


@query(
    f"""WITH {_OPS}, n AS (SELECT max(moment) AS now FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment, id) AS place, attempts > 0 AND now - moment < 60000 AS waits,
      CASE WHEN status < 300 THEN 'flushed' WHEN status BETWEEN 400 AND 499 AND status NOT IN (401, 408, 425, 429) THEN 'dropped' ELSE 'pending' END AS outcome FROM o, n),
      s AS (SELECT user_id, min(place) AS stop FROM k WHERE waits OR outcome = 'pending' GROUP BY user_id)
    SELECT k.id, CASE WHEN stop IS NULL OR place < stop THEN outcome ELSE 'pending' END AS state, CAST(CASE WHEN place = stop AND NOT waits THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts FROM k LEFT JOIN s ON k.user_id = s.user_id"""
)
def write_log_flushed(t: Tables) -> DataFrame:
    """One flush of every user's write log, oldest first: done ones leave, permanent errors drop out, the first transient one or one still pausing stops it."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_id") % 7 < 5, 200).otherwise((F.lit(200) + (F.col("event_id") * 37) % 400).cast("int"))
    log = t.events.select(F.col("event_id").alias("id"), "user_id", at.alias("at"), status.alias("status"), (F.col("event_id") % 3).cast("int").alias("attempts")).distinct()
    now = log.agg(F.max("at")).first()[0] or 0  # one row
    return stateful.flushed(log, F.lit(now)).select("id", "state", "attempts")


@query(
    """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment, id) AS k FROM (SELECT DISTINCT event_id AS id, user_id, epoch_us(ts) // 1000 AS moment, value / 100.0 AS p FROM events)),
    r AS (SELECT id, user_id, k, p > 0.005 AS saved, CASE WHEN p > 0.005 THEN p ELSE 0.0 END AS last FROM e WHERE k = 1
      UNION ALL SELECT e.id, e.user_id, e.k, e.p > r.last + 0.005, CASE WHEN e.p > r.last + 0.005 THEN e.p ELSE r.last END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
    SELECT id, user_id, saved FROM r"""
)
def progress_saved(t: Tables) -> DataFrame:
    """Which progress values of a user are worth sending: the highest one must have grown."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    e = t.events.select("user_id", at.alias("at"), F.col("event_id").alias("id"), (F.col("value") / 100.0).alias("progress")).distinct()
    return stateful.throttled(e).select("id", "user_id", "saved")


@query(
    f"""WITH {_EFF}, p AS (SELECT ch.book_id, ch.id, ch.seq, keys.id AS term, key FROM ch JOIN keys USING (book_id)
      WHERE contains(t, key) AND (NOT bounded OR regexp_matches(t, '(^|{_EDGE})' || regexp_escape(key) || '($|{_EDGE})'))),
    m AS (SELECT DISTINCT book_id, id, seq, term FROM p), s AS (SELECT p.book_id, p.term, min(p.seq) AS seq FROM p JOIN g ON g.id = p.term AND g.source = p.key GROUP BY ALL)
    SELECT DISTINCT m.id AS chapter_id, m.term AS glossary_id FROM m LEFT JOIN s ON m.book_id = s.book_id AND m.term = s.term WHERE s.seq IS NULL OR s.seq >= m.seq"""
)
def new_terms_in_chapter(t: Tables) -> DataFrame:
    """Terms a chapter holds by any of their keys while no earlier chapter of the book holds their source."""
    place = t.chapters.select("id", "book_id", "seq").distinct()
    found = _found(t)
    held = found.select("id", "term").distinct().join(place, "id")
    sources = dictionary.sources_present(found, t.once("glossary", "id", "source")).join(place, "id").groupBy("book_id", "term").agg(F.min("seq").alias("first"))
    return held.join(sources, ["book_id", "term"], "left").where("first IS NULL OR first >= seq").select(F.col("id").alias("chapter_id"), F.col("term").alias("glossary_id")).distinct()


@query(
    f"""WITH {_EFF} SELECT DISTINCT ch.id AS chapter_id, keys.id AS glossary_id FROM ch JOIN keys USING (book_id) JOIN g ON g.id = keys.id AND g.source = key
    WHERE contains(t, key) AND (NOT bounded OR regexp_matches(t, '(^|{_EDGE})' || regexp_escape(key) || '($|{_EDGE})'))"""
)
def sources_present(t: Tables) -> DataFrame:
    """Terms whose own source stands in a chapter; aliases do not count."""
    found = dictionary.sources_present(_found(t), t.once("glossary", "id", "source"))
    return found.select(F.col("id").alias("chapter_id"), F.col("term").alias("glossary_id"))


# Categories and genders of terms, the most aliases of a coerced term.
CATEGORIES = ("character", "place", "organization", "technique", "item", "realm", "title", "concept", "other")
GENDERS = ("masculine", "feminine", "neuter")
MAX_ALIASES = 8


@query(
    f"""WITH {_G}, c AS (SELECT DISTINCT id, content_source AS t FROM chapters), x AS (SELECT g.*, t FROM g JOIN c ON c.id = g.first_chapter_id WHERE trim(source) <> '' AND trim(target) <> '' AND contains(t, trim(source))),
    y AS (SELECT *, CASE WHEN category IN {CATEGORIES} THEN category END AS cat, CASE WHEN json_valid(aliases) THEN json_transform(aliases, '["VARCHAR"]') END AS al FROM x)
    SELECT id, trim(source) AS source, trim(target) AS target, cat AS category, CASE WHEN cat <> 'character' THEN 'neuter' WHEN gender IN {GENDERS} THEN gender ELSE 'neuter' END AS gender,
      nullif(trim(context), '') AS context, CAST(len(list_distinct(list_filter(al, lambda a: trim(a) <> '' AND trim(a) <> trim(source) AND contains(t, trim(a))))[:{MAX_ALIASES}]) AS INTEGER) AS aliases FROM y"""
)
def coerced_terms(t: Tables) -> DataFrame:
    """Proposed terms made fit for their chapter: the source must stand in it, unknown categories go, only characters have a gender, aliases must stand in it too."""
    c = t.chapters.select(F.col("id").alias("first_chapter_id"), F.col("content_source").alias("t"))
    g = t.once("glossary", "id", "source", "target", "category", "gender", "context", "aliases", "first_chapter_id")
    source, cat = F.trim("source"), F.when(F.col("category").isin(*CATEGORIES), F.col("category"))
    fits = lambda a: (F.trim(a) != "") & (F.trim(a) != source) & F.contains(F.col("t"), F.trim(a))
    aliases = F.slice(F.array_distinct(F.filter(F.from_json("aliases", "array<string>"), fits)), 1, MAX_ALIASES)
    gender = F.when(cat != "character", "neuter").when(F.col("gender").isin(*GENDERS), F.col("gender")).otherwise("neuter")
    kept = g.join(c, "first_chapter_id").where((source != "") & (F.trim("target") != "") & F.contains(F.col("t"), source))
    out = kept.select("id", source.alias("source"), F.trim("target").alias("target"), cat.alias("category"), gender.alias("gender"), F.nullif(F.trim("context"), F.lit("")).alias("context"), F.size(aliases).alias("n"))
    return out.withColumn("aliases", F.when(F.col("n") >= 0, F.col("n"))).drop("n").distinct()


@query(
    f"""WITH {_G} SELECT DISTINCT id, regexp_replace(source, '^\\s+|\\s+$', '', 'g') AS source, regexp_replace(target, '^\\s+|\\s+$', '', 'g') AS target, coalesce(pinned, FALSE) AS pinned,
      CASE WHEN json_valid(aliases) THEN CAST(len(json_transform(aliases, '["VARCHAR"]')) AS INTEGER) END AS aliases FROM g WHERE scope = 'book' AND regexp_replace(source, '\\s', '', 'g') <> '' AND regexp_replace(target, '\\s', '', 'g') <> ''"""
)
def term_files_round_trip(t: Tables) -> DataFrame:
    """Book terms written as CSV text files and read again by their headers."""
    g = t.once("glossary", "id", "scope", "source", "target", "gender", "context", "tags", "category", "pinned", "aliases").where("scope = 'book'")
    path = f"{shared_dir(t.spark)}/terms-{uuid.uuid4().hex}"
    terms = g.withColumn("aliases", F.from_json("aliases", "array<string>"))
    readers.term_table(terms, "id").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    back = readers.term_files(t.spark, path, "id", max_rows=None)
    return back.select(F.col("id").cast("long").alias("id"), "source", "target", "pinned", F.size("aliases").alias("n")).select("id", "source", "target", "pinned", F.when(F.col("n") >= 0, F.col("n")).alias("aliases"))


@query(
    f"""WITH {_C}, {_B}, l AS (SELECT b.user_id, c.id, c.book_id, c.seq, c.chapter_url, row_number() OVER (PARTITION BY b.user_id, c.chapter_url ORDER BY c.id) AS rn FROM c JOIN b ON c.book_id = b.id WHERE c.chapter_url IS NOT NULL),
    m AS (SELECT book_id, max(seq) AS top FROM c GROUP BY book_id)
    SELECT l.id AS chapter_id, CASE WHEN rn > 1 THEN 'known' ELSE 'new' END AS outcome, CASE WHEN rn = 1 THEN m.top + 1 END AS new_seq FROM l JOIN m USING (book_id)"""
)
def ingested_pages(t: Tables) -> DataFrame:
    """Pages fetched for a user: an address the user has already is that chapter again, another one goes behind the last chapter of its book."""
    b = t.once("books", F.col("id").alias("book_id"), "user_id")
    c = _chapters(t).select("id", "book_id", "seq", "chapter_url")
    top = c.groupBy("book_id").agg((F.max("seq") + 1).alias("next"))
    pages = c.where("chapter_url IS NOT NULL").join(b, "book_id")
    first = pages.groupBy("user_id", "chapter_url").agg(F.min("id").alias("first"))
    x = pages.join(first, ["user_id", "chapter_url"]).join(top, "book_id").withColumn("new", F.col("id") == F.col("first"))
    return x.select(F.col("id").alias("chapter_id"), F.when(F.col("new"), "new").otherwise("known").alias("outcome"), F.when(F.col("new"), F.col("next")).alias("new_seq"))


@query(
    f"""WITH {_C}, {_B}, k AS (SELECT book_id, seq, title_source FROM c)
    SELECT 'txt-' || b.id AS book_id, b.title, count(*) AS chapters, min(k.seq) AS first_seq FROM k JOIN b ON k.book_id = b.id WHERE trim(b.title) <> '' GROUP BY b.id, b.title"""
)
def imported_books(t: Tables) -> DataFrame:
    """Books and their chapters as an import makes them: both tables from one set of parts, the book counted over its chapters."""
    b = t.once("books", "id", "title").where(F.trim("title") != "").select(F.col("id").alias("book_id"), "title")
    parts = _chapters(t).select("book_id", "seq", "title_source")
    books, chapters = library.imported(b, parts, "txt")
    sizes = chapters.groupBy("book_id").agg(F.count("*").alias("chapters"), F.min("seq").alias("first_seq"))
    return books.join(sizes, "book_id").select("book_id", "title", "chapters", "first_seq")


@query(
    f"""WITH {_C}, a AS (SELECT book_id, CAST(median(seq) AS BIGINT) AS moment FROM c GROUP BY book_id)
    SELECT c.id AS chapter_id, seq = moment AS one, seq <= moment AS previous, TRUE AS every FROM c JOIN a USING (book_id)"""
)
def read_scopes(t: Tables) -> DataFrame:
    """Which chapters a change of the read mark reaches: the anchor alone, all up to it, or all of the book."""
    c = _chapters(t).select(F.col("id").alias("chapter_id"), "book_id", "seq")
    at = c.groupBy("book_id").agg(F.rint(F.expr("percentile(seq, 0.5)")).cast("long").alias("at"))
    return c.join(at, "book_id").select("chapter_id", (F.col("seq") == F.col("at")).alias("one"), (F.col("seq") <= F.col("at")).alias("previous"), F.lit(True).alias("every"))


@query(
    f"""WITH {_G}, k AS (SELECT * FROM g WHERE scope = 'book'), old AS (SELECT DISTINCT book_id, source FROM k WHERE id % 2 = 0),
      n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, source ORDER BY id) AS rn FROM k WHERE id % 2 = 1) WHERE rn = 1)
    SELECT n.id, n.book_id, n.source, 'ai' AS status, n.first_chapter_id FROM n WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.book_id = n.book_id AND old.source = n.source)"""
)
def added_terms(t: Tables) -> DataFrame:
    """Extracted terms that a book does not hold yet, stamped with status and first chapter; of one source the first proposal stands."""
    g = t.once("glossary", "id", "scope", "book_id", "source", "first_chapter_id").where("scope = 'book'")
    old = g.where("id % 2 = 0").select("book_id", "source")
    new = g.where("id % 2 = 1").groupBy("book_id", "source").agg(F.min_by(F.struct("id", "first_chapter_id"), "id").alias("x"))
    return new.join(old, ["book_id", "source"], "left_anti").select("x.id", "book_id", "source", F.lit("ai").alias("status"), "x.first_chapter_id")


QUERIES, SQL = query.queries, query.sql
