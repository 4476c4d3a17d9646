"""Dictionary queries: effective glossary of each book against its chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import languages
from lexmill.operators import dictionary, library
from lexmill.plans.registry import Registry, Tables
from lexmill.plans.shelf import _B, _G, _terms

query = Registry()

_EFF = f"""{_G}, {_B}, u AS (SELECT g.book_id, source, g.id, aliases, scope, updated_at FROM g WHERE scope = 'book' UNION ALL
  SELECT b.id, source, g.id, aliases, scope, updated_at FROM g JOIN b ON g.user_id = b.user_id AND g.source_lang = b.source_lang AND g.target_lang = b.target_lang WHERE scope = 'global'),
  eff AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, source ORDER BY scope = 'book' DESC, updated_at DESC, id DESC) AS rn FROM u) WHERE rn = 1),
  kk AS (SELECT book_id, source AS key, id, source, 0 AS prio FROM eff UNION ALL SELECT book_id, unnest(CASE WHEN json_valid(aliases) THEN json_transform(aliases, '["VARCHAR"]') END), id, source, 1 FROM eff),
  keys AS (SELECT book_id, key, min_by(id, (prio, source, id)) AS id FROM kk WHERE length(key) > 0 GROUP BY book_id, key),
  ch AS (SELECT DISTINCT c.id, c.book_id, c.seq, c.content_source AS t, b.source_lang IN ('en', 'ko') AS bounded FROM chapters c JOIN b ON c.book_id = b.id)"""
_EDGE = "[^\\p{L}\\p{N}\\p{M}]"


def _dictionary(t: Tables) -> DataFrame:
    terms = library.effective_terms(_terms(t), t.books).withColumn("aliases", F.from_json("aliases", "array<string>"))
    bounded = t.once("books", F.col("id").alias("book_id"), "source_lang").select("book_id", languages.delimited(F.col("source_lang")).alias("bounded"))
    return dictionary.keys(terms).join(bounded, "book_id")


def _found(t: Tables) -> DataFrame:
    return dictionary.occurrences(_dictionary(t), t.chapters.select("book_id", "id", F.col("content_source").alias("text")))


@query(f"WITH {_EFF} SELECT book_id, key, id FROM keys")
def dictionary_keys(t: Tables) -> DataFrame:
    """Keys of every book's dictionary: sources, and aliases nothing claims before."""
    return _dictionary(t).select("book_id", "key", "id")


@query(
    f"""WITH {_EFF} SELECT ch.id AS chapter_id, keys.key FROM ch JOIN keys USING (book_id)
    WHERE contains(t, key) AND (NOT bounded OR regexp_matches(t, '(^|{_EDGE})' || regexp_escape(key) || '($|{_EDGE})'))"""
)
def keys_present(t: Tables) -> DataFrame:
    """Keys present in every chapter, at word bounds where the language has words."""
    return dictionary.presence(_found(t)).withColumnRenamed("id", "chapter_id")


@query(
    f"""WITH {_EFF}, o AS (SELECT ch.id, keys.id AS term, key, t, bounded, unnest(list_filter(range(1, length(t) - length(key) + 2), lambda i: t[i:i + length(key) - 1] = key)) AS s FROM ch JOIN keys USING (book_id) WHERE contains(t, key)),
    w AS (SELECT id, term, key, s, s + length(key) AS e FROM o WHERE NOT bounded OR ((s = 1 OR regexp_matches(t[s - 1:s - 1], '^{_EDGE}')) AND (s + length(key) > length(t) OR regexp_matches(t[s + length(key):s + length(key)], '^{_EDGE}')))),
    c AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM w),
    k AS (SELECT id, term, key, bool_or(m IS NULL OR m < e) AS free, min(s) AS s FROM c GROUP BY id, term, key)
    SELECT id AS chapter_id, term AS glossary_id, CAST(min(s) - 1 AS INTEGER) AS first FROM k WHERE free GROUP BY id, term"""
)
def dictionary_matches(t: Tables) -> DataFrame:
    """Terms of every chapter by the longest-match rule, with the place where each first stands."""
    return dictionary.matches(_found(t)).select(F.col("id").alias("chapter_id"), F.col("term").alias("glossary_id"), "first")


@query(
    f"""WITH {_EFF}, p AS (SELECT ch.book_id, ch.id, ch.seq, keys.key FROM ch JOIN keys USING (book_id)
      WHERE contains(t, key) AND (NOT bounded OR regexp_matches(t, '(^|{_EDGE})' || regexp_escape(key) || '($|{_EDGE})')))
    SELECT book_id, key, min(seq) AS first_seq FROM p GROUP BY book_id, key"""
)
def first_seen(t: Tables) -> DataFrame:
    """Where each key of a book is new: the first chapter that holds it."""
    place = t.chapters.select("id", "book_id", "seq").distinct()
    return dictionary.presence(_found(t)).join(place, "id").groupBy("book_id", "key").agg(F.min("seq").alias("first_seq"))


QUERIES, SQL = query.queries, query.sql
