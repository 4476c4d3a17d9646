"""Matching scoped dictionaries against documents: all occurrences, word bounds, coverage-aware longest match.

Null or empty keys and texts match nothing. Rows of one id count once. Positions are code points from 0, end exclusive.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.blocks import meet

BLOCK_KEYS, BLOCK_TEXTS = 8192, 256


def keys(terms: DataFrame) -> DataFrame:
    """(book_id, key, id): every source and alias; a source owns its key before any alias, then the term first by source.

    terms: book_id, id, source, aliases (array or null).
    """
    own = terms.select("book_id", F.col("source").alias("key"), "id", "source", F.lit(0).alias("prio"))
    also = terms.select("book_id", F.explode("aliases").alias("key"), "id", "source", F.lit(1).alias("prio"))
    all_keys = own.unionByName(also).where(F.length("key") > 0)
    return all_keys.groupBy("book_id", "key").agg(F.min_by("id", F.struct("prio", "source", "id")).alias("id"))


def _word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LNM"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, own, find = None, [], None
    for batch in batches:
        out: list[tuple] = []
        for name, doc, patterns, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
            if patterns is not None:
                if name != part:
                    part, own = name, []
                own += patterns
                find = None
                continue
            if name != part or not own:
                continue
            if find is None:
                find = ahocorasick.Automaton()
                for p in own:
                    find.add_word(p["key"], p)
                find.make_automaton()
            for last, p in find.iter(text):
                start = last + 1 - len(p["key"])
                if p["bounded"] and (start and _word(text[start - 1]) or last + 1 < len(text) and _word(text[last + 1])):
                    continue
                out.append((doc, p["term"], p["key"], start, last + 1))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "term", "key", "s", "e"])


def occurrences(dictionary: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, term, key, s, e) of every occurrence, overlapping ones too.

    dictionary: book_id, key, id, bounded (whether matches need word bounds); texts: book_id, id, text.
    """
    patterns = dictionary.select("book_id", F.xxhash64("key").alias("id"), F.col("id").alias("term"), "key", "bounded")
    docs = texts.select("book_id", "id", "text").where(F.length("text") > 0).dropDuplicates(["id"])
    return meet(patterns, docs, "book_id", BLOCK_KEYS, BLOCK_TEXTS).mapInArrow(_occurrences, "id long, term long, key string, s int, e int")


def matches(found: DataFrame) -> DataFrame:
    """(id, term, first): a term stays if some occurrence of one of its keys lies inside no longer one; first is its earliest start.

    An occurrence is covered iff an earlier one in (start, longest first) order reaches at least as far.
    """
    before = Window.partitionBy("id").orderBy("s", F.col("e").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("e").over(before)
    free = found.withColumn("free", reach.isNull() | (reach < F.col("e")))
    per_key = free.groupBy("id", "term", "key").agg(F.bool_or("free").alias("free"), F.min("s").alias("s")).where("free")
    return per_key.groupBy("id", "term").agg(F.min("s").alias("first"))


def presence(found: DataFrame) -> DataFrame:
    """(id, key) of keys that occur at all."""
    return found.select("id", "key").distinct()


def sources_present(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term) of terms whose own source occurs, whatever their aliases do. terms: id, source."""
    return found.join(terms.select(F.col("id").alias("term"), F.col("source").alias("key")), ["term", "key"], "left_semi").select("id", "term").distinct()
