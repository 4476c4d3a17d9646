"""Ordered collections and scoped dictionaries: neighbours, placement, upserts, deletes, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators import ordered


def term_key() -> list[Column]:
    """What makes a glossary row unique: the book of a book term, the user and language pair of a global one."""
    book = F.col("scope") == "book"
    return [F.when(book, F.col("book_id")).otherwise(F.concat_ws("|", "user_id", "source_lang", "target_lang")).alias("owner_key"), F.col("scope"), F.col("source")]


def effective_terms(glossary: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, source, id, target, aliases, pinned, scope): a book's own terms over its user's global terms of the pair."""
    b = books.select(F.col("id").alias("book_id"), "user_id", "source_lang", "target_lang").distinct()
    keep = ["book_id", "source", "id", "target", "aliases", "pinned", "scope", "updated_at"]
    own = glossary.where("scope = 'book'").select(*keep)
    shared = glossary.where("scope = 'global'").drop("book_id").join(b, ["user_id", "source_lang", "target_lang"]).select(*keep)
    rank = [(F.col("scope") == "book").cast("int"), F.col("updated_at"), F.col("id")]
    return ordered.last_by_key(own.unionByName(shared), ["book_id", "source"], rank).drop("updated_at")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column], fixed: list[str]) -> DataFrame:
    """Existing and incoming rows by key: the last incoming row wins, but the fixed columns keep their existing value.

    Adds outcome: kept, updated or added. Keys compare null-safe, as group keys do.
    """
    new = ordered.last_by_key(incoming, keys, order)
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys]
    merged = both.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "_new").alias("last"), F.min_by(F.struct(*rest), "_new").alias("first"), F.min("_new").alias("lo"), F.max("_new").alias("hi")
    )
    value = lambda c: (F.col(f"first.{c}") if c in fixed else F.col(f"last.{c}")).alias(c)
    outcome = F.when(F.col("lo") == 1, "added").when(F.col("hi") == 1, "updated").otherwise("kept").alias("outcome")
    return merged.select(*keys, *(value(c) for c in rest), outcome)


def insert_at(rows: DataFrame, key: str, order: str, places: DataFrame) -> DataFrame:
    """rows with new_seq: one place is opened in each group at places (key, at); rows from there on move by one."""
    x = rows.join(places, key, "left")
    return x.withColumn("new_seq", F.when(F.col(order) >= F.col("at"), F.col(order) + 1).otherwise(F.col(order))).drop("at")


def reorder(rows: DataFrame, key: str, item: str, wanted: DataFrame) -> DataFrame:
    """(key, item, new_seq, valid): the dense order of wanted (key, item, pos); valid only if it names exactly the group's items."""
    both = rows.select(key, item, F.lit(1).alias("_has")).join(wanted, [key, item], "full")
    fine = both.groupBy(F.col(key).alias("_k")).agg(F.bool_and(F.col("_has").isNotNull() & F.col("pos").isNotNull()).alias("valid"))
    placed = ordered.numbered(wanted, key, "pos")
    return placed.join(fine, F.col(key) == F.col("_k")).select(key, item, F.col("new_seq").cast("long").alias("new_seq"), "valid")


def cascade(child: DataFrame, gone: DataFrame, column: str, set_null: bool = False) -> DataFrame:
    """Child rows after their parents (one column of ids) are deleted: dropped too, or with the reference set to null."""
    ids = gone.toDF(column).distinct()
    if not set_null:
        return child.join(ids, column, "left_anti")
    marked = child.join(ids.withColumn("_gone", F.lit(True)), column, "left")
    return marked.withColumn(column, F.when(F.col("_gone"), None).otherwise(F.col(column))).drop("_gone").select(*child.columns)


def imported(books: DataFrame, parts: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(books, chapters) of an import: books (book_id, title), parts (book_id, seq, ...); ids get the kind before them, chapters a dense place from 0."""
    name = lambda df: df.withColumn("book_id", F.concat(F.lit(f"{kind}-"), "book_id"))
    return name(books), name(parts)
