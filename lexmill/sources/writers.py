"""Exports: books as text, markdown or JSON, appends and keyed overwrites of parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X


#: Places of a book that go into one part of an export.
PART_PLACES = 500


def export_book(books: DataFrame, chapters: DataFrame, kind: str = "txt", places: int = PART_PLACES) -> DataFrame:
    """(book_id, name, part, body): every book as text, markdown or JSON, each chapter by its translation where there is one.

    A part holds the chapters of so many places, so that no book meets in one value; the parts of a book in order, laid end to end,
    are its file. Books without chapters give no parts.
    """
    t, c = F.coalesce("title_target", "title_source"), F.coalesce("content_target", "content_source")
    if kind == "json":
        one: Column = F.to_json(F.struct(t.alias("title"), F.col("title_source").alias("titleSource"), c.alias("content"), F.col("content_source").alias("contentSource")))
    else:
        one = F.concat(F.lit("## " if kind == "md" else ""), X.strip_tags(t), F.lit("\n\n"), X.strip_tags(c))
    between = {"json": ",", "md": "\n\n---\n\n", "txt": "\n\n\n"}[kind]
    parts = chapters.groupBy("book_id", F.floor(F.col("seq") / places).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("seq", "id", one.alias("one")))).alias("p"))
    ends = chapters.groupBy("book_id").agg(F.floor(F.min("seq") / places).cast("int").alias("first"), F.floor(F.max("seq") / places).cast("int").alias("last"))
    b = books.select(F.col("id").alias("book_id"), "title", "title_target", "author").dropDuplicates(["book_id"]).join(ends, "book_id").join(parts, "book_id")
    name, author = F.coalesce("title_target", "title"), F.nullif(F.coalesce("author", F.lit("")), F.lit(""))
    if kind == "json":
        head = F.concat(F.regexp_replace(F.to_json(F.struct("title", F.col("title_target").alias("titleTarget"), "author")), r"\}$", ""), F.lit(',"chapters":['))
    elif kind == "md":
        head = F.concat(F.lit("# "), name, F.lit("\n"), F.coalesce(F.concat(F.lit("\n_"), author, F.lit("_\n")), F.lit("")), F.lit("\n"))
    else:
        head = F.concat(name, F.lit("\n"), F.coalesce(F.concat(author, F.lit("\n")), F.lit("")), F.lit("\n"))
    before = F.when(F.col("part") == F.col("first"), head).otherwise(between)
    after = F.when(F.col("part") == F.col("last"), "]}" if kind == "json" else "\n").otherwise("")
    body = F.concat(before, F.array_join(F.col("p.one"), between), after)
    return b.select("book_id", F.concat(X.slug(name), F.lit(f".{kind}")).alias("name"), "part", body.alias("body"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def insert_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append only rows whose key the table does not hold yet; of equal keys among the new rows one goes in."""
    held = df.sparkSession.read.parquet(path).select(*keys)
    append(df.dropDuplicates(keys).join(held, keys, "left_anti"), path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
