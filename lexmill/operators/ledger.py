"""Usage ledgers: who owns a row, and sums per owner, book, kind, model, provider and day.

A row tied to a chapter belongs to the owner of the chapter's book whatever user it is stamped with; a row without a chapter
belongs to its user, or to nobody. The two branches are disjoint, so they are joined and united instead of one outer join
with a disjunction. Ledgers are never joined to each other: each is summed on its own and the sums are merged by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def owners(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(chapter_id, book_id, owner) of every chapter."""
    own = books.select(F.col("id").alias("book_id"), F.col("user_id").alias("owner")).distinct()
    return chapters.select(F.col("id").alias("chapter_id"), "book_id").distinct().join(own, "book_id")


def chained(ledger: DataFrame, own: DataFrame) -> DataFrame:
    """Rows tied to a chapter, with the owner of its book; rows of unknown chapters drop out."""
    return ledger.drop("user_id").where(F.col("chapter_id").isNotNull()).join(own, "chapter_id")


def attributed(ai: DataFrame, own: DataFrame) -> DataFrame:
    """ai_usage rows with owner and book_id (null for standalone rows); map rows are left to their own bucket."""
    ai = ai.where("kind <> 'map'")
    alone = ai.where("chapter_id IS NULL AND user_id IS NOT NULL").withColumnRenamed("user_id", "owner").withColumn("book_id", F.lit(None).cast("string"))
    return alone.unionByName(chained(ai, own))


def exact(column: str) -> Column:
    """Sum of money as decimal, so the order of additions cannot show; null over no rows."""
    return F.sum(F.col(column).cast("decimal(18,9)"))


def money(column: str) -> Column:
    return F.coalesce(exact(column), F.lit(0)).cast("double")


def amounts(*more: Column) -> list[Column]:
    """The sums every report shows, nulls as zero."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return [
        F.count("*").alias("calls"), money("cost_usd").alias("cost"), total("prompt_tokens").cast("long").alias("prompt"),
        total("cached_tokens").cast("long").alias("cached"), total("completion_tokens").cast("long").alias("completion"), *more,
    ]


def day(c: Column) -> Column:
    """UTC day number of epoch milliseconds."""
    return F.floor(c / F.lit(DAY_MS)).cast("long")
