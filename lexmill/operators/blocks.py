"""Two sides of a key brought together in blocks of bounded size, so that no key's rows meet in one task as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.runtime import small, stage


def meet(patterns: DataFrame, texts: DataFrame, key: str, pattern_block: int, text_block: int) -> DataFrame:
    """(part, kind, id, patterns, text), partitioned by part and sorted: the patterns of a part (kind 0) precede its texts (kind 1).

    patterns: key, id and any columns; texts: key, id, text. Each block of a key's patterns meets each block of its texts once.
    """
    rest = [c for c in patterns.columns if c != key]
    patterns = stage(patterns)
    p_blocks = small(stage(patterns.groupBy(key).agg(F.ceil(F.count("*") / F.lit(pattern_block)).cast("int").alias("pn"))))
    t_blocks = small(stage(texts.groupBy(key).agg(F.ceil(F.count("*") / F.lit(text_block)).cast("int").alias("tn"))))
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    part = F.concat_ws("/", key, "pb", "tb").alias("part")
    left = patterns.join(p_blocks, key).join(t_blocks, key).groupBy(key, of("pn").alias("pb"), "tn").agg(F.collect_list(F.struct(*rest)).alias("patterns"))
    left = left.withColumn("tb", F.explode(F.expr("sequence(0, tn - 1)"))).select(part, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), "patterns", F.lit(None).cast("string").alias("text"))
    right = texts.join(p_blocks, key).join(t_blocks, key).withColumn("tb", of("tn")).withColumn("pb", F.explode(F.expr("sequence(0, pn - 1)")))
    right = right.select(part, F.lit(1).alias("kind"), F.col("id").cast("long").alias("id"), F.lit(None).cast(left.schema["patterns"].dataType).alias("patterns"), "text")
    return left.unionByName(right).repartition("part").sortWithinPartitions("part", "kind")
