"""Text cut off by field limits (problem 3).

The corpus vocabulary is a trie whose last letter is the end of the line. Tokens are words with the marks that adhere to
them, or pairs of characters where a script has no blanks; a token that goes on, in a longer word or along its line, is a
proper prefix of known words. What a story line may end with is known from all story lines inside the texts: the shape of an
end is its script, the quotations left open and the closing marks. The values' own last lines teach nothing, they may be cut.

The end of a value is where its story ends: page lines around the story are set aside. A value is cut
- by its word: its last line ends in a shape unknown as an end, and its last token is a proper prefix of known words;
- by its length: the shape is unknown and the value is as long, in characters or bytes, as many values of unknown ends of
  the same site and field; or the shape is known but the token as a rule goes on (an abbreviation), at such a length.

Null and empty values are no cases; neither are template residue and texts in a wrong encoding. Repeated rows count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.rolling import chunks, joined
from lexmill.functions.web import site
from lexmill.llm import mojibake, page_text
from lexmill.runtime import BROADCAST_ROWS, small, stage

MIN_KNOWN = 3
#: A shape is known as an end from this share of the inner story lines of its script and field on.
END_SHARE = 0.01
#: A token goes on as a rule if at most this share of its places are ends.
GOES_ON = 0.02
#: A length is a limit where at least this many values of one site and field share it, and this share of them.
LIMIT_VALUES = 5
LIMIT_SHARE = 0.01


class Trie:
    """Which of the asked tokens go on in a text: as the beginning of a longer word, or before something else on the line."""

    def __init__(self, asked: list[str]):
        pairs = {t for t in asked if len(t) == 2 and page_text._CJK.search(t)}
        self.words = {t for t in asked if not page_text._CJK.search(t)}
        self.lengths = sorted({len(t) for t in self.words})
        self.pairs = np.array(sorted(ord(t[0]) << 21 | ord(t[1]) for t in pairs), dtype=np.int64)
        self.first, self.second = np.zeros(0x110000, dtype=bool), np.zeros(0x110000, dtype=bool)
        self.first[self.pairs >> 21], self.second[self.pairs & 0x1FFFFF] = True, True
        for table in (self.first, self.second):  # every number is a nought
            table[48:58] = table[48]
        self.nought = np.arange(0x110000)
        self.nought[48:58] = 48
        self.singles = {t for t in asked if len(t) == 1 and page_text._CJK.match(t)}
        self.known: dict[str, tuple[str, ...]] = {}

    def beginnings(self, word: str) -> tuple[str, ...]:
        """The asked tokens with which a word begins."""
        got = self.known.get(word)
        if got is None:
            own = page_text.bare(word)
            got = tuple(w for n in self.lengths if n <= len(own) and (w := own[:n]) in self.words)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = got
        return got

    def count(self, texts: list[str | None]) -> Counter[str]:
        out: Counter[str] = Counter()
        words, ends = Counter(), Counter()
        for text in texts if self.words else ():
            if not text:
                continue
            lines = text.split("\n")
            if page_text._CJK.search(text):  # there tokens are pairs
                lines = [line for line in lines if not page_text._CJK.search(line)]
                text = "\n".join(lines)
            words.update(text.split())
            ends.update([own[-1] for line in lines if (own := line.rsplit(None, 1))])
        words.subtract(ends)
        for word, n in ends.items():
            for w in self.beginnings(word):  # the last word of a line only begins what is longer
                if len(w) < len(page_text.bare(word)):
                    out[w] += n
        for word, n in words.items():
            for w in self.beginnings(word) if n else ():
                out[w] += n
        if len(self.pairs):
            for i, j in chunks(texts):
                c, _ = joined([f"{t}\n" if t else "" for t in texts[i:j]])
                if len(c) > 2:
                    on = np.flatnonzero(self.first[c[:-2]])
                    on = on[self.second[c[on + 1]] & (c[on + 2] != 10)]
                    key = (self.nought[c[on]] << 21) | self.nought[c[on + 1]]
                    at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                    for k, n in zip(*np.unique(key[self.pairs[at] == key], return_counts=True), strict=True):
                        out[chr(int(k) >> 21) + chr(int(k) & 0x1FFFFF)] += int(n)
        for one in self.singles:
            out[one] += sum(len(re.findall(re.escape(one) + r"(?=[^\n])", t)) for t in texts if t and one in t)
        return out


def _going_on(asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(asked.value)
        for batch in batches:
            seen: Counter[str] = Counter()
            for k in range(batch.num_columns):
                seen.update(trie.count(batch.column(k).to_pylist()))
            if seen:
                yield pa.record_batch([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    return run


def going_on(texts: DataFrame, tokens: DataFrame, block_tokens: int = BROADCAST_ROWS) -> DataFrame:
    """(token, n): in how many places of the text columns each of the tokens goes on.

    tokens: one column token, distinct. They are looked for in blocks of about block_tokens, each a pass over the texts.
    """
    tokens = stage(tokens.select("token").distinct())
    blocks = max(1, -(-tokens.count() // block_tokens))
    parts = None
    for b in range(blocks):
        asked = [r.token for r in tokens.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == b).collect()]
        found = texts.mapInArrow(_going_on(texts.sparkSession.sparkContext.broadcast(asked)), "token string, n long")
        parts = found if parts is None else parts.unionByName(found)
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def _shape(end: Column) -> Column:
    return F.split(end, "\t", 2)[0]


def _token(end: Column) -> Column:
    return F.split(end, "\t", 2)[1]


def story_ends(lines: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, inner): the last story line of every value, and how often each end stands inside a text.

    values: chapter_id, field, site, end, n, bytes; inner: field, end, n. Lines with garbled characters teach nothing.
    lines: page_text.chapter_lines with ends; labels: page_text.labelled of them.
    """
    own = labels.select("id", F.upper("labels").alias("labels"))
    both = lines.select("id", "site", "bits", "ends", "target_ends", "n_source", "b_source", "n_target", "b_target").join(own, "id")
    at = F.when(F.col("labels").contains("S"), F.length("labels") - F.instr(F.reverse("labels"), "S")).otherwise(-1)
    both = both.withColumns({"at": at, "last": F.size("target_ends") - 1})
    sides = F.array(
        F.struct(F.lit("content_source").alias("field"), F.when(F.col("at") >= 0, F.get("ends", F.col("at"))).alias("end"), F.col("n_source").alias("n"), F.col("b_source").alias("bytes")),
        F.struct(F.lit("content_target").alias("field"), F.when(F.col("last") >= 0, F.get("target_ends", F.col("last"))).alias("end"), F.col("n_target").alias("n"), F.col("b_target").alias("bytes")),
    )
    values = both.select(F.col("id").alias("chapter_id"), "site", F.explode(sides).alias("x")).select("chapter_id", "site", "x.*").where("end IS NOT NULL")
    clean = f"bits[i] & {page_text.T_GARBLED} = 0"
    inside = F.expr(f"filter(ends, (e, i) -> i < at AND substr(labels, i + 1, 1) = 'S' AND {clean})")
    inner = both.select(F.lit("content_source").alias("field"), F.explode(inside).alias("end")).unionAll(
        both.select(F.lit("content_target").alias("field"), F.explode(F.slice("target_ends", 1, F.greatest(F.col("last"), F.lit(0)))).alias("end"))
    )
    return values, inner.groupBy("field", "end").agg(F.count("*").alias("n"))


def cut_values(chapters: DataFrame, lines: DataFrame, labels: DataFrame, min_known: int = MIN_KNOWN, end_share: float = END_SHARE) -> DataFrame:
    """(chapter_id, field, site, evidence) of values that seem cut off; lines and labels as in story_ends."""
    values, inner = (stage(x) for x in story_ends(lines, labels))
    by_shape = inner.groupBy("field", _shape(F.col("end")).alias("shape")).agg(F.sum("n").alias("n")).withColumn("script", F.left("shape", F.lit(1)))
    all_ends = by_shape.groupBy("field", "script").agg(F.sum("n").alias("every"))
    known = by_shape.join(all_ends, ["field", "script"]).where((F.col("n") >= min_known) & (F.col("n") >= F.col("every") * end_share)).select("field", "shape", F.lit(True).alias("known"))
    ends = values.withColumns({"shape": _shape(F.col("end")), "token": _token(F.col("end")), "site_key": F.coalesce("site", F.lit("")), "n_key": F.floor(F.col("n") / 4), "bytes_key": F.floor(F.col("bytes") / 4)})
    ends = stage(ends.join(small(stage(known)), ["field", "shape"], "left").withColumn("open", F.col("known").isNull()))
    every = ends.groupBy("site_key", "field").agg(F.count("*").alias("every"))
    limits = []
    for unit in ("n", "bytes"):
        same = ends.groupBy("site_key", "field", f"{unit}_key").agg(F.count("*").alias("same"), F.count_if("open").alias("n_open")).join(every, ["site_key", "field"])
        same = same.where((F.col("n_open") >= LIMIT_VALUES) & (F.col("n_open") >= F.col("every") * LIMIT_SHARE) & (F.col("n_open") * 2 > F.col("same")))
        limits.append(small(stage(same.select("site_key", "field", f"{unit}_key", F.lit(True).alias(f"{unit}_limit")))))
    x = ends.join(limits[0], ["site_key", "field", "n_key"], "left").join(limits[1], ["site_key", "field", "bytes_key"], "left")
    x = stage(x.withColumn("limit", F.coalesce("n_limit", "bytes_limit", F.lit(False))).where("open OR limit").select("chapter_id", "field", "site", "end", "token", "open", "limit"))
    trie = small(stage(going_on(chapters.select("content_source", "content_target"), x.where("token <> ''")).withColumnRenamed("n", "n_on")))
    ended = small(stage(inner.groupBy(_token(F.col("end")).alias("token")).agg(F.sum("n").alias("n_end")).join(x.select("token").distinct(), "token", "left_semi")))
    x = x.join(trie, "token", "left").join(ended, "token", "left").fillna(0, ["n_on", "n_end"])
    goes_on = F.col("n_on") >= min_known
    rarely = goes_on & (F.col("n_on") >= 10 * min_known) & (F.col("n_end") <= GOES_ON * (F.col("n_on") + F.col("n_end")))
    word = F.col("open") & goes_on
    evidence = F.when(word & F.col("limit"), "both").when(word, "word").when(F.col("limit") & (F.col("open") | rarely), "limit")
    return x.withColumn("evidence", evidence).where("evidence IS NOT NULL").select("chapter_id", "field", "site", "evidence")


def cut_fields(chapters: DataFrame, books: DataFrame, lines: DataFrame, labels: DataFrame, min_known: int = MIN_KNOWN) -> DataFrame:
    """(chapter_id, field, site, evidence) of values that were cut off, without residue and texts in a wrong encoding."""
    cut = stage(cut_values(chapters, lines, labels, min_known))
    residue = page_text.residue_content(labels).select(F.col("id").alias("chapter_id"), F.lit("content_source").alias("field"))
    fields = mojibake.library_fields(chapters, books)
    asked = cut.where("field = 'content_source'").select(F.concat_ws("\t", F.lit("chapters"), "field", "chapter_id").alias("key"))
    garbled = mojibake.found(mojibake.garbled_values(fields, stage(asked))).select(F.col("rec_id").cast("long").alias("chapter_id"), "field")
    return cut.join(garbled.unionByName(residue), ["chapter_id", "field"], "left_anti")


def cut_share(chapters: DataFrame, books: DataFrame, cut: DataFrame) -> DataFrame:
    """(site, field, n_values, n_cut, share): how often each site's values are cut; values without a site under null."""
    hosts = small(books.select(F.col("id").alias("book_id"), site(F.col("source_url")).alias("site")).dropDuplicates(["book_id"]))
    one = chapters.select("id", "book_id", (F.length("content_source") > 0).alias("s"), (F.length("content_target") > 0).alias("t")).dropDuplicates(["id"]).join(hosts, "book_id", "left")
    values = one.groupBy("site").agg(F.count_if("s").alias("content_source"), F.count_if("t").alias("content_target"))
    values = values.unpivot("site", ["content_source", "content_target"], "field", "n_values")
    n = cut.groupBy(F.col("site").alias("s"), F.col("field").alias("f")).agg(F.count("*").alias("n_cut"))
    both = values.join(n, F.col("site").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")), "left")
    n_cut = F.coalesce("n_cut", F.lit(0))
    return both.where("n_values > 0").select("site", "field", "n_values", n_cut.alias("n_cut"), F.round(n_cut / F.col("n_values"), 6).alias("share"))
