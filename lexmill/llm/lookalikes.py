"""Visually identical text with different characters (problem 1).

Ignorable characters are deleted and compatibility normalization (NFKC) applied. What is left are letters of one script that
look like letters of another. A token in which scripts may be mixed is a lattice: every look-alike position holds all
characters of its class. Viterbi finds the path of highest score under character bigrams counted over the whole corpus,
plus a bonus wherever neighbours are of one script. Positions that look like nothing else cut the lattice into short runs, so
each distinct run with its neighbours is decoded once per worker.

Letter case and traditional or simplified forms stay as they are. Null stays null and empty text stays empty; a term whose
consistent form is empty matches nothing. Rows without an id are
left out, rows of one id count once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.rolling import chunks, joined
from lexmill.runtime import small, stage

# Characters that look alike, one class per word.
LATIN_CLASSES = (
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "HНΗ", "IІΙ", "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "SЅ", "TТΤ", "XХΧ", "YУΥ", "ZΖ",
    "aаα", "cсϲ", "eе", "iіι", "jј", "oоο", "pрρ", "sѕ", "uυ", "vν", "xх", "yу", "hһ", "dԁ", "qԛ", "wԝ",
)
KANA_CLASSES = ("ニ二", "ハ八", "ト卜", "ロ口", "タ夕", "カ力", "エ工", "ー一", "ヘへ", "ベべ", "ペぺ", "チ千", "オ才", "ヌ又")
#: Bigram score added where two neighbouring letters are of one script.
SAME_SCRIPT = 1.5
#: Chapters and terms of one book that meet in one task.
BLOCK_CHAPTERS = 256
BLOCK_TERMS = 4096

_CLASS = {c: cls for cls in (*LATIN_CLASSES, *KANA_CLASSES) for c in cls}
_IGNORABLE = re.compile(
    "[\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff]"
)
_FOREIGN = "".join(cls[1:] for cls in LATIN_CLASSES)
_MIXED = re.compile(rf"[^\W\d_]*[{_FOREIGN}][^\W\d_]*")
_KANA_RUN = re.compile("[" + "".join(KANA_CLASSES) + "]+")
_KANA = re.compile("[ァ-ヺー]")

Model = dict[str, float]


def plain(text: str) -> str:
    """Without ignorable characters, in compatibility composition."""
    if text.isascii():
        return text
    text = _IGNORABLE.sub("", text)
    return text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


def script(c: str) -> str:
    o = ord(c)
    if 0x30A0 <= o < 0x3100:
        return "katakana"
    if 0x3040 <= o < 0x30A0:
        return "hiragana"
    if 0x3400 <= o < 0xA000 or 0x20000 <= o < 0x32000:
        return "han"
    if 0x370 <= o < 0x400:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    return "latin" if c.isalpha() and o < 0x250 else ""


def viterbi(left: str, run: str, right: str, model: Model) -> str:
    """The best characters for run between its neighbours ("" at an edge of the text)."""

    def step(a: str, b: str) -> float:
        if not a or not b:
            return 0.0
        s = math.log(model.get(a + b, 0.0) + 0.1) - math.log(model.get(a, 0.0) + 2.0)
        return s + (SAME_SCRIPT if script(a) and script(a) == script(b) else 0.0)

    paths = {left: (0.0, "")}
    for c in run:
        nxt: dict[str, tuple[float, str]] = {}
        for rank, b in enumerate(_CLASS.get(c, c)):
            prior = 0.1 * math.log(model.get(b, 0.0) + 1.0) - 1e-9 * rank
            best = max(((s + step(a, b), p) for a, (s, p) in paths.items()), key=lambda x: (x[0], x[1]))
            nxt[b] = (best[0] + prior, best[1] + b)
        paths = nxt
    return max((s + step(a, right), p) for a, (s, p) in paths.items())[1]


class Consistent:
    """Brings texts to their one consistent form; remembers decoded runs."""

    def __init__(self, model: Model, memory: int = 200_000):
        self.model, self.memory, self.known = model, memory, {}

    def _decode(self, left: str, run: str, right: str) -> str:
        key = (left, run, right)
        out = self.known.get(key)
        if out is None:
            out = viterbi(left, run, right, self.model)
            if len(self.known) < self.memory:
                self.known[key] = out
        return out

    def __call__(self, text: str) -> str:
        text = plain(text)
        if text.isascii():
            return text
        text = _MIXED.sub(lambda m: self._decode("", m[0], ""), text)
        if _KANA.search(text):
            last = len(text)
            text = _KANA_RUN.sub(lambda m: self._decode(text[m.start() - 1] if m.start() else "", m[0], text[m.end()] if m.end() < last else ""), text)
        return text


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    member = np.zeros(0x110000, dtype=bool)
    member[[ord(c) for c in _CLASS]] = True
    member[:128] = False
    latin = np.zeros(0x110000, dtype=bool)
    latin[[ord(c) for c in _CLASS if c.isascii()]] = True
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for i, j in chunks(texts):
            c, _ = joined([plain(t) + "\n" if t else "" for t in texts[i:j]])
            a, b = c[:-1], c[1:]
            on = member[a] | member[b] | latin[a] | latin[b]
            k, n = np.unique((a[on].astype(np.int64) << 21) | b[on], return_counts=True)
            if len(k):
                yield pa.record_batch([pa.array(k), pa.array(n)], ["k", "n"])


def train(texts: DataFrame, min_share: float = 1e-6) -> Model:
    """Counts of bigrams with a look-alike character, and of their first characters.

    texts: one text column. Pairs below min_share of all counted are dropped, so at most 1 / min_share are collected.
    """
    counted = stage(texts.mapInArrow(_bigrams, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    model: Model = {}
    for k, n in counted.where(F.col("n") >= total * min_share).collect():
        a, b = chr(k >> 21), chr(k & 0x1FFFFF)
        model[a + b] = model.get(a + b, 0.0) + n
        model[a] = model.get(a, 0.0) + n
    return model


def _unified(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Consistent(model.value)
        for batch in batches:
            texts = [None if t is None else form(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(texts, pa.string())], batch.schema.names)

    return run


def consistent(df: DataFrame, text_col: str, model: Model) -> DataFrame:
    """df with text_col in its consistent form."""
    rest = [c for c in df.columns if c != text_col]
    data = df.sparkSession.sparkContext.broadcast(model)
    out = df.select(*rest, text_col)
    return out.mapInArrow(_unified(data), out.schema).select(*df.columns)


def _matches(model):
    """Rows (part, kind, id, terms, text), sorted by part and kind: the terms of a part come before its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, part, terms, find = Consistent(model.value), None, [], None
        for batch in batches:
            found_g, found_c = [], []
            for key, ident, own, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if own is not None:
                    if key != part:
                        part, terms = key, []
                    terms += [(t["id"], t["source"], form(t["source"])) for t in own]
                    find = None
                    continue
                if key != part or not terms:
                    continue
                if find is None:
                    find, by_form = ahocorasick.Automaton(), {}
                    for ident_g, raw, unified in terms:
                        if unified:
                            by_form.setdefault(unified, []).append((ident_g, raw))
                    for unified, rows in by_form.items():
                        find.add_word(unified, rows)
                    find.make_automaton()
                if not len(find):
                    continue
                seen = set()
                for _, rows in find.iter(form(text)):
                    if id(rows) not in seen:
                        seen.add(id(rows))
                        for ident_g, raw in rows:
                            if raw not in text:
                                found_g.append(ident_g)
                                found_c.append(ident)
            yield pa.record_batch([pa.array(found_g, pa.int64()), pa.array(found_c, pa.int64())], ["glossary_id", "chapter_id"])

    return run


def missed_matches(glossary: DataFrame, chapters: DataFrame, model: Model, block_chapters: int = BLOCK_CHAPTERS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(glossary_id, chapter_id): book terms a reader sees in a chapter of their book though their exact characters are not there.

    Terms and chapters of a book are dealt to blocks of bounded size; each block of terms meets each block of chapters once.
    """
    g = glossary.where("id IS NOT NULL AND scope = 'book' AND book_id IS NOT NULL AND length(source) > 0").select(F.col("id").cast("long").alias("id"), "book_id", "source").dropDuplicates(["id"])
    c = chapters.where("id IS NOT NULL AND book_id IS NOT NULL AND length(content_source) > 0").select(F.col("id").cast("long").alias("id"), "book_id", F.col("content_source").alias("text"))
    g = stage(g)
    sizes = small(stage(g.groupBy("book_id").agg(F.ceil(F.count("*") / F.lit(block_terms)).cast("int").alias("g_blocks"))))
    counts = small(stage(chapters.groupBy("book_id").agg(F.ceil(F.count("*") / F.lit(block_chapters)).cast("int").alias("c_blocks"))))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    name = lambda a, b: F.concat_ws("/", "book_id", a, b)
    left = g.join(sizes, "book_id").join(counts, "book_id").groupBy("book_id", block("g_blocks").alias("gb"), "c_blocks").agg(F.collect_list(F.struct("id", "source")).alias("terms"))
    left = left.withColumn("cb", F.explode(F.expr("sequence(0, c_blocks - 1)")))
    left = left.select(name("gb", "cb").alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), "terms", F.lit(None).cast("string").alias("text"))
    right = c.join(sizes, "book_id").join(counts, "book_id").withColumn("cb", block("c_blocks")).withColumn("gb", F.explode(F.expr("sequence(0, g_blocks - 1)")))
    right = right.select(name("gb", "cb").alias("part"), F.lit(1).alias("kind"), "id", F.lit(None).cast(left.schema["terms"].dataType).alias("terms"), "text")
    both = left.unionByName(right).repartition("part").sortWithinPartitions("part", "kind")
    data = glossary.sparkSession.sparkContext.broadcast(model)
    return both.mapInArrow(_matches(data), "glossary_id long, chapter_id long").distinct()
