"""Queries over document sources and sinks: exports, plain text, archives, pages, encodings, term tables, event logs."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import html as H
from lexmill.functions.arrow import column
from lexmill.plans.registry import Registry, Tables
from lexmill.sources import readers, writers

query = Registry()

_C = "c AS (SELECT DISTINCT id, book_id, seq, title_source, title_target, content_source, content_target FROM chapters)"
_B = "b AS (SELECT DISTINCT id, title, title_target, author FROM books)"
_EDGE = "[\\s\\x0b\\p{Z}\\x{feff}]+"
_LINES = f"list_filter(list_transform(string_split(content_source, chr(10)), lambda x: regexp_replace(x, '^{_EDGE}|{_EDGE}$', '', 'g')), lambda x: x <> '')"


def _chapters(t: Tables) -> DataFrame:
    return t.chapters.select("id", "book_id", "seq", "title_source", "title_target", "content_source", "content_target").dropDuplicates(["id"])


_ENDS = "e AS (SELECT book_id, min(seq // 500) AS first, max(seq // 500) AS last FROM c GROUP BY book_id)"
_PART = "regexp_replace(coalesce(title_target, title_source), '<[^>]+>', '', 'g') || chr(10) || chr(10) || regexp_replace(coalesce(content_target, content_source), '<[^>]+>', '', 'g')"
_NAME = "coalesce(b.title_target, b.title)"


@query(
    f"""WITH {_C}, {_B}, {_ENDS}, p AS (SELECT book_id, seq // 500 AS part, string_agg({_PART}, chr(10) || chr(10) || chr(10) ORDER BY seq, id) AS body FROM c GROUP BY ALL)
    SELECT b.id AS book_id, CAST(p.part AS INTEGER) AS part, md5(CASE WHEN part = first THEN {_NAME} || chr(10) || CASE WHEN coalesce(author, '') <> '' THEN author || chr(10) ELSE '' END || chr(10) ELSE chr(10) || chr(10) || chr(10) END
      || p.body || CASE WHEN part = last THEN chr(10) ELSE '' END) AS digest FROM b JOIN p ON b.id = p.book_id JOIN e ON e.book_id = b.id"""
)
def export_txt(t: Tables) -> DataFrame:
    """Books as plain text in parts, by digest."""
    return writers.export_book(t.books, _chapters(t)).select("book_id", "part", F.md5("body").alias("digest"))


@query(
    f"""WITH {_C}, {_B}, {_ENDS}, p AS (SELECT book_id, seq // 500 AS part, string_agg('## ' || {_PART}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY seq, id) AS body FROM c GROUP BY ALL)
    SELECT b.id AS book_id, CAST(p.part AS INTEGER) AS part, md5(CASE WHEN part = first THEN '# ' || {_NAME} || chr(10) || CASE WHEN coalesce(author, '') <> '' THEN chr(10) || '_' || author || '_' || chr(10) ELSE '' END || chr(10)
      ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) END || p.body || CASE WHEN part = last THEN chr(10) ELSE '' END) AS digest FROM b JOIN p ON b.id = p.book_id JOIN e ON e.book_id = b.id"""
)
def export_md(t: Tables) -> DataFrame:
    """Books as markdown in parts, by digest."""
    return writers.export_book(t.books, _chapters(t), "md").select("book_id", "part", F.md5("body").alias("digest"))


@query(
    f"""WITH {_C}, {_B} SELECT book_id, b.title, CAST(row_number() OVER (PARTITION BY book_id ORDER BY seq, c.id) - 1 AS INTEGER) AS idx, coalesce(c.title_target, title_source) AS chapter, md5(coalesce(content_target, content_source)) AS digest
    FROM c JOIN b ON c.book_id = b.id"""
)
def export_json(t: Tables) -> DataFrame:
    """Books as JSON in parts, the parts laid end to end and read back."""
    j = writers.export_book(t.books, _chapters(t), "json").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("part", "body"))).alias("p"))
    back = F.from_json(F.array_join(F.col("p.body"), ""), "struct<title:string,chapters:array<struct<title:string,content:string>>>")
    x = j.select("book_id", back.alias("j")).select("book_id", F.col("j.title").alias("title"), F.posexplode("j.chapters").alias("idx", "c"))
    return x.select("book_id", "title", "idx", F.col("c.title").alias("chapter"), F.md5("c.content").alias("digest"))


@query(
    f"""WITH {_C}, n AS (SELECT book_id, seq // 50 AS volume, content_source, row_number() OVER (PARTITION BY book_id, seq // 50 ORDER BY seq) AS k FROM c)
    SELECT book_id, volume, CAST(k - 1 AS INTEGER) AS idx, 'Chapter ' || k AS title, md5(array_to_string({_LINES}, chr(10) || chr(10))) AS digest FROM n WHERE len({_LINES}) > 0"""
)
def text_split(t: Tables) -> DataFrame:
    """Plain-text volumes of fifty places of every book under numbered headings, split again."""
    parts = _chapters(t).groupBy("book_id", F.floor(F.col("seq") / 50).cast("int").alias("volume")).agg(F.array_sort(F.collect_list(F.struct("seq", "content_source"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x, k: F.concat(F.lit("Chapter "), (k + 1).cast("string"), F.lit("\n"), x["content_source"])), "\n")
    x = parts.select("book_id", "volume", F.posexplode(readers.split_text(text, F.col("book_id"))).alias("idx", "c"))
    return x.select("book_id", "volume", "idx", F.col("c.title").alias("title"), F.md5("c.content").alias("digest"))


def _archive(book: str, titles: list[str], texts: list[str]) -> bytes:
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{k}" href="c{k}.xhtml"/>' for k in range(len(titles)))
        z.writestr("OEBPS/content.opf", f"<package><metadata><dc:title>{esc(book)}</dc:title></metadata><manifest>{items}</manifest><spine>" + "".join(f'<itemref idref="c{k}"/>' for k in range(len(titles))) + "</spine></package>")
        for k, (a, b) in enumerate(zip(titles, texts, strict=True)):
            z.writestr(f"OEBPS/c{k}.xhtml", f"<html><body><h1>{esc(a)}</h1>" + "".join(f"<p>{esc(x)}</p>" for x in b.split("\n")) + "</body></html>")
    return out.getvalue()


@query(
    f"""WITH {_C}, n AS (SELECT book_id, seq // 50 AS volume, content_source, row_number() OVER (PARTITION BY book_id, seq // 50 ORDER BY seq) AS k FROM c)
    SELECT book_id, volume, CAST(k - 1 AS INTEGER) AS idx, 'Part ' || k AS title, md5(array_to_string(list_prepend('Part ' || k, {_LINES}), chr(10) || chr(10))) AS digest FROM n"""
)
def archive_chapters(t: Tables) -> DataFrame:
    """EPUB archives of volumes of fifty places of every book, read in spine order."""
    parts = _chapters(t).groupBy("book_id", F.floor(F.col("seq") / 50).cast("int").alias("volume")).agg(F.array_sort(F.collect_list(F.struct("seq", "content_source"))).alias("p"))
    names = F.transform("p", lambda x, k: F.concat(F.lit("Part "), (k + 1).cast("string")))
    build = column(lambda b, names, texts: _archive(b, list(names), list(texts)), "binary")
    archives = parts.select(F.concat_ws("|", "book_id", "volume").alias("path"), build(F.col("book_id"), names, F.col("p.content_source")).alias("content"))
    rows = readers.epub_chapters(archives)
    at = F.split("path", "\\|")
    return rows.select(at[0].alias("book_id"), at[1].cast("int").alias("volume"), "idx", F.col("title_source").alias("title"), F.md5("content_source").alias("digest"))


def _page(t: Tables) -> DataFrame:
    """Chapter pages around the stored texts: header, menu, article and footer."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    paras = F.array_join(F.transform(F.split("content_source", "\n"), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))), "")
    c = _chapters(t)
    html = F.concat(
        F.lit('<html><head><title>x</title><link rel="next" href="/n/'), (F.col("id") + 1).cast("string"), F.lit('"></head><body><nav><a href="/">Home</a></nav><div class="menu"><a href="/a">A</a> <a href="/b">B</a></div><h1 id="t">'),
        esc(F.col("title_source")), F.lit('</h1><div id="body">'), paras, F.lit('</div><footer>(c) site</footer></body></html>'),
    )
    return c.select("id", F.concat(F.lit("https://example.org/n/"), "id").alias("url"), html.alias("html"))


_PARSED = "struct<title:string,content:string,prev_url:string,next_url:string,index_url:string,book_title:string>"


@query()
def pages_parsed(t: Tables) -> DataFrame:
    """Pages by a selector map: (chapter_id, title, chars, next_url), nulls where no real chapter comes out."""
    rules = {"title": "#t", "body": "#body", "next": {"sel": "a.none", "text": []}}
    x = _page(t).select(F.col("id").alias("chapter_id"), column(lambda h, u: H.chapter(h, u, rules), _PARSED)("html", "url").alias("p"))
    return x.select("chapter_id", F.col("p.title").alias("title"), F.length("p.content").alias("chars"), F.col("p.next_url").alias("next_url"))


@query()
def pages_prose(t: Tables) -> DataFrame:
    """Pages without a map: the densest block, its title and length."""
    x = _page(t).select(F.col("id").alias("chapter_id"), column(lambda h, u: H.chapter(h, u), _PARSED)("html", "url").alias("p"))
    return x.select("chapter_id", F.col("p.title").alias("title"), F.length("p.content").alias("chars"))


@query("""SELECT DISTINCT id AS book_id, title FROM books WHERE source_lang IN ('zh-Hans', 'zh-Hant', 'ja', 'ko') AND regexp_full_match(title, '[一-龥ぁ-んァ-ヶー가-힣 ]{4,}')""")
def encodings_guessed(t: Tables) -> DataFrame:
    """Titles written in the usual legacy encoding of their language and decoded by the charset rules."""
    b = t.once("books", F.col("id").alias("book_id"), "title", "source_lang").where(F.col("source_lang").isin("zh-Hans", "zh-Hant", "ja", "ko"))
    b = b.where(F.col("title").rlike("^[一-龥ぁ-んァ-ヶー가-힣 ]{4,}$"))
    codec = {"zh-Hans": "gb18030", "zh-Hant": "big5", "ja": "shift_jis", "ko": "euc-kr"}

    def there_and_back(title: str, lang: str) -> str:
        raw = title.encode({"shift_jis": "cp932", "euc-kr": "cp949"}.get(codec[lang], codec[lang]), "replace")
        return readers.charset.decode(raw, hints=(codec[lang],))

    return b.select("book_id", column(there_and_back, "string")("title", "source_lang").alias("title"))


@query(
    """WITH g AS (SELECT DISTINCT id, source, target, gender, tags, pinned FROM glossary)
    SELECT id, regexp_replace(source, '^\\s+|\\s+$', '', 'g') AS source, regexp_replace(target, '^\\s+|\\s+$', '', 'g') AS target, CASE WHEN gender IN ('masculine', 'feminine') THEN gender ELSE 'neuter' END AS gender, coalesce(pinned, FALSE) AS pinned FROM g"""
)
def term_table_round_trip(t: Tables) -> DataFrame:
    """Glossary to its export table and back."""
    g = t.once("glossary", "id", "source", "target", "gender", "tags", "pinned", "context", "category", "aliases")
    table = readers.term_table(g.withColumn("aliases", F.from_json("aliases", "array<string>")), "id")
    return readers.term_rows(table, "id").select("id", "source", "target", "gender", "pinned")


@query(
    """SELECT user_id, event_type, count(*) AS n, round(sum(v), 2) AS k FROM (SELECT DISTINCT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS DOUBLE) AS v FROM events) GROUP BY ALL"""
)
def event_log(t: Tables) -> DataFrame:
    """Events written as one server-sent log per user, heartbeats between them, and read back."""
    e = t.events.select("event_id", "user_id", "event_type", "props").distinct()
    block = F.concat(F.lit(": ping\n\ndata: "), F.to_json(F.struct("event_id", "event_type", "props")), F.lit("\n\n"))
    logs = e.groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(block)), "").alias("log"))
    x = logs.select("user_id", F.explode(readers.sse_events(F.concat("log", F.lit("data: {broken")))).alias("j"))
    x = x.select("user_id", F.from_json("j", "event_id long, event_type string, props string").alias("v"))
    return x.groupBy("user_id", F.col("v.event_type").alias("event_type")).agg(F.count("*").alias("n"), F.round(F.sum(F.get_json_object("v.props", "$.k").cast("double")), 2).alias("k"))


QUERIES, SQL = query.queries, query.sql
