"""Queries over texts: labels, statistics, languages, detectors, chunking, sentences, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import languages
from lexmill.functions import prose as P
from lexmill.functions import text as X
from lexmill.functions.arrow import column
from lexmill.plans.registry import Registry, Tables

query = Registry()

_CB = "cb AS (SELECT DISTINCT c.id, c.book_id, c.seq, c.title_source, c.title_target, c.content_source, c.content_target, b.source_lang, b.target_lang FROM chapters c JOIN (SELECT DISTINCT id, source_lang, target_lang FROM books) b ON c.book_id = b.id)"


def _texts(t: Tables, *columns: str) -> DataFrame:
    b = t.once("books", F.col("id").alias("book_id"), "source_lang", "target_lang")
    return t.chapters.select("id", "book_id", *columns).join(b, "book_id")  # rows delivered twice drop out of the compact results


@query(
    """WITH c AS (SELECT DISTINCT id, title_source AS t FROM chapters),
    n AS (SELECT id, t, coalesce(TRY_CAST(nullif(regexp_extract(t, '第\\s*([0-9]{1,7})\\s*[章回節节卷話话]', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(t, '제\\s*([0-9]{1,7})\\s*[장화권부편]', 1), '') AS BIGINT),
      TRY_CAST(nullif(regexp_extract(t, '(?i)\\bchapter\\s+([0-9]{1,7})\\b', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(t, '^\\s*제?\\s*0*([0-9]{1,7})(?:\\s*[화話장회권부편])?(?:[\\s\\-–—.:、)\\]]|$)', 1), '') AS BIGINT)) AS number,
      CASE WHEN regexp_matches(t, '楔子|序章|序言|引子|プロローグ|프롤로그|(?i:\\bprologue\\b)') THEN 'Prologue' WHEN regexp_matches(t, '尾聲|尾声|大結局|大结局|終章|终章') THEN 'Finale'
        WHEN regexp_matches(t, '(?i:\\bepilogue\\b)|エピローグ|에필로그') THEN 'Epilogue' WHEN regexp_matches(t, '番外|閑話|外伝|외전|(?i:\\bside[\\s-]?story\\b|\\bextra\\b)') THEN 'Extra'
        WHEN regexp_matches(t, '後記|后记|後話|后话|完本感言|感言|作者的?[話话]|上架|請假|请假|通知|公告|あとがき|작가의?\\s*말|(?i:author.?s?\\s*note|\\bafterword\\b)') THEN 'Note' END AS tag FROM c)
    SELECT id AS chapter_id, CASE WHEN number IS NOT NULL THEN 'chapter' WHEN tag IS NOT NULL THEN 'special' ELSE 'plain' END AS kind, number, CASE WHEN number IS NULL THEN tag END AS tag FROM n"""
)
def chapter_labels(t: Tables) -> DataFrame:
    """A chapter's number from its title, else a special tag, else plain."""
    c = t.once("chapters", "id", "title_source")
    number, tag = X.chapter_number(F.col("title_source")), X.special_tag(F.col("title_source"))
    x = c.select(F.col("id").alias("chapter_id"), number.alias("number"), tag.alias("tag"))
    kind = F.when(F.col("number").isNotNull(), "chapter").when(F.col("tag").isNotNull(), "special").otherwise("plain")
    return x.select("chapter_id", kind.alias("kind"), "number", F.when(F.col("number").isNull(), F.col("tag")).alias("tag"))


@query(
    """SELECT DISTINCT id AS chapter_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(title_source, '^\\s*第\\s*(?:[0-9]{1,7}|[〇零一二兩两三四五六七八九十百千萬万]{1,12})\\s*[章回節节卷][\\s:：、.\\-—]*', ''),
      '(?i)^\\s*chapter\\s+[0-9]{1,7}\\s*[:：.\\-—]*\\s*', ''), '^\\s*제?\\s*0*[0-9]{1,7}(?:\\s*[화話장회권부편])?(?:[\\s\\-–—.:、)\\]]+|$)', ''), '^[\\s\\x0b\\p{Z}\\x{feff}]+|[\\s\\x0b\\p{Z}\\x{feff}]+$', '', 'g') AS subtitle FROM chapters"""
)
def chapter_subtitles(t: Tables) -> DataFrame:
    """Titles without their chapter marker."""
    return t.once("chapters", F.col("id").alias("chapter_id"), "title_source").select("chapter_id", X.without_prefix(F.col("title_source")).alias("subtitle")).distinct()


@query(
    f"""WITH {_CB}, p AS (SELECT id, source_lang, list_filter(regexp_split_to_array(content_source, '\\n\\n+'), lambda x: x <> '') AS ps FROM cb),
    s AS (SELECT id, CASE WHEN source_lang IN ('en', 'ko') THEN 1 ELSE 0 END AS d, CASE source_lang WHEN 'en' THEN 220 WHEN 'ko' THEN 600 ELSE 400 END AS rate, length(array_to_string(ps, '')) AS chars,
      len(list_filter(regexp_split_to_array(array_to_string(ps, ' '), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS w, len(ps) AS paragraphs FROM p),
    u AS (SELECT *, CASE WHEN d = 1 THEN w ELSE 0 END AS words, CASE WHEN d = 1 THEN w ELSE chars END AS n FROM s)
    SELECT id AS chapter_id, CAST(chars AS INTEGER) AS chars, CAST(words AS INTEGER) AS words, CAST(paragraphs AS INTEGER) AS paragraphs, CAST(CASE WHEN n > 0 THEN greatest(1, floor(n / rate::DOUBLE + 0.5)) ELSE 0 END AS INTEGER) AS read_minutes FROM u"""
)
def content_counts(t: Tables) -> DataFrame:
    """Characters, words, paragraphs and reading time of every chapter by its language."""
    x = _texts(t, "content_source")
    s = X.content_stats(F.col("content_source"), languages.delimited(F.col("source_lang")), languages.read_rate(F.col("source_lang")))
    return x.select(F.col("id").alias("chapter_id"), s.alias("s")).select("chapter_id", "s.*").distinct()


@query(
    f"""WITH {_CB}, s AS (SELECT id, left(content_source, 4000) AS s FROM cb) SELECT id AS chapter_id, CASE WHEN trim(s) = '' THEN 'zh-Hant' WHEN regexp_matches(s, '[\\x{{3040}}-\\x{{30ff}}]') THEN 'ja' WHEN regexp_matches(s, '[\\x{{ac00}}-\\x{{d7a3}}]') THEN 'ko'
      WHEN regexp_matches(s, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]') THEN CASE WHEN length(regexp_replace(s, '[^{X.SIMPLIFIED}]', '', 'g')) > length(regexp_replace(s, '[^{X.TRADITIONAL}]', '', 'g')) THEN 'zh-Hans' ELSE 'zh-Hant' END
      WHEN regexp_matches(s, '[\\x{{e00}}-\\x{{e7f}}]') THEN 'th' WHEN regexp_matches(s, '[\\x{{590}}-\\x{{5ff}}]') THEN 'he' WHEN regexp_matches(s, '[\\x{{600}}-\\x{{6ff}}]') THEN 'ar' WHEN regexp_matches(s, '[\\x{{900}}-\\x{{97f}}]') THEN 'hi'
      WHEN regexp_matches(s, '[\\x{{370}}-\\x{{3ff}}\\x{{1f00}}-\\x{{1ffc}}]') THEN 'el' WHEN regexp_matches(s, '[\\x{{400}}-\\x{{4ff}}]') THEN 'ru' ELSE 'en' END AS lang FROM s"""
)
def detected_languages(t: Tables) -> DataFrame:
    """Source language of every chapter by its scripts."""
    return _texts(t, "content_source").select(F.col("id").alias("chapter_id"), X.language(F.col("content_source")).alias("lang")).distinct()


@query(
    f"""WITH {_CB}, h AS (SELECT id, source_lang AS l, content_target AS t, regexp_matches(content_target, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{20000}}-\\x{{2a6df}}]') AS han, length(content_source) AS s FROM cb WHERE content_target IS NOT NULL)
    SELECT id AS chapter_id, CASE WHEN l LIKE 'zh%' THEN han WHEN l = 'ja' THEN han OR regexp_matches(t, '[\\x{{3040}}-\\x{{30ff}}\\x{{31f0}}-\\x{{31ff}}]') WHEN l = 'ko' THEN regexp_matches(t, '[\\x{{ac00}}-\\x{{d7a3}}\\x{{1100}}-\\x{{11ff}}\\x{{3130}}-\\x{{318f}}]') ELSE FALSE END AS residue,
      length(t) >= 200 AND len(regexp_extract_all(t, '[a-z][A-Z]')) * 1000.0 / length(t) > 2 AS degenerate, s > 0 AND length(t) > s * 6 + 400 AS expanded, round(length(t)::DOUBLE / s, 4) AS ratio FROM h"""
)
def translation_flags(t: Tables) -> DataFrame:
    """Quality detectors of translations: source residue, degenerate text, over-expansion, expansion ratio."""
    x = _texts(t, "content_source", "content_target").where("content_target IS NOT NULL")
    s, c = F.col("content_source"), F.col("content_target")
    return x.select(
        F.col("id").alias("chapter_id"), X.has_residue(c, F.col("source_lang")).alias("residue"), X.degenerate(c).alias("degenerate"),
        X.over_expanded(s, c).alias("expanded"), F.when(F.length(s) > 0, F.round(F.length(c) / F.length(s), 4)).alias("ratio"),
    ).distinct()


@query(
    f"""WITH {_CB} SELECT id AS chapter_id, len(regexp_split_to_array(content_source, '\\n\\n+')) = len(regexp_split_to_array(content_target, '\\n\\n+')) AS aligned FROM cb WHERE content_target IS NOT NULL"""
)
def paragraphs_aligned(t: Tables) -> DataFrame:
    """Whether source and translation have as many paragraphs."""
    n = lambda c: F.size(F.split(c, r"\n{2,}", -1))
    x = _texts(t, "content_source", "content_target").where("content_target IS NOT NULL")
    return x.select(F.col("id").alias("chapter_id"), (n("content_source") == n("content_target")).alias("aligned")).distinct()


@query(
    """SELECT DISTINCT id, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '^$', 'book')[:60] AS slug,
      regexp_replace(title, '[\\\\/:*?"<>|\\x00-\\x1f]+', '_', 'g')[:120] AS file_name FROM books"""
)
def book_file_names(t: Tables) -> DataFrame:
    """Slug and file name of every book."""
    return t.once("books", "id", "title").select("id", X.slug(F.col("title")).alias("slug"), X.filename(F.col("title")).alias("file_name"))


@query(
    """SELECT DISTINCT id AS chapter_id, coalesce(nullif(regexp_replace(regexp_extract(lower(chapter_url), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\\.', ''), ''), 'unknown') AS host,
      nullif(regexp_extract(chapter_url, '/book/([0-9]+)/([0-9]+)', 1), '') AS book, nullif(regexp_extract(chapter_url, '/book/([0-9]+)/([0-9]+)', 2), '') AS chapter FROM chapters WHERE chapter_url IS NOT NULL"""
)
def url_parts(t: Tables) -> DataFrame:
    """Host, and book and chapter ids by a two-group pattern, of every chapter URL."""
    c = t.once("chapters", F.col("id").alias("chapter_id"), "chapter_url").where("chapter_url IS NOT NULL")
    ids = X.url_ids(F.col("chapter_url"), F.lit("/book/([0-9]+)/([0-9]+)"))
    return c.select("chapter_id", X.host(F.col("chapter_url")).alias("host"), ids.alias("i")).select("chapter_id", "host", "i.book", "i.chapter")


@query(
    """WITH g AS (SELECT DISTINCT id, book_id, source, target, gender, context, pinned, list_sort(coalesce(CASE WHEN json_valid(aliases) THEN json_transform(aliases, '["VARCHAR"]') END, [])) AS al FROM glossary WHERE scope = 'book'),
    s AS (SELECT book_id, source || '=' || target || '#' || gender || CASE WHEN trim(coalesce(context, '')) <> '' THEN '@' || trim(context) ELSE '' END || CASE WHEN pinned THEN '!' ELSE '' END || CASE WHEN len(al) > 0 THEN '~' || array_to_string(al, ',') ELSE '' END AS t FROM g)
    SELECT book_id, sha256(array_to_string(list_sort(list(t)), chr(10)))[:16] AS fingerprint FROM s GROUP BY book_id"""
)
def glossary_fingerprints(t: Tables) -> DataFrame:
    """Order-independent fingerprint of every book's terms."""
    aliases = F.coalesce(F.from_json("aliases", "array<string>"), F.array().cast("array<string>"))
    g = t.once("glossary", "id", "book_id", "source", "target", "gender", "context", "pinned", "aliases", "scope").where("scope = 'book'")
    s = X.term_string(F.col("source"), F.col("target"), F.col("gender"), F.col("context"), F.col("pinned"), aliases)
    return g.groupBy("book_id").agg(X.fingerprint(F.collect_list(s)).alias("fingerprint"))


@query(
    f"""WITH {_CB}, g AS (SELECT DISTINCT * FROM glossary WHERE book_id IS NOT NULL), s AS (SELECT book_id, source || '=' || target || '#' || gender || CASE WHEN trim(coalesce(context, '')) <> '' THEN '@' || trim(context) ELSE '' END || CASE WHEN pinned THEN '!' ELSE '' END
        || CASE WHEN len(json_transform(aliases, '["VARCHAR"]')) > 0 THEN '~' || array_to_string(list_sort(json_transform(aliases, '["VARCHAR"]')), ',') ELSE '' END AS s FROM g),
      f AS (SELECT book_id, left(sha256(string_agg(s, chr(10) ORDER BY s)), 16) AS fp FROM s GROUP BY book_id)
    SELECT id AS chapter_id, sha256('v1 ' || source_lang || '>' || target_lang || ' deep ' || coalesce(fp, left(sha256(''), 16)) || ' ' || sha256(content_source)) AS memo FROM cb LEFT JOIN f ON f.book_id = cb.book_id"""
)
def memo_keys(t: Tables) -> DataFrame:
    """Memo key of a chapter: changes with version, language pair, model, the book's terms and text."""
    text = F.sha2("content_source", 256)
    x = t.chapters.select("id", "book_id", text.alias("text")).distinct().join(t.once("books", F.col("id").alias("book_id"), "source_lang", "target_lang"), "book_id")
    x = x.join(glossary_fingerprints(t), "book_id", "left")
    terms = F.coalesce("fingerprint", F.left(F.sha2(F.lit(""), 256), F.lit(16)))
    payload = F.concat(F.lit("v1 "), "source_lang", F.lit(">"), "target_lang", F.lit(" deep "), terms, F.lit(" "), "text")
    return x.select(F.col("id").alias("chapter_id"), F.sha2(payload, 256).alias("memo"))


@query("SELECT DISTINCT id AS chapter_id, CAST((length(lower(content_source)) - length(replace(lower(content_source), 'the', ''))) / 3 AS INTEGER) AS n FROM chapters")
def find_in_page(t: Tables) -> DataFrame:
    """Occurrences of a needle in every chapter, letter case aside."""
    return t.chapters.select(F.col("id").alias("chapter_id"), X.occurrences(F.col("content_source"), F.lit("the")).alias("n")).distinct()


@query(
    """SELECT c_custkey, ip FROM (SELECT c_custkey, concat_ws('.', c_custkey % 256, (c_custkey // 3) % 256, c_nationkey, 1) AS ip, c_custkey % 256 AS a, (c_custkey // 3) % 256 AS b FROM customer)
    WHERE a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR a >= 224"""
)
def private_addresses(t: Tables) -> DataFrame:
    """Address predicate over made-up addresses."""
    ip = F.concat_ws(".", F.col("c_custkey") % 256, F.floor(F.col("c_custkey") / 3) % 256, "c_nationkey", F.lit(1))
    return t.customer.select("c_custkey", ip.alias("ip")).where(X.private_ip(F.col("ip")))


@query()
def body_texts(t: Tables) -> DataFrame:
    """Control labels dropped, broken paragraphs joined: (chapter_id, n_before, n_after, digest)."""
    x = t.chapters.select(F.col("id").alias("chapter_id"), "content_source", column(P.body_text, "string")(F.col("content_source")).alias("body"))
    n = lambda col: F.size(F.split(col, r"\n{2,}", -1))
    return x.select("chapter_id", n("content_source").alias("n_before"), n("body").alias("n_after"), F.md5("body").alias("digest")).distinct()


@query()
def extraction_chunks(t: Tables) -> DataFrame:
    """Greedy chunks for extraction: (chapter_id, chunk_no, chars)."""
    x = t.chapters.select(F.col("id").alias("chapter_id"), F.posexplode(column(P.extract_chunks, "array<string>")(F.col("content_source"))).alias("chunk_no", "chunk"))
    return x.select("chapter_id", "chunk_no", F.length("chunk").alias("chars")).distinct()


@query()
def tagged_paragraphs(t: Tables) -> DataFrame:
    """Paragraph chunks with numbered tags and back again: every place filled (chapter_id, chunk_no, places, filled)."""
    x = t.chapters.select(F.col("id").alias("chapter_id"), F.posexplode(column(P.paragraph_chunks, "array<array<string>>")(F.col("content_source"))).alias("chunk_no", "paras"))
    tagged = column(lambda p: P.numbered(list(p)), "string")(F.col("paras"))
    back = column(P.slots, "array<string>")(tagged, F.size("paras"))
    return x.select("chapter_id", "chunk_no", F.size("paras").alias("places"), F.size(F.filter(back, lambda s: s.isNotNull())).alias("filled")).distinct()


@query()
def sentence_counts(t: Tables) -> DataFrame:
    """Sentences of every chapter: number and longest length."""
    x = t.chapters.select(F.col("id").alias("chapter_id"), column(P.sentence_spans, "array<array<int>>")(F.col("content_source")).alias("s"))
    return x.select("chapter_id", F.size("s").alias("n"), F.array_max(F.transform("s", lambda p: p[1] - p[0])).alias("longest")).distinct()


@query()
def inline_tokens(t: Tables) -> DataFrame:
    """Words of all paragraphs rendered as inline markup: their number, and the characters of the paragraphs up to their last words."""
    p = t.chapters.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("chapter_id"), "content_source")
    p = p.select("row", "chapter_id", F.explode(F.split("content_source", "\n", -1)).alias("p"))
    kind = "array<struct<text:string,start:int,end:int,tags:array<string>,is_word:boolean,is_break:boolean>>"
    x = p.select("row", "chapter_id", column(P.tokens, kind)(X.markup(F.col("p"))).alias("w"))
    x = x.select("row", "chapter_id", F.transform(F.filter("w", lambda w: w.is_word), lambda w: w.end).alias("ends")).where(F.size("ends") > 0)
    return x.groupBy("row", "chapter_id").agg(F.sum(F.size("ends")).alias("words"), F.sum(F.array_max("ends")).alias("chars")).drop("row").distinct()


QUERIES, SQL = query.queries, query.sql
