"""Readers, writers and page parsing."""

import io
import zipfile

from pyspark.sql import functions as F

from lexmill.functions import html as H
from lexmill.sources import charset, epub, readers, writers
from tests.conftest import rows

STORY = "".join(f"<p>他走了{k}里路，來到古老的村子，看見許多人在樹下說話，沒有人認得他。</p>" for k in range(14))
PAGE = (
    '<html><head><title>書名_第12章 夜雨_小站</title><meta property="og:site_name" content="小站"><link rel="prev" href="11.html"></head><body><nav><a href="/">首頁</a></nav>'
    f'<h1 id="title">第12章 夜雨</h1><div class="menu"><a href="/a">甲</a> <a href="/b">乙</a></div><div id="content">{STORY}</div><a href="13.html">下一章</a><a href="#x">目录</a></body></html>'
)
URL = "https://s.example/book/12.html"


def test_charsets():
    text = "這是一個很長的測試，裡面都是漢字。"
    for enc in ("utf-8", "gb18030", "big5"):
        assert charset.decode(text.encode(enc)) == text
    assert charset.decode("これはテスト".encode("cp932"), hints=("shift_jis",)) == "これはテスト"  # a tie goes to the hint
    assert charset.decode("이것은 시험이다".encode("cp949"), hints=("euc-kr",)) == "이것은 시험이다"
    assert charset.decode(b"\xef\xbb\xbfabc") == "abc" and charset.decode("字".encode("utf-16")) == "字" and charset.decode(b"") == ""
    assert charset.decode('<?xml version="1.0" encoding="GBK"?><p>漢字</p>'.encode("gbk"), markup=True).endswith("<p>漢字</p>")


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_epub_spine_natural_order_and_errors():
    page = lambda t: f"<html><body><h1>{t}</h1><p>text of {t} &amp;#65; here</p></body></html>"
    spine = _zip({
        "META-INF/container.xml": '<rootfile full-path="O/c.opf"/>',
        "O/c.opf": '<package><dc:title>Book &amp; Co</dc:title><dc:creator>Me</dc:creator><manifest><item id="a" href="t/a%20b.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>',
        "O/t/a b.xhtml": page("A"), "O/b.xhtml": page("B"),
    })
    book = epub.read(spine, "x")
    assert (book["title"], book["author"], [c["title"] for c in book["chapters"]]) == ("Book & Co", "Me", ["B", "A"])
    assert "&#65;" in book["chapters"][0]["content"]
    bare = epub.read(_zip({f"c{k}.html": page(f"T{k}") for k in (10, 2, 1)}), "x")
    assert [c["title"] for c in bare["chapters"]] == ["T1", "T2", "T10"]
    assert epub.read(b"nothing", "x")["error"] and epub.read(_zip({"a.html": "<img>"}), "x")["error"]
    whole = "<html><body>" + "".join(f"<h2>Part {k}</h2><p>{'words ' * 1500}</p>" for k in range(4)) + "</body></html>"
    assert [c["title"] for c in epub.read(_zip({"a.html": whole}), "x")["chapters"]] == [f"Part {k}" for k in range(4)]


def test_epub_frame(spark):
    df = spark.createDataFrame([("d/b.epub", b"bad"), ("d/e.epub", None)], "path string, content binary")
    assert rows(readers.epub_chapters(df).select("path", "error")) == {("d/b.epub", "not an archive"), ("d/e.epub", "too large")}


def test_page_by_map_and_by_density():
    by_map = H.chapter(PAGE, URL, {"title": "#title", "body": "#content", "next": {"sel": "", "text": ["下一章"]}})
    by_density = H.chapter(PAGE, URL)
    for got in (by_map, by_density):
        assert got["title"] == "第12章 夜雨" and "他走了3里路" in got["content"] and "首頁" not in got["content"]
        assert got["next_url"] == "https://s.example/book/13.html" and got["prev_url"] == "https://s.example/book/11.html" and got["index_url"] == URL + "#x"
        assert got["book_title"] == "書名"
    assert H.chapter(PAGE, URL, {"title": "a", "body": "#content"}) is None
    assert H.chapter(PAGE, URL, {"title": "#title", "body": "#none"}) is None
    assert H.chapter('<a class="back">返回</a>' + STORY, URL, {"title": "a.back", "body": "body"}) is None
    assert H.chapter("<html><body><div id=app></div></body></html>", URL) is None


def test_titles_covers_entities():
    assert H.book_title("书名_最新章节_站") == "书名" and H.book_title("第1章 起点") == "" and H.book_title("Site - My Book", "Site") == "My Book"
    assert H.cover('<meta property="og:image" content="/c.jpg">', URL) == "https://s.example/c.jpg"
    assert H.cover('<img src="logo.gif"><img class="cover" src="b.jpg" width=100 height=150>', URL) == "https://s.example/book/b.jpg"
    assert H.cover("<img src=x.gif>", URL) is None
    assert H.entities("&amp;#65; &#x41; &#9999999;") == "&#65; A &#9999999;" and H.entities("&#9999999;&mdash;", archive=True) == "—"
    assert set(H.outline(PAGE)) == {"titles", "bodies", "links"}


def test_term_table_round_trip(spark):
    terms = spark.createDataFrame(
        [("=1+1", "-x", "masculine", None, "#a", "item", True, ["p", "q"]), ("甲", "A", "neuter", "ctx", None, None, False, None)],
        "source string, target string, gender string, context string, tags string, category string, pinned boolean, aliases array<string>",
    )
    back = readers.term_rows(readers.term_table(terms))
    assert rows(back.drop("status", "aliases")) == rows(terms.drop("aliases"))
    legacy = spark.createDataFrame([("甲", "A", "#female x"), ("", "B", "")], " Raw string, TRANSLATION string, Description string")
    assert rows(readers.term_rows(legacy).select("source", "target", "gender")) == {("甲", "A", "feminine")}


def test_event_log(spark):
    log = 'data: {"a":1}\n\n: ping\n\ndata: broken\n\nevent: x\ndata: {"b":2}\n\ndata: {"rest":1}'
    got = spark.createDataFrame([(log,)], "s string").select(readers.sse_events(F.col("s")).alias("e")).first().e
    assert got == ['{"a":1}', '{"b":2}']


def test_text_files(spark):
    df = spark.createDataFrame([("d/b.txt", "第1章 甲\n文\n第2章 乙\n字".encode("big5")), ("d/e.txt", b"")], "path string, content binary")
    got = rows(readers.text_file_chapters(df).select("path", "error", "idx", "title_source"))
    assert got == {("d/b.txt", None, 0, "第1章 甲"), ("d/b.txt", None, 1, "第2章 乙"), ("d/e.txt", "empty", None, None)}


def test_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.append(spark.createDataFrame([(1, "a")], "id int, v string"), path)
    writers.insert_new(spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "id int, v string"), path, ["id"])
    assert rows(spark.read.parquet(path)) == {(1, "a"), (2, "c")}
    part = str(tmp_path / "p")
    writers.replace_partitions(spark.createDataFrame([(1, "u"), (2, "w")], "id int, user string"), part, "user")
    writers.replace_partitions(spark.createDataFrame([(3, "u")], "id int, user string"), part, "user")
    assert rows(spark.read.parquet(part).select("id", "user")) == {(3, "u"), (2, "w")}
