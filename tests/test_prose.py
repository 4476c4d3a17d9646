"""Text operators against their rules and plain models."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import html as H
from lexmill.functions import prose as P
from lexmill.functions import text as X


def test_text_chapters():
    text = "第一章 起点\n風起。\n\n第2章 死亡\n他死了。\nChapter 3 The End\nDone."
    assert [t for t, _ in P.text_chapters(text, "x")] == ["第一章 起点", "第2章 死亡", "Chapter 3 The End"]
    assert [t for t, _ in P.text_chapters("序章：楔子\na\n第一章 起点——新的开始\nb", "x")] == ["序章：楔子", "第一章 起点——新的开始"]
    assert P.text_chapters("only text\nmore", "Book") == [("Book", "only text\n\nmore")]
    assert P.text_chapters("intro\n第1章 甲\nb", "Book") == [("Chapter 1", "intro"), ("第1章 甲", "b")]
    assert [t for t, _ in P.text_chapters("프롤로그\na\n제2장 시작\nb", "x")] == ["프롤로그", "제2장 시작"]
    assert P.text_chapters(" \n\n", "x") == []


def test_extract_chunks():
    assert P.extract_chunks("") == [] and P.extract_chunks("x" * 20000) == ["x" * 20000]
    assert len(P.extract_chunks("\n\n".join(["a" * 6000] * 2))) == 2
    assert len(P.extract_chunks("\n\n".join(["a" * 9000] * 300))) == 200


@given(st.lists(st.integers(1, 5000), max_size=30))
def test_chunks_keep_every_paragraph(sizes):
    paras = [chr(97 + k % 26) * n for k, n in enumerate(sizes)]
    chunks = P.extract_chunks("\n\n".join(paras))
    assert [p for c in chunks for p in c.split("\n\n")] == paras
    for c in chunks:  # model of the greedy rule: a chunk only exceeds the limit by the separator before its last paragraph
        assert "\n\n" not in c or len(c) <= P.EXTRACT_LIMIT + 2


def test_coalesced():
    assert P.coalesced("He walked\n\nhome.\n\nNext") == "He walked home.\n\nNext"
    assert P.coalesced("◇\n\nHe came.") == "◇\n\nHe came."
    assert P.coalesced("a​\n\n​\n\nb") == "a b"
    long = "字" * 1500
    assert P.coalesced(f"{long}\n\n{long}") == f"{long}\n\n{long}"
    assert P.without_labels("上一章\n\n正文在此。\n\n第(1/3)页") == "正文在此。"


@given(st.lists(st.text("ab .!", min_size=1, max_size=900), max_size=12))
def test_coalesced_against_model(paras):
    out = []
    for p in (p.strip() for p in paras):
        if not p:
            continue
        if out and any(c.isalpha() for c in out[-1]) and out[-1][-1] not in ".!" and len(out[-1]) + 1 + len(p) <= 2000:
            out[-1] += " " + p
        else:
            out.append(p)
    assert P.coalesced("\n\n".join(paras)) == "\n\n".join(out)


def test_numbered_slots_and_gaps():
    paras = ["one", "two", "three"]
    assert P.slots(P.numbered(paras), 3) == paras
    assert P.slots("⟦¶1⟧ a ⟬¶3⟭ c ⟦¶3⟧ d ⟦¶9⟧ z", 3) == ["a", None, "c d"]
    assert P.gaps(["a", None, "c", None, None]) == [0, 1, 2, 3, 4] and P.gaps([None, "b"]) == [0]


def test_sentences():
    text = "Pi is 3.14. Really?!” 好。」他走了\nNew line"
    assert [text[a:b] for a, b in P.sentence_spans(text)] == ["Pi is 3.14.", "Really?!”", "好。」", "他走了", "New line"]
    assert P.sentence_spans("") == [] and P.sentence_spans("  ") == []


def test_tokens_and_highlight():
    words = [t["text"] for t in P.tokens("a <b>bold</b> &amp; <x> c<br>d") if t["is_word"]]
    assert words == ["a", "bold", "&", "<x>", "c", "d"]
    assert next(t for t in P.tokens("a <b>bold</b>") if t["text"] == "bold")["tags"] == ["b"]
    got = P.highlighted("the <b>art</b> of start & art", [("1", "art")], True)
    assert got.count("<span") == 2 and "st<span" not in got
    assert P.highlighted("齊天神丹", [("1", "齊天"), ("2", "齊天神丹")], False).count("<span") == 1


def test_term_objects():
    assert P.term_objects('{"terms":[{"a":1}]}') == [{"a": 1}] and P.term_objects('[{"a":1}]') == [{"a": 1}]
    assert P.term_objects('{"terms":[{"a":1},{"b":2},{"c"') == [{"a": 1}, {"b": 2}]


def test_natural_order():
    assert sorted(["c10", "c2", "c1"], key=P.natural_key) == ["c1", "c2", "c10"]


CASES = [
    (lambda: X.numeral(F.lit("五百五十五")), 555), (lambda: X.numeral(F.lit("十二万")), 20010), (lambda: X.chapter_number(F.lit("第五百五十五章 風")), 555),
    (lambda: X.chapter_number(F.lit("제3화 시작")), 3), (lambda: X.chapter_number(F.lit("Chapter 12: x")), 12), (lambda: X.chapter_number(F.lit("5분 후")), None),
    (lambda: X.special_tag(F.lit("番外 雨")), "Extra"), (lambda: X.without_prefix(F.lit("第12章：風")), "風"), (lambda: X.without_prefix(F.lit("Chapter 1")), ""),
    (lambda: X.slug(F.lit("The Lost  Box!")), "the-lost-box"), (lambda: X.slug(F.lit("學堂")), "book"), (lambda: X.resolve_path(F.lit("a/b/"), F.lit("../c/./d.html#x")), "a/c/d.html"),
    (lambda: X.percent_decoded(F.lit("a%20b+c")), "a b+c"), (lambda: X.percent_decoded(F.lit("%zz")), None), (lambda: X.csv_safe(F.lit("=1+1")), "\t=1+1"), (lambda: X.truthy(F.lit(" Yes ")), True),
    (lambda: X.occurrences(F.lit("AbaBab"), F.lit("ab")), 3), (lambda: X.host(F.lit("HTTPS://www.Ex.org:8/x")), "ex.org"), (lambda: X.host(F.lit("none")), "unknown"),
    (lambda: X.like_base_slash(F.lit("https://e.org/a"), F.lit("https://e.org/b/")), "https://e.org/a/"), (lambda: X.like_base_slash(F.lit("https://e.org/a/?q=1"), F.lit("https://e.org/b")), "https://e.org/a?q=1"),
    (lambda: X.quoted_url(F.lit("go('/v/1',2)")), "/v/1"), (lambda: X.utf16_length(F.lit("a😀")), 3), (lambda: X.language(F.lit("これは")), "ja"), (lambda: X.language(F.lit("们这国")), "zh-Hans"),
    (lambda: X.language(F.lit(" ")), "zh-Hant"), (lambda: X.language(F.lit("привет")), "ru"), (lambda: X.degenerate(F.lit("a" * 250)), True), (lambda: X.degenerate(F.lit("aB" * 50)), False),
    (lambda: X.title_from_path(F.lit("x/my_first-page.xhtml")), "my first page"), (lambda: X.unquoted(F.lit("“hi”")), "hi"), (lambda: X.outcome(F.lit(404)), "drop"), (lambda: X.outcome(F.lit(429)), "retry"),
    (lambda: X.without_leading_title(F.lit("第1章 風\n\n正文\n\n後"), F.lit("x")), "正文\n\n後"), (lambda: X.markup(F.lit("<b>x</b> **y** <i onclick=1>")), "<b>x</b> <strong>y</strong> &lt;i onclick=1&gt;"),
    (lambda: X.meta_tags(F.lit('<meta name="a" content="1"><meta property="A" content="2">')), {"a": "2"}), (lambda: X.private_ip(F.lit("172.20.0.1")), True), (lambda: X.private_ip(F.lit("8.8.8.8")), False),
    (lambda: X.private_ip(F.lit("8.8.8")), True), (lambda: X.gender(X.hashtags(F.lit("#Male x"))), "masculine"), (lambda: X.is_host(F.lit("https://m.e.org/"), "e.org"), True),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_expressions(spark, k):
    make, want = CASES[k]
    assert spark.range(1).select(make().alias("v")).first().v == want


def test_markup_is_random_safe():
    rng = random.Random(1)
    for _ in range(200):
        s = "".join(rng.choice("<>b/&;a \n") for _ in range(30))
        assert "".join(t for t, _ in P.runs(s)) is not None


@pytest.mark.parametrize(
    ("line", "heading"),
    [
        ("第三章 起点之战", True), ("第三章起点之战", False), ("第12話：剣", True), ("あとがき", True), ("외전 - 별", True), ("Chapter 7. The Gate", True), ("Chapter 7th day", False), ("제3장", True),
        ("序章", True), ("番外、春", True), ("番外的故事", False),
    ],
)
def test_headings_end_or_are_followed_by_a_separator(line, heading):
    assert (P.text_chapters(f"{line}\nbody", "f")[0] == (line, "body")) is heading


@pytest.mark.parametrize("label", ["上一章", "下一節", "前一页", "下一篇", "返回目錄", "存书签", "加入书架", "章节错误,点此举报", "第(1/3)页", "12 / 340", "로딩 중...", "목록 보기", "Table of Contents", "PREV"])
def test_control_labels_are_dropped(label):
    assert P.without_labels(f"story\n\n{label}\n\nmore") == "story\n\nmore"


@pytest.mark.parametrize("line", ["前一节", "大學", "下一站", "返回的人", "The next one"])
def test_prose_is_kept(line):
    assert P.without_labels(line) == line


@pytest.mark.parametrize(
    ("html", "which", "found"),
    [
        ('<div id="nextra-banner" data-href="/x"></div>', "next", None), ('<input class="next" value="5515272">', "next", None), ('<a class="forward" href="/n">x</a>', "next", "https://s.example/n"),
        ('<input id="next_page_url" value="/viewer/2">', "next", "https://s.example/viewer/2"), ('<div class="feedback" data-url="/f"></div>', "prev", None), ('<a class="上一頁" href="/p">x</a>', "prev", "https://s.example/p"),
        ("<div onclick=\"go('/novel/42')\"></div>", "index", "https://s.example/novel/42"), ('<a href="/q">다음화 보기</a>', "next", "https://s.example/q"), ('<link rel="next" href="/l/"><a class="next" href="/m">x</a>', "next", "https://s.example/l"),
    ],
)
def test_neighbours_by_hints(html, which, found):
    assert H.nav_by_hints(H.tree(html), "https://s.example/viewer/1", which) == found
