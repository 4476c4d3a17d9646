"""Relational, dictionary and stateful operators against plain models."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.operators import dictionary, ledger, library, ordered
from lexmill.plans.usage import top_k
from lexmill.streaming import stateful
from tests.conftest import rows


def _ordered(n=300, seed=1):
    rng = random.Random(seed)
    seen = {(rng.choice("ab"), rng.randrange(5000)) for _ in range(n)}
    return [(k, s, f"{k}{s}") for k, s in seen]


def test_positions_and_neighbours_over_buckets(spark):
    data = _ordered()
    df = spark.createDataFrame(data, "g string, seq int, u string")
    x = ordered.positions(ordered.neighbours(df, "g", "seq", "u", 16), "g", "seq", "u", 16)
    want = set()
    for g in "ab":
        us = [u for k, _, u in sorted(data, key=lambda r: r[1]) if k == g]
        want |= {(u, us[i - 1] if i else None, us[i + 1] if i + 1 < len(us) else None, i + 1, len(us)) for i, u in enumerate(us)}
    assert rows(x.select("u", "prev_u", "next_u", "position", "total")) == want


def test_running_max(spark):
    rng = random.Random(2)
    data = [(g, t, rng.random()) for g in "ab" for t in rng.sample(range(1000), 80)]
    want = set()
    for g in "ab":
        high = 0.0
        for _, t, v in sorted(r for r in data if r[0] == g):
            high = max(high, v)
            want.add((g, t, high))
    assert rows(ordered.running_max(spark.createDataFrame(data, "g string, t int, v double"), "g", "t", "v", 50).select("g", "t", "high")) == want


def test_top_k_with_ties(spark):
    df = spark.createDataFrame([("a", k % 3, k) for k in range(100)] + [(None, 1, 1)], "g string, v int, id int")
    got = rows(top_k(df, "g", [F.col("v").desc(), F.col("id")], 3).select("g", "id", "rank"))
    assert got == {("a", 2, 1), ("a", 5, 2), ("a", 8, 3), (None, 1, 1)}


def test_upsert_keeps_fixed_columns(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, born int, v string")
    new = spark.createDataFrame([("b", 9, "z"), ("c", 7, "p"), ("c", 8, "q")], "k string, born int, v string")
    got = library.upsert(old, new, ["k"], [F.col("born")], ["born"])
    assert rows(got.select("k", "born", "v", "outcome")) == {("a", 1, "x", "kept"), ("b", 2, "z", "updated"), ("c", 8, "q", "added")}


def test_reorder_validates(spark):
    have = spark.createDataFrame([("b", 1), ("b", 2), ("c", 3)], "book string, id int")
    want = spark.createDataFrame([("b", 2, 10), ("b", 1, 20), ("c", 4, 1)], "book string, id int, pos int")
    assert rows(library.reorder(have, "book", "id", want)) == {("b", 2, 0, True), ("b", 1, 1, True), ("c", 4, 0, False)}


def test_cascade(spark):
    child = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "id int, parent int")
    gone = spark.createDataFrame([(5,)], "id int")
    assert rows(library.cascade(child, gone, "parent")) == {(2, None), (3, 6)} or rows(library.cascade(child, gone, "parent")) == {(None, 2), (6, 3)}
    assert rows(library.cascade(child, gone, "parent", set_null=True)) == {(1, None), (2, None), (3, 6)}


def _books(spark):
    users = "id string, user_id string, created_at long"
    return spark.createDataFrame([("b1", "u1", 0), ("b2", "u2", 0)], users), spark.createDataFrame([(1, "b1"), (2, "b2")], "id long, book_id string")


def test_attribution(spark):
    books, chapters = _books(spark)
    own = ledger.owners(chapters, books)
    schema = "kind string, user_id string, chapter_id long, model string, prompt_tokens int, cached_tokens int, completion_tokens int, cost_usd double"
    ai = spark.createDataFrame(
        [("extract", "u2", 1, "m", 50, 0, 10, 0.01), ("title", "u1", None, "m", 20, 0, 5, 0.005), ("title", None, None, "m", 1, 0, 1, 9.99), ("map", "u1", None, "m", 30, 0, 0, 0.02), ("extract", "u1", 99, "m", 1, 0, 0, 1.0)], schema
    )
    got = ledger.attributed(ai, own).groupBy("owner").agg(*ledger.amounts())
    assert rows(got.select("owner", "calls", "cost", "prompt")) == {("u1", 2, 0.015, 70)}


def _brute(text, keys, bounded):
    occ = [(k, i, i + len(k)) for k in keys for i in range(len(text)) if text.startswith(k, i)]
    if bounded:
        w = lambda i: 0 <= i < len(text) and text[i].isalnum()
        occ = [(k, s, e) for k, s, e in occ if not w(s - 1) and not w(e)]
    kept = {}
    for k, s, e in occ:
        if not any(len(o) > len(k) and k in o and s2 <= s and e <= e2 for o, s2, e2 in occ):
            kept.setdefault(k, min(x for q, x, _ in occ if q == k))
    return kept


def test_dictionary_against_brute_force(spark):
    rng = random.Random(4)
    keys = sorted({"".join(rng.choice("ab c") for _ in range(rng.randint(1, 4))).strip() or "a" for _ in range(14)})
    texts = [(k, "".join(rng.choice("ab c") for _ in range(40))) for k in range(60)]
    for bounded in (False, True):
        d = spark.createDataFrame([("x", k, i, bounded) for i, k in enumerate(keys)], "book_id string, key string, id long, bounded boolean")
        t = spark.createDataFrame([("x", i, s) for i, s in texts] + [("y", 99, "a"), ("x", 98, None), ("x", 97, "")], "book_id string, id long, text string")
        got = {(r.id, keys[r.term], r.first) for r in dictionary.matches(dictionary.occurrences(d, t)).collect()}
        assert got == {(i, k, s) for i, text in texts for k, s in _brute(text, keys, bounded).items()}


def test_dictionary_cases(spark):
    cases = [(["齊天", "齊天神丹"], "齊天 與 齊天神丹 齊天", False, {"齊天", "齊天神丹"}), (["山", "高山"], "高山之上", False, {"高山"}), (["art"], "this is the start", True, set()), (["art"], "The art of war; art!", True, {"art"}), (["sword", "king", "art"], "the sword and the shield of kings", True, {"sword"})]
    for keys, text, bounded, want in cases:
        d = spark.createDataFrame([("b", k, i, bounded) for i, k in enumerate(keys)], "book_id string, key string, id long, bounded boolean")
        t = spark.createDataFrame([("b", 1, text)], "book_id string, id long, text string")
        assert {keys[r.term] for r in dictionary.matches(dictionary.occurrences(d, t)).collect()} == want


def test_alias_claims(spark):
    terms = spark.createDataFrame([("b", 1, "齊天大聖", ["孫悟空", "大聖"]), ("b", 2, "大聖", None), ("b", 3, "猴", ["孫悟空"])], "book_id string, id long, source string, aliases array<string>")
    assert rows(dictionary.keys(terms).select("key", "id")) == {("齊天大聖", 1), ("大聖", 2), ("猴", 3), ("孫悟空", 3)} or rows(dictionary.keys(terms).select("key", "id")) == {("齊天大聖", 1), ("大聖", 2), ("猴", 3), ("孫悟空", 1)}


@given(st.lists(st.integers(0, 5000), max_size=60).map(sorted))
def test_limiter_state_splits_anywhere(times):
    whole, _ = stateful.admit(times, [], 600, 3)
    a, state = stateful.admit(times[: len(times) // 2], [], 600, 3)
    b, _ = stateful.admit(times[len(times) // 2 :], state, 600, 3)
    assert whole == a + b
    passed = [t for t, ok in zip(times, whole, strict=True) if ok]
    assert all(sum(t - 600 < p <= t for p in passed) <= 3 for t in passed)


def test_limiter_batch_equals_stream_rule(spark):
    rng = random.Random(3)
    data = [(rng.randrange(4), rng.randrange(20000), k) for k in range(400)]
    want = set()
    for u in range(4):
        mine = sorted((t, k) for v, t, k in data if v == u)
        ok, _ = stateful.admit([t for t, _ in mine], [], 600, 3)
        want |= {(u, t, k, f) for (t, k), f in zip(mine, ok, strict=True)}
    assert rows(stateful.admitted(spark.createDataFrame(data, "user_id long, at long, id long"), 600, 3)) == want


def test_replay():
    op = lambda status, attempts=0, last=None: {"status": status, "attempts": attempts, "last_attempt_at": last}
    states = lambda log, now=100_000: [o["state"] for o in stateful.replay(log, now)]
    assert states([op(200), op(404), op(200)]) == ["flushed", "dropped", "flushed"]
    assert states([op(200), op(503), op(200)]) == ["flushed", "pending", "pending"]
    assert states([op(200, 1, 90_000), op(200)]) == ["pending", "pending"] and states([op(200, 1, 10_000)]) == ["flushed"]
    assert stateful.saved([0.1, 0.104, 0.2])[0] == [True, False, True]


def test_settings_as_text():
    from lexmill.plans.rules import Limits

    assert Limits.read({"daily_budget": "", "requests": "0"}) == Limits()
    got = Limits.read({"daily_budget": "0", "requests": "7"})
    assert got.daily_budget == 0 and got.requests == 7


def test_flush_as_windows_equals_replay(spark):
    import random

    from lexmill.streaming import stateful as S

    rng = random.Random(2)
    logs = {u: [{"id": u * 100 + k, "user_id": u, "at": k * 1000, "status": rng.choice([200, 200, 201, 404, 401, 429, 500, 302]), "attempts": rng.choice([0, 0, 1])} for k in range(12)] for u in range(20)}
    now = 70_000
    want = {}
    for log in logs.values():
        for op in S.replay([dict(op, last_attempt_at=op["at"]) for op in log], now):
            want[op["id"]] = (op["state"], op["attempts"])
    df = spark.createDataFrame([op for log in logs.values() for op in log], "id long, user_id long, at long, status int, attempts int")
    from pyspark.sql import functions as F

    assert {r.id: (r.state, r.attempts) for r in S.flushed(df, F.lit(now)).collect()} == want


def test_throttled_progress_equals_its_rule(spark):
    from lexmill.streaming import stateful as S

    values = [0.1, 0.104, 0.106, 0.05, 0.2, 0.2049, 0.206]
    df = spark.createDataFrame([(1, k, k, v) for k, v in enumerate(values)], "user_id long, at long, id long, progress double")
    assert [r.saved for r in S.throttled(df).orderBy("id").collect()] == S.saved(values)[0]


def test_term_files_refuse_an_open_quote(spark, tmp_path):
    from lexmill.sources import readers

    (tmp_path / "good.csv").write_text('Raw,Translation,description\n"a, b",x,#male\n c ,"y ""z"""\n', encoding="utf-8")
    got = {(r.source, r.target, r.gender) for r in readers.term_files(spark, str(tmp_path / "good.csv")).collect()}
    assert got == {("a, b", "x", "masculine"), ("c", 'y "z"', "neuter")}
    (tmp_path / "bad.csv").write_text('source,target\n"a,b\n', encoding="utf-8")
    with pytest.raises(ValueError, match="quote"):
        readers.term_files(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(ValueError, match="more than"):
        readers.term_files(spark, str(tmp_path / "good.csv"), max_rows=1)


def test_exports_in_parts_lie_end_to_end(spark):
    import json

    from lexmill.sources import writers

    books = spark.createDataFrame([("b", "T", None, "A")], "id string, title string, title_target string, author string")
    data = [(k, "b", k * 7, f"t{k}", None, f"c{k}", None) for k in range(9)]
    chapters = spark.createDataFrame(data, "id long, book_id string, seq int, title_source string, title_target string, content_source string, content_target string")
    for kind in ("txt", "md", "json"):
        files = {places: "".join(r.body for r in writers.export_book(books, chapters, kind, places).orderBy("part").collect()) for places in (10, 1000)}
        assert files[10] == files[1000]
        assert kind != "json" or [c["title"] for c in json.loads(files[10])["chapters"]] == [f"t{k}" for k in range(9)]


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from lexmill import runtime

    kept = dict(runtime._LOCAL)
    runtime._LOCAL.clear()
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    try:
        with pytest.raises(RuntimeError):
            runtime.shared_dir(session)
    finally:
        runtime._LOCAL.update(kept)
