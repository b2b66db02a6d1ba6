"""Winnowing against a search of every window."""

import random
import re
import time

import corpus_pipeline
import duckdb
import pytest

from tessella.llm import queries
from tessella.llm.decontaminate import Items, decontaminate
from tessella.llm.wordhash import text_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, own in items:
            own = words(own)
            n = min(window, len(own))
            for a in range(len(own) - n + 1) if n else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == own[a : a + n]:
                        hit |= set(range(b, b + n))
                        names.add(str(name))
        out.append((i, len(w), frozenset(hit), tuple(sorted(names))))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_equals_brute_force(spark, limit):
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "É", "d9", "The"]
    text = lambda n: rng.choice([" ", ", "]).join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 14, 25]))) for i in range(12)] + [(50, ""), (51, None), (None, "a"), (3, text(12))]
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)]
    for i in range(40):
        own = words(rng.choice(items[:12])[1])
        docs.append((100 + i, text(rng.randint(0, 15)) + " " + " ".join(own[: rng.randint(1, 25)]).upper() + " " + text(5)))
    docs += [(None, docs[-1][1]), (200, None), (201, ""), (202, docs[-1][1]), (202, docs[-1][1])]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, spans int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, frozenset(p for s in r.spans for p in range(s.start, s.end)), tuple(r["items"])) for r in decontaminate(d, b, broadcast_bytes=limit).collect()]
    assert sorted(got, key=str) == brute(docs, [x for x in items if x[0] is not None])


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_items_without_id(spark, limit):
    items = [(None, "one two three"), (None, "four five"), (7, "four five"), (8, "six")]
    docs = [(1, "zero one two three"), (2, "four five"), (3, "six one two three"), (4, "one two")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: ([tuple(s) for s in r.spans], r["items"]) for r in decontaminate(d, b, broadcast_bytes=limit, null_items=True).collect()}
    assert got == {1: ([(1, 4)], [None]), 2: ([(0, 2)], ["7", None]), 3: ([(0, 4)], ["8", None]), 4: ([], [])}


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_rows_whose_id_and_text_could_be_mixed_up(spark, limit):
    """A null id before "1:a b" is not id 1 before "a b"."""
    own = " ".join(f"w{i}" for i in range(12))
    docs = [(None, f"1:{own}"), (1, own), (1, f"1:{own}"), (None, own), (11, f":{own}"), (1, f"1:{own} x")]
    items = [(None, own), (1, f"1 {own}"), (2, "1:w0"), (3, "!?"), (4, ""), (5, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, frozenset(p for s in r.spans for p in range(s.start, s.end)), tuple(r["items"])) for r in decontaminate(d, b, broadcast_bytes=limit).collect()]
    assert sorted(got, key=str) == brute(docs, [x for x in items if x[0] is not None])


def test_many_short_items_are_not_broadcast(spark, monkeypatch):
    """Rows count, not only texts; rows without words don't."""
    from tessella.llm import decontaminate as module

    ways = []
    for way in ("_by_broadcast", "_by_shuffle"):
        monkeypatch.setattr(module, way, lambda docs, *rest, way=way: ways.append(way) or docs)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for text in ("a", " . "):
        items = spark.range(1000).selectExpr("id as item_id", f"'{text}' as text")
        module.decontaminate(docs, items, broadcast_bytes=50_000)
    assert ways == ["_by_shuffle", "_by_broadcast"]


def test_repeated_words_take_linear_time():
    texts = [b"a " * 60_000, b"b c " * 30_000]
    index = Items([("x", b"a " * 3_000), ("y", b"b c " * 1_500), *((str(i), b"a " * 40) for i in range(300))], 10, 5)
    began = time.process_time()
    spans, names = index.hits(*text_words(texts))
    assert spans == [[(0, 60_000)], [(0, 60_000)]] and len(names[0]) == 301 and names[1] == ["y"]
    assert time.process_time() - began < 5


@pytest.fixture
def tables(spark, tmp_path):
    """Documents with a window of an item without an id, and the benchmark."""
    window = " ".join("abcdefghijkl")
    docs = [(1, f"x {window} y"), (2, "x y"), (3, f"{window} of another")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, window), (5, f"{window} of")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_query_and_pipeline_with_items_without_id(spark, tables):
    want = duckdb.connect()
    for name in ("documents", "benchmark"):
        want.execute(f"create view {name} as select * from '{tables}/{name}.parquet/*.parquet'")
    got = queries.op8_decontaminate(spark, tables)
    assert sorted(map(tuple, got.collect())) == sorted(want.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL['op8_decontaminate']})").fetchall())
    kept = corpus_pipeline.decontaminate(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables)
    assert [r.doc_id for r in kept.collect()] == [2]


def test_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "word " * 12)], "item_id long, text string")
    got = decontaminate(odd, items).collect()
    assert len(got) == odd.count() and sum(len(r.spans) for r in got) == 1
    assert decontaminate(none, items).count() == 0 and decontaminate(odd, items.limit(0)).count() == odd.count()
