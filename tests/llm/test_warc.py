"""WARC: an exact round trip, and transactions whose links go either way."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import queries, warc
from tessella.llm.skew import split_join
from tessella.llm.storage import new_path

SMALL = "/root/testdata/sf0.001"


def test_query(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op6_warc(spark, SMALL).collect()}
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        data = (p.html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        again = len(data) >= 100 and digest in first
        want = (len(data), digest, "revisit" if again else "response", first[digest] if again else None)
        first.setdefault(digest, p.page_id)
        r = got.pop(p.page_id)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == want
    assert not got


def captures(spark, rows):
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    files = [r.file for r in warc.write_warc(docs, new_path(spark, "warc")).collect()]
    return files, warc.assemble(warc.read_records(spark, files)).collect()


def test_round_trip(spark):
    big, other = "é" * 80, "\r\n\r\nx" * 40
    rows = [(3, "http://a/", big), (1, "http://b/", big), (2, None, big), (4, "u\nv", other), (5, "u", None), (6, "u", "short"), (7, "u", "short"), (None, "u", big), (8, "u", "z" * 2_000_000), (8, "u", "z" * 2_000_000)]
    files, got = captures(spark, rows)
    assert len(got) == len(rows) and all(r.request and len(r.metadata) == 1 for r in got)
    found = [(int(r.metadata[0].fields.get("page-id", -1)), r.response.type, None if r.response.payload is None else bytes(r.response.payload).decode()) for r in got]
    want = [(-1, "response", big), (1, "response", big), (2, "revisit", None), (3, "revisit", None), (4, "response", other), (5, "response", ""), (6, "response", "short"), (7, "response", "short")]
    want += [(8, "response", "z" * 2_000_000)] * 2
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_revisits_resolve(spark):
    """A revisit's original is found by its record id alone, checked by digest and length."""
    big = "é" * 80
    rows = [(3, "u", big), (1, "u", big), (2, "u", big), (9, "u", "x" * 100), (None, "u", "x" * 100), (10, "u", "x" * 100)]
    files, _ = captures(spark, rows)
    page = F.try_element_at(F.col("metadata")[0]["fields"], F.lit("page-id")).cast("long")
    found = warc.resolve(warc.assemble(warc.read_records(spark, files)), {"page": page}).select(page.alias("page"), "original.page", "response.payload_bytes").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(3, 1, 160), (1, None, 160), (2, 1, 160), (9, None, 100), (None, None, 100), (10, 9, 100)], key=str)
    lost = warc.assemble(warc.read_records(spark, files).where(F.col("type") != "response"))
    with pytest.raises(Exception, match="no such payload"):
        warc.resolve(lost, {"page": page}).collect()


@pytest.mark.parametrize("per", [3, 1000])
def test_split_join(spark, per):
    left = [(k, i) for k, n in (("a", 20), ("b", 3), ("c", 1), (None, 5)) for i in range(n)]
    right = [("a", 20, "x"), ("b", 3, "y"), ("d", 0, "z")]
    got = split_join(spark.createDataFrame(left, "k string, i long"), spark.createDataFrame(right, "k string, n long, v string"), "k", "n", "i", rows_per_turn=per)
    want = {"a": "x", "b": "y"}
    assert sorted(map(str, ((r.k, r.i, r.v) for r in got.collect()))) == sorted(map(str, ((k, i, want.get(k)) for k, i in left)))


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, payload int, digest int")
    files = warc.write_warc(empty, new_path(spark, "warc")).collect()
    assert files == [] and warc.assemble(warc.read_records(spark, [])).count() == 0


def test_links_either_way(spark):
    row = lambda i, t, to=None: ("f", i, t, to, None, "u", None, None, None, None)
    rows = [row("q1", "request", "r1"), row("r1", "response"), row("m1", "metadata", "q1"), row("q2", "request"), row("r2", "response", "q2"), row("m2", "metadata", "r2"), row("q3", "request", "r3"), row("r3", "response", "q3"), row("m4", "metadata")]
    got = warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()
    found = sorted((r.request and r.request.record_id or "", r.response and r.response.record_id or "", *(m.record_id for m in r.metadata)) for r in got)
    assert found == [("", "", "m4"), ("q1", "r1", "m1"), ("q2", "r2", "m2"), ("q3", "r3")]


def test_damage():
    data = warc.record("response", {"WARC-Record-ID": "a", "WARC-Payload-Digest": "sha256:00"}, b"HTTP/1.1 200 OK\r\n\r\nx")
    with pytest.raises(ValueError, match="digest"):
        list(warc.parse(zlib.decompress(data, 31)))
    import io

    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(io.BytesIO(data[:-9])))
