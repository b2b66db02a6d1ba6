"""The pipeline's stages against plain versions of their decisions."""

import corpus_pipeline
from tessella.llm import langid, pieces
from test_decontaminate import brute as brute_leaks
from test_neardup import brute as brute_classes
from test_spans import brute_secrets

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = docs.where("lang = 'en' and n_chars > 500").first()
    text = " ".join(reversed(first.text.split())) + " password=Zx9kQw81Lm0pAA."
    docs = docs.union(spark.createDataFrame([first.asDict() | {"doc_id": 100_000, "text": text, "n_chars": len(text)}], docs.schema))
    model = langid.fit(docs.where(~langid.held_out()))
    rows = {r.doc_id: r for r in docs.collect()}
    labels = dict(zip(rows, langid.label(model, [r.text for r in rows.values()])))
    want = {i: r.text for i, r in rows.items() if labels[i][0] != "und" and labels[i][1] >= 0.4}
    stages, kept = dict(corpus_pipeline.STAGES), docs
    assert len(corpus_pipeline.STAGES) == 5

    def step(name):
        out = stages[name](spark, kept, SMALL).cache()
        assert out.columns == docs.columns and out.schema == docs.schema
        return out

    kept = step("language")
    assert {r.doc_id: r.text for r in kept.collect()} == want
    classes = brute_classes(sorted(want.items()))
    want = {i: t for i, t in want.items() if classes[i] == i}
    kept = step("near_duplicates")
    assert {r.doc_id: r.text for r in kept.collect()} == want and kept.count() == len(want)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaks = {x[0] for x in brute_leaks(sorted(want.items()), items) if x[2]}
    want = {i: t for i, t in want.items() if i not in leaks}
    kept = step("decontaminate")
    assert {r.doc_id: r.text for r in kept.collect()} == want and leaks
    kept = step("secrets")
    got = {r.doc_id: r for r in kept.collect()}
    assert got.keys() == want.keys()
    changed = {i for i, t in want.items() if got[i].text != t}
    assert changed and all(brute_secrets(want[i]) and "[SECRET]" in got[i].text and got[i].n_chars == len(got[i].text) for i in changed)
    assert all(rows[i].n_chars == got[i].n_chars for i in want if i not in changed)
    out = {r.doc_id: r for r in stages["pieces"](spark, kept, SMALL).collect()}
    encoder = pieces.Encoder(pieces.default_model())
    assert out.keys() == want.keys() and all(r.round_trip and list(r.ids) == encoder.encode([got[i].text])[0].tolist() for i, r in out.items())


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)


def test_odd(spark, odd, none):
    docs = odd.unionByName(odd.withColumn("doc_id", odd.doc_id + 100))
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, none, SMALL).count() == 0
        assert stage(spark, docs, SMALL).count() <= docs.count()
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()
    texts = [r.text or "" for r in kept]
    assert len(set(texts)) == len(texts) and set(texts) == {r.text or "" for r in docs.collect()}
