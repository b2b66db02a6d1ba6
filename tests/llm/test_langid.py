"""Language ID: Viterbi against all paths, held-out accuracy, mixed texts and scripts."""

import itertools
import zlib

import numpy as np
import pytest

from tessella.llm import langid, queries

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{MIDDLE}/documents.parquet").where(~langid.held_out()))


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = queries.op7_language(spark, MIDDLE).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 200 and sum(docs[r.doc_id] == r.lang_pred for r in out) >= 0.98 * len(out)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(11)
    counts = np.array([3, 0, 1, 6, 5])
    scores = rng.normal(0, 6, (counts.sum(), 3)).astype(np.float32)
    found, at = langid.viterbi(scores, counts), 0
    for n in counts:
        def value(path, at=at):
            return sum(scores[at + i, k] for i, k in enumerate(path)) - langid.PENALTY * sum(a != b for a, b in zip(path, path[1:]))
        if n:
            best = max(value(p) for p in itertools.product(range(3), repeat=int(n)))
            assert abs(value(found[at : at + n]) - best) < 1e-3
        at += n


def test_spans_of_mixed_text(spark, model):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").where(langid.held_out())
    texts = {lang: " ".join(docs.where(f"lang = '{lang}' and not text rlike '[%$&*#!]'").first().text.split()[:60]) for lang in ("en", "de", "fr")}
    text = f"{texts['en']}\n{texts['de']}\n{texts['fr']}"
    _, score, spans = langid.label(model, [text])[0]
    assert [s[0] for s in spans] == ["en", "de", "fr"] and score < 0.7
    bounds = [len(texts["en"]), len(texts["en"]) + 1 + len(texts["de"])]
    assert all(abs(s[2] - b) < 40 for s, b in zip(spans, bounds))


def test_scripts():
    rows = [("en", "the quick brown fox"), ("ru", "быстрая лиса прыгает"), ("el", "γρήγορη αλεπού")]
    grams = np.zeros((1 << langid.GRAM_BITS, 3))
    seen = np.zeros((langid.SCRIPTS, 3), bool)
    for i, (_, t) in enumerate(rows):
        w = langid.words([t.encode()])
        np.add.at(grams[:, i], w.grams, 1)
        seen[w.script, i] = True
    assert seen[1].tolist() == [True, False, False] and seen[3].tolist() == [False, True, False] and seen[2].tolist() == [False, False, True]
    model = langid.Model(("en", "ru", "el"), np.log(grams + 0.1).astype(np.float32), seen)
    assert [x[0] for x in langid.label(model, ["лиса", "αλεπού", "zzz", "漢字", "12 !", None, "🎉"])] == ["ru", "el", "en", "en", "und", "und", "und"]
    assert langid.label(model, ["漢字"])[0] == ("en", 0.0, [])
    assert langid._scripts(np.frombuffer("aé漢한か🎉я".encode(), np.uint8))[np.frombuffer("aé漢한か🎉я".encode(), np.uint8) & 0xC0 != 0x80].tolist() == [1, 1, 11, 12, 10, 0, 3]


def test_long_and_grouped_texts_agree(model):
    texts = ["the and of " * 20_000, "der die das und", "le la les et", "a"] * 3
    assert langid.label(model, texts) == [langid.label(model, [t])[0] for t in texts]


def test_odd(odd, none, model):
    rows = langid.predict(odd, model).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (1, 2, 4)} == {"und"}
    assert langid.predict(none, model).count() == 0
    empty = langid.fit(none)
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}


def plain_words(text):
    """(byte bounds, bytes with blanks around, script class) of runs of letters, character by character."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in text)
    out, run, at = [], [], 0
    for c in [*lower, " "]:
        if "a" <= c <= "z" or ord(c) >= 128:
            run.append(c)
        elif run:
            word = "".join(run)
            size = len(word.encode())
            out.append((at - size, at, b" " + word.encode() + b" "))
            run = []
        at += len(c.encode())
    return out


def plain_grams(word):
    """Hashes of the bytes up to each byte behind the first, four at most, a nought byte for what is missing."""
    for i in range(1, len(word)):
        code = word[i]
        for k in (1, 2, 3):
            code = (code * 0x01000193 & 0xFFFFFFFF) ^ (word[i - k] if i - k >= 0 else 0)
        yield (code * 0x9E3779B1 & 0xFFFFFFFF) >> 16


def test_label_equals_plain_version(spark, texts):
    """Counts, log probabilities, candidates and the best path, from characters and dictionaries alone (Latin texts)."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    train = [(t, lang) for i, t, lang in rows if t and lang and zlib.crc32(str(i).encode()) % 4 != 2]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string").selectExpr("0 as doc_id", "text", "lang"))
    counts = {}
    for t, lang in train:
        for _, _, w in plain_words(t):
            for g in plain_grams(w):
                own = counts.setdefault(lang, {})
                own[g] = own.get(g, 0) + 1
    total = {k: sum(c.values()) for k, c in counts.items()}
    assert model.languages == tuple(sorted(total, key=lambda k: (-total[k], k)))
    logs = {k: {g: np.log((n + 0.3) / (total[k] + 0.3 * 65536)) for g, n in c.items()} for k, c in counts.items()}
    none = {k: np.log(0.3 / (total[k] + 0.3 * 65536)) for k in counts}
    agree = 0
    for _, t, _ in rows[:40]:
        own = plain_words(t or "")
        if not own:
            continue
        best, back = None, []
        for _, _, w in own:
            score = {k: 0.5 * sum(logs[k].get(g, none[k]) for g in plain_grams(w)) for k in model.languages}
            if best is None:
                best = score
                continue
            top = max(model.languages, key=lambda k: best[k])
            came = {k: top if best[top] - 8 > best[k] else k for k in model.languages}
            back.append(came)
            best = {k: score[k] + max(best[k], best[top] - 8) for k in model.languages}
        path = [max(model.languages, key=lambda k: best[k])]
        for came in reversed(back):
            path.append(came[path[-1]])
        size = dict.fromkeys(model.languages, 0)
        for (a, b, _), k in zip(own, reversed(path)):
            size[k] += b - a
        lang, score, spans = langid.label(model, [t])[0]
        assert score == pytest.approx(size[lang] / sum(size.values()), abs=1e-9) and size[lang] == max(size.values())
        assert sum(b - a for _, a, b in spans) > 0
        agree += 1
    assert agree > 30
