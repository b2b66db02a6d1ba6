"""SentencePiece: best scores against a plain dynamic program, and an exact round trip."""

import random
import tracemalloc

import pytest
import sentencepiece

from tessella.llm import pieces, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.default_model())


def best(model, known, text):
    """(score, ids) over the whole prepared text, without cutting it into words."""
    text = pieces.prepared(model, text)
    at = [(0.0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        raw = text[end - 1].encode()
        top = (at[end - 1][0] + pieces.BYTE_SCORE * len(raw), at[end - 1][1] + [int(model.bytes[b]) for b in raw])
        for n in range(1, min(end, model.longest) + 1):
            i = known.get(text[end - n : end])
            if i is not None and at[end - n][0] + model.scores[i] >= top[0]:
                top = (at[end - n][0] + model.scores[i], at[end - n][1] + [i])
        at[end] = top
    return at[-1]


def test_scores_and_round_trip(model, texts):
    known = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (pieces.NORMAL, pieces.USER)}
    rng = random.Random(10)
    parts = ["the", "The", " ", "  ", "   ", "\n", "é", "ñ", "漢", "🎉", "\x00", "ing", "Paris", "12", "été", "▁", "ﬁ", "퟿", "."]
    cases = [t[:1500] for _, t in texts[:60]] + ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(400)]
    ids, ends = pieces.Encoder(pieces.default_model()).encode(cases)
    for n, t in enumerate(cases):
        own = ids[ends[n] : ends[n + 1]].tolist()
        assert own == best(model, known, t)[1], repr(t)
        assert pieces.decode(model, own) == t.replace("▁", " ")


def test_no_piece_crosses_a_cut(model):
    assert not [p for p, k in zip(model.pieces, model.kinds) if k == pieces.NORMAL and (any(a != "▁" and b == "▁" for a, b in zip(p, p[1:])) or len(model.part.findall(p)) != 1)]


def test_pieces_equal_the_library(model):
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert model.pieces == [own.id_to_piece(i) for i in range(own.vocab_size())]
    assert all(abs(model.scores[i] - own.get_score(i)) < 1e-6 for i in range(own.vocab_size()))
    assert own.decode(pieces.Encoder(pieces.default_model()).encode(["a test of\nwords é🎉"])[0].tolist()) == "a test of\nwords é🎉"


def test_query(spark, texts):
    rows = {r.doc_id: r for r in queries.op3_pieces(spark, SMALL).collect()}
    assert len(rows) == len(texts) and all(r.round_trip for r in rows.values())
    ids, ends = pieces.Encoder(pieces.default_model()).encode([t for _, t in texts])
    assert [rows[i].n_tokens for i, _ in texts] == (ends[1:] - ends[:-1]).tolist()


def test_odd(odd, none):
    rows = [r for r in pieces.decoded(pieces.encode(odd)).collect()]
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(r.doc_id), str(r.text)) for r in odd.collect())
    assert pieces.encode(none).count() == 0


def test_cache_restarts(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 4)
    a, b = pieces.Encoder(pieces.default_model()), pieces.Encoder(pieces.default_model())
    for t in ("a b c", "d e f g h i j", "a", ""):
        assert a.encode([t])[0].tolist() == b.encode([t, t])[0][: len(a.encode([t])[0])].tolist()


def test_round_trip_is_exact(spark):
    """A text with the sign that stands for blanks decodes to blanks, which is told."""
    docs = spark.createDataFrame([(1, "a b"), (2, "a\u2581b"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.round_trip for r in pieces.round_trips(docs).collect()} == {1: True, 2: False, 3: None, 4: True}


def test_memory_follows_groups_of_texts(model):
    """Of a batch's words only numbers are held: the words of all its texts at once would take some 100 bytes each."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=1000)) for _ in range(400)]
    encoder = pieces.Encoder(pieces.default_model())
    encoder.encode([" ".join(words)])
    tracemalloc.start()
    ids, ends = encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 + 2 * ids.nbytes
    plain = pieces.Encoder(pieces.default_model())
    assert all(ids[ends[i] : ends[i + 1]].tolist() == plain.encode([texts[i]])[0].tolist() for i in range(0, 400, 40))


def test_words_met_again_are_kept(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_WORDS", 8)
    monkeypatch.setattr(pieces, "GROUP_TEXT", 10)
    encoder = pieces.Encoder(pieces.default_model())
    texts = ["the the cat", "sat on a", "", "mat the cat one two", "three four"]
    for again in range(3):
        ids, ends = encoder.encode(texts)
        for i, t in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == pieces.Encoder(pieces.default_model()).encode([t])[0].tolist()
        encoder._forget()
        assert list(encoder.known.items()) == [("▁the", 0), ("▁cat", 1)]
