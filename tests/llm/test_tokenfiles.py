"""Token files: exact against the library, an exact round trip, zero-copy rows."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessella.llm import queries, tokenfiles
from tessella.llm.storage import new_path

SMALL = "/root/testdata/sf0.001"


def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_pieces_equal_whole_texts(texts):
    rng = random.Random(4)
    parts = ["The", "it's", "'LL", "é", "é", " ", "  ", "\n", "　", "\xa0", "́", "<|endoftext|>", "<|ENDOFTEXT|>", "12", "Σ", "ΟΔΟΣ", "İ", "🎉", "\x00", "\x1c", "\t", "_", "...", "don't", "漢字"]
    cases = [t for _, t in texts] + ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    ids, begins = tokenfiles.Encoder(public_tokenizers.path("word_bpe_49k.json")).encode([t.encode() for t in cases], 2)
    own = library()
    for i, t in enumerate(cases):
        assert ids[begins[i] : begins[i + 1]].tolist() == own.encode(t, add_special_tokens=False).ids + [2], repr(t)


def test_other_tokenizers_take_whole_texts(texts):
    """Whether words may be encoded apart is read from the tokenizer's file."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, own = tokenfiles.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.whole_words and tokenfiles.Encoder(public_tokenizers.path("word_bpe_49k.json")).whole_words
    cases = [t for _, t in texts[:20]] + ["  Two  blanks ", "UPPER lower", ""]
    ids, begins = encoder.encode([t.encode() for t in cases], 2)
    assert all(ids[begins[i] : begins[i + 1]].tolist() == own.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(cases))


def test_cache_restarts(monkeypatch):
    monkeypatch.setattr(tokenfiles, "CACHED_WORDS", 5)
    encoder, own = tokenfiles.Encoder(public_tokenizers.path("word_bpe_49k.json")), library()
    for t in ("a b c d", "e f g a", "h i j k l m n o p q r s t u v", "a", ""):
        assert encoder.encode([t.encode()], 2)[0].tolist() == own.encode(t, add_special_tokens=False).ids + [2]


def test_query(spark, texts):
    got = {r.doc_id: r for r in queries.op1_token_files(spark, SMALL).collect()}
    own, start = library(), 0
    for i, t in sorted(texts):
        ids = own.encode(t, add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_rows_and_views(spark, texts):
    path = new_path(spark, "tokens")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    manifest = tokenfiles.write_token_files(docs, path, length=64, rows=4).collect()
    own = library()
    want = [i for _, t in sorted(texts) for i in (*own.encode(t, add_special_tokens=False).ids, 2)]
    found = []
    for m in sorted(manifest):
        reader = tokenfiles.open_shard(path, "sequences", m.shard)
        n = -(-m.tokens // 64)
        for row in random.Random(5).sample(range(n), n):
            ids, mask = tokenfiles.sequence(reader, row)
            assert len(ids) == len(mask) == 64 and not ids.flags.owndata
        found += [i for row in range(n) for i in (lambda ids, mask: ids[mask])(*tokenfiles.sequence(reader, row)).tolist()]
        assert reader.schema.field("ids").type.list_size == 64
    assert found == want and sum(m.tokens for m in manifest) == len(want)


def test_odd(spark, odd, none):
    path = new_path(spark, "tokens")
    tokenfiles.write_token_files(odd, path)
    rows = tokenfiles.read_token_files(spark, path).orderBy("start").collect()
    assert len(rows) == odd.count() and [r.id for r in rows[:2]] == [None, None]
    assert [r.n_tokens for r in rows if r.id in (1, 2, 4)] == [1, 1, 1]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    path = new_path(spark, "tokens")
    assert tokenfiles.write_token_files(none, path).count() == 0 and tokenfiles.read_token_files(spark, path).count() == 0
