import hashlib
import time

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import bpe_codec, token_counts

ODD = ["", " ", "a", "  a  \n\n b", "Hi<|endoftext|> there <|endoftext|><|endof", "x" * 500, " " * 300 + "y", "don't DON'T 's", "ΑΣ ΟΔΟΣ İ ǅ", "日本語 한국어 é é", "\x1c\x85 a​b", "½ ² ٣ 12,5", "😀 a😀b", "́x", "<|startoftext|>q<|endoftext|>"]


@pytest.fixture(scope="module")
def small():
    return token_counts.ChunkCounter(P.path("byte_bpe_50k.json"), chunk=48, overlap=6)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


LETTERS = st.text(st.one_of(st.sampled_from(" \n\tabcéß'12.,!#<|>σΣ한é😀"), st.characters(codec="utf-8")), max_size=300)


@settings(max_examples=300, deadline=None)
@given(st.one_of(LETTERS, st.lists(st.sampled_from(["<|endoftext|>", "<|endof", " ", "   ", "\n", "word", "'s", "éé", "1234567", "!!", "a" * 30, " " * 40]), max_size=40).map("".join)))
def test_chunks_count_as_the_library(small, library, text):
    assert small.count(text) == len(library.encode(text, add_special_tokens=False))


def test_odd_texts(small, library, codec, word_library):
    for t in ODD + ["".join(ODD) * 3]:
        assert small.count(t) == len(library.encode(t, add_special_tokens=False)), t
        assert codec.ids(t) == word_library.encode(t, add_special_tokens=False).ids, t


def test_many_distinct_characters(library, codec, word_library):
    text = "".join(map(chr, range(0x4E00, 0x4E00 + 20_000)))
    counter = token_counts.ChunkCounter(P.path("byte_bpe_50k.json"))
    began = time.process_time()
    assert counter.characters.all_alike(text) and codec.characters.all_alike(text)
    assert time.process_time() - began < 4  # one pass; about a second on a quiet machine
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False))
    assert codec.ids(text) == word_library.encode(text, add_special_tokens=False).ids


def test_characters_that_differ_go_to_the_library(library, codec, word_library):
    signs = [chr(c) for c in range(0x80, 0x3400) if not 0xD800 <= c < 0xE000]
    text = " ".join("".join(signs[i : i + 3]) for i in range(0, len(signs), 3))
    counter = token_counts.ChunkCounter(P.path("byte_bpe_50k.json"))
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False))
    assert codec.ids(text) == word_library.encode(text, add_special_tokens=False).ids


def test_one_trie_for_all_texts_of_a_batch(codec, word_library):
    texts = ["the then there", "", "thereof then " + "x" * 300, "<|endoftext|> there", "éé there"]
    ids = [word_library.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(codec.encode(texts)) == ids
    assert [codec.decode(i) for i in ids] == [word_library.decode(i, skip_special_tokens=False) for i in ids]


def test_long_texts_in_segments(spark, word_library):
    text = ("lorem <|endoftext|>ipsum\n" * 40 + "y" * 500 + " ") * 90
    assert "".join(bpe_codec.segments(text, 100)) == text
    assert [i for part in bpe_codec.segments(text, 100) for i in word_library.encode(part, add_special_tokens=False).ids] == word_library.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, text * 15), (2, "b"), (3, text)], "doc_id long, text string")  # over a million characters
    got = {r.doc_id: r for r in bpe_codec.encode(docs, P.path("word_bpe_49k.json"), digest=True).collect()}
    for k, t in ((1, text * 15), (2, "b"), (3, text)):
        ids = word_library.encode(t, add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(word_library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_overlaps_widen(small):
    n, places, widened = small._spliced("ab " * 10 + "x" * 200 + " cd" * 300)
    assert widened >= 1 and places
    assert n == len(small.tok.encode("ab " * 10 + "x" * 200 + " cd" * 300, add_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.one_of(LETTERS, st.lists(st.sampled_from(["<|endoftext|>", " ", "the", "thering", "ééa", "123", "!!", "a" * 30, "IN", "tion"]), max_size=40).map("".join)))
def test_codec_is_the_library(codec, word_library, text):
    e = word_library.encode(text, add_special_tokens=False)
    assert codec.ids(text) == e.ids
    assert codec.decode(e.ids) == word_library.decode(e.ids, skip_special_tokens=False)


def test_on_documents(spark, library, word_library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    counted = token_counts.query(spark, "/root/testdata/sf0.01").collect()
    coded = {r.doc_id: r for r in bpe_codec.query(spark, "/root/testdata/sf0.01").collect()}
    assert len(counted) == len(coded) == len(texts)
    for r in counted:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
        e = word_library.encode(texts[r.doc_id], add_special_tokens=False).ids
        c = coded[r.doc_id]
        assert (c.n_tokens, c.ids_sha256) == (len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest())
        assert c.decoded_sha256 == hashlib.sha256(word_library.decode(e, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (None, "hi there", "z"), (2, "", "z")], "doc_id long, text string, ids string")
    where = P.path("byte_bpe_50k.json")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, where).collect())
    assert got == [("1", 0, 0), ("1", 0, 0), ("2", 0, 0), ("None", 8, 2)]
    assert token_counts.count_tokens(docs.limit(0), where).count() == 0
    file = P.path("word_bpe_49k.json")
    coded = bpe_codec.encode(docs, file)
    assert sorted((str(r.doc_id), list(r.ids)) for r in coded.collect()) == [("1", []), ("1", []), ("2", []), ("None", [1883, 997])]
    assert {r.text for r in bpe_codec.decode(coded, file).collect()} == {"", "hi</w> there</w>"}
    assert {r.text for r in bpe_codec.decode(coded, file, readable=True).collect()} == {"", "hi there"}
    assert bpe_codec.encode(docs.limit(0), file, digest=True).count() == 0


@pytest.mark.parametrize("run", ["ab", "日本", "12", "-=", "́é", "  "])
def test_unbroken_text_takes_linear_time(library, run):
    """A run of one class is cut and counted in time that grows as the text, and counts as the library does."""
    counter = token_counts.ChunkCounter(P.path("byte_bpe_50k.json"))
    text = run * 100_000
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False))
    times = []
    for n in (250_000, 1_000_000):
        began = time.process_time()
        counter.counts.clear()
        counter.count(run * n)
        times.append(time.process_time() - began)
    assert times[1] < 12 * max(times[0], 0.1)  # 16 would be the square
