import codecs
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kindred.llm import bpe
from kindred.llm.queries import op4_bpe_codec, word_bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(word_bpe())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_bpe())


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_proper_list_with_bounded_lookahead(codec):
    assert codec.transducer.proper and 0 < codec.transducer.lookahead < 2000


LIBRARY = Tokenizer.from_file(word_bpe())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'stredlvm<|>endoftext")), max_size=60))
def test_like_the_library(text):
    assert ids(bpe.codec(word_bpe()).encode(text)) == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["a", "ab", "thein", "é", "日本", "!?"])
@pytest.mark.parametrize("size", [1366, 2735, 9000])
def test_long_words_stream(codec, library, letters, size):
    text = "".join(random.Random(size).choices(letters, k=size))
    assert ids(codec.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_stream_in_parts(codec):
    transducer = codec.transducer
    word = "".join(random.Random(1).choices("thean", k=12_000)).encode()
    whole = transducer.merge(transducer.symbols(word, True))
    for step in (1, 777, 5000):
        found = list(transducer.stream(word[i : i + step] for i in range(0, len(word), step)))
        assert "".join(found) == whole and max(map(len, found)) <= 2 * transducer.window + 1


def test_short_and_long_merging_agree(codec):
    rng = random.Random(2)
    for _ in range(2000):
        word = codec.transducer.symbols("".join(rng.choices("theanisr'é", k=rng.randint(1, 30))).encode(), True)
        assert codec.transducer.merge(word) == codec.transducer._merge_long(list(word))


def test_added_tokens(codec, library):
    for text in ("a<|endoftext|>b", "<|startoftext|>", "x <|endoftext|> y<|", ""):
        e = library.encode(text, add_special_tokens=False).ids
        assert ids(codec.encode(text)) == e and codec.decode(codec.encode(text)) == library.decode(e, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_byte_text_machine(data, step):
    machine = bpe.ByteTextMachine()
    text = "".join(machine.feed(data[i : i + step]) for i in range(0, len(data), step)) + machine.end()
    assert text == codecs.decode(data, "utf-8", "replace")


def test_stream_decoder(codec):
    decoder = bpe.StreamDecoder(codec, readable=True)
    found = ids(codec.encode("Hello wörld 日本"))
    assert "".join(decoder.feed([i]) for i in found) + decoder.end() == "hello wörld 日本 "


def test_query(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op4_bpe_codec(spark, sf).collect():
        e = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (2, "", 7), (2, "", 7)], "doc_id long, text string, ids int")
    got = bpe.encode_decode(df, word_bpe()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in got) == [(0, 2, "a</w> b</w>"), (1, 0, ""), (2, 0, ""), (2, 0, "")]
    assert bpe.encode_decode(df.limit(0), word_bpe()).count() == 0


def test_ids_and_text_come_through_transducer_and_machine(library, monkeypatch):
    codec = bpe.Codec(word_bpe())
    streamed, fed = [], []
    stream, feed = bpe.MergeTransducer.stream, bpe.ByteTextMachine.feed
    monkeypatch.setattr(bpe.MergeTransducer, "stream", lambda self, parts: stream(self, streamed.append(list(parts)) or streamed[-1]))
    monkeypatch.setattr(bpe.ByteTextMachine, "feed", lambda self, data: fed.append(data) or feed(self, data))
    text = "Streams of words, größer 日本 words"
    found = codec.encode(text)
    assert ids(found) == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(found) == library.decode(ids(found), skip_special_tokens=False) == b"".join(fed).decode()
    assert {p.decode() for parts in streamed for p in parts} == {"streams", "of", "words", ",", "größer", "日本"}


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab é日\n\u0301"), max_size=80), st.integers(0, 9))
def test_portions(text, size):
    codec = bpe.codec(word_bpe())
    assert ids(b"".join(codec.portions(text, size))) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_other_files_are_refused():
    from public_tokenizers import path

    with pytest.raises(ValueError):
        bpe.Codec(path("byte_bpe_50k.json"))
