import random

import public_tokenizers
import pytest
import tiktoken

from chronostrata.llm import byte_bpe as b

PATH = public_tokenizers.path(b.VOCABULARY)


@pytest.fixture(scope="module")
def both():
    return b.Encoder(PATH), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.ranks_of(PATH), special_tokens={})


def test_random_texts(both):
    random.seed(3)
    for _ in range(3000):
        text = "".join(random.choice("abcthe éñ日本語🎉'\n\t  \x00 0123中文ü<|end|>") for _ in range(random.randint(0, 60)))
        assert both[0].encode(text) == both[1].encode_ordinary(text), repr(text)


def test_long_runs_and_bounded_tables(both):
    small = b.Encoder(PATH)
    small.transducer.max_states, small.chunks.most = 50, 20
    random.seed(5)
    for text in ["a" * 20000, " " * 3000, "theringand" * 900, "".join(random.choice("theringandofa") for _ in range(9000))]:
        assert both[0].encode(text) == small.encode(text) == both[1].encode_ordinary(text)


def test_pairs_by_definition(both):
    t = both[0].transducer
    random.seed(1)
    ids = list(t.spelled)
    for _ in range(5000):
        x, y = random.choice(ids), random.choice(ids)
        assert t.may_follow(x, y) == (t.merged(t.spelled[x] + t.spelled[y]) == [t.spelled[x], t.spelled[y]])


@pytest.mark.parametrize("chunk", [1, 2, 3, 7])
def test_utf8_stream_cut_anywhere(chunk):
    text = "aé日🎉߿￿" * 20
    stream, data = b.Utf8Stream(), text.encode()
    assert "".join([*(stream.feed(data[i : i + chunk]) for i in range(0, len(data), chunk)), stream.finish()]) == text


def test_ill_formed_bytes():
    stream = b.Utf8Stream()
    assert stream.feed(b"a\xe6\x97") == "a" and stream.finish() == "�"
    assert b.Utf8Stream().feed(b"\xff\x80a") == "��a"
