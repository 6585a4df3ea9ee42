import hashlib

import pytest

from chronostrata.functions import digests

# Published BLAKE3 digests of nothing, "abc", and of i % 251 at some lengths.
KNOWN = {
    b"": "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    b"abc": "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85",
}


@pytest.mark.parametrize("data", sorted(KNOWN))
def test_known_digests(data):
    assert digests.blake3(data) == KNOWN[data]




def test_silence_fixture():
    assert hashlib.sha256(bytes(2048 * 2)).hexdigest() == "ad7facb2586fc6e966c004d7d1d16b024f5805ff7cb47c7a85dabd8b48892ca7"


# Published digests of input[i] = i % 251.
COUNTED = {
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    4096: "015094013f57a5277b59d8475c0501042c0b642e531b0a1c8f58d2163229e969",
    16384: "f875d6646de28985646f34ee13be9a576fd515f76b5b0a26bb324735041ddde4",
}


@pytest.mark.parametrize("n", sorted(COUNTED))
def test_counted_digests(n):
    assert digests.blake3(bytes(i % 251 for i in range(n))) == COUNTED[n]


def test_piece_by_piece_and_side_by_side():
    import random

    from chronostrata.functions import digests as d

    random.seed(2)
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 5000, 31744, 102400]
    objects = [bytes(i % 251 for i in range(n)) for n in sizes]
    assert d.blake3_all(objects) == [d.blake3(x) for x in objects]
    whole = bytes(random.randrange(256) for _ in range(70000))
    for subtree in (1, 2, 4, 16):
        for n in (0, 1, 1024, 1025, 2048, 4096, 4097, 16384, 16385, 70000):
            h = d.Blake3()
            h.SUBTREE = subtree
            at = 0
            while at < n:
                step = random.randrange(1, 5000)
                h.update(whole[at : min(n, at + step)])
                at += step
            assert h.hexdigest() == d.blake3(whole[:n]), (subtree, n)
    h = d.Blake3()
    h.update(b"a")
    h.zeros(600_000)
    assert h.hexdigest() == d.blake3(b"a" + bytes(600_000))
