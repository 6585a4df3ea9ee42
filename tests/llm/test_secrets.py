import base64
import bz2
import gzip
import hashlib
import lzma
import urllib.parse
import zlib

import pytest
import zstandard

from chronostrata.llm import secrets as x

S = "password=hunter2secret"


def b64(s):
    return base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()


LAYERS = {
    "base64": b64(S),
    "url-safe": base64.urlsafe_b64encode(S.encode()).decode(),
    "base64 twice": b64(b64(S)),
    "quoted base64": urllib.parse.quote(b64(S)),
    "escapes": "".join(f"%{ord(c):02x}" for c in S),
    "escapes twice": "".join(f"%25{ord(c):02x}" for c in S),
    "unicode": "".join(f"\\u{ord(c):04x}" for c in S),
    "references": "".join(f"&#{ord(c)};" for c in S),
    "gzip": b64(gzip.compress(S.encode())),
    "zlib of base64": b64(zlib.compress(b64(S).encode())),
    "zstd": b64(zstandard.compress(S.encode())),
    "bz2": b64(bz2.compress(S.encode())),
    "xz": b64(lzma.compress(S.encode())),
    "escaped zlib": "".join(f"%{c:02x}" for c in zlib.compress(S.encode())),
}


@pytest.mark.parametrize("name", LAYERS)
def test_layers_are_found_where_they_stand(name):
    text = f"é before {LAYERS[name]} after"
    base, found = x.find(text)
    assert base == [] and any(k == "assign" for k, _, _ in found)
    k, a, b = next(s for s in found if s[0] == "assign")
    assert 9 <= a < b <= 9 + len(LAYERS[name])
    assert S not in x.redacted(text, found) and LAYERS[name] not in x.redacted(text, found)


MEMBERS = {
    "gzip": gzip.compress(b"nothing") + gzip.compress(S.encode()),
    "gzip, padded": gzip.compress(b"nothing") + bytes(512) + gzip.compress(S.encode()),
    "zlib": zlib.compress(b"nothing") + zlib.compress(S.encode()),
    "bz2": bz2.compress(b"nothing") + bz2.compress(S.encode()),
    "xz": lzma.compress(b"nothing") + lzma.compress(S.encode()),
    "zstd": zstandard.compress(b"nothing") + zstandard.compress(S.encode()),
    "gzip, then bz2": gzip.compress(b"nothing") + bz2.compress(S.encode()),
}


@pytest.mark.parametrize("name", MEMBERS)
def test_all_members_are_read(name):
    code = b64(MEMBERS[name])
    assert x.find(f"é {code} after")[1] == [("assign", 2, 2 + len(code))]


def test_secrets_among_binary_data_are_found():
    code = b64(bytes(range(128, 192)) + S.encode() + bytes(40))
    assert [k for k, _, _ in x.find(code)[1]] == ["assign"]


def test_padding_goes_with_the_run():
    for tail in ("", "x", "xy"):
        code = b64(S + tail)
        assert x.redacted(f"a {code} b", x.find(f"a {code} b")[1]) == "a [assign] b"


def test_redacted_texts_hold_no_planted_secret():
    import random

    random.seed(11)
    wraps = [b64, lambda s: b64(gzip.compress(s.encode())), lambda s: b64(zlib.compress(s.encode())), lambda s: urllib.parse.quote(s, safe=""), lambda s: "".join(f"%{c:02X}" for c in s.encode()), lambda s: "".join(f"\\u{ord(c):04x}" for c in s)]
    for _ in range(300):
        parts, planted = [], 0
        for _ in range(random.randint(1, 6)):
            parts.append(" ".join(random.choice(["river", "stone", "light", "über", "日本"]) for _ in range(random.randint(1, 9))))
            if random.random() < 0.7:
                s = random.choice(["password=", "api_key: ", "Token = '"]) + "".join(random.choice("abcdefghijkXYZ0123456789") for _ in range(random.randint(8, 24)))
                for _ in range(random.randint(0, 3)):
                    s = random.choice(wraps)(s)
                parts.append(s)
                planted += 1
        text = " ".join(parts)
        clean = x.redacted(text, x.find(text)[1])
        assert clean.count("[assign]") == planted and x.find(clean)[1] == []


def test_clashing_columns_are_kept(spark):
    df = spark.createDataFrame([(1, f"a {S}", "x", 5, "y")], "doc_id long, text string, _spans string, _base long, _Redacted string")
    assert x.redact(df).collect() == [(1, "a [assign]", "x", 5, "y")]


def test_base_rules():
    assert x.find("token=token:abcdefgh")[0] == []  # the first match takes the second keyword in and is too short
    assert x.find("PASSWD : 'abcdef'")[0] == [("assign", 0, 16)]
    assert x.find("ſecret=abcdefgh")[0] == []  # only ASCII letters have another case
    assert x.find("AKIA" + "A" * 15)[0] == [] and x.find("AKIA" + "A" * 16)[0] == [("access", 0, 20)]
    assert x.find("g" + "a1" * 12 + "g")[0] == [("hex", 1, 25)]


def test_partly_escaped():
    base, found = x.find("pass%77ord=abc%64efgh x")
    assert base == [] and found == [("assign", 0, 21)]


def test_clean_prose_has_no_spans():
    assert x.find("Anblewhsttibleathawhthonre was isanlyhendand oftionnten " * 50) == ([], [])


def test_same_content_is_not_followed_again():
    text = " ".join([b64("nothing to see in here, move on")] * 50)
    assert x.find(text) == ([], [])


@pytest.mark.parametrize("other", ["base64", "gzip", "quoted base64", "zstd"])
def test_same_secret_is_found_at_every_place(other):
    text = f"{LAYERS['base64']} and {LAYERS[other]} and {LAYERS['base64']}"
    base, found = x.find(text)
    assert base == [] and len(found) == 3
    assert x.redacted(text, found).replace("%3D", "").replace("=", "") == "[assign] and [assign] and [assign]"


def test_bomb_is_bounded(monkeypatch):
    monkeypatch.setattr(x, "MOST_UNPACKED", 1 << 21)
    assert x.find(b64(zlib.compress(b" " * (1 << 24))))[0] == []


def lines(s, width, stop="\n"):
    return stop.join(s[i : i + width] for i in range(0, len(s), width))


@pytest.mark.parametrize("width, stop", [(76, "\n"), (64, "\r\n"), (64, "\n    ")])
@pytest.mark.parametrize("after", ["", " after", "\nafter", "\n-----END-----"])
def test_wrapped_base64_is_joined(width, stop, after):
    plain = "a line of clear text before it and some more words"
    for code in (b64(plain + " " * 4 + S + " and more"), b64(gzip.compress(noise(200).hex().encode()[:203] + b" " + S.encode())), b64(bz2.compress((plain + S).encode()))):
        text = f"é before\n-----BEGIN CERTIFICATE-----\n{lines(code, width, stop)}{after}"
        base, found = x.find(text)
        assert base == [] and any(k == "assign" for k, _, _ in found)
        k, a, b = max(s for s in found if s[0] == "assign")
        assert text.index("\n", 9) < a < b <= len(text) - len(after)


def test_wrapped_base64_keeps_places():
    code = b64("x" * 50 + " " + S + " and so on")
    text = f"{lines(code, 76)}\n"
    assert x.find(text) == ([], [("assign", 68, 99)])  # 4 characters for 3 of the 51st to 73rd, and the line break


def noise(n):
    return b"".join(hashlib.sha512(str(i).encode()).digest() for i in range(n // 64 + 1))[:n]


LONG = b64(noise(400_000))
FAR = {
    "compressed in compressed": gzip.compress(zlib.compress((LONG + " " + S).encode())),
    "base64 over windows": gzip.compress(b64("a line of text. " * 25_000 + S).encode()),
    "compressed in base64 over windows": gzip.compress(b"a, " + b64(bz2.compress((LONG + " " + S).encode())).encode()),
    "escaped base64": gzip.compress(urllib.parse.quote(b64(b"??>" * 100_000 + S.encode()), safe="").encode()),
    "compressed as escapes": gzip.compress("".join(f"%{c:02x}" for c in zlib.compress((LONG[:200_000] + " " + S).encode())).encode()),
}


@pytest.mark.parametrize("name", FAR)
def test_unpacked_data_over_windows_are_read_to_the_end(name, monkeypatch):
    for limit, size in {"WINDOW": 1 << 16, "OVERLAP": 1 << 12, "MOST_UNPACKED": 1 << 18}.items():
        monkeypatch.setattr(x, limit, size)
    text = f"before {b64(FAR[name])} after"
    assert ("assign", 7, 7 + len(b64(FAR[name]))) in x.find(text)[1]


def test_secrets_behind_a_bomb_are_found(monkeypatch):
    monkeypatch.setattr(x, "MOST_UNPACKED", 1 << 20)
    bomb = b64(zlib.compress(b" " * (1 << 22) + S.encode()))
    text = f"{bomb} {LAYERS['gzip']}"
    assert x.find(text)[1] == [("assign", 0, len(bomb)), ("assign", len(bomb) + 1, len(text))]


def test_deep_nesting_does_not_recurse():
    data = S.encode()
    for _ in range(1500):
        data = zlib.compress(data, 0)
    assert x.find(b64(data))[1] == [("assign", 0, len(b64(data).rstrip("=")) + b64(data).count("="))]


@pytest.mark.parametrize("held", [1 << 22, 16])
def test_data_that_contain_themselves_end(held, monkeypatch):
    own = gzip.compress(S.encode())
    monkeypatch.setattr(x, "MOST_UNPACKED", held)
    monkeypatch.setattr(x, "streams", lambda chunks: (c for c in ([own] if b"".join(chunks)[:2] == own[:2] else [])))
    assert x.find(b64(own)) == ([], [])


def test_query_digest(spark):
    rows = [(1, f"a {S} b {b64('token: abcdef99')}"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in x.scanned(df).collect()}
    assert got[1]["_base"] == "assign:2:24" and len(got[1]["_spans"]) == 2
    assert hashlib.sha256(got[2]["_base"].encode()).hexdigest().startswith("e3b0c442")
