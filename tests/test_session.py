import numpy as np
import pytest

from chronostrata import session

RNG = np.random.default_rng(3)
#: name: channels, depth, intervals (start, frames); the timeline ends 9 frames after the last.
SOURCES = {"a": (1, 16, [(0, 40), (50, 30)]), "b": (2, 24, [(7, 100)]), "c": (2, 16, [(3, 1), (5, 64), (200, 20)])}


def planes(name):
    channels, depth, intervals = SOURCES[name]
    total = intervals[-1][0] + intervals[-1][1] + 9
    out = np.zeros((total, channels), np.int64)
    for s, n in intervals:
        out[s : s + n] = RNG.integers(-(1 << (depth - 1)), 1 << (depth - 1), (n, channels))
    return out


PLANES = {k: planes(k) for k in SOURCES}


def tables(spark):
    index, pieces, objects = [], [], []
    for k, (channels, depth, intervals) in SOURCES.items():
        packed, data = 0, b""
        for s, n in intervals:
            index.append((f"blake3:{k}", s, n, packed))
            packed += n
            data += b"".join(int(v).to_bytes(depth // 8, "little", signed=True) for v in PLANES[k][s : s + n].reshape(-1))
        step = 30 * depth // 8 // (depth // 8) * (depth // 8)
        pieces += [(f"blake3:{k}", i, data[i : i + step]) for i in range(0, len(data), step)]
        objects.append((f"blake3:{k}", channels, depth, len(PLANES[k])))
    return (
        spark.createDataFrame(index, "identity string, start long, frames long, packed_offset long"),
        spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in pieces], "identity string, at long, bytes binary"),
        spark.createDataFrame(objects, "identity string, channels long, depth int, frames long"),
    )


def document(**change):
    parts = [f'{{"id":"{k}","content":"blake3:{k}","channels":{change.get("channels", SOURCES[k][0])},"bit_depth":{SOURCES[k][1]},"frames":"{len(PLANES[k])}"}}' for k in change.get("names", SOURCES)]
    return '{"schema_version":1,"sample_rate_hz":48000,"sources":[' + ",".join(parts) + "]}"


@pytest.mark.parametrize("name, start, frames", [("a", 0, 89), ("a", 35, 20), ("b", 0, 300), ("b", 60, 7), ("c", 2, 210), ("c", 80, 50)])
def test_samples(spark, name, start, frames):
    s = session.open_session(spark, document(), *tables(spark))
    got = {(r["frame"], r["channel"]): r["sample"] for r in s.samples(name, start, frames).collect()}
    full = PLANES[name] / (1 << (SOURCES[name][1] - 1))
    assert got == {(f, c): full[f, c] for f in range(start, min(start + frames, len(full))) for c in range(full.shape[1])}


def test_windows_and_refusals(spark):
    s = session.open_session(spark, document(), *tables(spark))
    assert sorted(map(tuple, s.window_at(100, 128, 64).collect())) == sorted((k, min(100, len(p)), max(0, min(128, len(p) - 100))) for k, p in PLANES.items())
    for bad in (document(names=["a", "b"]), document(names=["a", "a", "b", "c"]), document(channels=1), document()[:-1]):
        with pytest.raises(session.SessionError) as e:
            session.open_session(spark, bad, *tables(spark))
        assert e.value.code == "session.declaration_mismatch"
    with pytest.raises(session.SessionError) as e:
        s.samples("z", 0, 1)
    assert e.value.code == "stem.not_found"
    s.close()
    with pytest.raises(session.SessionError) as e:
        s.samples("a", 0, 1)
    assert e.value.code == "session.closed"
