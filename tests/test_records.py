"""Strict admission, record by record."""

import json

import pytest
from pyspark.sql import functions as F

from chronostrata.sources import manifests as m

D = "0" * 64
SOUND = {
    "bitDepth": 16, "channels": 2,
    "chunks": [{"bytes": 10, "flacSha256": D, "frames": 5, "offset": 0, "packedStartFrame": 0, "pcmSha256": D}, {"bytes": 7, "flacSha256": D, "frames": 3, "offset": 10, "packedStartFrame": 5, "pcmSha256": D}],
    "format": m.FORMAT, "frames": 100, "identity": f"blake3:{D}",
    "intervals": [{"frames": 6, "packedFrameOffset": 0, "startFrame": 0}, {"frames": 2, "packedFrameOffset": 6, "startFrame": 98}],
    "sampleRateHz": 48000,
}


def text(record):
    return json.dumps(record, sort_keys=True, separators=(",", ":"))


def changed(**change):
    return text({**SOUND, **change})


def interval(k, **change):
    return changed(intervals=[{**x, **(change if i == k else {})} for i, x in enumerate(SOUND["intervals"])])


def chunk(k, **change):
    return changed(chunks=[{**x, **(change if i == k else {})} for i, x in enumerate(SOUND["chunks"])])


CASES = [
    (text(SOUND), 17, None),
    (text(SOUND), None, None),
    (changed(intervals=[], chunks=[]), 0, None),
    (text(SOUND), 18, "payload"),
    ("{", 17, "json"),
    ("[]", 17, "shape"),
    ("null", 17, "shape"),
    (changed(extra=1), 17, "shape"),
    (changed(frames="100"), 17, "shape"),
    (changed(intervals=None), 17, "shape"),
    (changed(intervals={}), 17, "shape"),
    (changed(intervals=[None]), 17, "shape"),
    (changed(chunks=[*SOUND["chunks"], None]), 17, "shape"),
    (changed(frames=None), 17, "shape"),
    (chunk(0, bytes=None), 17, "shape"),
    (text({k: v for k, v in SOUND.items() if k != "chunks"}), 17, "shape"),
    (changed(frames=1.5), 17, "shape"),
    (changed(frames=0), 17, "frames"),
    (changed(frames=1 << 53), 17, "frames"),
    (changed(identity=f"blake3:{D}\n"), 17, "identity"),
    (changed(channels=0), 17, "channels"),
    (interval(1, startFrame=6), 17, "interval.order"),
    (interval(1, startFrame=99), 17, "interval.outside"),
    (interval(0, frames=0), 17, "interval.number"),
    (interval(1, packedFrameOffset=5), 17, "interval.offset"),
    (interval(1, startFrame=-1), 17, "interval.number"),
    (chunk(1, offset=9), 17, "chunk.offset"),
    (chunk(0, bytes=0), 17, "chunk.number"),
    (chunk(1, frames=48000 * 30 + 1), 17, "chunk.frames"),
    (chunk(1, pcmSha256="A" * 64), 17, "chunk.digest"),
    (chunk(1, frames=4), 17, "endpoint"),
]


def test_manifests(spark):
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(CASES)], "i int, t string, p long")
    got = {r["i"]: r["x"] for r in df.select("i", m.manifest_problem(F.col("t"), F.col("p")).alias("x")).collect()}
    assert {i: got[i] for i in got} == {i: x for i, (_, _, x) in enumerate(CASES)}


@pytest.mark.parametrize("data, want", [(text(SOUND).encode(), None), (b"", "size"), (text(SOUND).encode() + b"\xff", "utf8"), (json.dumps(SOUND).encode(), "canonical"), (json.dumps(dict(reversed(SOUND.items())), separators=(",", ":")).encode(), "canonical")])
def test_manifest_bytes(spark, data, want):
    df = spark.createDataFrame([(bytearray(data),)], "b binary")
    assert df.select(m.manifest_bytes_problem(F.col("b"))).first()[0] == want
