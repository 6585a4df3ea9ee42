"""The metadata walk and the reads of a ranged reader, against an object walked byte by byte."""

import random

from chronostrata.sources import packages

INFO = bytes.fromhex("664C61438000002210001000000000000000" + "0AC442F000001000" + "00" * 16)


def walked(x, most=128):
    out, at = [], 4
    while x is not None and len(out) < most and at + 4 <= len(x):
        kind, size, final = x[at] & 127, int.from_bytes(x[at + 1 : at + 4], "big"), x[at] > 127
        if at + 4 + size > len(x) or kind > 6:
            break
        out.append((len(out), kind, size, at, final))
        if final:
            break
        at += 4 + size
    return out


def block(kind, size, final=False):
    return bytes([kind | 128 * final]) + size.to_bytes(3, "big") + b"\xaa" * size


def objects():
    random.seed(5)
    first = INFO[:4] + b"\0" + INFO[5:]  # further blocks follow
    made = [None, b"", b"fLaC", INFO, INFO[:41], INFO + b"\xbb" * 130, first, first + b"\x86\0\0", first + block(7, 3, True) + b"b" * 9, first + b"\x84\0\xff\xff" + b"b" * 99, b"fLaD" + INFO[4:] + b"b" * 70]
    made += [first + block(1, 300) * 2 + block(6, 70000, True) + b"b" * 64]
    made += [first + block(1, 0) * n + block(2, 1, True) + b"b" * 65 for n in (125, 126, 127, 200)]
    for _ in range(200):
        blocks = b"".join(block(random.randrange(7), random.randrange(90)) for _ in range(random.randrange(5)))
        made.append(first + blocks + block(random.choice((3, 3, 3, 9)), random.randrange(9), True) + b"b" * random.randrange(200))
    return made


def reads(x, slot):
    out = [("probe", 0, 41)]
    blocks = walked(x) if x is not None and x[:4] == b"fLaC" and len(x) >= 42 else []
    out += [("metadata", at, at + 3) for number, _, _, at, _ in blocks if number]
    if blocks and blocks[-1][4]:
        begin = blocks[-1][3] + 4 + blocks[-1][2]
        out += [("audio", a, min(a + slot, len(x)) - 1) for a in range(begin, len(x), slot)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, x in rows], "k string, data binary").repartition(3)


def test_metadata_walk(spark):
    rows = [(f"k{i}", x) for i, x in enumerate(objects())]
    got = sorted(map(tuple, packages.metadata_walk(frame(spark, rows), "k", "data").collect()))
    assert got == sorted((k, *b) for k, x in rows for b in walked(x))


def test_ranged_reads(spark):
    # Two objects of one key, and two without: each has its own reads.
    rows = [(f"k{i // 2}" if i > 1 else None, x) for i, x in enumerate(objects())]
    got = packages.ranged_reads(frame(spark, rows), "k", "data", 64).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((k, *r)) for k, x in rows for r in reads(x, 64))


def test_ranged_reads_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(packages, "PIECE", 7, raising=False)
    x = INFO + b"b" * 1000
    got = list(map(tuple, packages.ranged_reads(spark.createDataFrame([(1, bytearray(x))], "k int, data binary"), "k", "data", 10).collect()))
    assert got == [(1, *r) for r in reads(x, 10)]


def test_ranged_reads_are_one_pass(spark):
    plan = packages.ranged_reads(spark.range(9).selectExpr("id", "cast(cast(id as string) as binary) as data"), "id", "data")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "Exchange" not in plan and "Join" not in plan
