"""Scalar rules as column expressions: grammars, byte order, sample decoding, budgets and names."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20
SAFE = 9007199254740991


def is_identity(c: Column) -> Column:
    """blake3: and 64 hexadecimal digits, nothing before or after, not even a line feed."""
    return F.coalesce(c.rlike(r"\Ablake3:[0-9a-f]{64}\z"), F.lit(False))


def is_digest(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def big_endian(data: Column, at: int, size: int) -> Column:
    """An unsigned number of up to 7 bytes from a binary column (at from 0)."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("bigint")


def little_endian(data: Column, at: int, size: int) -> Column:
    parts = [F.hex(F.substring(data, at + 1 + k, 1)) for k in reversed(range(size))]
    return F.conv(F.concat(*parts), 16, 10).cast("bigint")


def _decoded(data: bytes | None, depth: int) -> np.ndarray | None:
    """Little-endian PCM of 16 or 24 bits as doubles in [-1, 1); a sample that is not whole is left out."""
    if data is None:
        return None
    size = depth // 8
    raw = np.frombuffer(data, np.uint8, len(data) // size * size).reshape(-1, size)
    wide = np.zeros((len(raw), 4), np.uint8)
    wide[:, 4 - size :] = raw
    return (wide.view("<i4")[:, 0] >> (32 - depth)).astype(np.float64) / (1 << (depth - 1))


def samples(data: Column, depth: int) -> Column:
    """PCM of 16 or 24 bits as an array of doubles: one numpy pass over each cell of an Arrow batch."""

    @F.pandas_udf("array<double>")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda x: _decoded(x, depth))

    return decode(data)


def planes(data: Column, channels: int, depth: int) -> Column:
    """Interleaved PCM as an array of one array for each channel; a frame that is not whole is left out."""

    @F.pandas_udf("array<array<double>>")
    def split(values: pd.Series) -> pd.Series:
        def one(x: bytes | None) -> list[list[float]] | None:
            if x is None:
                return None
            flat = _decoded(x, depth)
            return flat[: len(flat) // channels * channels].reshape(-1, channels).T.tolist()

        return values.map(one)

    return split(data)


def packed_doubles(numbers: Column, most: int) -> Column:
    """Whole numbers of 0 to 2**53 as little-endian 64-bit floats, one after another; null for more than ``most``.
    The numbers of an Arrow batch become bytes at once; nulls among them are left out."""

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        held, bounds = lists.values, lists.offsets.to_numpy().astype(np.int64)
        there = held.is_valid().to_numpy(zero_copy_only=False)
        data = held.fill_null(0).to_numpy()[there].astype("<f8")
        ends = 8 * np.concatenate(([0], np.cumsum(there)))[bounds]
        whole = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        return pc.if_else(lists.is_valid(), whole, None).cast(pa.binary())

    return F.when(F.size(numbers) <= most, pack(numbers.cast("array<bigint>")))


def backoff_ms(attempt: Column) -> Column:
    """5 ms doubling with each attempt, 100 ms at most; attempts beyond the fourth are refused (null)."""
    return F.when((attempt >= 1) & (attempt <= 4), F.least(F.lit(100), F.lit(5) * F.pow(F.lit(2.0), attempt - 1)).cast("bigint"))


def memory_budget(device_gib: Column, worker: int = 8 * MIB, least: int = 8 * MIB, most: int = 32 * MIB, otherwise: int = 16 * MIB) -> Column:
    sound = device_gib.isNotNull() & ~F.isnan(device_gib) & (F.abs(device_gib) != float("inf")) & (device_gib > 0)
    return F.when(sound, F.least(F.lit(most), F.greatest(F.lit(least), F.floor(device_gib * worker)))).otherwise(F.lit(otherwise)).cast("bigint")


def admission_width(cores: Column, budget: Column, most: Column | int = 4, worker: int = 8 * MIB) -> Column:
    """Workers that cores, memory and the policy allow; null where the budget holds none."""
    most = F.lit(most) if isinstance(most, int) else most
    hardware = F.when(cores.isNotNull() & ~F.isnan(cores.cast("double")), F.floor(cores)).otherwise(F.lit(2))
    return F.when(budget >= worker, F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), hardware - 1), F.floor(budget / worker), most))).cast("bigint")


def funded_width(workers: Column, budget: Column) -> Column:
    """Verification lanes that memory beyond the workers' own pays for: 2 MiB each, three at most."""
    sound = (workers >= 1) & (budget >= 0)
    return F.when(sound, F.least(F.lit(3), workers, F.floor(F.greatest(F.lit(0), budget - workers * 8 * MIB) / (2 * MIB)))).otherwise(F.lit(0)).cast("bigint")


def content_length(c: Column) -> Column:
    """A decimal length within the safe range; null for anything else."""
    digits = F.when(c.rlike(r"\A[0-9]{1,16}\z"), c).cast("bigint")
    return F.when(digits <= SAFE, digits)


def safe_file_part(c: Column) -> Column:
    """Letters, digits, _ and - stay, others become _; null unless 1 to 128 characters."""
    part = F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_")
    return F.when(F.length(part).between(1, 128), part)


def marker_name(identity: Column) -> Column:
    return F.concat(F.lit("sparse-pcm-v1-commit-blake3-"), F.substring(identity, 8, 64), F.lit(".json"))


def payload_name(identity: Column, generation: Column) -> Column:
    return F.concat(F.lit("sparse-pcm-v1-data-blake3-"), F.substring(identity, 8, 64), F.lit("-"), safe_file_part(generation))


def identity_of_marker(name: Column) -> Column:
    return F.when(name.rlike(r"\Asparse-pcm-v1-commit-blake3-[0-9a-f]{64}\.json\z"), F.concat(F.lit("blake3:"), F.substring(name, 29, 64)))


def canonical_json(fields: dict[str, Column]) -> Column:
    """A struct of whole numbers, strings and arrays as JSON with sorted keys and no white space."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def canonical_bytes(frames: Column, channels: Column, depth: Column) -> Column:
    """Bytes of dense PCM; null where the shape is not admitted or the number is not safe."""
    size = F.try_multiply(F.try_multiply(frames.cast("bigint"), channels.cast("bigint")), (depth / 8).cast("bigint"))
    return F.when(channels.isin(1, 2) & depth.isin(16, 24) & (frames >= 0) & (size <= SAFE), size)


def first_missing(capabilities: list[tuple[str, Column]]) -> Column:
    """The first capability, in order, that is absent; null when all are there."""
    return F.coalesce(*(F.when(~there, F.lit(name)) for name, there in capabilities))


def retryable(status: Column) -> Column:
    return F.coalesce(status.between(500, 599), F.lit(False))


def range_problem(status: Column, encoding: Column, content_range: Column, start: Column, end: Column, body: Column) -> Column:
    """Why a ranged response is refused; null for an exact one."""
    pattern = r"\Abytes ([0-9]+)-([0-9]+)/([0-9]+)\z"
    part = lambda k: F.regexp_extract(content_range, pattern, k).cast("bigint")
    return (
        F.when(retryable(status), "retry")
        .when(F.coalesce(status != 206, F.lit(True)), "status")
        .when(encoding.isNotNull() & (encoding != "identity"), "encoding")
        .when(~F.coalesce(content_range.rlike(pattern), F.lit(False)), "header")
        .when((part(1) != start) | (part(2) != end - 1) | (part(3) < end), "range")
        .when(body != end - start, "body")
    )
