"""Binary packages and metadata: header admission, package bytes, block walks, chunked objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronostrata.functions.digests import ordered_digests
from chronostrata.functions.scalars import big_endian, content_length, little_endian
from chronostrata.operators import intervals as iv

MAGIC = b"MISOSTM1"  # fixed value: the first bytes of a package
MANIFEST_BYTES = 8 << 20
RATES, CHANNELS, DEPTHS = (44100, 48000, 88200, 96000), (1, 2), (16, 24)


def u32_le(n: Column) -> Column:
    hexed = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*(F.substring(hexed, 7 - 2 * k, 2) for k in range(4))))


def package(manifest: Column, payload: Column) -> Column:
    """magic, manifest length, four zero bytes, manifest, payload."""
    return F.concat(F.lit(MAGIC), u32_le(F.octet_length(manifest)), F.unhex(F.lit("00000000")), manifest, payload)


def header_problem(data: Column) -> Column:
    """Why the first 16 bytes are refused; null for a sound header."""
    size = little_endian(data, 8, 4)
    return (
        F.when(F.octet_length(data) < 16, "short")
        .when(F.substring(data, 1, 8) != F.lit(MAGIC), "magic")
        .when(little_endian(data, 12, 4) != 0, "reserved")
        .when((size < 1) | (size > MANIFEST_BYTES), "length")
    )


def manifest_of(data: Column) -> Column:
    return data.substr(F.lit(17), little_endian(data, 8, 4).cast("int"))


def payload_of(data: Column) -> Column:
    size = little_endian(data, 8, 4).cast("int")
    return data.substr(size + 17, F.octet_length(data) - size - 16)


def stream_info(data: Column) -> dict[str, Column]:
    """The fields of a 42-byte probe: marker, block header and the 34 bytes of STREAMINFO."""
    packed = big_endian(data, 18, 4)
    return {
        "min_block": big_endian(data, 8, 2),
        "max_block": big_endian(data, 10, 2),
        "min_frame": big_endian(data, 12, 3),
        "max_frame": big_endian(data, 15, 3),
        "rate": F.shiftright(packed, 12),
        "channels": F.shiftright(packed, 9).bitwiseAND(F.lit(7)) + 1,
        "depth": F.shiftright(packed, 4).bitwiseAND(F.lit(31)) + 1,
        "samples": packed.bitwiseAND(F.lit(15)) * (1 << 32) + big_endian(data, 22, 4),
    }


def stream_info_problem(data: Column) -> Column:
    f = stream_info(data)
    return (
        F.when(F.octet_length(data) != 42, "size")
        .when(F.substring(data, 1, 4) != F.lit(b"fLaC"), "magic")
        .when((big_endian(data, 4, 1).bitwiseAND(F.lit(127)) != 0) | (big_endian(data, 5, 3) != 34), "block")
        .when((f["min_block"] < 16) | (f["max_block"] < f["min_block"]), "block_size")
        .when((f["min_frame"] != 0) & (f["max_frame"] != 0) & (f["min_frame"] > f["max_frame"]), "frame_size")
        .when(~f["rate"].isin(*RATES), "rate")
        .when(~f["channels"].isin(*CHANNELS), "channels")
        .when(~f["depth"].isin(*DEPTHS), "depth")
    )


def _walker(most: int) -> Callable[[pa.Array], tuple[np.ndarray, ...]]:
    """What finds the metadata blocks of the objects in an Arrow column: row, number, type, length, offset and
    final of each, by row. A step reads the four bytes of one header of every object that has one more."""

    def walk(cells: pa.Array) -> tuple[np.ndarray, ...]:
        wide = cells.cast(pa.large_binary())
        held, bounds = wide.buffers()[2], np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, 8 * wide.offset)
        data = np.frombuffer(held if held is not None else b"", np.uint8)
        rows = np.flatnonzero(wide.is_valid().to_numpy(zero_copy_only=False))
        at, steps = bounds[rows] + 4, []
        for number in range(most):
            there = at + 4 <= bounds[rows + 1]
            rows, at = rows[there], at[there]
            head = data[at[:, None] + np.arange(4)].astype(np.int64)
            kind, size, final = head[:, 0] & 127, head[:, 1] << 16 | head[:, 2] << 8 | head[:, 3], head[:, 0] > 127
            sound = (at + 4 + size <= bounds[rows + 1]) & (kind <= 6)
            steps.append(tuple(x[sound] for x in (rows, np.full(len(rows), number), kind, size, at - bounds[rows], final)))
            more = sound & ~final
            rows, at = rows[more], (at + 4 + size)[more]
            if not len(rows):
                break
        found = [np.concatenate(x) for x in zip(*steps)]
        by_row = np.argsort(found[0], kind="stable")
        return tuple(x[by_row] for x in found)

    return walk


def metadata_walk(objects: DataFrame, key: str, data: str, most: int = 128) -> DataFrame:
    """The metadata blocks of each object: number, type, length, offset, final. Each header tells where the
    next one is, so objects are walked header by header, all those of an Arrow batch side by side."""
    walk = _walker(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, kind, size, at, final = walk(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(kind, pa.int32()), pa.array(size), pa.array(at), pa.array(final)], [key, "number", "type", "length", "offset", "final"])

    kind = dict(objects.dtypes)[key]
    return objects.select(key, data).mapInArrow(run, f"{key} {kind}, number int, type int, length long, offset long, final boolean")


def chunked(objects: DataFrame, data: str, width: int) -> DataFrame:
    """Objects as rows of at most ``width`` bytes: chunk number and bytes; nothing for empty ones."""
    size = F.octet_length(data)
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    return objects.withColumn("_at", F.explode(starts)).withColumn("chunk", (F.col("_at") / width).cast("int")).withColumn("bytes", F.col(data).substr(F.col("_at") + 1, F.lit(width))).drop("_at", data)


def located(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and length of the files of a folder: contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def normalised(document: Column) -> Column:
    """A document given as bytes or as text, as text; bytes that are no UTF-8 give null."""
    return F.when(F.is_valid_utf8(document.cast("string")), document.cast("string"))


def located_objects(wanted: DataFrame, locators: DataFrame, identity: str) -> DataFrame:
    """wanted with the path of each object and ``problem``: address for what no locator knows."""
    paths = locators.groupBy(identity).agg(F.min("path").alias("path"))
    return wanted.join(paths, identity, "left").withColumn("problem", F.when(F.col("path").isNull(), "stem.delivery.address"))


# Fixed value: the most bytes that a reader asks for at once.
SLOT = 256 << 10


def full_response_problem(status: Column, encoding: Column, length: Column, body: Column) -> Column:
    """Why a response for a whole object is refused: its status, an encoding, a length that is none or not
    that of the body; null for an exact one."""
    plain = encoding.isNull() | F.lower(encoding).isin("", "identity")
    declared = content_length(length)
    return (
        F.when(F.coalesce(status != 200, F.lit(True)), "status")
        .when(~plain, "encoding")
        .when(length.isNotNull() & declared.isNull(), "length")
        .when(F.coalesce(declared < body, F.lit(False)), "excess")
        .when(F.coalesce(declared > body, F.lit(False)), "short")
    )


def sequential_reads(objects: DataFrame, size: str, slot: int = SLOT) -> DataFrame:
    """The reads of a cursor over whole objects: at, bytes, and whether it is at the end after each."""
    return iv.tiled(objects, size, slot, "at", "bytes").withColumn("end", F.col("at") + F.col("bytes") == F.col(size))


PIECE = 1 << 16  # fixed value: the most rows in a batch that comes back from Python


def ranged_reads(objects: DataFrame, key: str, data: str, slot: int = SLOT, most: int = 128) -> DataFrame:
    """The exact ranges that a ranged reader asks for, in order: the probe of 42 bytes, the header of each
    further metadata block (their contents are skipped), then the audio in slots. phase, first and last byte.
    Objects whose probe is refused, or without audio, have none beyond what was asked until then. One pass:
    objects are neither read twice nor joined."""
    walk, piece = _walker(most), PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phases = pa.array(["probe", "metadata", "audio"])
        for batch in batches:
            ends = batch.column(2).to_numpy(zero_copy_only=False)
            rows, number, _, size, at, final = walk(batch.column(1))
            n, later = batch.num_rows, number > 0
            begin, tail = (at + 4 + size)[final], rows[final]
            # Spans of bytes (object, phase, first, length), each asked for in steps.
            spans = [(np.arange(n), 0, np.zeros(n, np.int64), 42), (rows[later], 1, at[later], 4), (tail, 2, begin, ends[tail].astype(np.int64) - begin)]
            of, first, length, phase = (np.concatenate(x) for x in zip(*((r, a, np.full(len(r), m), np.full(len(r), p)) for r, p, a, m in spans)))
            by_row = np.argsort(of, kind="stable")
            of, first, length, phase = of[by_row], first[by_row], length[by_row], phase[by_row]
            step = np.where(phase == 2, slot, length)
            upto = np.cumsum(-(-length // step))
            for low in range(0, int(upto[-1]) if n else 0, piece):
                read = np.arange(low, min(low + piece, upto[-1]))
                span = np.searchsorted(upto, read, "right")
                start = first[span] + (read - np.concatenate(([0], upto))[span]) * step[span]
                last = np.minimum(start + step[span], first[span] + length[span]) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[span])), phases.take(pa.array(phase[span])), pa.array(start), pa.array(last)], [key, "phase", "first", "last"])

    sound = F.when(stream_info_problem(F.substring(F.col(data), 1, 42)).isNull(), F.col(data))
    kind = dict(objects.dtypes)[key]
    return objects.select(key, sound.alias("_sound"), F.octet_length(data).cast("bigint").alias("_size")).mapInArrow(run, f"{key} {kind}, phase string, first long, last long")


def finite_extents(pieces: DataFrame, extents: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """extents (key, bytes, sha256) with ``status`` after their pieces were read one after another, every
    byte hashed and the rest drained: sound, short (it ended before its extent), excess, digest or missing."""
    seen = ordered_digests(pieces, key, order, data).select(key, F.col("digest").alias("_digest"), F.col("bytes").alias("_seen"), F.col("pieces").alias("reads"))
    status = (
        F.when(F.col("_seen").isNull(), "missing")
        .when(F.col("_seen") < F.col("bytes"), "short")
        .when(F.col("_seen") > F.col("bytes"), "excess")
        .when(F.col("_digest") != F.col("sha256"), "digest")
        .otherwise("sound")
    )
    return extents.join(seen, key, "left").withColumn("status", status).drop("_digest", "_seen")
