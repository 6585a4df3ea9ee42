"""Strict admission of JSON records: manifests, session documents, index rows, spans, worker responses.

Each function gives the name of the first broken rule as a column, null for a sound record. Rules run
inside one projection; lists are folded with ``aggregate``, so a record never leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronostrata.functions.scalars import SAFE, is_digest, is_identity

# The format tag, the admitted shapes and the bounds of a manifest.
FORMAT = "miso_sparse_stem_v1"
RATES, CHANNELS, DEPTHS = (44100, 48000, 88200, 96000), (1, 2), (16, 24)
MOST_LIST, MOST_CHUNK_BYTES, MOST_MANIFEST_BYTES, MOST_OBJECT_BYTES, HEADER_BYTES, CHUNK_SECONDS = 65_536, 32 << 20, 8 << 20, 8 << 30, 16, 30
MOST_SPAN_BYTES = 128 << 10

INTERVAL = "struct<frames:bigint,packedFrameOffset:bigint,startFrame:bigint>"
CHUNK = "struct<bytes:bigint,flacSha256:string,frames:bigint,offset:bigint,packedStartFrame:bigint,pcmSha256:string>"
#: Fields in the order of their names, so that writing the record again gives its canonical text.
SCHEMA = f"bitDepth bigint, channels bigint, chunks array<{CHUNK}>, format string, frames bigint, identity string, intervals array<{INTERVAL}>, sampleRateHz bigint"


def recursive_json(text: Column) -> Column:
    """JSON with the keys of every object sorted and no white space; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def _integer(c: Column, least: int) -> Column:
    return c.between(least, SAFE)


def _intervals_problem(m: Column) -> Column:
    """Of the first bad interval: sound numbers, inside the timeline, a gap to the one before, packed without one."""
    start = F.struct(F.lit(-1).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("packed"), F.lit(None).cast("string").alias("bad"))

    def step(acc: Column, x: Column) -> Column:
        end = x["startFrame"] + x["frames"]
        bad = (
            F.when(~(_integer(x["startFrame"], 0) & _integer(x["frames"], 1) & _integer(x["packedFrameOffset"], 0)), "interval.number")
            .when(end > m["frames"], "interval.outside")
            .when(x["startFrame"] <= acc["end"], "interval.order")
            .when(x["packedFrameOffset"] != acc["packed"], "interval.offset")
        )
        return F.struct(end.alias("end"), (acc["packed"] + x["frames"]).alias("packed"), F.coalesce(acc["bad"], bad).alias("bad"))

    return F.aggregate(m["intervals"], start, step)


def _chunks_problem(m: Column) -> Column:
    start = F.struct(F.lit(0).cast("bigint").alias("frame"), F.lit(0).cast("bigint").alias("offset"), F.lit(None).cast("string").alias("bad"))

    def step(acc: Column, x: Column) -> Column:
        bad = (
            F.when(~(_integer(x["offset"], 0) & _integer(x["bytes"], 1) & _integer(x["frames"], 1) & _integer(x["packedStartFrame"], 0)), "chunk.number")
            .when(x["bytes"] > MOST_CHUNK_BYTES, "chunk.bytes")
            .when(x["frames"] > m["sampleRateHz"] * CHUNK_SECONDS, "chunk.frames")
            .when(x["packedStartFrame"] != acc["frame"], "chunk.start")
            .when(x["offset"] != acc["offset"], "chunk.offset")
            .when(~(is_digest(x["flacSha256"]) & is_digest(x["pcmSha256"])), "chunk.digest")
        )
        return F.struct((acc["frame"] + x["frames"]).alias("frame"), (acc["offset"] + x["bytes"]).alias("offset"), F.coalesce(acc["bad"], bad).alias("bad"))

    return F.aggregate(m["chunks"], start, step)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def manifest_problem(text: Column, payload_bytes: Column | None = None) -> Column:
    """The first broken rule of a manifest; ``payload_bytes``, where known, must end with the last chunk."""

    def folded(m: Column) -> Column:
        # Written with its nulls a record shows what is missing, written without them what is null.
        holes = F.exists(m["intervals"], lambda x: x.isNull()) | F.exists(m["chunks"], lambda x: x.isNull())
        exact = F.when(~F.coalesce(holes, F.lit(True)) & (F.to_json(m, {"ignoreNullFields": "false"}) == F.to_json(m)), F.to_json(m))
        folds = F.struct(exact.alias("canonical"), _intervals_problem(m).alias("intervals"), _chunks_problem(m).alias("chunks"))
        return _once(folds, lambda x: problem(m, x["canonical"], x["intervals"], x["chunks"]))

    def problem(m: Column, canonical: Column, intervals: Column, chunks: Column) -> Column:
        payload = F.coalesce(payload_bytes, chunks["offset"]) if payload_bytes is not None else chunks["offset"]
        return (
            F.when(F.try_parse_json(text).isNull(), "json")
            .when(~F.coalesce(recursive_json(text) == canonical, F.lit(False)), "shape")
            .when(m["format"] != FORMAT, "format")
            .when(F.size(m["intervals"]) > MOST_LIST, "intervals")
            .when(F.size(m["chunks"]) > MOST_LIST, "chunks")
            .when(~m["sampleRateHz"].isin(*RATES), "rate")
            .when(~m["channels"].isin(*CHANNELS), "channels")
            .when(~m["bitDepth"].isin(*DEPTHS), "depth")
            .when(~_integer(m["frames"], 1) | (m["frames"] > F.floor(F.lit(SAFE) / (m["channels"] * m["bitDepth"] / 8))), "frames")
            .when(~is_identity(m["identity"]), "identity")
            .when(intervals["bad"].isNotNull(), intervals["bad"])
            .when(chunks["bad"].isNotNull(), chunks["bad"])
            .when(chunks["frame"] != intervals["packed"], "endpoint")
            .when(payload != chunks["offset"], "payload")
            .when(F.octet_length(canonical) > MOST_MANIFEST_BYTES, "size")
            .when(F.octet_length(canonical) + HEADER_BYTES + payload > MOST_OBJECT_BYTES, "object")
        )

    return _once(F.from_json(text, SCHEMA), folded)


def manifest_bytes_problem(data: Column, payload_bytes: Column | None = None) -> Column:
    """The same for bytes: well-formed UTF-8, a sound manifest, and exactly its canonical encoding."""
    text = data.cast("string")
    return (
        F.when(~F.octet_length(data).between(1, MOST_MANIFEST_BYTES), "size")
        .when(~F.is_valid_utf8(text), "utf8")
        .otherwise(F.coalesce(manifest_problem(text, payload_bytes), F.when(F.to_json(F.from_json(text, SCHEMA)) != text, "canonical")))
    )


def document_problem(text: Column) -> Column:
    """The first broken rule of a session document: version, rate and list; then every source; then their names."""
    d = F.from_json(text, "schema_version variant, sample_rate_hz variant, sources array<variant>")
    kind = lambda v: F.schema_of_variant(v)
    number = lambda v, least: F.coalesce((kind(v) == "BIGINT") & F.try_variant_get(v, "$", "bigint").between(least, SAFE), F.lit(False))
    part = lambda s, name: F.try_variant_get(s, f"$.{name}", "variant")
    string = lambda v: F.coalesce(kind(v) == "STRING", F.lit(False))
    get = lambda s, name: F.try_variant_get(s, f"$.{name}", "string")

    def sound(s: Column) -> Column:
        depth = part(s, "bit_depth")
        return (
            string(part(s, "id"))
            & (F.length(get(s, "id")) > 0)
            & string(part(s, "content"))
            & number(part(s, "channels"), 1)
            & F.coalesce(((kind(depth) == "BIGINT") & get(s, "bit_depth").isin("16", "24")) | ((kind(depth) == "STRING") & (get(s, "bit_depth") == "32f")), F.lit(False))
            & string(part(s, "frames"))
            & F.coalesce(get(s, "frames").rlike(r"\A(0|[1-9][0-9]*)\z"), F.lit(False))
        )

    ids = F.transform(d["sources"], lambda s: get(s, "id"))
    return (
        F.when(F.try_parse_json(text).isNull(), "json")
        .when(~(number(d["schema_version"], 1) & F.coalesce(F.try_variant_get(d["schema_version"], "$", "bigint") == 1, F.lit(False)) & number(d["sample_rate_hz"], -SAFE)) | d["sources"].isNull(), "document")
        .when(~F.forall(d["sources"], sound), "source")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "duplicate")
    )


def index_row_sound(identity: Column, size: Column, last_used: Column, pins: Column) -> Column:
    """Whether a row of a store's index may stand: name, whole positive size, finite time, pins that are all there."""
    finite = last_used.isNotNull() & ~F.isnan(last_used) & (F.abs(last_used) != float("inf"))
    return F.coalesce(is_identity(identity) & _integer(size, 1) & finite & pins.isNotNull() & F.forall(pins, lambda p: p.isNotNull()), F.lit(False))


def span_problem(data: Column, start: Column, keys: Column) -> Column:
    """A span has bytes, one to 128 KiB of them, nothing beside bytes and startFrame, and a whole start."""
    return (
        F.when(data.isNull(), "bytes")
        .when(~F.octet_length(data).between(1, MOST_SPAN_BYTES), "length")
        .when(F.size(F.array_except(keys, F.array(F.lit("startFrame"), F.lit("bytes")))) > 0, "keys")
        .when(~F.coalesce(_integer(start, 0), F.lit(False)), "start")
    )


COUNTERS = ("progressBytes", "canonicalBytes", "readCalls", "readBytes", "hashedBytes", "hashUpdates", "zeroUpdates")
TIMES = ("elapsedMs", "readWaitMs", "hashMs")
# How a verification may fail.
FAILURES = ("boundary", "corrupt", "deadline", "io", "cancelled")


def response_problem(r: Column) -> Column:
    """The first broken rule of a worker's answer, a struct of version, type, jobId, generation, bytes,
    identity, digest, kind, message, COUNTERS and TIMES."""
    whole = lambda name, least: F.coalesce(_integer(r[name], least), F.lit(False))
    finite = lambda name: F.coalesce((r[name] >= 0) & (r[name] != float("inf")) & ~F.isnan(r[name]), F.lit(False))
    complete = F.when(~is_identity(r["identity"]), "identity")
    for name in COUNTERS:
        complete = complete.when(~whole(name, 0), name)
    for name in TIMES:
        complete = complete.when(~finite(name), name)
    complete = complete.when(~is_digest(r["digest"]), "digest")
    failure = F.when(~F.coalesce(r["kind"].isin(*FAILURES), F.lit(False)) | r["message"].isNull(), "failure")
    return (
        F.when(~F.coalesce(r["version"] == 1, F.lit(False)) | ~F.coalesce(r["type"].isin("progress", "complete", "failure"), F.lit(False)), "protocol")
        .when(~whole("jobId", 1), "jobId")
        .when(~whole("generation", 1), "generation")
        .when((r["type"] == "progress") & ~whole("bytes", 0), "bytes")
        .when(r["type"] == "complete", complete)
        .when(r["type"] == "failure", failure)
    )
