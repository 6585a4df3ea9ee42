"""The error catalogue: code, phase and whether the same operation may succeed later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, phase and whether it is transient. The remedies are in words of our own.
ROWS = [
    ("capability.audio_worklet", "capability", False, "Use a secure page in a browser that has audio worklets."),
    ("capability.cross_origin_isolation", "capability", False, "Isolate the page from other origins by its response headers."),
    ("capability.module_worker", "capability", False, "Let worker scripts be loaded as modules from an allowed address."),
    ("capability.opfs", "capability", False, "Use a browser with private file storage outside of private windows."),
    ("capability.shared_array_buffer", "capability", False, "Isolate the page so that shared memory exists; nothing stands in for it."),
    ("capability.simd128", "capability", False, "Use a browser whose WebAssembly has 128-bit vectors."),
    ("capability.web_locks", "capability", False, "Use a browser with lock management; a store has one writer an object."),
    ("console.lease_refused", "console", False, "Attach a console that publishes meters, then ask for the feed again."),
    ("console.not_attached", "console", False, "Open the session with its console."),
    ("console.refused", "console", False, "Correct the edit; the same edit is refused again."),
    ("session.closed", "lifecycle", False, "Open another session: a closed one stays closed."),
    ("session.busy", "lifecycle", True, "Wait for the operation that is under way, then call again."),
    ("session.seek", "lifecycle", False, "Look at the cause and open another session."),
    ("session.playback", "lifecycle", False, "Look at the cause and open another session after its worker failed."),
    ("stem.cancelled", "lifecycle", False, "Nothing failed: the caller withdrew. Open again if that was not meant."),
    ("session.declaration_mismatch", "open", False, "Let the document and the declared sources say the same of every source."),
    ("session.input_path", "open", False, "Give exactly one way by which sources are delivered."),
    ("session.open", "open", False, "Look at the cause; all that was opened has been released."),
    ("stem.invalid_declaration", "open", False, "Declare one or two channels, 16 or 24 bits and a safe number of frames."),
    ("stem.decode.asset", "decode", False, "Serve the decoder with its media type, or name another address for it."),
    ("stem.decode.flac", "decode", False, "Encode the object again as a sound stream."),
    ("stem.decode.output", "decode", False, "Encode the object again in the shape that the session declares."),
    ("stem.decode.stall", "decode", True, "Relieve the decoder of competing work and open again."),
    ("stem.decode.worker", "decode", False, "Check that the decoder's script loads; look at the cause."),
    ("stem.flac.invalid", "decode", False, "Publish a stream whose description comes before its first frame."),
    ("stem.flac.resource_limit", "decode", False, "Publish a stream within the bounds on blocks and buffers."),
    ("stem.flac.shape", "decode", False, "Let the stream's description agree with the session."),
    ("stem.delivery.address", "delivery", False, "Locate the object by an absolute address or a request without a body."),
    ("stem.delivery.http", "delivery", True, "Answer with exact ranges and lengths and without an encoding."),
    ("stem.delivery.range", "delivery", False, "Keep size and version of the object the same between attempts."),
    ("stem.delivery.retry_exhausted", "delivery", True, "Mend what the cause names, or allow more attempts."),
    ("stem.delivery.stall", "delivery", True, "Find out why the server fell silent, or allow more time."),
    ("stem.corrupt", "store", False, "Publish the object again: its bytes are not those of its name."),
    ("stem.not_found", "store", False, "Read only objects that the lease holds."),
    ("stem.quota", "store", True, "Free storage, or ask for fewer bytes at once."),
    ("stem.read_deadline", "store", True, "Release the object where it is locked, or try again."),
]


def rows() -> list[tuple[str, str, str, bool]]:
    """code, phase, remedy, transient."""
    return [(code, phase, remedy, transient) for code, phase, transient, remedy in ROWS]


def catalogue(spark: SparkSession) -> DataFrame:
    """36 rows: code, phase, remedy, transient."""
    return spark.createDataFrame(rows(), "code string, phase string, remedy string, transient boolean")


def described(failures: DataFrame, code: str, retryable: Column) -> DataFrame:
    """failures with phase, remedy and transient; a response that was seen to be retryable outranks the table."""
    out = failures.join(F.broadcast(catalogue(failures.sparkSession)), code, "left")  # 36 rows
    return out.withColumn("transient", F.coalesce(retryable, F.lit(False)) | F.coalesce("transient", F.lit(False)))
