"""A session: the declared sources of a document over verified sparse objects, and bounded reads of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronostrata.functions.scalars import samples as decoded
from chronostrata.operators import intervals as iv
from chronostrata.operators import pump
from chronostrata.sources.manifests import document_problem

SOURCES = "id string, content string, channels bigint, bit_depth string, frames string"


class SessionError(ValueError):
    """``code`` of the error catalogue, and what it is about."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class Session:
    """Use open_session(). ``sources``: source_id, identity, channels, depth, frames."""

    def __init__(self, sources: DataFrame, index: DataFrame, pieces: DataFrame):
        self.sources, self.index, self.pieces, self._open = sources, index, pieces, True

    def _source(self, source_id: str) -> DataFrame:
        if not self._open:
            raise SessionError("session.closed", "the session is closed")
        found = self.sources.filter(F.col("source_id") == source_id)
        if found.isEmpty():
            raise SessionError("stem.not_found", source_id)
        return found

    def window_at(self, frame: int, window: int = pump.WINDOW_FRAMES, quantum: int = 128) -> DataFrame:
        """source_id, start, frames: what every source reads next after a seek to ``frame``."""
        if not self._open:
            raise SessionError("session.closed", "the session is closed")
        if not 0 <= frame <= iv.SAFE:
            raise ValueError("a seek goes to a whole frame within the safe range")
        at = F.least(F.lit(frame).cast("bigint"), F.col("frames"))
        return self.sources.select("source_id", pump.window_at(F.col("frames"), at, window, quantum).alias("w")).select("source_id", "w.start", "w.frames")

    def samples(self, source_id: str, start: int, frames: int) -> DataFrame:
        """frame, channel, sample of [start, start + frames) of one source; gaps are silent. Only the pieces
        that hold asked frames are decoded."""
        s = self._source(source_id).select("identity", "channels", "depth", F.col("frames").alias("total"))
        window = s.select("identity", "channels", "depth", F.lit(start).cast("bigint").alias("w_start"), F.least(F.lit(start + frames).cast("bigint"), F.col("total")).alias("w_end"))
        width = F.col("channels") * (F.col("depth") / 8).cast("bigint")
        met = iv.overlaps(window.select("identity", "w_start", "w_end"), self.index, "identity", max(1, frames)).select("identity", "from_frame", F.col("frames").alias("n"), "packed_frame")
        wanted = met.join(s, "identity").withColumn("width", width).withColumn("first", F.col("packed_frame") * F.col("width")).withColumn("last", F.col("first") + F.col("n") * F.col("width"))
        held = self.pieces.withColumn("size", F.octet_length("bytes")).join(wanted, "identity").filter((F.col("at") < F.col("last")) & (F.col("at") + F.col("size") > F.col("first")))
        a, z = F.greatest("at", "first"), F.least(F.col("at") + F.col("size"), F.col("last"))
        part = held.select("identity", "channels", "depth", "width", (F.col("from_frame") * F.col("width") + a - F.col("first")).alias("place"), F.col("bytes").substr((a - F.col("at") + 1).cast("int"), (z - a).cast("int")).alias("data"))
        parts = [part.filter(F.col("depth") == d).select("channels", (F.col("place") / (d // 8)).cast("bigint").alias("number"), F.posexplode(decoded(F.col("data"), d)).alias("pos", "sample")) for d in (16, 24)]
        sound = parts[0].union(parts[1]).withColumn("number", F.col("number") + F.col("pos"))
        sound = sound.select(F.floor(F.col("number") / F.col("channels")).cast("bigint").alias("frame"), (F.col("number") % F.col("channels")).cast("int").alias("channel"), "sample")
        dense = window.filter("w_end > w_start").select(F.explode(F.sequence(F.col("w_start"), F.col("w_end") - 1)).alias("frame"), "channels").select("frame", F.explode(F.sequence(F.lit(0), (F.col("channels") - 1).cast("int"))).alias("channel"))
        return dense.join(sound, ["frame", "channel"], "left").select("frame", "channel", F.coalesce("sample", F.lit(0.0)).alias("sample"))

    def close(self) -> None:
        self._open = False


def open_session(spark: SparkSession, document: str, index: DataFrame, pieces: DataFrame, objects: DataFrame) -> Session:
    """Opens a session over committed objects.

    document: session JSON. objects: identity, channels, depth, frames. index: identity, start, frames,
    packed_offset. pieces: identity, at (byte offset in the packed payload, on whole samples), bytes.
    Refused: a document that is not sound (session.declaration_mismatch), sources without an object or of
    another shape (the same), objects that no source names (the same).
    """
    row = spark.createDataFrame([(document,)], "text string")
    if (problem := row.select(document_problem(F.col("text"))).first()[0]) is not None:
        raise SessionError("session.declaration_mismatch", f"the document is refused: {problem}")
    declared = row.select(F.explode(F.from_json("text", f"sources array<struct<{SOURCES}>>")["sources"]).alias("s")).select(F.col("s.id").alias("source_id"), F.col("s.content").alias("identity"), F.col("s.channels").alias("channels"), F.try_to_number(F.col("s.bit_depth"), F.lit("99")).cast("int").alias("depth"), F.col("s.frames").cast("bigint").alias("frames"))
    shapes = objects.select(F.col("identity").alias("_i"), F.col("channels").cast("bigint").alias("_c"), F.col("depth").cast("int").alias("_d"), F.col("frames").cast("bigint").alias("_f"))
    same = (F.col("channels") == F.col("_c")) & (F.col("depth") == F.col("_d")) & (F.col("frames") == F.col("_f"))
    met = declared.join(shapes, F.col("identity") == F.col("_i"), "full_outer").select(F.coalesce("source_id", "_i").alias("name"), F.when(F.col("_i").isNull(), "no object").when(F.col("source_id").isNull(), "no source").when(~F.coalesce(same, F.lit(False)), "another shape").alias("problem")).filter("problem is not null")
    if bad := met.orderBy("name").first():
        raise SessionError("session.declaration_mismatch", f"{bad['name']}: {bad['problem']}")
    return Session(declared, index, pieces)
