"""Secret scans with a recursive decoding worklist.

The text itself is the first layer. Every layer is scanned and unwrapped: URL escapes, Unicode escapes
and references, base64 runs (also over several lines), and compressed data inside either. Each new layer joins the worklist unless
a layer with the same content from the same places was seen before, so the list runs dry even on data
that contain themselves, and equal content is followed wherever it stands. A layer knows, for each of its characters, which stretch of the original text it came from;
what is found in it is reported as that stretch.

Unpacked data of up to MOST_UNPACKED bytes are held as a layer. Longer data are a stream, read again for
each use and never held: decompression, escapes and base64 runs of any length are carried on along it, and
its text is taken in windows that end where no pattern can go on or, if there is no such place in WINDOW
bytes, overlap by OVERLAP. All that is found in unpacked data is reported as the stretch that was packed.

Runs of base64 under 16 characters are no layer: the shortest match of any pattern has 12. Data that are no
readable text are scanned too, byte by byte. Streams of xz and zstd that ask for more than LARGEST_WINDOW
of memory are left packed.

Defined results: a null text is empty and has no spans; the same span found in several layers counts
once; a zero-length text, repeated rows and further columns need no special care.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronostrata.llm import workers
from chronostrata.llm.lineage import ship
from chronostrata.llm.names import fresh

KINDS = ("assign", "access", "hex")
WINDOW, OVERLAP, MOST_UNPACKED = 1 << 20, 1 << 14, 1 << 22
#: What a decoder of xz or zstd may hold itself; a stream that asks for more is left packed.
LARGEST_WINDOW = 1 << 28
LEAST_VALUE = 6

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_FIXED = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*+\r?\n[ \t]*+)+[A-Za-z0-9+/_-]++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
BREAKS = b" \t\r\n"
PIECES = re.compile(rb"[A-Za-z0-9+/_-]+|[ \t\r\n]+")
PLAIN_PIECES = re.compile(rb"[A-Za-z0-9+]+|[ \t\r\n]+")
URL_BYTES = re.compile(rb"(?:%[0-9A-Fa-f]{2})+")
URL_TAIL = re.compile(rb"%[0-9A-Fa-f]?\Z")
UNICODE_BYTES = re.compile(UNICODE_FIXED.pattern.encode())
UNICODE_TAIL = re.compile(rb"[\\&][^\\&]{0,12}\Z")
#: After these no match of any pattern goes on: bytes that are in none, and lone spaces between words.
SAFE = re.compile(rb"[^A-Za-z0-9+/_.=%\\&#;:{}\"'\r\n\t\x20-]|(?<=[A-Za-z0-9.,;])\x20(?=[A-Za-z0-9])")

Span = tuple[str, int, int]
Source = Callable[[], Iterator[bytes]]


def scan(text: str) -> list[Span]:
    """Spans of the base patterns: leftmost, not overlapping within a kind, too short ones dropped."""
    found: list[Span] = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(h.encode() in low for h in HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text and, for its characters, where they begin and end in the original: arrays, or the one
    stretch ``fixed`` for all. ``raw`` is the data that the text shows, if it is unpacked data."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, depth: int = 0, fixed: tuple[int, int] | None = None, raw: bytes | None = None):
        self.text, self.starts, self.ends, self.depth, self.fixed, self.raw = text, starts, ends, depth, fixed, raw

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.fixed:
            return self.fixed
        if self.starts is None:
            return start, end
        return int(self.starts[start]), int(self.ends[end - 1])

    def key(self) -> bytes:
        """A digest of the text and of where it came from."""
        h = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for x in (self.starts, self.ends, self.fixed):
            h.update(b"" if x is None else np.asarray(x, np.int64).tobytes())
        return h.digest()

    def replaced(self, parts: list[tuple[int, int, str]]) -> Layer:
        """This text with [start, end) given way to other texts, whose characters all come from there."""
        if self.fixed:
            at, text = 0, []
            for a, b, new in parts:
                text += [self.text[at:a], new]
                at = b
            return Layer("".join([*text, self.text[at:]]), depth=self.depth + 1, fixed=self.fixed)
        text, starts, ends, at = [], [], [], 0
        own_starts = np.arange(len(self.text)) if self.starts is None else self.starts
        own_ends = np.arange(1, len(self.text) + 1) if self.ends is None else self.ends
        for a, b, new in parts:
            x, y = self.origin(a, b)
            text += [self.text[at:a], new]
            starts += [own_starts[at:a], np.full(len(new), x)]
            ends += [own_ends[at:a], np.full(len(new), y)]
            at = b
        text.append(self.text[at:])
        return Layer("".join(text), np.concatenate([*starts, own_starts[at:]]), np.concatenate([*ends, own_ends[at:]]), self.depth + 1)


class Flow:
    """Unpacked data too long to be held, from one stretch of the original."""

    def __init__(self, again: Source, fixed: tuple[int, int], depth: int):
        self.again, self.fixed, self.depth = again, fixed, depth

    def key(self) -> bytes:
        h = hashlib.blake2b(np.asarray(self.fixed, np.int64).tobytes(), digest_size=16)
        for chunk in self.again():
            h.update(chunk)
        return h.digest()


def unpacked(again: Source, fixed: tuple[int, int], depth: int) -> Iterator[Layer | Flow]:
    """One layer of the data that ``again`` reads, none if there are none."""
    held, size = [], 0
    for chunk in again():
        held.append(chunk)
        size += len(chunk)
        if size > MOST_UNPACKED:
            yield Flow(again, fixed, depth)
            return
    if size:
        raw = b"".join(held)
        yield Layer(raw.decode("latin-1"), depth=depth, fixed=fixed, raw=raw)


class Reader:
    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.rest = chunks, b""

    def read(self, n: int) -> bytes:
        while not self.rest and (chunk := next(self.chunks, None)) is not None:
            self.rest = chunk
        out, self.rest = self.rest[:n], self.rest[n:]
        return out


def streams(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Chunks of what compressed data hold, all members or frames one after another; nothing for other
    data. Broken data give what comes before."""
    while True:
        head = b""
        for chunk in chunks:
            head += chunk
            if len(head) >= 6:
                break
        chunks = itertools.chain([head], chunks)
        if head[:2] == b"\x1f\x8b":
            d = zlib.decompressobj(31)
        elif len(head) > 2 and head[0] & 15 == 8 and head[0] >> 4 <= 7 and (head[0] << 8 | head[1]) % 31 == 0:
            d = zlib.decompressobj(15)
        elif head[:3] == b"BZh":
            d = bz2.BZ2Decompressor()
        elif head[:6] == b"\xfd7zXZ\0":
            d = lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=LARGEST_WINDOW)
        elif head[:4] == b"\x28\xb5\x2f\xfd" or (head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5):
            try:
                with zstandard.ZstdDecompressor(max_window_size=LARGEST_WINDOW).stream_reader(Reader(chunks), read_across_frames=True) as r:
                    while chunk := r.read(1 << 16):
                        yield chunk
            except zstandard.ZstdError:
                pass
            return
        else:
            return
        try:
            for data in chunks:
                out = d.decompress(data, 1 << 16)
                while out or not (d.eof or getattr(d, "needs_input", True)):
                    if out:
                        yield out
                    if d.eof:
                        break
                    out = d.decompress(getattr(d, "unconsumed_tail", b""), 1 << 16)
                if d.eof:
                    break
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return
        if not d.eof:
            return
        chunks = itertools.chain([d.unused_data.lstrip(b"\0")], chunks)  # padding may stand between members


def part(chunks: Iterator[bytes], start: int, end: int) -> Iterator[bytes]:
    at = 0
    for chunk in chunks:
        if at + len(chunk) > start:
            yield chunk[max(0, start - at) : end - at]
        at += len(chunk)
        if at >= end:
            return


def unsplit(chunks: Iterator[bytes], tail: re.Pattern) -> Iterator[bytes]:
    """The same data in chunks that do not end in what ``tail`` matches."""
    held = b""
    for chunk in chunks:
        held += chunk
        m = tail.search(held, max(0, len(held) - 16))
        cut = m.start() if m else len(held)
        yield held[:cut]
        held = held[cut:]
    yield held


def without_url(chunks: Iterator[bytes]) -> Iterator[bytes]:
    for chunk in unsplit(chunks, URL_TAIL):
        yield URL_BYTES.sub(lambda m: bytes.fromhex(m[0].replace(b"%", b"").decode()), chunk)


def without_unicode(chunks: Iterator[bytes]) -> Iterator[bytes]:
    def character(m: re.Match) -> bytes:
        code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4] or m[6], 16)
        return chr(code if code < 0x110000 else 0xFFFD).encode("utf-8", "replace")

    for chunk in unsplit(chunks, UNICODE_TAIL):
        yield UNICODE_BYTES.sub(character, chunk)


def without_base64(chunks: Iterator[bytes]) -> Iterator[bytes]:
    held = b""
    for chunk in chunks:
        held += chunk.translate(bytes.maketrans(b"-_", b"+/"), BREAKS)
        cut = len(held) // 4 * 4
        yield binascii.a2b_base64(held[:cut])
        held = held[cut:]
    if len(held) > 1:
        yield binascii.a2b_base64(held + b"=" * (4 - len(held)))


def pieces(chunks: Iterator[bytes], pattern: re.Pattern) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and last byte of the pattern's matches, which go on from chunk to chunk if of one sort."""
    held, at = None, 0
    for chunk in chunks:
        for m in pattern.finditer(chunk):
            i, j, last = at + m.start(), at + m.end(), chunk[m.end() - 1 : m.end()]
            if held and held[1] == i and (held[2] in BREAKS) == (last in BREAKS):
                held = (held[0], j, last)
            else:
                if held:
                    yield held
                held = (i, j, last)
        at += len(chunk)
    if held:
        yield held


def long_runs(chunks: Iterator[bytes], pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Stretches of more than OVERLAP bytes: words, or lines of one width with a shorter one after them,
    with and without that one."""
    start = end = before = width = 0
    open_, gap = False, None
    for i, j, last in itertools.chain(pieces(chunks, pattern), [(-1, -1, b"x")]):
        if last in BREAKS:
            gap = (i, j)
            continue
        if open_ and gap and gap[0] == end and gap[1] == i and j - i <= width:
            before, end, open_ = end, j, j - i == width
            continue
        for stop in sorted({end, before if end > start and not open_ else end}):
            if stop - start > OVERLAP:
                yield start, stop
        start, end, before, width, open_ = i, j, j, j - i, True
    return


def windows(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """The data in windows, and whether each ends where no pattern goes on."""
    held = b""
    for chunk in chunks:
        held += chunk
        if len(held) < WINDOW:
            continue
        cut = 0
        for back in (1 << 12, 1 << 16, len(held)):
            for m in SAFE.finditer(held, max(1, len(held) - back)):
                cut = m.end()
            if cut:
                break
        yield held[: cut or len(held)], cut > 0
        held = held[cut or -OVERLAP :]
    if held:
        yield held, True


def readable(data: bytes) -> str | None:
    """Text of well-formed UTF-8 that is nearly all printable."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(not (c.isprintable() or c in "\t\n\r") for c in text)
    return text if text and odd * 20 <= len(text) else None


class Unwrapper:
    def packed(self, layer: Layer, a: int, b: int, data: bytes) -> Iterator[Layer | Flow]:
        """The layer of compressed data that came from [a, b)."""
        if data:
            yield from unpacked(lambda: streams(iter([data])), layer.origin(a, b), layer.depth + 1)

    def flow(self, flow: Flow) -> Iterator[Layer | Flow]:
        fixed, depth, again = flow.fixed, flow.depth + 1, flow.again
        yield from unpacked(lambda: streams(again()), fixed, depth)
        torn = False
        for window, whole in windows(again()):
            torn |= not whole
            yield Layer(window.decode("latin-1"), depth=depth, fixed=fixed)
        if not torn:
            return
        yield from unpacked(lambda: without_url(again()), fixed, depth)
        yield from unpacked(lambda: without_unicode(again()), fixed, depth)
        for i, j, _ in pieces(unsplit(again(), URL_TAIL), URL_BYTES):
            if j - i > OVERLAP:
                yield from unpacked(lambda i=i, j=j: streams(without_url(part(again(), i, j))), fixed, depth)
        for i, j in long_runs(again(), PIECES):
            yield from self.long_run(lambda i=i, j=j: part(again(), i, j), fixed, depth)
            for k, m in long_runs(part(again(), i, j), PLAIN_PIECES):
                if m - k < j - i:
                    yield from self.long_run(lambda i=i + k, j=i + m: part(again(), i, j), fixed, depth)

    @staticmethod
    def long_run(run: Source, fixed: tuple[int, int], depth: int) -> Iterator[Layer | Flow]:
        found = False
        for x in unpacked(lambda: streams(without_base64(run())), fixed, depth):
            found = True
            yield x
        if not found:
            yield from unpacked(lambda: without_base64(run()), fixed, depth)

    def url(self, layer: Layer) -> Iterator[Layer]:
        if "%" not in layer.text:
            return
        parts = []
        for m in URL.finditer(layer.text):
            data = bytes.fromhex(m[0].replace("%", ""))
            yield from self.packed(layer, *m.span(), data)
            parts += self.characters(m.start(), data)
        if parts:
            yield layer.replaced(parts)

    @staticmethod
    def characters(at: int, data: bytes) -> list[tuple[int, int, str]]:
        """Each decoded character with the escapes it came from: three characters a byte."""
        text, i = [], 0
        for c in data.decode("utf-8", "replace"):
            n = len(c.encode("utf-8")) if c != "\ufffd" else 1
            if c == "\ufffd" and data[i : i + 3] == b"\xef\xbf\xbd":
                n = 3
            n = min(n, len(data) - i)
            if n <= 0:
                break
            text.append((at + 3 * i, at + 3 * (i + n), c))
            i += n
        return text

    def unicode(self, layer: Layer) -> Iterator[Layer]:
        if "\\" not in layer.text and "&#" not in layer.text:
            return
        parts, high = [], None
        for m in UNICODE_FIXED.finditer(layer.text):
            u4, x2, braced, u8, decimal, hexadecimal = m.groups()
            code = int(decimal) if decimal else int(u4 or x2 or braced or u8 or hexadecimal, 16)
            if high and high[1] == m.start() and 0xDC00 <= code < 0xE000:
                parts[-1] = (high[0], m.end(), chr(0x10000 + ((high[2] - 0xD800) << 10) + code - 0xDC00))
                high = None
                continue
            high = (m.start(), m.end(), code) if 0xD800 <= code < 0xDC00 else None
            parts.append((*m.span(), chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"))
        if parts:
            yield layer.replaced(parts)

    def base64(self, layer: Layer) -> Iterator[Layer]:
        for m in BASE64.finditer(layer.text):
            yield from self.run(layer, np.arange(*m.span()), m[0])
        for m in WRAPPED.finditer(layer.text):
            lines = [x.span() for x in LINE.finditer(layer.text, *m.span())]
            for i, j in self.wrapped([b - a for a, b in lines]):
                at = np.concatenate([np.arange(a, b) for a, b in lines[i:j]])
                yield from self.run(layer, at, "".join(layer.text[a:b] for a, b in lines[i:j]), False)

    @staticmethod
    def wrapped(widths: list[int]) -> list[tuple[int, int]]:
        """Lines to be joined: those of one width with a shorter one after them, and all, each with and
        without the last."""
        found, i = {(0, len(widths)), (0, len(widths) - 1)}, 0
        for j in range(1, len(widths) + 1):
            if j == len(widths) or widths[j] > widths[i] or widths[j - 1] < widths[i]:
                found |= {(i, j), (i, j - 1)}
                i = j
        return sorted((i, j) for i, j in found if j - i > 1)

    def run(self, layer: Layer, at: np.ndarray, run: str, whole: bool = True) -> Iterator[Layer | Flow]:
        """Layers of the base64 ``run``, whose characters stand at ``at``."""
        body = run.rstrip("=")
        body = body[: len(body) - (len(body) % 4 == 1)]
        try:
            data = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
        except (binascii.Error, ValueError):
            data = b""
        found = False
        for x in self.packed(layer, int(at[0]), int(at[-1]) + 1, data):
            found = True
            yield x
        if not found and data:
            found = (text := readable(data)) is not None
            size = np.array([len(c.encode("utf-8")) for c in text]) if found else np.ones(len(data), np.int64)
            text = text if found else data.decode("latin-1")
            if layer.fixed:
                yield Layer(text, depth=layer.depth + 1, fixed=layer.fixed)
            else:
                first = np.cumsum(size) - size
                a = at[np.minimum(first * 4 // 3, len(run) - 1)]
                b = at[np.minimum(-(-(first + size) * 4 // 3), len(run)) - 1]
                begin, end = (a, b + 1) if layer.starts is None else (layer.starts[a], layer.ends[b])
                yield Layer(text, begin, end, layer.depth + 1)
        if not found and whole:
            for part in re.finditer(r"[A-Za-z0-9+]{16,}={0,2}", run):
                if part[0] != run:
                    yield from self.run(layer, at[part.start() : part.end()], part[0], False)

    def layers(self, layer: Layer | Flow) -> Iterator[Layer | Flow]:
        if isinstance(layer, Flow):
            yield from self.flow(layer)
            return
        if layer.raw:
            yield from self.packed(layer, 0, len(layer.text), layer.raw)
        yield from self.url(layer)
        yield from self.unicode(layer)
        yield from self.base64(layer)


def ordered(spans: set[Span] | list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the text itself, and these with the spans of all layers below it."""
    base = scan(text)
    found, unwrap, seen = set(base), Unwrapper(), set()
    todo = [iter([Layer(text)])]
    while todo:
        if (layer := next(todo[-1], None)) is None:
            todo.pop()
            continue
        if (key := layer.key()) in seen:
            continue
        seen.add(key)
        if layer.depth and isinstance(layer, Layer):
            found |= {(kind, *layer.origin(a, b)) for kind, a, b in scan(layer.text)}
        todo.append(unwrap.layers(layer))
    return ordered(base), ordered(found)


PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
PADDING = re.compile("={0,2}")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first; the padding behind
    an encoded one goes with it."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        if b > at and not PATTERNS[kind].fullmatch(text, a, b):
            b = PADDING.match(text, b).end()
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scanned(docs: DataFrame, text: str = "text", spans: str = "_spans", base: str = "_base", clean: str = "_redacted") -> DataFrame:
    """docs with ``spans`` (all, in order), ``base`` (the base ones, joined) and the text without secrets as
    ``clean``; columns of docs that have these names are replaced."""
    docs = docs.drop(spans, base, clean)
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, SPANS), T.StructField(base, T.StringType()), T.StructField(clean, T.StringType())])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.claim("secrets")
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for i in range(0, b.num_rows, 500):
                s = b.slice(i, 500)
                texts = s.column(s.schema.get_field_index(text)).to_pylist()
                found = [find(t or "") for t in texts]
                all_spans = pa.array([[{"kind": k, "start": x, "end": y} for k, x, y in f[1]] for f in found], kind)
                cleaned = pa.array([redacted(t, f[1]) if t and f[1] else t for t, f in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_arrays([*(s.column(s.schema.get_field_index(n)) for n in names), all_spans, pa.array([joined(f[0]) for f in found], pa.string()), cleaned], schema.names)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets taken out of ``text``; ``n_chars``, where there is one, follows the text."""
    columns = docs.columns
    spans, base, clean = (fresh(columns, n) for n in ("_spans", "_base", "_redacted"))
    out = scanned(docs, "text", spans, base, clean).withColumn("text", F.col(clean))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter(F.split("_base", ","), lambda x: x.startswith(kind + ":"))).cast("bigint").alias(f"n_{kind}")
    return out.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(F.col("_base").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("_spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )
