"""Byte-level BPE encoding and decoding.

Encoding: a text is split by the tokenizer's pattern, and every piece runs through a finite-state
transducer over its bytes. After each prefix of a piece the last token of the prefix's encoding is
unique: of the vocabulary entries that end there, the one that may stand behind the token before it. Two
tokens may stand side by side when merging their joined bytes gives the two again; a sequence is an
encoding when all neighbours may. A state holds the trie nodes of the entries that may still grow, each
with the entries below it that are forbidden there by the token before: tokens that forbid the same are
one state, so a few thousand states serve all words. A transition names the token that ends at its byte.
The tokens on the way back from every entry that may still grow are certain and are emitted: output lags
behind by the longest vocabulary entry and what hangs on it. States and transitions are made when a text
first needs them, kept in bounded arrays, and applied to all new pieces of a batch side by side.

Decoding: token bytes are joined in order and an incremental UTF-8 machine holds back the unfinished
character at the end of each chunk.

Defined results: a null text is encoded as the empty one (no ids); null ids decode to nothing; rows
pass through one by one, so repeated rows and null ids of documents stay as they are; an input column
named like the output is replaced; other columns stay.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronostrata.llm import workers
from chronostrata.llm.lineage import ship

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bounds on the tables that a worker keeps: states of the transducer, chunks of text with their ids (twice
#: so many: the last full table is kept beside the one being filled).
MAX_STATES, MAX_PIECES = 32_000, 80_000
ROWS = 256
#: Pieces of at most so many bytes run side by side, in groups of so many bytes; longer ones run alone.
SIDE_BY_SIDE, GROUP = 256, 1 << 17
#: Bytes of a piece that wait at most before what is certain is emitted.
HOLD = 4096
NEVER = 1 << 62


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """A lazily determinised transducer from the bytes of a piece to its tokens.

    Entries that merge to themselves stand in the order of their bytes, so those below a trie node are one
    range. What may stand behind a token is a set of entries; a state knows, for every node that may still
    grow, which of the entries below it are forbidden there, and nothing else of the token before it.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.spelled = {v: k for k, v in ranks.items()}
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        self.entries: list[int] = []
        for token in sorted(ranks):
            parts = self.merged(token, 2)
            if len(parts) == 2:
                self.halves[token] = parts[0], parts[1]
            if len(parts) <= 2:
                self.entries.append(ranks[token])
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.token_at: dict[int, int] = {}  # node -> place of its entry
        self.depth, self.low, self.high = [0], [0], [0]
        for place, rank in enumerate(self.entries):
            at = 0
            for b in self.spelled[rank]:
                self.high[at] = place + 1
                if (to := self.child.get(at << 8 | b)) is None:
                    to = self.child[at << 8 | b] = len(self.depth)
                    self.depth.append(self.depth[at] + 1)
                    self.low.append(place)
                    self.high.append(place)
                at = to
            self.high[at], self.token_at[at] = place + 1, place
        #: The merges that take a part in as their left half, and the entries that have a part at their left end.
        self.pairs: dict[bytes, list[tuple[int, bytes]]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for k in range(1, len(token)):
                if token[:k] in ranks and token[k:] in ranks:
                    self.pairs.setdefault(token[:k], []).append((rank, token[k:]))
        begins: dict[bytes, list[tuple[int, int]]] = {}
        for place, rank in enumerate(self.entries):
            for part, taken in self.edge(rank, 0):
                begins.setdefault(part, []).append((-taken, place))
        self.begins = {part: np.array(sorted(own), np.int64).T for part, own in begins.items()}
        self.reset()

    def reset(self) -> None:
        none = np.zeros(0, np.int32)
        self.sets, self.set_numbers, self.behind = [none], {b"": 0}, {}
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.numbers: dict[tuple[tuple[int, int], ...], int] = {}
        self.next = self.token = np.zeros(0, np.int32)
        self.state_of(((0, 0),))

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """Parts by the definition: join the neighbours of lowest rank, leftmost first, down to ``stop`` parts or while any has one."""
        parts, get = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > stop:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at the right (side 1) or left (0) end of an entry while it is merged, each with the rank of the merge that takes it in."""
        part = self.spelled[token]
        known = [(part, NEVER)]
        while part in self.halves:
            taken = self.ranks[part]
            part = self.halves[part][side]
            known.append((part, taken))
        return known

    def may_follow(self, a: int, b: int) -> bool:
        """Whether a and b stay as they are side by side: no part at the right end of a merges with one
        at the left end of b before either is taken into its own token (a tie goes to the left)."""
        return b in self.entries and self.entries.index(b) not in self.sets[self.forbidden(a)]

    def set_of(self, places: np.ndarray) -> int:
        key = places.tobytes()
        if (known := self.set_numbers.get(key)) is None:
            known = self.set_numbers[key] = len(self.sets)
            self.sets.append(places)
        return known

    def forbidden(self, token: int) -> int:
        """The set of the entries that may not stand behind ``token``."""
        if (known := self.behind.get(token)) is None:
            merges: dict[bytes, int] = {}
            for part, taken in self.edge(token, 1):
                for rank, other in self.pairs.get(part, ()):  # lowest ranks first
                    if rank >= taken:
                        break
                    if rank < merges.get(other, NEVER):
                        merges[other] = rank
            found = [np.zeros(0, np.int64)]
            for other, rank in merges.items():
                if (own := self.begins.get(other)) is not None:
                    found.append(own[1][: own[0].searchsorted(-rank, "right")])
            places = np.sort(np.concatenate(found)).astype(np.int32)
            known = self.behind[token] = self.set_of(places[np.diff(places, prepend=-1) > 0])
        return known

    def state_of(self, alive: tuple[tuple[int, int], ...]) -> int:
        if (number := self.numbers.get(alive)) is None:
            number = self.numbers[alive] = len(self.states)
            self.states.append(alive)
            if len(self.next) < len(self.states) << 8:
                more = np.full(max(1 << 16, len(self.next)), -1, np.int32)
                self.next, self.token = np.concatenate([self.next, more]), np.concatenate([self.token, more])
        return number

    def step(self, state: int, byte: int) -> int:
        """The transition of a state by a byte: the next state; the token that ends here is kept beside it."""
        alive, here = [], None
        for node, own in self.states[state]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            place, first, last, not_here = self.token_at.get(to), self.low[to], self.high[to], self.sets[own]
            if own:
                i, j = not_here.searchsorted((first, last)).tolist()
                not_here = not_here[i:j]
            if place is not None:
                first += 1
                if len(not_here) and not_here[0] == place:
                    not_here = not_here[1:]
                elif here is None:
                    here = self.entries[place]
            if len(not_here) < last - first:
                alive.append((to, self.set_of(not_here) if own else 0))
        if here is None:
            raise ValueError(f"no token of the vocabulary ends with byte {byte}")
        alive.append((0, self.forbidden(here)))
        number = self.state_of(tuple(alive))
        self.next[state << 8 | byte], self.token[state << 8 | byte] = number, here
        return number

    def bounded(self) -> None:
        """Start the tables again once they are full; called between pieces."""
        if len(self.states) > self.max_states or len(self.sets) > self.max_states:
            self.reset()

    def way_back(self, ends: list[int], at: int) -> list[int]:
        """Positions at which tokens end, from ``at`` back to the start of ``ends``."""
        way, length = [at], self.length
        while at > 0:
            at -= int(length[ends[at - 1]])
            way.append(at)
        return way

    def certain(self, state: int, ends: list[int]) -> int:
        """The last position that lies on the way back of every entry that may still grow."""
        common = set(self.way_back(ends, len(ends)))
        for node, _ in self.states[state]:
            common &= set(self.way_back(ends, len(ends) - self.depth[node]))
        return max(common)

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece, however long: what is certain is emitted on the way."""
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        self.bounded()
        state, ends, out, hold = 0, [], [], HOLD
        for byte in piece:
            to = int(self.next[state << 8 | byte])
            if to < 0:
                if len(self.states) > self.max_states or len(self.sets) > self.max_states:
                    alive = [(node, self.sets[own]) for node, own in self.states[state]]
                    self.reset()
                    state = self.state_of(tuple((node, self.set_of(own)) for node, own in alive))
                to = self.step(state, byte)
            ends.append(int(self.token[state << 8 | byte]))
            state = to
            if len(ends) >= hold:
                # Where nothing is certain yet, as in long runs of one letter, the next look is at twice the length.
                hold = HOLD if (done := self.certain(state, ends)) else 2 * hold
                out += [ends[i - 1] for i in self.way_back(ends, done)[-2::-1]]
                del ends[:done]
        return out + [ends[i - 1] for i in self.way_back(ends, len(ends))[-2::-1]]

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces in one array, and how many each piece has.

        The pieces run through the transitions side by side, a byte of each at a time; only transitions
        that are not known yet are made one by one.
        """
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends, kept = np.zeros(len(data), np.int32), np.zeros(len(data), bool)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        last = (start + size - 1)[whole >= 0]
        ends[last], kept[last] = whole[whole >= 0], True
        for k in np.flatnonzero((whole < 0) & (size > SIDE_BY_SIDE)).tolist():
            ids = np.array(self.encode(pieces[k]), np.int64)
            at = start[k] + np.cumsum(self.length[ids]) - 1
            ends[at], kept[at] = ids, True
        run = np.flatnonzero((whole < 0) & (size <= SIDE_BY_SIDE) & (size > 0))
        run = run[np.argsort(-size[run], kind="stable")]
        for own in np.split(run, np.flatnonzero(np.diff(np.cumsum(size[run]) // GROUP)) + 1) if len(run) else ():
            self.bounded()
            self.side_by_side(data, start[own], size[own], ends, kept)
        total = np.concatenate([[0], np.cumsum(kept)])
        return ends[kept], total[start + size] - total[start]

    def side_by_side(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> None:
        """Marks the tokens of the pieces, longest first, at the bytes where they end."""
        state = np.zeros(len(size), np.int64)
        for j in range(int(size[0])):
            m = int(np.searchsorted(-size, -j))
            at = start[:m] + j
            key = state[:m] << 8 | data[at]
            to = self.next[key]
            if to.min() < 0:
                for k in np.unique(key[to < 0]).tolist():
                    self.step(k >> 8, k & 255)
                to = self.next[key]
            ends[at], state[:m] = self.token[key], to
        at = start + size - 1
        while len(at):
            kept[at] = True
            after = at - self.length[ends[at]]
            more = after >= start
            at, start = after[more], start[more]


class Chunks(dict):
    """Chunks of text to their packed ids, in two generations, so that frequent chunks stay."""

    def __init__(self, transducer: Transducer, split, most: int = MAX_PIECES):
        super().__init__()
        self.transducer, self.split, self.most, self.older = transducer, split, most, {}

    def add(self, chunks: set[str]) -> None:
        """Encode the chunks that are not known: their distinct pieces run together."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        new, older = [], self.older
        for c in chunks.difference(self):
            if (known := older.get(c)) is None:
                new.append(c)
            else:
                self[c] = known
        pieces, counts = [], []
        for c in new:
            own = self.split(c)
            pieces += own
            counts.append(len(own))
        ids, size = self.transducer.encode_all([p.encode("utf-8") for p in pieces])
        packed = ids.astype("<i4").tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *counts])] * 4
        ends = ends.tolist()
        self.update(zip(new, (packed[i:j] for i, j in zip(ends, ends[1:]))))


class Encoder:
    """Encodes texts whole. A space or line feed between two other characters always begins a piece, so
    a text is cut there first, and chunks (mostly words) that were met before are looked up."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.transducer, self.split = Transducer(ranks_of(path)), regex.compile(pattern).findall
        self.chunks = Chunks(self.transducer, self.split)
        self.uncut = re.compile(r"\s\s|\x00").search if pattern == public_tokenizers.PATTERN else lambda _: True

    def cut(self, text: str) -> list[str]:
        if self.uncut(text):
            return self.split(text)
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        cut = [self.cut(t) if t else [] for t in texts]
        self.chunks.add(set().union(*cut))
        get = self.chunks.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed([text])[0], dtype="<i4").tolist()


class Utf8Stream:
    """An incremental UTF-8 machine: text so far certain out of chunks of bytes cut anywhere.

    Between chunks the state is the unfinished character: at most three bytes, whose first tells how
    many are missing. Ill-formed bytes become U+FFFD.
    """

    def __init__(self):
        self.pending = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that needs more."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF5 else 0
                return back if back < need else 0
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self.pending + chunk
        n = self.unfinished(data)
        self.pending = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.pending = self.pending.decode("utf-8", "replace"), b""
        return out


class Decoder:
    """Joins token bytes in order. Bytes of all tokens stand in one array, so many ids are looked up at once."""

    def __init__(self, path: str, chunk: int = 1 << 16):
        ranks, self.chunk = ranks_of(path), chunk
        spelled = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            spelled[rank] = token
        self.size = np.array([len(t) for t in spelled], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where those of each id end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - (ends - size), size)
        at += np.arange(len(at))
        return self.letters[at].tobytes(), ends

    def text(self, data: bytes) -> str:
        """The text of bytes that arrive in chunks cut anywhere."""
        stream = Utf8Stream()
        return "".join([*(stream.feed(data[i : i + self.chunk]) for i in range(0, len(data), self.chunk)), stream.finish()])

    def decode(self, ids: list[int]) -> str:
        return self.text(self.joined(np.asarray(ids, np.int64))[0]) if ids else ""


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


workers.keeps(lambda: (encoder.cache_clear(), decoder.cache_clear()))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array, names: list[str]) -> pa.RecordBatch:
    """batch with one more column, under the output's names, in their order."""
    return pa.RecordBatch.from_arrays([values if n == name else batch.column(batch.schema.get_field_index(n)) for n in names], names)


def vocabulary_path(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the token ids of ``text`` as array<int> ``out``."""
    path, docs = vocabulary_path(path), docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.claim("byte_bpe")
        packed = encoder(path).packed
        for b in slices(batches):
            parts = packed(b.column(b.schema.get_field_index(text)).to_pylist())
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
            yield with_column(b, out, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype="i4"))), names)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text that array<int> ``ids`` spells, as string ``out``."""
    path, rows = vocabulary_path(path), rows.drop(out)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.claim("byte_bpe")
        d = decoder(path)
        for b in slices(batches):
            lists = b.column(b.schema.get_field_index(ids))
            counts = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)])
            data, ends = d.joined(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            ends = np.concatenate([[0], ends])[counts].tolist()
            yield with_column(b, out, pa.array([d.text(data[i:j]) for i, j in zip(ends, ends[1:])], pa.string()), names)

    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the ids of ``text`` and the text that these spell, in one pass of one worker."""
    path, docs = vocabulary_path(path), docs.drop(ids, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(out, T.StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.claim("byte_bpe")
        packed, d = encoder(path).packed, decoder(path)
        for b in slices(batches):
            parts = packed(b.column(b.schema.get_field_index(text)).to_pylist())
            counts = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
            flat = np.frombuffer(b"".join(parts), dtype="i4")
            data, ends = d.joined(flat.astype(np.int64))
            at = np.concatenate([[0], ends])[counts].tolist()
            texts = pa.array([d.text(data[i:j]) for i, j in zip(at, at[1:])], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(counts), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names[:-2]), lists, texts], names)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
