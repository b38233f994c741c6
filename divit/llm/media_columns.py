"""Media columns as content-defined chunks.

A rolling gear hash over the last 32 bytes cuts each payload where its content says so, which keeps the cuts of a passage in place wherever
it stands. A payload is kept as the ordered list of its chunks' digests; each chunk is kept once, compressed, in a table dealt out by digest.
Lists of equal payloads are stored once too. Reading joins the lists with the chunks, puts the chunks of a payload in order and verifies the digest of the whole.

Payloads are on the move by quarters: chunks are stored, and payloads read, in `TURNS` classes of digests, one after the other, and the shuffle files of a turn are
removed before the next begins, so that at no time more than a share of the bytes lies in shuffle files beside the store.

Digests that stand for more than one in `HOT` of all references meet their chunk by a broadcast of those chunks (fewer than `HOT`, each of `MOST` bytes at
most); all others by a join that moves references only, as the chunks lie dealt out already.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, quoted, settle, settle_turns_by, small_batches, tidy
from .textbytes import steps

#: Least, usual and most bytes of a chunk.
LEAST, USUAL, MOST = 1024, 4096, 16384
HOT = 256
#: Tables of chunks, by the first byte of their digests.
ROUNDS = 2
#: Turns in which chunks are stored and payloads are read, by the first byte of their digests; a multiple of ROUNDS.
TURNS = 4
#: The text payload is padded with spaces to a multiple of this.
UNIT = 192
HEADER = 44
_GEAR = np.random.Generator(np.random.PCG64(20250211)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def gear(arr: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, over it and the 31 before it: sums of 2, 4, .. 32 terms by doubling."""
    h = _GEAR[arr]
    for w in (1, 2, 4, 8, 16):
        if len(h) > w:
            h[w:] = h[w:] + (h[:-w] << np.uint32(w))  # the right side is a new array
    return h


def cuts(arr: np.ndarray, least: int = LEAST, usual: int = USUAL, most: int = MOST) -> list[int]:
    """Where chunks end: the first place after `least` bytes whose hash has its top bits zero, `most` bytes at the latest."""
    n = len(arr)
    places = np.flatnonzero(gear(arr) < np.uint32((1 << 32) // (usual - least))) + 1
    out, at = [], 0
    while n - at > least:
        k = int(np.searchsorted(places, at + least))
        at = min(int(places[k]) if k < len(places) else n, at + most, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def _digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def chunks(media: bytes) -> Iterator[tuple[bytes, memoryview]]:
    """(digest, bytes) of each chunk of a payload."""
    view, at = memoryview(media), 0
    for end in cuts(np.frombuffer(media, np.uint8)):
        yield _digest(view[at:end]), view[at:end]
        at = end


def as_wav(payload: bytes, rate: int = 8000) -> bytes:
    """A payload as the 8-bit samples of a mono sound file."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def text_media(text: bytes | None) -> bytes:
    """A text's bytes, with spaces up to a positive multiple of 192 of them, as a sound file."""
    text = text or b""
    return as_wav(text + b" " * (-len(text) % UNIT if text else UNIT))


def as_it_is(value: bytes | None) -> bytes:
    return value or b""


@dataclass
class MediaStore:
    """rows: the stored rows with their media digest; lists: (media, at, digest, size), once per distinct payload; data: for each of `ROUNDS` classes of digests (digest, data), once per distinct chunk."""

    rows: DataFrame
    lists: DataFrame
    data: list[DataFrame]


def _class(digest: str, classes: int = ROUNDS) -> Column:
    """The class of a digest column: its first byte modulo the number of classes."""
    return F.conv(F.hex(F.substring(digest, 1, 1)), 16, 10).cast("int") % classes


def store_media(df: DataFrame, column: str, wrap: Callable[[bytes | None], bytes] = as_it_is) -> MediaStore:
    """Keep the payloads of a binary or string column as chunks.

    `wrap` makes the stored payload of a value (by default the value itself; null counts as empty). rows has the other columns of df and `media`, the
    sha256 of the payload (with `_` behind its name where df has such a column); repeated rows stay, equal payloads share one list. An empty payload has a list without
    chunks: it is in rows alone. An empty table gives empty tables.
    """
    spark = df.sparkSession
    small_batches(spark)
    name = fresh(df, "media")
    others = [c for c in df.columns if c != column]
    values = F.col(quoted(column)).cast("binary")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "v", 1 << 20):
                media, lists = [], []
                for v in part.column("v").cast(pa.large_binary()).to_pylist():
                    m = wrap(v)
                    media.append(hashlib.sha256(m).digest())
                    lists.append([{"digest": d, "size": len(c)} for d, c in chunks(m)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(media, pa.binary()), pa.array(lists, pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32())])))], names=[*part.schema.names[:-1], "m", "l"])

    plain = df.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others)), values.alias("v"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1]) + "m binary, l array<struct<digest:binary,size:int>>"
    with tidy(spark):
        told = settle(plain.mapInArrow(listed, schema), "media_rows")
        lists = settle(told.select("m", "l").groupBy("m").agg(F.first("l").alias("l")).selectExpr("m as media", "posexplode(l) as (at, c)").selectExpr("media", "at", "c.digest", "c.size"), "media_lists")

    def data(turn: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack = zstandard.ZstdCompressor(level=5)
            for batch in batches:
                for part in steps(batch, "v", 1 << 20):
                    own = {}
                    for v in pc.unique(part.column("v").cast(pa.large_binary())).to_pylist():
                        own |= {d: c for d, c in chunks(wrap(v)) if d[0] % TURNS == turn}
                    yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([pack.compress(c) for c in own.values()], pa.binary())], names=["digest", "data"])

        return run

    def single(turn: int) -> DataFrame:
        return df.select(values.alias("v")).mapInArrow(data(turn), "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data"))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with tidy(spark):
        parts = [settle_turns_by((single(turn) for turn in range(number, TURNS, ROUNDS)), "chunks", "digest", n) for number in range(ROUNDS)]
    return MediaStore(told.drop("l").toDF(*others, name), lists, parts)


def met(left: DataFrame, right: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """An inner join on a digest that is unique in `right`: digests with more than one in `hot` of the rows of `left` (fewer than `hot` digests) by broadcast."""
    total = left.count()
    many = settle(left.groupBy(key).count().where(F.col("count") > total / hot).select(key), "hot")
    few_left = left.join(F.broadcast(many), key, "left_anti")
    hot_right = right.join(F.broadcast(many), key, "left_semi")
    return few_left.join(right.hint("merge"), key).unionByName(left.join(F.broadcast(hot_right), key))


def _ordered(store: MediaStore, lists: DataFrame) -> DataFrame:
    """The chunks of each payload next to one another and in order."""
    spark = lists.sparkSession
    found = None
    for number, data in enumerate(store.data):
        part = met(lists.where(_class("digest") == number), data, "digest").select("media", "at", "size", "data")
        found = part if found is None else found.unionByName(part)
    return found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "media").sortWithinPartitions("media", "at")


class Broken(ValueError):
    """A payload that can't be put together again as it was."""


class _Whole:
    """Takes the chunks of one payload in order; done() verifies its digest."""

    def __init__(self, media: bytes) -> None:
        self.media, self.sum, self.at, self.bytes = media, hashlib.sha256(), 0, 0

    def add(self, at: int, size: int, data: bytes) -> None:
        if at != self.at or size != len(data):
            raise Broken(f"{self.media.hex()}: chunk {self.at} is missing or has another size")
        self.sum.update(data)
        self.at += 1
        self.bytes += size

    def done(self) -> tuple:
        if self.sum.digest() != self.media:
            raise Broken(f"{self.media.hex()}: its chunks don't make it up")
        return ()


class _Payload(_Whole):
    def __init__(self, media: bytes) -> None:
        super().__init__(media)
        self.parts: list[bytes] = []

    def add(self, at: int, size: int, data: bytes) -> None:
        super().add(at, size, data)
        self.parts.append(data)

    def done(self) -> tuple:
        super().done()
        return self.media, b"".join(self.parts)


class _Sound(_Whole):
    """What is told of a sound file: its size, its samples' digest and their last 16 bytes' checksum, and a feature, all in one pass."""

    def __init__(self, media: bytes) -> None:
        super().__init__(media)
        self.head, self.samples, self.tail = b"", hashlib.sha256(), b""
        self.total = self.squares = self.crossings = 0
        self.last: int | None = None
        self.bins = np.zeros(16, np.int64)

    def add(self, at: int, size: int, data: bytes) -> None:
        super().add(at, size, data)
        need = HEADER - len(self.head)
        self.head += data[:need]
        data = data[need:] if need else data
        if not data:
            return
        self.samples.update(data)
        self.tail = (self.tail + data[-16:])[-16:]
        x = np.frombuffer(data, np.uint8)
        y = x.astype(np.int64) - 128
        self.total += int(y.sum())
        self.squares += int((y * y).sum())
        high = x >= 128
        self.crossings += int(np.count_nonzero(high[1:] != high[:-1])) + (self.last is not None and self.last != bool(high[0]))
        self.last = bool(high[-1])
        self.bins += np.bincount(x >> 4, minlength=16)

    def done(self) -> tuple:
        super().done()
        n = self.bytes - HEADER
        if self.head[:4] != b"RIFF" or self.head[36:40] != b"data" or struct.unpack("<I", self.head[40:])[0] != n:
            raise Broken(f"{self.media.hex()}: no sound file of one 8-bit channel")
        feature = f"{self.total}:{self.squares}:{self.crossings}:{'-'.join(map(str, self.bins.tolist()))}"
        return self.media, self.bytes, n, self.samples.hexdigest(), zlib.crc32(self.tail), feature


def _read(kind: type[_Whole], types: list[tuple[str, pa.DataType]], flush: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, now, out = zstandard.ZstdDecompressor(), None, []

        def emit() -> pa.RecordBatch:
            rows = out[:]
            out.clear()
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])

        for batch in batches:
            for media, at, size, data in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or media != now.media:
                    if now is not None:
                        out.append(now.done())
                    if len(out) >= flush:
                        yield emit()
                    now = kind(media)
                now.add(at, size, unpack.decompress(data))
        if now is not None:
            out.append(now.done())
        yield emit()

    return run


def read_payloads(store: MediaStore) -> DataFrame:
    """(media, payload): each distinct payload that isn't empty, once, put together from its chunks and verified."""
    return _ordered(store, store.lists).mapInArrow(_read(_Payload, [("media", pa.binary()), ("payload", pa.binary())], 16), "media binary, payload binary")


def read_sounds(store: MediaStore) -> DataFrame:
    """media, media_bytes, payload_bytes, payload_sha256, tail_crc32 and feature of each distinct sound file, read from its chunks and verified.

    The feature is made of whole numbers: the sum and the sum of squares of the samples less 128, how often neighbours lie on two sides of
    128, and the counts of 16 classes of loudness.
    """
    types = [("media", pa.binary()), ("media_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())]
    schema, out = "media binary, media_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string", None
    with tidy(store.lists.sparkSession):
        for turn in range(TURNS):
            told = settle(_ordered(store, store.lists.where(_class("media", TURNS) == turn)).mapInArrow(_read(_Sound, types, 1024), schema), "sounds")
            out = told if out is None else out.unionByName(told)
    return out


def text_sounds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a stored sound file, read back: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null text counts as empty and is 192 spaces; null ids stay null; a row for each row, repeated or not, and equal texts have equal values. An empty
    table gives no rows; other columns are not read.
    """
    text = F.col(quoted(text_col)).cast("string")
    slim = docs.select(F.col(quoted(id_col)).alias("doc"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    store = store_media(slim, "text", text_media)
    return met(store.rows, read_sounds(store), "media").select(F.col("doc").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media")).alias("media_sha256"), "feature")
