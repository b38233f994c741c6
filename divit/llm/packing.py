"""Packing token sequences by best-fit decreasing over a segment tree of remaining capacities.

Documents are tokenised, closed by an end id and cut into full windows first; what is left of each is
placed in decreasing length into the open window with the least sufficient room. A task packs
its rows by itself, `BATCH_TOKENS` at a time, so that memory doesn't grow with the input and nothing is
shuffled; the one window that stays open goes on into the next batch. Gaps of at least `CUT` tokens
that best fit leaves are filled by cutting the pieces of the emptiest windows, and the last open
window of a task is cut into powers of two.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted, small_batches

BATCH_TOKENS, CUT = 2_000_000, 4
#: Texts of these characters alone go through the faster of two libraries that hold the same vocabulary.
_COMMON = r"[^\x00-ԯ]"


@lru_cache(maxsize=2)
def _encoder(path: str | None):
    """text -> ids, those of Tokenizer.encode(text, add_special_tokens=False): a text that holds the string of a special token gets its id."""
    import base64
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    odd = re.compile("|".join([_COMMON, *map(re.escape, special)]))
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda text: slow.encode(text, add_special_tokens=False).ids if odd.search(text) else fast.encode_ordinary(text)


class Rooms:
    """A segment tree over capacities 0..most: which of them some open window has left."""

    def __init__(self, most: int) -> None:
        self.base = 1 << most.bit_length()
        self.tree = [0] * (2 * self.base)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.base
        while i:
            self.tree[i] += by
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity >= need of an open window, or -1."""
        i, tree = need + self.base, self.tree
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return -1


def best_fit(pieces: list[tuple], window: int, open_: list[tuple] | None = None) -> list[list[tuple]]:
    """Windows of pieces (..., start, length); open_ is a window that is partly filled already."""
    rooms, at = Rooms(window), {}
    out: list[list[tuple]] = []
    if open_:
        out.append(list(open_))
        left = window - sum(p[-1] for p in open_)
        rooms.add(left, 1)
        at[left] = [0]
    for piece in sorted(pieces, key=lambda p: -p[-1]):
        n = piece[-1]
        room = rooms.tightest(n)
        if room < 0:
            out.append([])
            k, room = len(out) - 1, window
        else:
            k = at[room].pop()
            rooms.add(room, -1)
        out[k].append(piece)
        if room > n:
            at.setdefault(room - n, []).append(k)
            rooms.add(room - n, 1)
    return out


def poured(windows: list[list[tuple]], window: int, least: int) -> list[list[tuple]]:
    """Cut the pieces of the emptiest windows into the gaps of at least `least` tokens of the fullest."""
    full = sorted(windows, key=lambda w: -sum(p[-1] for p in w))
    gaps = [window - sum(p[-1] for p in w) for w in full]
    i, j = 0, len(full) - 1
    while i < j:
        if gaps[i] < least:
            i += 1
            continue
        *head, start, n = full[j].pop()
        take = min(n, gaps[i])
        full[i].append((*head, start, take))
        gaps[i] -= take
        if take < n:
            full[j].append((*head, start + take, n - take))
        gaps[j] += take
        if not full[j]:
            j -= 1
    return full[: j + 1] if full else full


def _pack(window: int, end_id: int, path: str | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 36
        held: list[tuple] = []  # (doc, ids)
        tokens = 0
        open_: list[tuple] = []

        def emit(windows: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal sequence
            cols: list[list] = [[] for _ in range(8)]
            for w in windows:
                offset = 0
                for doc, ids, start, n in w:
                    part = ids[start : start + n]
                    for c, v in zip(cols, (doc, start, n, zlib.crc32(part.tobytes()), len(ids), sequence, offset, part)):
                        c.append(v)
                    offset += n
                sequence += 1
            ids = pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32())) if with_ids else pa.nulls(len(cols[0]), pa.list_(pa.int32()))
            return pa.record_batch([*(pa.array(c, pa.int64()) for c in cols[:7]), ids], names=_NAMES)

        def place() -> Iterator[pa.RecordBatch]:
            nonlocal open_
            whole, rest = [], []
            for doc, ids in held:
                cut = len(ids) // window * window
                whole += [[(doc, ids, s, window)] for s in range(0, cut, window)]
                if cut < len(ids):
                    rest.append((doc, ids, cut, len(ids) - cut))
            held.clear()
            windows = poured(best_fit(rest, window, open_), window, CUT)
            open_ = windows.pop() if windows and sum(p[-1] for p in windows[-1]) < window else []
            yield emit(whole + windows)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], np.uint32)
                    held.append((doc, ids))
                    tokens += len(ids)
                    if tokens >= BATCH_TOKENS:
                        yield from place()
                        tokens = 0
        yield from place()
        last: list[list[tuple]] = []
        while open_:  # powers of two need no padding
            room, w = 1 << (sum(p[-1] for p in open_).bit_length() - 1), []
            while room:
                *head, start, n = open_.pop()
                take = min(n, room)
                w.append((*head, start, take))
                if take < n:
                    open_.append((*head, start + take, n - take))
                room -= take
            last.append(w)
        yield emit(last)

    return run


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def pack_documents(docs: DataFrame, window: int = 1024, end_id: int = 0, tokenizer_path: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most `window` (a power of two) tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32 (of its ids as little-endian unsigned
    32-bit numbers), doc_tokens, sequence_id, offset and, with `with_ids`, ids (else null). A null or empty text
    is the end id alone; null ids stay null; each row is a document of its own, repeated or not. Ties in
    length go by row order. An empty table gives no rows; extra columns are not read. `tokenizer_path` is a
    tokenizers file (by default the public byte-level one); a rank file of the same name beside it is used where it gives the same ids.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc"), F.col(quoted(text_col)).cast("string").alias("text"))
    schema = ", ".join(f"`{n}` long" for n in _NAMES[:-1]) + ", ids array<int>"
    out = rows.mapInArrow(_pack(window, end_id, tokenizer_path, with_ids), schema)
    return out if with_ids else out.drop("ids")
