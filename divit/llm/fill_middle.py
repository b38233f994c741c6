"""Fill-in-the-middle transformation of whole texts by ropes.

A text becomes a balanced tree whose leaves are pieces of its UTF-8 bytes; each node caches how many units and how many code points
lie below it. Two ranks of units split the tree into prefix, middle and suffix, and their subtrees are joined anew between sentinels, without
copying a text until it is written out. Inversion makes a rope of the output, finds the sentinels and splits at their ranks of code points.

Units tile a text: code points ("point"), words with the white space after them ("word"; leading white space is a unit) or lines with their ends ("line").
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, small_batches
from .textbytes import SPACE, steps

#: Bytes of a leaf; a code point is never cut, so a leaf may be three bytes longer.
LEAF = 4096
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
UNITS, POINTS = 0, 1


def _marks(arr: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Where units and where code points begin."""
    points = (arr & 0xC0) != 0x80
    if unit == "point":
        return points, points
    units = np.zeros(len(arr), bool)
    if len(arr):
        units[0] = True
        if unit == "line":
            units[1:] = arr[:-1] == 10
        elif unit == "word":
            units[1:] = SPACE[arr[:-1]] & ~SPACE[arr[1:]]
        else:
            raise ValueError(f"unknown unit {unit}")
    return units, points


class Rope:
    """A leaf (bytes and the marks in them) or the concatenation of two ropes; `size` holds the counts of units and code points."""

    __slots__ = ("left", "right", "data", "marks", "size")

    def __init__(self, left: Rope | None, right: Rope | None, data: memoryview | None = None, marks: tuple[np.ndarray, np.ndarray] | None = None, size: tuple[int, int] | None = None) -> None:
        self.left, self.right, self.data, self.marks = left, right, data, marks
        self.size = size or (left.size[0] + right.size[0], left.size[1] + right.size[1])


def _leaf(data: memoryview, units: np.ndarray, points: np.ndarray) -> Rope:
    return Rope(None, None, data, (units, points), (int(np.count_nonzero(units)), int(np.count_nonzero(points))))


def build(data: bytes, unit: str = "point") -> Rope:
    """A balanced rope of a text."""
    view, arr = memoryview(data), np.frombuffer(data, np.uint8)
    units, points = _marks(arr, unit)
    edges = []
    for at in range(0, len(arr), LEAF):
        while at < len(arr) and not points[at]:
            at += 1
        edges.append(at)
    row = [_leaf(view[a:b], units[a:b], points[a:b]) for a, b in zip(edges, [*edges[1:], len(arr)])] or [_leaf(view, units, points)]
    while len(row) > 1:
        row = [Rope(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0]


def split(rope: Rope, rank: int, by: int = UNITS) -> tuple[Rope, Rope]:
    """The first `rank` units (or code points) and the rest."""
    if rope.data is not None:
        starts = np.flatnonzero(rope.marks[by])
        at = int(starts[rank]) if rank < len(starts) else len(rope.data)
        units, points = rope.marks
        return _leaf(rope.data[:at], units[:at], points[:at]), _leaf(rope.data[at:], units[at:], points[at:])
    if rank < rope.left.size[by]:
        a, b = split(rope.left, rank, by)
        return a, Rope(b, rope.right)
    a, b = split(rope.right, rank - rope.left.size[by], by)
    return Rope(rope.left, a), b


def joined(*parts: Rope) -> Rope:
    out = parts[0]
    for p in parts[1:]:
        out = Rope(out, p)
    return out


def written(rope: Rope) -> bytes:
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if r.data is not None:
            out.append(r.data)
        else:
            todo += [r.right, r.left]
    return b"".join(out)


def _sentinel(text: str) -> Rope:
    """A leaf without units: what is put in has code points only."""
    data = text.encode()
    arr = np.frombuffer(data, np.uint8)
    return _leaf(memoryview(data), np.zeros(len(arr), bool), (arr & 0xC0) != 0x80)


def transform(data: bytes, draws: tuple[int, int, int, int], unit: str, plain: int, spm: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text. draws: numbers that choose both ends of the middle, whether to stay plain, and the order."""
    rope = build(data, unit)
    n = rope.size[UNITS]
    if not n or draws[2] % 100 >= 100 - plain or any(s.encode() in data for s in sentinels):
        return n, PLAIN, None, None, data
    a, b = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    head, suffix = split(rope, b)
    prefix, middle = split(head, a)
    p, s, m = map(_sentinel, sentinels)
    form = SPM if draws[3] % 100 < spm else PSM
    out = joined(s, suffix, p, prefix, m, middle) if form == SPM else joined(p, prefix, s, suffix, m, middle)
    return n, form, prefix.size[POINTS], middle.size[POINTS], written(out)


def inverse(output: bytes, form: str, sentinels: tuple[str, str, str]) -> bytes:
    """The text of an output: the rope of the output is split at the code-point ranks of its sentinels."""
    if form == PLAIN:
        return output
    rope, (p, s, m) = build(output), (x.encode() for x in sentinels)
    first, second = (s, p) if form == SPM else (p, s)
    if not output.startswith(first):
        raise ValueError("an output that begins without its sentinel")
    cuts = [0]
    for mark in (second, m):
        at = output.find(mark, cuts[-1])
        if at < 0:
            raise ValueError("an output without one of its sentinels")
        cuts.append(at)
    points = (np.frombuffer(output, np.uint8) & 0xC0) != 0x80
    pieces = []
    for cut, mark in zip(reversed(cuts), (m, second, first)):
        rope, tail = split(rope, int(np.count_nonzero(points[:cut])), POINTS)
        pieces.append(split(tail, len(mark.decode()), POINTS)[1])
    middle, two, one = pieces
    prefix, suffix = (two, one) if form == SPM else (one, two)
    return written(joined(prefix, middle, suffix))


def _draws(key: str, seed: str) -> list:
    """The first four groups of eight hex digits of sha256(seed:key), as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that can be told apart wherever texts are cut: none begins inside another or again inside itself."""
    if len(set(sentinels)) < 3 or any(not s or any(t.startswith(s[k:]) or s[k:].startswith(t) for k in range(1, len(s))) or (s is not t and s in t) for s in sentinels for t in sentinels):
        raise ValueError("sentinels must not overlap one another")
    return sentinels


def fill_in_middle(docs: DataFrame, unit: str = "point", plain: int = 10, spm: int = 20, seed: str = "1", sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with five more columns: units long, form string, prefix_chars and middle_chars long, output string.

    `plain` percent of the texts stay as they are, and so do empty texts and texts that hold a sentinel (form plain, no lengths); of the others `spm`
    percent have their suffix first (form spm), the rest their prefix (psm). A null text counts as empty. What is drawn for a row hangs on its id
    alone (a null id counts as ""), so reruns and repeated rows agree. Columns of any name are carried along; a new column whose name is taken gets
    a longer one, with `_` behind it. An empty table gives no rows.
    """
    _checked(sentinels)
    small_batches(docs.sparkSession)
    n, at = len(docs.columns), docs.columns.index(text_col)
    names = [f"c{i}" for i in range(n)]
    plain_rows = docs.toDF(*names)  # Spark can't hand columns with dots in their names to Arrow functions
    rows = plain_rows.withColumn(f"c{at}", F.col(f"c{at}").cast("string")).select(*names, *_draws(names[docs.columns.index(id_col)], seed))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:n]) + ", units long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, names[at], 1 << 20):
                draws = zip(*(part.column(n + i).to_pylist() for i in range(4)))
                texts = part.column(at).cast(pa.large_binary()).to_pylist()
                found = [transform(t or b"", d, unit, plain, spm, sentinels) for t, d in zip(texts, draws)]
                new = [pa.array([r[k] for r in found], kind) for k, kind in ((0, pa.int64()), (1, pa.string()), (2, pa.int64()), (3, pa.int64()))]
                out = pa.array([r[4] for r in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *new, out], names=[*names, "units", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, schema).toDF(*docs.columns, *(fresh(docs, name) for name in ("units", "form", "prefix_chars", "middle_chars", "output")))


def restored(rows: DataFrame, output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows with one more column, restored string: the text that an output and its form stand for.

    A null output gives null, a null form counts as plain, and an output without its sentinels is an error. Other columns are carried along;
    where there is a column `restored` already, the new one has a longer name, with `_` behind it. An empty table gives no rows.
    """
    small_batches(rows.sparkSession)
    names = [f"c{i}" for i in range(len(rows.columns))]
    at, kind = rows.columns.index(output), rows.columns.index(form)
    plain_rows = rows.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, names[at], 1 << 20):
                pairs = zip(part.column(at).cast(pa.large_binary()).to_pylist(), part.column(kind).to_pylist())
                texts = pa.array([None if o is None else inverse(o, f or PLAIN, sentinels) for o, f in pairs], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*names, "restored"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain_rows.schema.fields) + ", restored string"
    return plain_rows.mapInArrow(run, schema).toDF(*rows.columns, fresh(rows, "restored"))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: its units, form, lengths, and the digests of its output and of the text restored from that."""
    made = fill_in_middle(docs.select("doc_id", "text")).drop("text")
    return restored(made).select("doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), F.sha2(F.encode("restored", "UTF-8"), 256).alias("restored_sha256"))
