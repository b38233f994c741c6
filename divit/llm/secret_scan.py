"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Runs of `SHORTEST` or more characters of an encoding's alphabet outside the fixed patterns' matches are candidates. Their
encoding (decimal, hex, base32, base64, base64url, alphanumeric) is inferred from the characters; strings of letters of one
case are words of some language rather than an encoding and no candidates. Each candidate's digits go through chi-squared
uniformity over the alphabet (folded until five are expected in a cell), a runs test about the middle, and lag-one
serial correlation; the three p-values combine by Fisher's method. Random strings have uniform p-values, other strings
p-values near 0. So over the distinct strings of all documents, per encoding and length class, twice the number above 1/2 estimates the
random strings, and the least threshold at which the others' share among the accepted is at most `rate` is taken. Shares of small classes are
shrunk towards those of all classes together, and these towards a prior in which half of the strings are random, by one formula for any number of strings:
a lone secret is judged by the prior.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted, settle, small_batches
from .textbytes import steps

#: Fixed patterns, with the shortest length that counts.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WORDS = ("passw", "secret", "token", "api_key", "apikey")

#: Runs shorter than SHORTEST give the chi-squared test fewer than four cells of five expected digits. A class' shares are shrunk towards those of
#: all classes, which count as FEW more strings, and these towards the prior in the same way. Natural strings lie in the first bin of the prior.
SHORTEST, BINS, FEW = 20, 100, 60
PRIOR = [0.5 + 0.5 / BINS] + [0.5 / BINS] * (BINS - 1)
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_ALPHABETS = {
    "decimal": (re.compile(r"[0-9]+"), _DIGITS),
    "hex": (re.compile(r"[0-9a-f]+|[0-9A-F]+"), _DIGITS + "abcdef"),
    "base32": (re.compile(r"(?=.*[2-7])[A-Z2-7]+=*"), _UPPER + "234567"),
    "alnum": (re.compile(r"(?=.*[0-9])[A-Za-z0-9]+"), _UPPER + _LOWER + _DIGITS),
    "base64": (re.compile(r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+=*"), _UPPER + _LOWER + _DIGITS + "+/"),
    "base64url": (re.compile(r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_-]+=*"), _UPPER + _LOWER + _DIGITS + "-_"),
}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches: leftmost and non-overlapping within each kind, in code points."""
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding_of(token: str) -> str | None:
    """The narrowest encoding whose alphabet holds the token, or None."""
    return next((name for name, (fits, _) in _ALPHABETS.items() if fits.fullmatch(token)), None)


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str, encoding: str) -> float:
    """Fisher's combination of the three tests' p-values: uniform on (0, 1) for random strings."""
    alphabet = _ALPHABETS[encoding][1]
    token = token.rstrip("=")
    if encoding == "hex":
        token = token.lower()
    v = np.array([alphabet.index(c) for c in token])
    n, size = len(v), len(alphabet)
    cells = max(2, min(size, n // 5))
    edges = (np.arange(size) * cells) // size
    expected = np.bincount(edges, minlength=cells) * n / size
    chi = float((((np.bincount(edges[v], minlength=cells)) - expected) ** 2 / expected).sum())
    df = cells - 1
    tests = [_upper_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))]
    high = v >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + int((high[1:] != high[:-1]).sum())
        tests.append(2 * _upper_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        tests.append(2.0 ** (1 - n))
    c = v - v.mean()
    total = float((c * c).sum())
    tests.append(2 * _upper_tail(abs(float((c[1:] * c[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total else 0.0)
    x = -sum(math.log(max(p, 1e-300)) for p in tests)
    return math.exp(-x) * (1 + x + x * x / 2)


def _name(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little", signed=True)


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float, int]]:
    """(start, end, encoding, p, hash of the string) of runs that overlap none of the spans in `taken`."""
    out, at, reach = [], 0, -1  # reach: the furthest end of the spans that begin before a run ends
    for m in _RUN.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach > m.start():
            continue
        encoding = encoding_of(m[0])
        if encoding:
            out.append((m.start(), m.end(), encoding, randomness(m[0], encoding), _name(m[0])))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("p", pa.float64()), ("name", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "text"):
            base, more = [], []
            for text in part.column("text").to_pylist():
                b = base_spans(text or "")
                base.append([{"start": s, "end": e, "kind": k, "p": None, "name": None} for s, e, k in b])
                more.append([{"start": s, "end": e, "kind": k, "p": p, "name": h} for s, e, k, p, h in candidates(text or "", b)])
            yield pa.record_batch([part.column("doc"), pa.array(base, _SPANS), pa.array(more, _SPANS)], names=["doc", "base", "more"])


_LENGTH_CLASS = "cast(least(6, floor(log2(c.end - c.start))) as int)"


def thresholds(scanned: DataFrame, rate: float) -> dict[tuple[str, int], float]:
    """Per (encoding, length class) the least accepted p-value; each distinct string counts once. A few dozen rows of counts reach the driver."""
    distinct = scanned.selectExpr("explode(more) c").selectExpr("c.kind k", f"{_LENGTH_CLASS} l", f"least({BINS - 1}, cast(floor(c.p * {BINS}) as int)) b", "c.name name").distinct()
    bins: dict[tuple[str, int], list[int]] = {}
    for r in distinct.groupBy("k", "l", "b").count().collect():
        bins.setdefault((r.k, r.l), [0] * BINS)[r.b] = r["count"]
    out = {}
    whole = [FEW * p + sum(c) for p, *c in zip(PRIOR, *bins.values())]
    for key, own in bins.items():
        n = [c + FEW * w / sum(whole) for c, w in zip(own, whole)]
        random = 2 * sum(n[BINS // 2 :])
        ok = [i for i in range(BINS // 2 + 1) if (kept := sum(n[i:])) and 1 - min(kept, random * (1 - i / BINS)) / kept <= rate]
        out[key] = min(ok) / BINS if ok else 0.5
    return out


def scan_secrets(docs: DataFrame, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in each document.

    Returns one row per input row: `id_col` and spans, an array of (start, end, kind) in code points, end exclusive, by start and
    then kind: the fixed patterns' kinds, then "random". Null and empty texts have none; null ids stay null. Repeated rows count each.
    An empty table gives no rows; extra columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc"), F.col(quoted(text_col)).cast("string").alias("text"))
    span = "array<struct<start:int,end:int,kind:string,p:double,name:bigint>>"
    scanned = settle(rows.mapInArrow(_scan, f"doc long, base {span}, more {span}"), "scanned")
    least = thresholds(scanned, rate)
    cut = "case " + " ".join(f"when c.kind = '{k}' and {_LENGTH_CLASS} = {n} then c.p >= {p}" for (k, n), p in least.items()) + " else false end" if least else "false"
    kinds = "array(" + ", ".join(f"'{k}'" for k in (*KINDS, "random")) + ")"
    slim = "named_struct('start', {0}.start, 'at', array_position({1}, {2}), 'end', {0}.end, 'kind', {2})"
    base = f"transform(base, c -> {slim.format('c', kinds, 'c.kind')})"
    more = f"transform(filter(more, c -> {cut}), c -> {slim.format('c', kinds, chr(39) + 'random' + chr(39))})"
    ordered = f"transform(array_sort(concat({base}, {more})), s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))"
    return scanned.select(F.col("doc").alias(id_col), F.expr(ordered).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with each span of secrets (joined where they overlap) replaced by `mark`; all rows and columns stay.

    Decisions use the thresholds over all documents and a text alone, so rows that repeat an id or a text are each redacted. Null and
    empty texts stay as they are, null ids too, and columns of any name are carried along. `chars_col`, where there is one, gets the new
    length of texts that change. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(quoted(text_col)).cast("string").alias("text")).withColumn("doc", F.lit(None).cast("long"))
    span = "array<struct<start:int,end:int,kind:string,p:double,name:bigint>>"
    least = thresholds(settle(rows.mapInArrow(_scan, f"doc long, base {span}, more {span}"), "scanned"), rate)
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        found = [(s, e) for s, e, _ in base] + [(s, e) for s, e, k, p, _ in candidates(text, base) if p >= least.get((k, min(6, int(math.log2(e - s)))), 2.0)]
        out, done, pos = [], 0, 0
        for s, e in sorted(found):
            if s >= done:
                out += [text[pos:s], mark]
            done = max(done, e)
            pos = done
        return "".join([*out, text[pos:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(at).to_pylist()
            texts = [clean(t) for t in before]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if size_at is not None:
                sizes = [n if t == u else len(t) for n, t, u in zip(columns[size_at].to_pylist(), texts, before)]
                columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # Spark can't hand columns with dots in their names to Arrow functions
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
