"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

A text's vector holds all its words, lower-cased, weighted by (1 + log of its count) * idf * (1 + `PULL` * lean), where lean is the signed root of the
likelihood ratio of the word between the classes in the labelled rows (0 unless it leans to label 1): words that say nothing of the class still count,
those that do count more. Held out at sf0.1, plain TF-IDF (`PULL` = 0) ranks far worse; README has figures. Document frequencies of the
examples' words are counted over all documents; a word that no example has takes part in the norm alone, as one of a single document.

At most `TAUGHT` labelled rows, drawn by a hash, give the leans, and at most `EXAMPLES` of them are indexed (copies and near copies once),
so what is broadcast is bounded. Neighbours are exact: blocks of examples are visited by falling bound, a few at a time, until the
bound is below the k-th best cosine. Neighbours vote by squared cosine; votes are calibrated on the examples, each scored without itself, by
pooling adjacent violators. A score depends on the text alone: equal texts score alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted, settle, small_batches, trimmed
from .textbytes import LOWER, Hasher, flat, mix, spans, steps

TAUGHT, EXAMPLES, NEIGHBOURS, BLOCK, PULL = 20_000, 1_024, 25, 64, 3.0
#: A word of fewer labelled rows has no lean.
SUPPORT = 5
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, how often) of the distinct words of each row, by row and term."""
    buf, off = flat(column)
    low = LOWER[buf]
    if len(low):
        latin = np.zeros(len(low), bool)
        latin[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)
        low = np.where(latin, low + np.uint8(0x20), low)
    begin, end, row = spans(low, off, _WORD[low])
    term = mix(Hasher(low)(begin, end) + np.uint64(1))
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    if not len(row):
        return row, term, row
    at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])]))
    return row[at], term[at], np.diff(np.append(at, len(row)))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beside each row a hash of its four smallest word hashes: copies and most near copies share it."""
    for batch in batches:
        for part in steps(batch, "text"):
            row, term, _ = _terms(part.column("text"))
            place = np.arange(len(row)) - np.searchsorted(row, row)
            key = np.zeros(part.num_rows, np.uint64)
            for k in range(4):
                at = place == k
                key[row[at]] = mix(key[row[at]] ^ term[at])
            yield pa.record_batch([part.column("text"), part.column("label"), part.column("doc"), pa.array(key.view(np.int64))], names=["text", "label", "doc", "alike"])


def _support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many labelled rows, how many of label 1 and how many indexed examples have each word, summed step by step."""
    for batch in batches:
        for part in steps(batch, "text"):
            row, term, _ = _terms(part.column("text"))
            t, at = np.unique(term, return_inverse=True)
            sums = [np.bincount(at, weights=np.asarray(part.column(c)).astype(np.float64)[row], minlength=len(t)).astype(np.int64) for c in ("label", "indexed")]
            yield pa.record_batch([pa.array(t.view(np.int64)), pa.array(np.bincount(at, minlength=len(t)).astype(np.int64)), *map(pa.array, sums)], names=["term", "n", "pos", "indexed"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words and counts of each example."""
    for batch in batches:
        for part in steps(batch, "text"):
            row, term, times = _terms(part.column("text"))
            cuts = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows)))
            lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(v.astype(np.int64) if v is times else v.view(np.int64))) for v in (term, times)]
            yield pa.record_batch([part.column("doc"), part.column("label"), *lists], names=["doc", "label", "terms", "times"])


def _frequencies(words):
    """In how many rows of a task each of the sorted words is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        count = np.zeros(len(known), np.int64)
        for batch in batches:
            for part in steps(batch, "text"):
                _, term, _ = _terms(part.column("text"))
                at = np.searchsorted(known, term)
                near = at < len(known)
                at = at[near][known[at[near]] == term[near]]
                count += np.bincount(at, minlength=len(known))
        at = np.flatnonzero(count)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(count[at])], names=["word", "n"])

    return run


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after another, and which range each is of."""
    n = (end - begin).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (begin - (np.cumsum(n) - n))[of], of


class BlockMaxIndex:
    """Postings of unit vectors in blocks of examples, with each word's largest weight in each block.

    vectors: (places of words, counts) of each example; `scale` weighs the words, `other` is the weight of unknown ones.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray, other: float = 1.0, block: int = BLOCK) -> None:
        order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0].tolist(), vectors[i][1].tolist()))  # like vectors share blocks
        self.names, self.block, self.scale, self.other, self.size = np.array(order, np.int64), block, scale, other, len(order)
        self.blocks = -(-len(order) // block)
        word = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0, np.int64)])
        place = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order]) if order else word
        weight = (1 + np.log(np.concatenate([vectors[i][1] for i in order] or [np.ones(0)]))) * scale[word]
        norm = np.sqrt(np.bincount(place, weights=weight**2, minlength=len(order)))
        weight = weight / norm[place]
        by = np.lexsort((place, word))
        word = word[by]
        self.place, self.weight = place[by].astype(np.int32), weight[by]
        cell = word * max(1, self.blocks) + self.place // block
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        self.start = np.append(first, len(cell)).astype(np.int32)  # cells: the postings of a word in a block
        self.in_block = (self.place[first] // block).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.cells = np.searchsorted(word[first], np.arange(len(scale) + 1)).astype(np.int32)

    def nearest(self, words: np.ndarray, times: np.ndarray, k: int, unknown: np.ndarray | None = None, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of the largest cosine above 0, as (cosine, example), best first; ties to the smaller example."""
        weight = (1 + np.log(times)) * self.scale[words]
        rest = 0.0 if unknown is None else float((((1 + np.log(unknown)) * self.other) ** 2).sum())
        norm = np.sqrt((weight**2).sum() + rest)
        if not len(words) or not norm or not self.size:
            return []
        weight = weight / norm
        which, of = _ranges(self.cells[words], self.cells[words + 1])
        in_block, weight = self.in_block[which], weight[of]
        bound = np.bincount(in_block, weights=weight * self.top[which], minlength=self.blocks)
        visit = np.argsort(-bound, kind="stable")
        visit = visit[bound[visit] > 0]
        scores = np.zeros(self.size)
        at, wave, least = 0, 4, 0.0
        while at < len(visit) and bound[visit[at]] >= least - 1e-9:
            some = visit[at : at + wave]
            now = np.zeros(self.blocks, bool)
            now[some[bound[some] >= least - 1e-9]] = True
            at, wave = at + wave, 2 * wave
            here = now[in_block]
            post, of = _ranges(self.start[which[here]], self.start[which[here] + 1])
            scores += np.bincount(self.place[post], weights=self.weight[post] * weight[here][of], minlength=self.size)
            if len(scores) > k + 1:
                least = float(np.partition(scores, -k - 1)[-k - 1])  # one more than k: `without` may be among them
        found = np.flatnonzero(scores > 0)
        if len(found) > k + 1:
            found = found[scores[found] >= np.partition(scores[found], -k - 1)[-k - 1] - 1e-9]
        near = sorted((-round(float(scores[i]), 9), int(self.names[i])) for i in found)
        return [(-s, name) for s, name in near if name != without][:k]


def _vote(found: list[tuple[float, int]], labels: np.ndarray, prior: float) -> float:
    w = np.array([s * s for s, _ in found])
    return float((w @ labels[[i for _, i in found]] + 1e-6 * prior) / (w.sum() + 1e-6)) if found else prior


def _alone(shared, others, k: int):
    """The vote on each example by the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, labels, prior = shared.value[:3]
        vectors = others.value
        for batch in batches:
            places = batch.column(0).to_pylist()
            votes = [_vote(index.nearest(*vectors[i], k, without=i), labels, prior) for i in places]
            yield pa.record_batch([pa.array(votes, pa.float64()), pa.array([int(labels[i]) for i in places], pa.int64())], names=["vote", "label"])

    return run


_NEAR = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))


def _scored(shared, k: int, knots, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, labels, prior, docs, known = shared.value
        seen: dict[int, tuple] = {}
        for batch in batches:
            for part in steps(batch, "text"):
                row, term, times = _terms(part.column("text"))
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                place = np.minimum(np.searchsorted(known, term), max(0, len(known) - 1))
                hit = known[place] == term if len(known) else np.zeros(len(term), bool)
                votes, near = [], []
                for a, b in zip(cuts, cuts[1:]):
                    key = hashlib.blake2b(term[a:b].tobytes() + times[a:b].tobytes(), digest_size=16).digest()
                    if key not in seen:
                        h = hit[a:b]
                        found = index.nearest(place[a:b][h], times[a:b][h], k, times[a:b][~h])
                        if len(seen) > (1_000 if keep else 20_000):
                            seen.clear()
                        seen[key] = _vote(found, labels, prior), [{"example": int(docs[j]), "cosine": s, "label": int(labels[j])} for s, j in found] if keep else None
                    votes.append(seen[key][0]), near.append(seen[key][1])
                score = np.clip(np.interp(votes, *knots) if knots[0] else np.array(votes), 0.0, 1.0)
                yield pa.record_batch([part.column("doc"), part.column("key"), pa.array(score, pa.float64()), pa.array(near, _NEAR)], names=["doc", "key", "score", "evidence"])

    return run


def _calibration(cells: list[tuple[float, float, float]], prior: float) -> tuple[list[float], list[float]]:
    """Pool adjacent violators over (mean vote, rows, positives) by rising vote -> knots of a rising line, with ends half way to 0 and 1."""
    pools: list[list[float]] = []
    for x, n, pos in cells:
        pools.append([x * n, n, pos])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], a)]
    xs, ys = [p[0] / p[1] for p in pools], [(p[2] + prior) / (p[1] + 1) for p in pools]
    if not xs:
        return xs, ys
    return [*([0.0] if xs[0] > 0 else []), *xs, *([1.0] if xs[-1] < 1 else [])], [*([ys[0] / 2] if xs[0] > 0 else []), *ys, *([(1 + ys[-1]) / 2] if xs[-1] < 1 else [])]


def score_toxicity(docs: DataFrame, labels: DataFrame, train: str = "true", taught: int = TAUGHT, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS, evidence: bool = False, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", key: bool = False) -> DataFrame:
    """How likely each document is of class 1, from its whole text alone.

    labels(id_col, label_col) may teach where the SQL condition `train` on `id_col` holds; at most `taught` of them do, and `examples` are indexed. Rows of labels
    with a null id or label teach nothing, and an id labelled more than once counts with its smallest label; of rows that repeat a labelled id each text teaches.
    Returns one row per input row: `id_col`, score (0 to 1), predicted (1 if score >= 0.5) and, on demand, evidence (the nearest examples with cosine and label)
    and key (a hash of the text). Null and empty texts and those without a word of any example get the examples' rate of label 1. Without labelled rows
    scores are 0.49, hence predicted 0. Null ids stay null; an empty table gives no rows; extra columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col(quoted(text_col)).cast("string")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("key"))
    label = F.col(quoted(label_col)).cast("int")
    teach = labels.where(F.expr(train)).select(F.col(quoted(id_col)).cast("long").alias("t_doc"), label.alias("label")).where("t_doc is not null and label is not null")
    teach = teach.groupBy("t_doc").agg(F.min("label").alias("label"))
    drawn = settle(teach.orderBy(F.xxhash64(F.lit(7), "t_doc"), "t_doc").limit(taught), "drawn")
    texts = rows.join(F.broadcast(drawn), F.col("doc") == F.col("t_doc")).where("text is not null").select("text", "label", "doc")  # at most `taught` ids of 12 bytes
    marked = texts.mapInArrow(trimmed(_alike), "text string, label int, doc long, alike long")
    texts = settle(marked.groupBy("alike").agg(F.min_by(F.struct("text", "label", "doc"), F.struct("doc", "text")).alias("r")).select("r.*"), "labelled")
    chosen = texts.select(F.xxhash64(F.lit(9), "doc").alias("turn"), "doc").orderBy("turn", "doc").limit(examples).select(F.col("doc").alias("e_doc"))
    texts = settle(texts.join(F.broadcast(chosen), F.col("doc") == F.col("e_doc"), "left").select("text", "label", "doc", F.col("e_doc").isNotNull().cast("int").alias("indexed")), "labelled")
    totals = texts.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    n, pos = totals["n"], totals["pos"] or 0
    prior = pos / n if n else 0.49

    support = texts.mapInArrow(trimmed(_support), "term long, n long, pos long, indexed long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n", "pos", "indexed")))
    vocabulary = support.where("indexed > 0").select("term", "n", "pos").toPandas()  # the words of the examples
    known = vocabulary["term"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(known)
    known, has, of = known[by], vocabulary["n"].to_numpy(np.float64)[by], vocabulary["pos"].to_numpy(np.float64)[by]
    lean = np.zeros(len(known))
    if 0 < pos < n:
        observed = np.stack([of, has - of, pos - of, (n - pos) - (has - of)])
        expected = np.stack([has * prior, has * (1 - prior), (n - has) * prior, (n - has) * (1 - prior)])
        ratio = 2 * np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-300) / np.maximum(expected, 1e-300)), 0.0).sum(0)
        lean = np.where((has >= SUPPORT) & (of / pos > (has - of) / (n - pos)), np.sqrt(np.maximum(ratio, 0.0)), 0.0)
    words = spark.sparkContext.broadcast(known)
    df = np.zeros(len(known))
    counted = rows.select("text").mapInArrow(trimmed(_frequencies(words)), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    df[counted["word"].to_numpy(np.int64)] = counted["n"].to_numpy(np.float64)
    total = docs.count()
    scale = (np.log((1 + total) / (1 + df)) + 1) * (1 + PULL * lean)

    sample = sorted(texts.where("indexed = 1").mapInArrow(trimmed(_vectors), "doc long, label int, terms array<long>, times array<long>").collect(), key=lambda r: (r.doc, r.terms))  # at most `examples` vectors
    sample = [r for r in sample if r.terms]
    vectors = [(np.searchsorted(known, np.array(r.terms, np.int64).view(np.uint64)), np.array(r.times, np.float64)) for r in sample]
    index = BlockMaxIndex(vectors, scale, float(np.log((1 + total) / 2) + 1))
    others = spark.sparkContext.broadcast(vectors)
    shared = spark.sparkContext.broadcast((index, np.array([r.label for r in sample], np.float64), prior, [r.doc for r in sample], known))
    alone = spark.range(0, len(sample), 1, max(1, len(sample) // 128)).mapInArrow(trimmed(_alone(shared, others, neighbours)), "vote double, label long").collect()  # a row per example
    others.destroy()
    words.destroy()
    cells = [(v, 1.0, float(y)) for v, y in sorted((r.vote, r.label) for r in alone)]
    knots = _calibration(cells, prior)
    out = rows.mapInArrow(trimmed(_scored(shared, neighbours, knots, evidence)), "doc long, key long, score double, evidence array<struct<example:long,cosine:double,label:int>>")
    out = out.select(F.col("doc").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "key")
    return out.drop(*([] if evidence else ["evidence"]), *([] if key else ["key"]))
