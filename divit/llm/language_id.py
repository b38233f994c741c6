"""Language ID by Bayesian fusion of a page's text with declared markup language, address suffix and host.

Text: naive Bayes over hashed byte trigrams of the visible text, learned from at most `SAMPLE` labelled documents of each language, its
log-likelihoods divided by `TEMPER` (neighbouring trigrams are not independent). Markup (the lang attribute of <html>) and address
suffix (top-level domain and first path segment): P(value | language) from counts of posteriors, grouped over all pages and
smoothed. Host: P(language | host) from the same kind of counts, smoothed towards the parent domain, this towards its own parent, up to all pages; a
page's own share is taken out of its host's counts. Counts start from text posteriors and are taken anew once from the fused ones.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle, small_batches
from .textbytes import LOWER, flat, steps
from .url_filter import host_and_path

SAMPLE, BUCKETS, TEMPER, SMOOTH, KAPPA = 2000, 1 << 14, 12.0, 0.5, 4.0
_HIDDEN = re.compile(r"(?is)<(script|style|head|nav|footer|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def visible(page: str | None) -> str:
    """Text outside tags, comments, scripts, styles, heads, navigation and footers."""
    return entities.unescape(_HIDDEN.sub(" ", page)) if page else ""


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each byte trigram that stays inside its row."""
    buf, off = flat(column)
    b = LOWER[buf].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]
    row = np.searchsorted(off, np.arange(len(code)), "right") - 1
    inside = np.arange(len(code)) + 3 <= off[row + 1]
    return row[inside], (((code * np.uint32(2654435761)) >> np.uint32(18)) & np.uint32(BUCKETS - 1)).astype(np.int64)[inside]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in steps(batch, "text"):
            row, bucket = _trigrams(part.column("text"))
            langs = np.array(part.column("lang").to_pylist(), object)[row]
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(bucket[langs == lang], minlength=BUCKETS)
    for lang, n in sums.items():
        k = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n[k].astype(np.int64))], names=["lang", "bucket", "n"])


def _likelihoods(table: np.ndarray, pages: bool):
    """Log-likelihoods of each row's text in every language, tempered and with their maximum at 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                text = pa.array([visible(t) for t in part.column("text").to_pylist()], pa.string()) if pages else part.column("text")
                row, bucket = _trigrams(text)
                out = np.stack([np.bincount(row, weights=t[bucket], minlength=part.num_rows) for t in table], 1) / TEMPER
                out -= out.max(1, keepdims=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]).astype(np.int32)), pa.array(out.reshape(-1)))
                yield pa.record_batch([*(part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "text"), lists], names=[*(n for n in part.schema.names if n != "text"), "loglik"])

    return run


def text_model(labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of trigram buckets) from at most `sample` documents of each language, drawn by a hash of their ids."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(F.lit(3), id_col, F.length(text_col)).alias("h"), F.col(id_col).alias("i"))
    totals = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(totals)
    share = {lang: min(1.0, sample / n) for lang, n in totals.items()}
    cut = F.lit(0.0)
    for lang in langs:
        cut = F.when(F.col(lang_col) == lang, F.lit(share[lang])).otherwise(cut)
    draw = F.pmod(F.xxhash64(F.lit(3), id_col, F.length(text_col)), F.lit(1 << 40)) / float(1 << 40)
    chosen = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (draw < cut)).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    table = np.full((len(langs), BUCKETS), SMOOTH)
    for r in chosen.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():  # languages x buckets rows at most
        table[langs.index(r.lang), r.bucket] += r.n
    return langs, np.log(table / table.sum(1, keepdims=True))


def _normal(logs: Column) -> Column:
    """exp and divide by the sum; the largest term is taken out first."""
    return F.expr(f"transform(transform({logs}, x -> exp(x - array_max({logs}))), x -> x / aggregate(transform({logs}, y -> exp(y - array_max({logs}))), 0D, (s, y) -> s + y))")


def identify_languages(pages: DataFrame, labelled: DataFrame, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **columns: str) -> DataFrame:
    """The language of each page.

    labelled(doc_id, text, lang) teaches the text model (`columns` names others). Returns one row per input row: `id_col`, host, declared (markup language or null),
    lang, probability and text_lang (what the text alone says). Null html has no text and nothing declared, null or odd urls have an empty host: the
    evidence that is left decides, at last the languages' shares over all pages; ties go to the smaller code. Null ids stay null and repeated rows count each. Without labelled
    rows lang and text_lang are null. An empty table gives no rows; extra columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    langs, table = text_model(labelled, sample, **columns)
    host, path = host_and_path(F.col(url_col))
    declared = F.nullif(F.lower(F.regexp_extract(F.col(html_col), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), F.regexp_extract(path, r"^/([A-Za-z]{2,3})(?:/|$)", 1).alias("seg"), declared.alias("declared"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("text"))
    if not langs:
        null = F.lit(None).cast("string")
        return rows.select(F.col("id").alias(id_col), "host", "declared", null.alias("lang"), F.lit(None).cast("double").alias("probability"), null.alias("text_lang"))
    n = len(langs)
    seen = rows.mapInArrow(_likelihoods(table, True), "id long, host string, seg string, declared string, loglik array<double>")
    tld = F.element_at(F.split("host", r"\."), -1)
    seen = seen.withColumn("suffix", F.concat_ws("/", tld, F.lower("seg"))).withColumn("site", F.when(F.size(F.split("host", r"\.")) >= 2, F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".")).otherwise(F.col("host")))
    seen = seen.withColumn("has_text", F.expr("array_min(loglik) < 0")).withColumn("post", _normal("loglik"))
    seen = settle(seen.withColumn("row", F.monotonically_increasing_id()), "seen")
    total = lambda name: [F.sum(F.col(name)[i]).alias(f"s{i}") for i in range(n)]
    packed = F.array(*[F.col(f"s{i}") for i in range(n)])
    for turn in range(2):
        base = seen if turn else seen.where("has_text")
        by = {k: settle(base.groupBy(k).agg(*total("post")).select(F.col(k).alias("k"), packed.alias("c")), "counts") for k in ("declared", "suffix", "host", "site")}
        whole = by["host"].agg(*[F.sum(F.col("c")[i]).alias(f"s{i}") for i in range(n)]).first()
        whole = np.array([x or 0.0 for x in whole]) + 1.0
        prior = whole / whole.sum()
        lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
        logs = [F.col("loglik")[i] for i in range(n)]
        out = seen
        for k in ("declared", "suffix", "host", "site"):
            out = out.join(by[k].select(F.col("k").alias(f"{k}_k"), F.col("c").alias(f"{k}_c")), F.col(k) == F.col(f"{k}_k"), "left").drop(f"{k}_k")
        own = [F.when(F.col("has_text") | F.lit(bool(turn)), F.col("post")[i]).otherwise(0.0) for i in range(n)]
        for k in ("declared", "suffix"):  # P(value | language), the page's own share taken out
            for i in range(n):
                c = F.greatest(F.lit(0.0), F.coalesce(F.col(f"{k}_c")[i], F.lit(0.0)) - own[i])
                evidence = F.log((c + SMOOTH) / float(whole[i] + 2 * SMOOTH))
                logs[i] = logs[i] + F.when(F.col(k).isNull() | (F.col(k) == ""), 0.0).otherwise(evidence)
        site = [F.greatest(F.lit(0.0), F.coalesce(F.col("site_c")[i], F.lit(0.0)) - own[i]) for i in range(n)]
        site_n = sum(site[1:], site[0])
        site_p = [(site[i] + KAPPA * float(prior[i])) / (site_n + KAPPA) for i in range(n)]
        mine = [F.greatest(F.lit(0.0), F.coalesce(F.col("host_c")[i], F.lit(0.0)) - own[i]) for i in range(n)]
        mine_n = sum(mine[1:], mine[0])
        logs = [logs[i] + F.log((mine[i] + KAPPA * site_p[i]) / (mine_n + KAPPA)) for i in range(n)]
        out = out.select("id", "row", "host", "site", "suffix", "declared", "loglik", F.lit(True).alias("has_text"), F.array(*logs).alias("fused"))
        seen = settle(out.withColumn("post", _normal("fused")), "fused")
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.element_at(names, F.expr(f"cast(array_position({c}, array_max({c})) as int)"))
    return seen.select(F.col("id").alias(id_col), "host", "declared", best("post").alias("lang"), F.array_max("post").alias("probability"), F.when(F.expr("array_min(loglik) < 0"), best("loglik")).alias("text_lang"))
