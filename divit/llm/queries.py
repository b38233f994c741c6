"""The thin opN_<name> queries over the driver tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collision_ann import nearest
from .fill_middle import digests
from .jaccard_join import jaccard_components
from .language_id import identify_languages
from .license_scan import scan_licenses
from .media_columns import text_sounds
from .mixing import mix_sources
from .packing import pack_documents
from .secret_scan import KINDS, scan_secrets
from .subspace_dedup import near_duplicate_vectors
from .toxicity import score_toxicity
from .url_filter import filter_urls
from .whitening import whiten

#: The url rules of the contract: (verdict, host/path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rows of labels that may teach; the others are held out.
TAUGHT = "crc32(cast(doc_id as string)) % 5 <> 0"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents under Jaccard >= 0.9 of three-word shingles."""
    return jaccard_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    scores = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), TAUGHT, evidence=True)
    return scores.select("doc_id", (~F.expr(TAUGHT)).alias("held_out"), "score", "predicted", F.slice("evidence", 1, 3).alias("evidence"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return pack_documents(_table(spark, sf_dir, "documents"), with_ids=False)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal labels with cosine >= 0.93."""
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document a mix of the sources takes."""
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences that documents are, or name on a line of their own."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of every page."""
    return filter_urls(_table(spark, sf_dir, "pages"), RULES)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page."""
    return identify_languages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    line = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    base = F.expr(line.format("filter(spans, s -> s.kind <> 'random')"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.expr(line.format("spans")).alias("spans"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in its middle, and restored."""
    return digests(_table(spark, sf_dir, "documents"))


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a sound file that is kept in chunks and read back."""
    return text_sounds(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened along their first 32 components."""
    return whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_toxicity, op3_packing, op4_embedding_near_dedup, op5_source_mixing, op6_license_scan, op7_url_filter,
        op8_nearest_neighbours, op9_language_id, op10_secret_scan, op11_fill_middle, op12_media_columns, op13_embedding_whitening,
    )
}

#: Sentinels, cuts and outputs of the fill-in-the-middle query; the text itself stands for what is restored.
_FILL = """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
num AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn),
cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM num
),
parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

ORACLE: dict[str, str] = {"op11_fill_middle": _FILL}
