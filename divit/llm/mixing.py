"""Mixing sources to target weights by pivotal dependent rounding.

Each document has an expected number of copies, its source's target over its source's size. The whole part
is certain; the fractional parts are rounded dependently: two documents of a source trade words of expectation
until one of them is integral, in a direction drawn once for each open document so that expectations hold, and the
sum of expected words stays exactly the same. The largest go first, so what stays open last is small. Buckets of about `BUCKET` documents do so side by side and leave one fractional
document each; these meet `FAN` buckets at a time in a reduction tree, until one is left per source.
Draws and buckets are hashes of the rows, so reruns agree whatever the partitions are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, quoted, settle, small_batches
from .textbytes import steps, word_counts

BUCKET, FAN = 4096, 16


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "text"):
            yield pa.record_batch([part.column("doc"), part.column("src"), pa.array(word_counts(part.column("text")))], names=["doc", "src", "size"])


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sizes(src, size) -> (src, source_size, units, target): weights by code point order of the sources, nulls last.

    Targets share `share` times all sizes by weight; none exceeds `most` times its source's size, and excess is shared anew by
    weight among the others. The sources that stop are a prefix in the order of most * size / weight, so one pass of running sums finds them.
    """
    if share > most:
        raise ValueError("the share can't exceed what all sources may give")
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    order = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    run = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    per = per.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(all_)).withColumn("all_w", F.sum("w").over(all_))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(run), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(run), F.lit(0.0))))
    # The level of the first source that does not stop holds for all that follow it.
    free = F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("src").isNull(), "src", "level"))).over(all_)
    per = per.withColumn("free", free["level"])
    target = F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("free") * F.col("w")))
    return per.select("src", "source_size", "units", target.cast("double").alias("target"))


def _rounded(last: bool):
    """Pivotal rounding inside each (src, bucket); a fractional rest goes up the tree, or is drawn at its top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from batch.to_pylist()

        for _, group in itertools.groupby(rows(), key=lambda r: (r["src"], r["bucket"])):
            done: list[dict] = []
            rest = None
            for r in group:
                if rest is None:
                    rest = r
                    continue
                x, y = rest["p"] * rest["mass"], r["p"] * r["mass"]
                give, take = min(x, r["mass"] - y), min(y, rest["mass"] - x)
                if rest["u"] * (give + take) < take:
                    x, y = x - give, y + give
                    emptied = give == rest["p"] * rest["mass"]
                    first, second = (0.0 if emptied else x / rest["mass"]), (y / r["mass"] if emptied else 1.0)
                else:
                    x, y = x + take, y - take
                    emptied = take == r["p"] * r["mass"]
                    first, second = (x / rest["mass"] if emptied else 1.0), (0.0 if emptied else y / r["mass"])
                pair = [rest | {"p": first}, r | {"p": second}]
                done += [q for q in pair if q["p"] <= 0.0 or q["p"] >= 1.0]
                open_ = [q for q in pair if 0.0 < q["p"] < 1.0]
                rest = open_[0] if open_ else None
            if rest is not None:
                done.append(rest | {"p": float(rest["u"] < rest["p"])} if last else rest)
            yield pa.RecordBatch.from_pylist(done, schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("src", pa.string()), ("bucket", pa.int64()), ("doc", pa.int64()), ("size", pa.int64()), ("mass", pa.float64()), ("p", pa.float64()), ("u", pa.float64())])
_DDL = "src string, bucket long, doc long, size long, mass double, p double, u double"


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many copies of each document a mix takes.

    Returns one row per input row: `id_col`, `source_col`, size (its words), source_size, target (its source's), copies, taken (copies * size).
    A null text has size 0; a null source is a source of its own, the last one; null ids are ids like any other. Documents
    without words can't change the sum and are drawn each for itself. Rows that repeat id, source and size get the same number of copies.
    The words taken from a source differ from its target by less than its largest group of such rows, mostly by less than a small one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc"), F.col(quoted(source_col)).cast("string").alias("src"), F.col(quoted(text_col)).cast("string").alias("text"))
    sizes = settle(rows.mapInArrow(_sizes, "doc long, src string, size long"), "sizes")
    targets = settle(source_targets(sizes, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    same = F.expr("src <=> t_src")
    named = targets.withColumnRenamed("src", "t_src")
    units = sizes.groupBy("doc", "src", "size").agg(F.count("*").alias("times")).join(F.broadcast(named) if targets.count() <= 100_000 else named, same).drop("t_src")
    draw = lambda salt: (F.pmod(F.xxhash64(F.lit(seed + salt), "doc", "src", "size"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    units = units.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.floor("rate"))
    units = units.withColumn("u", draw(1)).withColumn("mass", (F.col("times") * F.col("size")).cast("double"))
    units = units.withColumn("bucket", F.floor(draw(2) * F.ceil(F.col("units") / BUCKET)).cast("long"))
    units = settle(units.select("doc", "src", "size", "base", "p", "u", "mass", "bucket"), "units")

    open_ = units.where("size > 0 and p > 0 and p < 1").select(*_SCHEMA.names)
    done = None
    levels = max(0, (units.agg(F.max("bucket")).first()[0] or 0)).bit_length()
    depth = -(-levels // (FAN.bit_length() - 1))
    for k in range(depth + 1):
        dealt = open_.repartition(n_parts, "src", "bucket").sortWithinPartitions("src", "bucket", F.desc("mass"), "u", "doc", "size")
        step = settle(dealt.mapInArrow(_rounded(k == depth), _DDL), "rounded")
        integral = step.where("p <= 0 or p >= 1").select("doc", "src", "size", F.col("p").cast("long").alias("extra"))
        done = integral if done is None else done.unionByName(integral)
        open_ = step.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN))
    done = done.select(F.col("doc").alias("d_doc"), F.col("src").alias("d_src"), F.col("size").alias("d_size"), "extra")
    on = F.expr("doc <=> d_doc and src <=> d_src and size <=> d_size")
    copies = F.col("base") + F.coalesce("extra", F.when(F.col("size") > 0, (F.col("p") >= 1).cast("long")).otherwise((F.col("u") < F.col("p")).cast("long")))
    decided = units.join(done, on, "left").select(F.col("doc").alias("d_doc"), F.col("src").alias("d_src"), F.col("size").alias("d_size"), copies.alias("copies"))
    decided = settle(decided, "copies")
    out = sizes.join(decided, on).join(F.broadcast(named), same) if targets.count() <= 100_000 else sizes.join(decided, on).join(named, same)
    return out.select(F.col("doc").alias(id_col), F.col("src").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents as the mix takes them: a row for each copy, with all columns; rows with no copy go.

    Rows that repeat id, source and size all get the number of copies that each of them has. A null source is a source of its own; null ids are ids
    like any other; null and empty texts have size 0 and come as often as their draw says. Columns of any name are carried along. An empty table gives no rows.
    """
    size, copy, p_doc, p_src, p_size, p_copies = (fresh(docs, n) for n in ("size_of", "copy", "p_doc", "p_src", "p_size", "p_copies"))
    plan = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    plan = plan.select(F.col(quoted(id_col)).alias(p_doc), F.col(quoted(source_col)).alias(p_src), F.col("size").alias(p_size), F.col("copies").alias(p_copies)).distinct().where(F.col(p_copies) > 0)
    words = F.size(F.filter(F.split(F.coalesce(F.col(quoted(text_col)), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    sized = docs.withColumn(size, words.cast("long"))
    on = F.col(quoted(id_col)).eqNullSafe(F.col(p_doc)) & F.col(quoted(source_col)).eqNullSafe(F.col(p_src)) & (F.col(size) == F.col(p_size))
    return sized.join(plan, on).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(p_copies).cast("int")))).select(*(F.col(quoted(c)) for c in docs.columns))
