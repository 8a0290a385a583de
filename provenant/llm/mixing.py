"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's exact budget."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.common import WORD, checkpoint, numbered, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Rows of a slice: as many leading hex digits of the random key cut a source as its rows need.
SLICE = 2_000


def _source_key(name: str = "source") -> Column:
    """Null sources are a source of their own, after all others in code point order."""
    return F.when(F.col(name).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(name)))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source_key, source_size -> target: each source's part of share * all sizes by weight, at most `most` times its size.

    What a source can't take is shared again by weight until none is above its limit: the level at which the limits,
    taken in order of limit over weight, no longer bind. One row per source, so its windows are as small as that list.
    """
    by_name = Window.orderBy("source_key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size").cast("double") * most)
    by_bound = Window.orderBy(F.col("limit") / F.col("weight"), "source_key")
    rows = (
        rows.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double") * share)
        .withColumn("before", F.coalesce(F.sum("limit").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_bound.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
        .withColumn("place", F.row_number().over(by_bound))
    )
    free = F.min(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct("place", "level"))).over(Window.partitionBy())
    return rows.withColumn("free", free).select(
        "source_key", "source_size", F.when(F.col("free").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("free.level") * F.col("weight"))).alias("target")
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """Per row of docs: the columns to carry, doc_id, text_hash, size (words), source_size, target (its source's), taken (words, repeats counted).

    Each source is read in the order of md5(seed|doc_id): whole epochs first, then up to the budget's last word, so one
    document of a source may be cut. Rows with a null doc_id share one key; ties go by doc_id, size and the text's hash, and rows
    alike in these get amounts in any order. Null and wordless texts have size 0 and give nothing; an empty table gives
    no rows; other columns are not read.
    """
    rows = docs.select(
        *carry,
        F.col("doc_id"),
        _source_key().alias("source_key"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text_of()).alias("text_hash"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("mix_key"),
    )
    rows = checkpoint(rows)
    digits = max(1, math.ceil(math.log(max(1, rows.count() / SLICE), 16)))
    rows = rows.withColumn("slice", F.substring("mix_key", 1, digits))
    slices = rows.groupBy("source_key", "slice").agg(F.sum("size").alias("in_slice"))
    sizes = slices.groupBy("source_key").agg(F.sum("in_slice").alias("source_size"))
    before = Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("base", F.coalesce(F.sum("in_slice").over(before), F.lit(0))).join(targets(sizes, weights, share, most), "source_key")
    order = Window.partitionBy("source_key", "slice").orderBy("mix_key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        rows.join(slices.drop("in_slice"), ["source_key", "slice"])
        .withColumn("start", F.col("base") + F.sum("size").over(order) - F.col("size"))
        .withColumn("epochs", epochs)
        .withColumn("left", budget - F.col("epochs") * F.col("source_size") - F.col("start"))
        .select(
            *carry, "doc_id", "text_hash", "size", "source_size", "target",
            (F.col("epochs") * F.col("size") + F.least(F.greatest("left", F.lit(0)), F.col("size"))).cast("long").alias("taken"),
        )
    )


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole epoch of a document, and one cut to the words that its
    source's budget has left. Documents that the mix takes nothing of are left out; n_chars, if there is one, follows a cut text.
    """
    rows, row = numbered(docs)
    taken = mix(rows, weights, share, most, seed, carry=[row]).where("taken > 0").select(F.col(row).alias(f"{row}_"), F.struct("size", "taken").alias(f"{row}_mix"))
    size, whole = F.col(f"{row}_mix.size"), F.floor(F.col(f"{row}_mix.taken") / F.col(f"{row}_mix.size")).cast("int")
    rest = (F.col(f"{row}_mix.taken") - whole * size).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), rest), " ")
    copies = F.concat(F.array_repeat(F.col("text"), whole), F.when(rest > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    out = rows.join(taken, F.col(row) == F.col(f"{row}_")).withColumn(f"{row}_copy", F.explode(copies)).withColumn("text", F.col(f"{row}_copy"))
    if "n_chars" in docs.columns:
        kept = F.when((rest > 0) & (F.length("text") != F.col("n_chars")), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", kept.cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
