"""SimHash near-duplicates, candidates by pigeonring filtering.

A fingerprint's 64 bits lie on a ring of three segments (22, 21, 21 bits). If two fingerprints differ in at most two
bits, some segment starts a chain whose cumulative differences stay within the proportional budgets 0, 1, 2 (a third of
two bits for each segment, rounded down). So rows meet on an equal first segment, and the chain prunes what meets before
the whole Hamming distance is looked at. A segment value that more than BUCKET fingerprints share is dealt again by the
next segment with one bit masked, and at last by the third one; those last groups hold four fingerprints at most, so no
bucket is ever compared pair by pair beyond BUCKET rows and none is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.common import checkpoint, numbered, small, text_of, written
from provenant.operators.components import components

RADIUS = 2
WIDTHS = (22, 21, 21)
#: Fingerprints of one bucket that are compared pair by pair.
BUCKET = 1000
SEED = 42

#: Similar documents: min-wise samples a band has, and bands. At a similarity of 0.8 a pair misses all bands once in 4,000.
SAMPLES, BANDS = 4, 16
#: A band's value that more documents share is not compared pair by pair: its documents meet so many hubs of it, and then on their
#: rarest shingles.
CROWD, HUBS = 32, 4
#: Counters by which shingles are ordered; two that share one only make the order worse.
COUNTERS, _CHUNK = 1 << 18, 1 << 10


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of A-Z-lowered words, repeats included; fewer words: of all of them; none: empty."""
    found = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not found:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    last = max(1, len(found) - words + 1)
    return np.fromiter((digest(join(found[i : i + words]), SEED) for i in range(last)), np.uint64, last)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; the result is signed, as Spark's longs are."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)]).astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (long): one row per row of docs; a null or wordless text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = [simhash(shingle_hashes(x, words)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segment(k: int) -> Column:
    return F.shiftrightunsigned("fp", sum(WIDTHS[:k])).bitwiseAND(F.lit((1 << WIDTHS[k]) - 1))


def _differences(name: str) -> Column:
    return F.bit_count(F.col(f"a.{name}").bitwiseXOR(F.col(f"b.{name}")))


def _pairs(rows: DataFrame, key: list[str], within: Column) -> DataFrame:
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    return rows.alias("a").join(rows.alias("b"), [*same, F.col("a.fp") < F.col("b.fp"), within]).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _dealt(rows: DataFrame, key: list[str], bucket: int) -> tuple[DataFrame, DataFrame]:
    """Rows that share their key with others: those of buckets of at most `bucket` rows, and the rest."""
    shared = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("in_bucket")).where("in_bucket > 1")
    rows = rows.join(shared, key)
    return rows.where(F.col("in_bucket") <= bucket).drop("in_bucket"), rows.where(F.col("in_bucket") > bucket).drop("in_bucket")


def hamming_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Distinct values of the column fp -> a < b: pairs whose closure joins all fingerprints within two bits.

    Null fingerprints link to nothing; an empty input gives no rows.
    """
    ring = [F.struct(F.lit(k).alias("at"), _segment(k).alias("k0"), _segment((k + 1) % 3).alias("k1"), _segment((k + 2) % 3).alias("k2")) for k in range(3)]
    rows = fps.where("fp IS NOT NULL").select("fp", F.explode(F.array(*ring)).alias("s")).select("fp", "s.*")
    chain = (_differences("k1") <= 1) & (_differences("k1") + _differences("k2") <= RADIUS)
    small, hot = _dealt(rows, ["at", "k0"], bucket)
    links = _pairs(small, ["at", "k0"], chain)

    # The next segment as it is (bit -1), and with each bit masked: a difference of one bit meets under that bit.
    masks = F.transform(F.sequence(F.lit(-1), F.lit(max(WIDTHS) - 1)), lambda j: F.struct(j.alias("bit"), F.when(j < 0, F.col("k1")).otherwise(F.col("k1").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), j)))).alias("m1")))
    second = hot.select("*", F.explode(masks).alias("s")).select("fp", "at", "k0", "k1", "k2", "s.bit", "s.m1")
    key = ["at", "k0", "bit", "m1"]
    small, hot = _dealt(second, key, bucket)
    exactly = F.when(F.col("a.bit") < 0, F.lit(True)).otherwise(_differences("k1") == 1)
    links = links.union(_pairs(small, key, exactly & chain))

    # The third segment with one bit masked, or two where the second is equal: what then meets is within two bits.
    one = F.transform(F.sequence(F.lit(0), F.lit(max(WIDTHS) - 1)), lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j))
    two = F.array(*[F.lit((1 << i) | (1 << j)) for i in range(max(WIDTHS)) for j in range(i)])
    third = hot.select("*", F.explode(F.when(F.col("bit") < 0, two).otherwise(one)).alias("mask"))
    third = third.withColumn("m2", F.col("k2").bitwiseAND(F.bitwise_not(F.col("mask"))))
    met = third.groupBy(*key, "mask", "m2").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    return links.union(met.select(F.col("fps")[0].alias("a"), F.explode(F.expr("slice(fps, 2, size(fps))")).alias("b"))).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links of at most two bits reach.

    One row per row of docs. Equal fingerprints are linked; null and wordless texts have fingerprint zero and link like
    any other. A null doc_id keeps its row and is never a component's smallest, unless it is alone (then null). Other
    columns are not read; an empty table gives no rows.
    """
    rows = checkpoint(fingerprints(docs, words))
    kinds = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(hamming_links(kinds.select("fp"), bucket))
    tied = kinds.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = tied.select("fp", "root").join(ids, "root").select(F.col("fp").alias("kind"), "component_id")
    return rows.join(labels, F.col("fp") == F.col("kind")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(5)
    draw = random.integers(0, 1 << 63, (2, SAMPLES * BANDS), dtype=np.int64).astype(np.uint64)
    return draw[0] << np.uint64(1) | np.uint64(1), draw[1]


def bands(hashes: np.ndarray) -> list[int]:
    """A value for each band: the hash of its min-wise samples of the shingles."""
    by, plus = _multipliers()
    least = np.full(SAMPLES * BANDS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 4096):
        mixed = hashes[i : i + 4096, None] * by
        mixed ^= mixed >> np.uint64(29)
        mixed += plus
        least = np.minimum(least, (mixed * by).min(0))
    size = 8 * SAMPLES
    raw = least.astype("<u8").tobytes()
    return [xxhash.xxh64_intdigest(raw[k : k + size], k) - (1 << 63) for k in range(0, len(raw), size)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets of shingle hashes; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _signatures(rows: DataFrame, row: str, words: int) -> DataFrame:
    """row, doc_id, kind (of equal words), fp, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            kinds, fps, values = [], [], []
            for text in batch.column(2).to_pylist():
                kinds.append(xxhash.xxh3_128_hexdigest(b" ".join(text.encode().lower().split())))
                hashes = shingle_hashes(text, words)
                fps.append(simhash(hashes))
                values.append(bands(hashes) if len(hashes) else [])
            columns = [pa.array(kinds), pa.array(fps, pa.int64()), pa.array(values, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["row", "doc_id", "kind", "fp", "bands"])

    return rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "row long, doc_id long, kind string, fp long, bands array<long>")


def _candidates(firsts: DataFrame, crowd: int, hubs: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """row, fp, bands of different texts -> a < b: pairs that share a band, or whose fingerprints are within two bits; and
    row: the members of crowds.

    Of a band's value that a crowd shares, every member meets the hubs: those whose bands are shared most, the nearest to
    what the crowd has in common. That joins copies of one text; members alike for another reason meet in _crowd_pairs.
    """
    same = firsts.select("row", F.posexplode(F.concat(F.array("fp"), "bands")).alias("band", "value"))
    shared = same.groupBy("band", "value").agg(F.count(F.lit(1)).alias("sharing")).where("sharing > 1")
    rows = checkpoint(same.join(shared, ["band", "value"]))
    few = rows.where(F.col("sharing") <= crowd).drop("sharing")
    pairs = few.alias("a").join(few.alias("b"), [F.col("a.band") == F.col("b.band"), F.col("a.value") == F.col("b.value"), F.col("a.row") < F.col("b.row")]).select(F.col("a.row").alias("a"), F.col("b.row").alias("b"))
    many = rows.where(F.col("sharing") > crowd)
    degree = many.groupBy("row").agg(F.sum("sharing").alias("degree"))
    rank = F.row_number().over(Window.partitionBy("band", "value").orderBy(F.desc("degree"), "row"))
    hub = many.join(degree, "row").withColumn("place", rank).where(F.col("place") <= hubs).select("band", "value", F.col("row").alias("hub"))
    stars = many.join(hub, ["band", "value"]).where("row <> hub").select(F.least("row", "hub").alias("a"), F.greatest("row", "hub").alias("b"))
    near = hamming_links(firsts.select("fp").distinct(), bucket)
    one = firsts.groupBy("fp").agg(F.min("row").alias("row"))
    near = near.join(one.select(F.col("fp").alias("a"), F.col("row").alias("x")), "a").join(one.select(F.col("fp").alias("b"), F.col("row").alias("y")), "b")
    return pairs.union(stars).union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct(), degree.select("row")


def _crowd_pairs(members: DataFrame, words: int, similarity: float) -> DataFrame:
    """row, root, text -> a < b: all pairs of different roots whose sets of shingles can have this Jaccard similarity.

    Prefix filtering: shingles are ordered by how many members have them (by counters that hashes share, so any number of shingles
    will do). Two similar texts have their first common shingle among so few of their first ones that enough are left after it.
    What a whole crowd shares stands last, so a passage or template in common makes no pairs by itself.
    """

    def sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        return (np.unique(shingle_hashes(text, words)) for text in batch.column(2).to_pylist())

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(COUNTERS, np.int64)
        for batch in small(batches):
            for own in sets(batch):
                np.add.at(found, (own % np.uint64(COUNTERS)).astype(np.int64), 1)
        parts = {i // _CHUNK: found[i : i + _CHUNK].tobytes() for i in range(0, COUNTERS, _CHUNK) if found[i : i + _CHUNK].any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(list(parts.values()), pa.binary())], ["chunk", "part"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [sum(np.frombuffer(p, np.int64) for p in pdf["part"]).tobytes()]})

    held = written(members.select("row", "root", "text"), "crowds")
    total = np.zeros(COUNTERS, np.int64)
    for r in held.mapInArrow(tally, "chunk int, part binary").groupBy("chunk").applyInPandas(added, "chunk int, part binary").collect():  # 2 MB
        total[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["part"], np.int64)
    shared = members.sparkSession.sparkContext.broadcast(total)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sizes, firsts = [], []
            for own in sets(batch):
                first = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
                firsts.append(own[np.argsort(shared.value[(own % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")][:first].view(np.int64))
                sizes.append(len(own))
            columns = [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "root", "n", "firsts"])

    found = held.mapInArrow(prefixes, "row long, root long, n long, firsts array<long>")
    posted = found.select("row", "root", "n", F.posexplode("firsts").alias("at", "shingle")).withColumn("left", F.col("n") - F.col("at"))
    # The smaller text of a pair meets with fewer first shingles: as if the other were of its size.
    posted = posted.withColumn("smaller", F.col("left") >= F.lit(2 * similarity / (1 + similarity)) * F.col("n") - 1e-6)
    several = posted.groupBy("shingle").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("smaller").alias("any")).where("r0 <> r1 AND any").select("shingle")
    posted = checkpoint(posted.join(several, "shingle"))
    need = F.lit(similarity / (1 + similarity)) * (F.col("x.n") + F.col("y.n")) - 1e-6
    fits = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.row") < F.col("y.row"))
    met = posted.where("smaller").alias("x").join(posted.alias("y"), [F.col("x.shingle") == F.col("y.shingle"), F.col("x.root") != F.col("y.root"), fits, F.least("x.left", "y.left") >= need])
    return met.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()


def _verified(pairs: DataFrame, rows: DataFrame, row: str, words: int, similarity: float) -> DataFrame:
    """The pairs whose texts' sets of shingles have at least this Jaccard similarity."""
    texts = rows.select(F.col(row).alias("row"), text_of().alias("text"))
    one = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            held: dict[int, np.ndarray] = {}
            keep = []

            def hashes(key: int, text: str) -> np.ndarray:
                if key not in held:
                    if len(held) > 200:
                        held.clear()
                    held[key] = np.unique(shingle_hashes(text, words))
                return held[key]

            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keep.append(jaccard(hashes(a, x), hashes(b, y)) >= similarity)
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, crowd: int = CROWD, hubs: int = HUBS, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame, str]:
    """Groups of documents whose sets of word shingles are alike: (row, group, first), the numbered docs, their row column.

    Texts with equal A-Z-lowered words are one kind (all wordless ones are). Kinds that meet in a fingerprint within two bits, or in
    a band of min-wise samples, are linked if their Jaccard similarity, computed on the whole texts, is at least `similarity`;
    crowds of a band's value meet on their rarest shingles, which misses no link. A group is what links reach. first marks one row of each group: of its smallest doc_id (nulls last). An
    empty table gives no rows.
    """
    rows, row = numbered(docs)
    signs = written(_signatures(rows, row, words), "signatures")
    kinds = checkpoint(signs.groupBy("kind").agg(F.min("row").alias("least")))
    firsts = signs.join(kinds, F.col("row") == F.col("least"), "left_semi").select("row", "fp", "bands")
    pairs, crowded = _candidates(firsts, crowd, hubs, bucket)
    roots = components(_verified(checkpoint(pairs), rows, row, words, similarity))
    crowded = checkpoint(crowded)
    if not crowded.isEmpty():
        known = crowded.join(roots, F.col("row") == F.col("node"), "left").select(F.col("row").alias("member"), F.coalesce("root", "row").alias("root"))
        members = rows.select(F.col(row).alias("row"), text_of().alias("text")).join(known, F.col("row") == F.col("member")).select("row", "root", "text")
        more = _verified(checkpoint(_crowd_pairs(members, words, similarity)), rows, row, words, similarity)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    roots = roots.withColumnRenamed("root", "reached")
    tied = signs.select("row", "doc_id", "kind").join(kinds, "kind").join(roots, F.col("least") == F.col("node"), "left")
    tied = tied.select("row", "doc_id", F.coalesce("reached", "least").alias("group"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = tied.groupBy("group").agg(F.min(order)["row"].alias("first_row"))
    return tied.join(first, "group").select("row", "group", (F.col("row") == F.col("first_row")).alias("first")), rows, row


def without_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of similar_groups, with the columns of docs."""
    groups, rows, row = similar_groups(docs, words, similarity)
    kept = groups.where("first").select(F.col("row").alias(f"{row}_"))
    return rows.join(kept, F.col(row) == F.col(f"{row}_"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
