"""Packing token sequences: cutting-stock column generation over the length histogram.

Documents become blocks of a whole sequence and one remainder each. Piece lengths, rounded up to UNIT tokens, are the
stock problem's items. A linear program over patterns (which lengths share one sequence) is solved by column
generation: a knapsack dynamic program over the capacity prices new patterns with the duals. Pattern counts are rounded
down; what is left over, bounded by patterns times items, is packed largest first. Patterns then take the pieces of each
length by rank. Histogram, patterns and left-overs depend on the sequence length alone, not on the input.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.common import checkpoint, small, text_of

LENGTH = 2048
#: Piece lengths are planned in this many tokens.
UNIT = 8
END_ID = 1
#: Pieces of a slice in which the pieces of one length are ranked; a length has as many slices as its pieces need.
SLICE = 2_000
#: The linear program ends when its value is this near to a proven lower bound.
GAP = 2e-4

#: The pattern that splits text before byte-level merges (as the public tokenizer has it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies name bytes: printable ones themselves, the rest from 256 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> tiktoken.Encoding:
    """An encoder of a byte-level BPE vocabulary file (tokenizers' JSON), whose ids are its merge ranks."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Whole sequences and a remainder per document: doc_id, start, length, ids_crc32, doc_tokens, and the ids if asked for.

    A null or empty text is the end id alone, in one piece; null ids and repeated rows are cut like others; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in small(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text, allowed_special="all"), end_id], "<u4")
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    out.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids), part.astype("<i4") if with_ids else None))
            doc_ids, starts, lengths, sums, totals, parts = zip(*out, strict=True) if out else [()] * 6
            columns = [pa.array(x, pa.int64()) for x in (doc_ids, starts, lengths, sums, totals)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.list_(pa.int32()))][: 6 if with_ids else 5], names=names[: 6 if with_ids else 5])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, schema)


def _price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the capacity: the best value, and how often each item is taken."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room], choice[room] = best[room - 1], -1
        fits = np.searchsorted(sizes, room, "right")
        if fits:
            gains = best[room - sizes[:fits]] + values[:fits]
            k = int(gains.argmax())
            if gains[k] > best[room] + 1e-12:
                best[room], choice[room] = gains[k], k
    taken, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        k = choice[room]
        if k < 0:
            room -= 1
        else:
            taken[k] += 1
            room -= sizes[k]
    return float(best[capacity]), taken


def cutting_stock(demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[int, np.ndarray]]:
    """How many sequences use which pattern. demand[s]: pieces of s units, s from 1 to capacity; a pattern has counts like it.

    Supply covers demand for every size; an empty histogram needs no pattern.
    """
    sizes = np.flatnonzero(demand[1:]) + 1
    if not len(sizes):
        return []
    need = demand[sizes].astype(float)
    patterns = [np.where(np.arange(len(sizes)) == k, capacity // s, 0) for k, s in enumerate(sizes)]
    inverse = np.diag(1.0 / np.array([p.max() for p in patterns]))
    level = inverse @ need
    for _ in range(50 * len(sizes) + 100):
        value, entering = _price(inverse.sum(0), sizes, capacity)
        if value <= 1 + 1e-9 or level.sum() * (1 - 1 / value) <= gap * level.sum():  # the value over the best price is a lower bound
            break
        direction = inverse @ entering
        ratio = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        patterns[out] = entering
        level = np.maximum(inverse @ need, 0)
    plan = []
    left = demand[sizes].astype(np.int64)
    for count, pattern in zip(np.floor(level + 1e-7).astype(np.int64), patterns, strict=True):
        if count:
            plan.append((int(count), pattern))
            left = left - count * pattern
    left = np.maximum(left, 0)
    while left.any():  # largest first, as often as one filling repeats
        room, pattern = capacity, np.zeros(len(sizes), np.int64)
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(left[k], room // sizes[k])
            room -= int(pattern[k] * sizes[k])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((times, pattern))
        left = left - times * pattern
    out = []
    for count, pattern in plan:
        full = np.zeros(capacity + 1, np.int64)
        full[sizes] = pattern
        out.append((count, full))
    return out


def _runs(plan: list[tuple[int, np.ndarray]], capacity: int) -> dict[int, np.ndarray]:
    """Per size: rows (first rank, pieces a sequence, first sequence) in the order of ranks."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    given, sequence = np.zeros(capacity + 1, np.int64), 0
    for count, pattern in plan:
        for size in np.flatnonzero(pattern):
            runs.setdefault(int(size), []).append((int(given[size]), int(pattern[size]), sequence))
            given[size] += pattern[size] * count
        sequence += count
    return {size: np.array(rows, np.int64) for size, rows in runs.items()}


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, unit: int = UNIT, end_id: int = END_ID, per_slice: int = SLICE, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids): one row per piece of docs.

    A null or empty text is the end id alone; repeated rows and null doc_ids are packed like others; an empty table gives
    no rows; other columns are not read. The order of ranks is by doc_id, start and checksum: reruns agree.
    """
    rows = checkpoint(pieces(docs, tokenizer, length, end_id, with_ids).withColumn("units", F.ceil(F.col("length") / unit).cast("int")))
    capacity = length // unit
    demand = np.zeros(capacity + 1, np.int64)
    for row in rows.groupBy("units").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        demand[row["units"]] = row["n"]
    slices = F.element_at(F.array(*[F.lit(int(max(1, -(-n // per_slice)))) for n in demand]), F.col("units") + 1)
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), slices).cast("long"))
    counts = rows.groupBy("units", "slice").agg(F.count(F.lit(1)).alias("in_slice"))
    runs = _runs(cutting_stock(demand, capacity), capacity)

    before = Window.partitionBy("units").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("in_slice").over(before), F.lit(0))).drop("in_slice")
    place = Window.partitionBy("units", "slice").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = rows.join(bases, ["units", "slice"]).withColumn("rank", F.col("base") + F.row_number().over(place) - 1).drop("base", "slice")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, rank = (np.asarray(batch.column(x)) for x in ("units", "rank"))
            sequence = np.zeros(len(rank), np.int64)
            for size in np.unique(units):
                own, table = units == size, runs[int(size)]
                at = table[np.searchsorted(table[:, 0], rank[own], "right") - 1]
                sequence[own] = at[:, 2] + (rank[own] - at[:, 0]) // at[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence)], [*batch.schema.names, "sequence_id"])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in ranked.schema)
    dealt = ranked.mapInArrow(deal, f"{fields}, sequence_id long")
    filled = Window.partitionBy("sequence_id").orderBy(F.desc("units"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    return dealt.withColumn("offset", F.sum("length").over(filled) - F.col("length")).select(*kept, "offset", *["ids"] * with_ids)
