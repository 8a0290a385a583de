"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraph digests.

A sketch has cells of (count, XOR of digests, XOR of checks); each digest falls into one cell of each of three
subtables. The difference of two versions' sketches holds only the digests that differ, and peeling takes out one that is
alone in a cell after the other. If some remain, the counts left in the cells tell about how many digests differ (the sum of
their squares grows with it), and a sketch of that size is made: digests are dealt to blocks by a hash, each block has cells of
its own, filled by one aggregation over the digests of both versions, and is peeled by itself. Blocks that fail are made again,
as many as their own cells ask for and with other hashes, until none is left. Everything is built from SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.llm.common import text_of, written

#: Lines longer than this are cut at the white space that follows so many code units.
PARAGRAPH = 160
TABLES = 3
#: Cells of a subtable, as a power of two.
BITS = 2
#: Differing digests that a block of a larger sketch gets on average.
LOAD = 4
#: Most rounds of peeling; an unfinished block counts as failed and is made again, larger.
ROUNDS = 8
CHECK_BITS = 0xFFFFFFFF
#: Percentiles that bound the stretches of ids, and rows of a stretch.
BOUNDS, BUCKET = 500, 100


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(97)).bitwiseAND(F.lit(CHECK_BITS))


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs (lines, long ones cut); none for an empty text."""
    lines = F.split(F.regexp_replace(text, rf"([^\n]{{{PARAGRAPH}}}\S*)\s", "$1\n"), "\n")
    return F.array_distinct(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x)))


def _hash(digest: Column, level: int) -> Column:
    """The bits that choose a digest's cells: its own for the stored sketch, others at each larger one."""
    return F.xxhash64(digest, F.lit(level)) if level else digest


def _cell(hashed: Column, table: int) -> Column:
    return F.shiftrightunsigned(hashed, BITS * table).bitwiseAND(F.lit((1 << BITS) - 1))


def cells(members: Column) -> Column:
    """The stored sketch of an array of digests: the subtables' cells one after the other."""

    def subtable(table: int) -> Column:
        def cell(place: Column) -> Column:
            own = F.filter(members, lambda x: _cell(x, table) == place)
            return _let(own, lambda hit: F.struct(F.size(hit).alias("n"), _xor(hit).alias("k"), _xor(F.transform(hit, _check)).alias("c")))

        return F.transform(F.array(*[F.lit(i).cast("long") for i in range(1 << BITS)]), cell)

    return F.concat(*[subtable(t) for t in range(TABLES)])


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.struct((a["n"] - b["n"]).alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["c"].bitwiseXOR(b["c"]).alias("c")))


_NONE = "array<struct<k:bigint,n:int,h:bigint>>"


def peel(difference: Column, level: int = 0) -> Column:
    """struct(cells, found, over): what peeling leaves in the cells, and the digests taken out with their side (1 or -1)."""

    def touches(hashed: Column, place: Column) -> Column:
        table = [_cell(hashed, t) == place - (t << BITS) for t in range(TABLES)]
        return F.when(place < 1 << BITS, table[0]).when(place < 2 << BITS, table[1]).otherwise(table[2])

    def without(cell: Column, place: Column, alone: Column) -> Column:
        return _let(
            F.filter(alone, lambda p: touches(p["h"], place)),
            lambda hit: F.when(F.size(hit) == 0, cell).otherwise(
                F.struct(
                    (cell["n"] - F.aggregate(hit, F.lit(0), lambda a, p: a + p["n"])).alias("n"),
                    cell["k"].bitwiseXOR(_xor(F.transform(hit, lambda p: p["k"]))).alias("k"),
                    cell["c"].bitwiseXOR(_xor(F.transform(hit, lambda p: _check(p["k"])))).alias("c"),
                )
            ),
        )

    def one_round(state: Column, _: Column) -> Column:
        single = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["k"])))
        found = F.array_distinct(F.transform(single, lambda c: F.struct(c["k"].alias("k"), c["n"].cast("int").alias("n"), _hash(c["k"], level).alias("h"))))
        peeled = _let(
            found,
            lambda alone: F.struct(
                F.when(F.size(alone) == 0, state["cells"]).otherwise(F.transform(state["cells"], lambda c, i: without(c, i, alone))).alias("cells"),
                F.concat(state["found"], alone).alias("found"),
                (F.size(alone) == 0).alias("over"),
            ),
        )
        return F.when(state["over"], state).otherwise(peeled)

    start = F.struct(difference.alias("cells"), F.array().cast(_NONE).alias("found"), F.lit(False).alias("over"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, one_round)


def _emptied(state: Column) -> Column:
    """The found digests if no cell has anything left, else null."""
    return F.when(F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0)), state["found"])


def blocks_for(difference: Column) -> Column:
    """How many blocks a larger sketch needs, estimated from the counts in the cells of one that failed.

    If d digests differ, D more on one side, the squares of a subtable's m counts sum up to d + (D * D - d) / m on average.
    """
    m = 1 << BITS
    squares = F.aggregate(difference, F.lit(0).cast("long"), lambda a, c: a + c["n"].cast("long") * c["n"]) / TABLES
    surplus = F.aggregate(F.slice(difference, 1, m), F.lit(0).cast("long"), lambda a, c: a + c["n"])
    differ = (squares - surplus * surplus / m) * (m / (m - 1))
    return F.ceil(F.greatest(differ, F.abs(surplus)) * 1.25 / LOAD).cast("long")


def _by_row(df: DataFrame) -> DataFrame:
    """df dealt out by row, in as many parts as the session's shuffles have: few bytes, but much to compute, so they are not merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row")


def _sketched(items: DataFrame, level: int) -> DataFrame:
    """row, pair, block, digest, side -> row, pair, block, items, difference: the cells of each block, in which the two versions'
    digests are added up with opposite signs."""
    hashed = _hash(F.col("digest"), level)
    rows = items.withColumn("h", hashed).withColumn("check", _check(F.col("digest")))
    sums = []
    for t in range(TABLES):
        for place in range(1 << BITS):
            own = _cell(F.col("h"), t) == place
            name = f"{t}_{place}"
            sums += [F.sum(F.when(own, F.col("side")).otherwise(0)).cast("int").alias(f"n{name}"), F.bit_xor(F.when(own, F.col("digest"))).alias(f"k{name}"), F.bit_xor(F.when(own, F.col("check"))).alias(f"c{name}")]
    whole = rows.groupBy("row", "pair", "block").agg(*sums, F.collect_list(F.struct("digest", "side")).alias("items"))
    zero = F.lit(0).cast("long")
    cell = [F.struct(F.col(f"n{t}_{p}").alias("n"), F.coalesce(f"k{t}_{p}", zero).alias("k"), F.coalesce(f"c{t}_{p}", zero).alias("c")) for t in range(TABLES) for p in range(1 << BITS)]
    return whole.select("row", "pair", "block", "items", F.array(*cell).alias("difference"))


def _dealt(items: DataFrame, level: int) -> DataFrame:
    """Digests dealt to the blocks of a larger sketch: by other bits of the hash than those that choose cells."""
    part = F.pmod(F.shiftrightunsigned(_hash(F.col("digest"), level), BITS * TABLES), F.col("many"))
    return items.withColumn("block", F.xxhash64("block", part)).drop("many")


def larger(items: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """row, pair, block, many, digest, side -> (level, table) for each size tried: row, pair, n (differing digests found), found
    (these, with their sides), failed (blocks still to be made again, with their items).

    The items of a row are in one partition, so a block is filled, peeled and counted without a shuffle. Only failed blocks go on,
    each to at least two.
    """
    level = 1
    while True:
        state = peel(F.col("difference"), level)
        dealt = _dealt(items, level)
        blocks = _sketched(_by_row(dealt) if level > 1 else dealt, level)
        told = blocks.select("row", "pair", "block", "items", _emptied(state).alias("found"), F.greatest(blocks_for(F.col("difference")), F.lit(2).cast("long")).alias("many"))
        failed = F.collect_list(F.when(F.col("found").isNull(), F.struct("block", "many", "items")))
        told = told.groupBy("row", "pair").agg(F.coalesce(F.sum(F.size("found")), F.lit(0)).alias("n"), F.flatten(F.collect_list("found")).alias("found"), failed.alias("failed"))
        told = written(told, f"peeled-{level}")
        yield level, told
        again = told.where(F.size("failed") > 0).select("row", "pair", F.explode("failed").alias("f"))
        if again.isEmpty():
            return
        items = again.select("row", "pair", "f.block", "f.many", F.explode("f.items").alias("i")).select("row", "pair", "block", "many", "i.digest", "i.side")
        level += 1


def _sided(found: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["k"].alias("k"), x["n"].alias("n"))).alias("found")


def likeness(differing: Column, left: Column, right: Column) -> Column:
    """Paragraphs in common over all paragraphs of the two, from the number of differing ones; 1 if neither has any."""
    either = (left + right + differing) / 2
    return F.when(either == 0, F.lit(1.0)).otherwise((either - differing) / either)


def fingerprint(members: Column, stored: Column) -> Column:
    """The stored sketch as text: the number of digests, then each cell's count, digests and checks in hex."""
    cell = F.transform(stored, lambda c: F.concat(F.lpad(F.hex(c["n"]), 4, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["c"]), 8, "0")))
    return F.lower(F.concat_ws("", F.hex(F.size(members)), F.lit(":"), F.concat_ws("", cell)))


def _bucket(doc_id: Column, bounds: list[int], parts: int) -> Column:
    """A number that grows with doc_id: between which bounds it lies, each stretch cut evenly into parts; nulls: -1."""
    held = F.lit(bounds)

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        return _let(middle, lambda m: F.when(F.element_at(held, m + 1) <= doc_id, F.struct(m.alias("low"), state["high"].alias("high"))).otherwise(F.struct(state["low"].alias("low"), m.alias("high"))))

    steps = F.array(*[F.lit(i) for i in range(len(bounds).bit_length())])
    low = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halve)["low"]

    def within(at: Column) -> Column:
        first, last = (F.element_at(held, F.least(at + i, F.lit(len(bounds)))).cast("double") for i in (1, 2))
        share = F.when(last > first, (doc_id.cast("double") - first) / (last - first)).otherwise(0.0)
        return at.cast("long") * parts + F.least(F.greatest(F.floor(share * parts), F.lit(0)), F.lit(parts - 1))

    return F.when(doc_id.isNull(), F.lit(-1).cast("long")).otherwise(_let(low, within))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash, members -> the same rows with next_text and next_members, doc_id descending.

    After the last comes the first; null ids are last, equal ids in the order of their text's hash, and rows equal in both are one
    document. Rows are dealt out once, by stretches of ids of about BUCKET rows; each stretch's last row gets the first of
    the next stretch. Bounds are BOUNDS percentiles of the ids, so gaps and clusters of ids do no harm.
    """
    asked = [i / BOUNDS for i in range(BOUNDS + 1)]
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", asked, 10 * BOUNDS).alias("bounds")).first()
    bounds = sorted(set(stats["bounds"] or [0]))
    parts = max(1, -(-stats["n"] // (len(bounds) * BUCKET)))
    rows = docs.withColumn("bucket", _bucket(F.col("doc_id"), bounds, parts))

    firsts = rows.groupBy("bucket").agg(F.max_by("text", F.struct("doc_id", "text_hash")).alias("first_text"))
    firsts = written(firsts, "firsts")
    # The stretch after each: inside its percentile, else the first of the next one; only the BOUNDS percentiles meet in one task.
    numbers = firsts.select(F.col("bucket").alias("own_bucket"), F.floor(F.col("bucket") / parts).alias("percentile"))
    tops = numbers.groupBy("percentile").agg(F.max("own_bucket").alias("top"))
    down = Window.orderBy(F.desc("percentile"))
    tops = tops.select("percentile", F.coalesce(F.lead("top").over(down), F.first("top").over(down)).alias("next_top"))
    inside = F.lead("own_bucket").over(Window.partitionBy("percentile").orderBy(F.desc("own_bucket")))
    numbers = numbers.withColumn("inside", inside).join(F.broadcast(tops), "percentile").select("own_bucket", F.coalesce("inside", "next_top").alias("next_bucket"))
    after = numbers.join(firsts, F.col("next_bucket") == F.col("bucket")).select("own_bucket", "first_text")

    within = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text_hash").desc())
    numbered = rows.withColumn("place", F.dense_rank().over(within))
    one_on = Window.partitionBy("bucket").orderBy("place").rangeBetween(1, 1)
    told = numbered.withColumn("next", F.first(F.struct("text", "members")).over(one_on)).join(after, F.col("bucket") == F.col("own_bucket"))
    inside = F.col("next").isNotNull()
    return told.select(
        "doc_id", "text", "members",
        F.when(inside, F.col("next.text")).otherwise(F.col("first_text")).alias("next_text"),
        F.when(inside, F.col("next.members")).otherwise(digests(F.col("first_text"))).alias("next_members"),
    )


def compare(docs: DataFrame, levels: dict[int, int] | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and what
    the sketches tell of the edit: digests added and removed.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document,
    doc_id descending; after the last comes the first, and a lone document follows itself. Null texts are empty; empty
    texts are alike. An empty table gives no rows; other columns are not read. levels, if given, gets the number of pairs that
    each size of sketch settled or helped to settle, 0 for the stored ones.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = with_next(rows.select("*", F.xxhash64("text").alias("text_hash"), digests(F.col("text")).alias("members")))
    size = F.length("text")
    rows = rows.withColumn("n_chars", size.cast("long")).withColumn("moved", F.floor(size / 3).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("moved")).cast("int")), F.substring("next_text", F.lit(1), F.col("moved")))
    both = rows.withColumn("edited", edited).select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "members", digests(F.col("edited")).alias("edited_members"), "next_members")
    both = written(both.withColumn("row", F.monotonically_increasing_id()), "digests")

    own = F.array(*[F.struct(F.lit(pair).alias("pair"), cells(F.col(f"{name}_members")).alias("cells")) for pair, name in enumerate(("edited", "next"))])
    first = both.select("row", cells(F.col("members")).alias("stored"), F.explode(own).alias("other")).select("row", "other.pair", subtract(F.col("stored"), F.col("other.cells")).alias("difference"))
    first = written(first.select("row", "pair", _emptied(peel(F.col("difference"))).alias("found"), F.greatest(blocks_for(F.col("difference")), F.lit(1).cast("long")).alias("many")), "peeled-0")

    # What the stored sketches could not tell: the digests of both versions, dealt to the blocks of larger ones.
    failed = first.where("found IS NULL").groupBy("row").agg(F.max(F.when(F.col("pair") == 0, F.col("many"))).alias("edited_many"), F.max(F.when(F.col("pair") == 1, F.col("many"))).alias("next_many"))
    sides = [
        F.when(F.col(f"{name}_many").isNotNull(), F.transform(x, (lambda p, s, n: lambda d: F.struct(F.lit(p).alias("pair"), F.col(f"{n}_many").alias("many"), d.alias("digest"), F.lit(s).alias("side")))(pair, side, name))).otherwise(F.array())
        for pair, name in enumerate(("edited", "next"))
        for x, side in ((F.col("members"), 1), (F.col(f"{name}_members"), -1))
    ]
    todo = _by_row(both.select("row", "members", "edited_members", "next_members")).join(_by_row(failed), "row").select("row", F.explode(F.concat(*sides)).alias("i"))
    items = todo.select("row", "i.pair", F.lit(0).cast("long").alias("block"), "i.many", "i.digest", "i.side")
    settled = [first.where("found IS NOT NULL").select("row", "pair", F.size("found").cast("long").alias("n"), _sided("found"))]
    for level, told in larger(items):
        settled.append(told.select("row", "pair", F.col("n").cast("long"), _sided("found")))
        if levels is not None:
            levels[level] = told.where("n > 0").count()
    if levels is not None:
        levels[0] = settled[0].count()
    every = reduce(DataFrame.union, settled)
    of = {name: (F.col("pair") == pair) for pair, name in enumerate(("edited", "next"))}
    totals = every.groupBy("row").agg(
        *[F.sum(F.when(is_, F.col("n")).otherwise(0)).alias(f"{name}_n") for name, is_ in of.items()],
        F.flatten(F.collect_list(F.when(of["edited"], F.col("found")))).alias("edited_found"),
    )
    counted = totals.withColumnRenamed("row", "told_row")
    out = both.join(counted, F.col("row") == F.col("told_row"))
    side = {name: F.transform(F.filter("edited_found", (lambda n: lambda x: x["n"] == n)(n)), lambda x: x["k"]) for name, n in (("removed", 1), ("added", -1))}
    sizes = {name: F.size(name) for name in ("members", "edited_members", "next_members")}
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("members"), cells(F.col("members"))).alias("fingerprint"),
        fingerprint(F.col("edited_members"), cells(F.col("edited_members"))).alias("edited_fingerprint"),
        likeness(F.col("edited_n"), sizes["members"], sizes["edited_members"]).alias("near_edited"),
        likeness(F.col("next_n"), sizes["members"], sizes["next_members"]).alias("near_next"),
        side["added"].alias("added"), side["removed"].alias("removed"),
    )
