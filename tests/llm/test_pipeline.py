"""The pipeline's stages against brute force, each on what its predecessor kept."""

from collections import Counter

import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline
from provenant.llm import mixing
from provenant.llm.common import forget_written, table, written


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"  # with some hundred labels


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def test_stages_keep_the_columns(spark, sf_dir, kept):
    columns = table(spark, sf_dir, "documents").columns
    assert [d.columns for d in kept[:-1]] == [columns] * 3
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "mixing", "packing"]


def test_toxicity(spark, sf_dir, kept):
    docs = table(spark, sf_dir, "documents")
    toxic = {r["doc_id"] for r in table(spark, sf_dir, "labels").where("toxic = 1").collect()}
    left = {r["doc_id"] for r in kept[0].select("doc_id").collect()}
    assert len(left) == kept[0].count() > 0.7 * docs.count()
    assert len(toxic - left) >= 0.6 * len(toxic)
    assert kept[0].exceptAll(docs).count() == 0


def shingles(text):
    words = text.encode().lower().split()
    return frozenset(zip(*[words[i:] for i in range(5)])) or frozenset([tuple(words)])


def test_one_of_each_group_stays(kept):
    rows = [(r["doc_id"], shingles(r["text"] or "")) for r in kept[0].collect()]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (a, x) in enumerate(rows):
        for b, y in rows[:n]:
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                one, other = sorted((find(a), find(b)))
                root[other] = one
    assert sorted(r["doc_id"] for r in kept[1].collect()) == sorted({find(i) for i, _ in rows})


def test_the_mix_is_what_the_operator_took(kept):
    words = lambda t: len((t or "").encode().split())
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(kept[1]).collect() if r["taken"]}
    found = Counter()
    for r in kept[2].collect():
        found[r["doc_id"]] += words(r["text"])
    assert found == taken
    whole = {r["doc_id"]: r["text"] for r in kept[1].collect()}
    assert all(r["text"] == whole[r["doc_id"]] or whole[r["doc_id"]].split()[: words(r["text"])] == r["text"].split() for r in kept[2].collect())


def test_every_token_is_packed_once(kept):
    encode = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = Counter()
    for r in kept[2].collect():
        want[r["doc_id"]] += len(encode(r["text"], add_special_tokens=False).ids) + 1
    found, sequences = Counter(), {}
    for r in kept[3].collect():
        found[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert found == want
    for parts in sequences.values():
        assert sum(n for _, n in parts) <= 2048 and sorted(parts)[0][0] == 0


def test_run_is_the_stages_in_order(spark, sf_dir, kept):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    found = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, found.select(names).collect())) == sorted(map(str, kept[3].select(names).collect()))


def test_stages_take_odd_rows_and_names(spark, sf_dir):
    rows = [(1, None, None, "x", 1), (2, "", "a", "y", 2), (3, "word " * 20_000, "a", None, 3), (4, "one two three", "b", "z", 4), (4, "one two three", "b", "z", 4), (None, "no id", None, "w", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tox_rejected string, `a.b` long")
    docs = docs.selectExpr("*", "'k' AS row", "'k' AS taken", "'k' AS whole", "'k' AS `ids`", "'k' AS fp", "7 AS n_chars")
    left = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert left.columns == docs.columns and {x for x, in left.select("tox_rejected").collect()} <= {"x", "y", None, "z", "w"} and left.exceptAll(docs).count() == 0
    unique = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert unique.columns == docs.columns and sorted(r["doc_id"] or 0 for r in unique.collect()) == [0, 1, 3, 4]
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {3, 4, None}
    assert corpus_pipeline.pack_documents(spark, docs, sf_dir).count() >= len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == [], name


def test_written_tables_can_be_dropped(spark):
    made = written(spark.range(3), "test")
    assert made.count() == 3 and forget_written(spark) > 0
    with pytest.raises(Exception, match="(?i)not exist|file not found"):
        spark.read.parquet(made.inputFiles()[0]).count()
