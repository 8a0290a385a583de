"""Each operator against a brute-force version, an exact round trip, or held-out rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

from provenant.llm import gru_lm, html_template, iblt, mixing, mpeg, packing, queries, simhash, toxicity, url_tree, warc
from provenant.llm.common import table
from provenant.operators.components import components

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def components_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 470)] + [(None, 1), (5, 5), (2, None)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert found == components_of({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("bucket", [1000, 3, 1])
def test_pigeonring_loses_no_link(spark, bucket):
    rng = random.Random(bucket)
    fps = {0, -1, 1, 3}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            near = centre
            for _ in range(rng.randrange(4)):
                near ^= 1 << rng.randrange(64)
            fps.add(near - (1 << 64) if near >> 63 else near)
    fps = sorted(fps)
    links = simhash.hamming_links(spark.createDataFrame([(x,) for x in fps], "fp long"), bucket).collect()
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2 for r in links)
    assert components_of(fps, [(r["a"], r["b"]) for r in links]) == components_of(fps, near)


def test_fingerprints(spark, sf_dir, texts):
    def brute(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    found = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, sf_dir, "documents")).collect()}
    fps = {i: brute(t) for i, t in texts.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in found.items()} == fps
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {i: r["component_id"] for i, r in found.items()} == components_of(fps, near)


def similar(a, b):
    sets = [set(zip(*[w[i:] for i in range(5)])) or {tuple(w)} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_groups_against_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for group in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((30, 80, 300)))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    groups, _, _ = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    linked = [(a, b) for a, x in rows for b, y in rows if a < b and similar(x, y) >= 0.8]
    want = components_of(range(len(rows)), linked)
    firsts = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in firsts) == sorted(set(want.values()))
    assert groups.where("first").count() == len(set(want.values()))


@pytest.mark.parametrize("crowd, hubs, bucket", [(2, 1, 1), (3, 2, 2), (1000, 4, 1000)])
def test_no_constant_changes_the_groups(spark, crowd, hubs, bucket):
    rng = random.Random(15)
    rows = []
    for group in range(8):
        words = [f"w{rng.randrange(300)}" for _ in range(60)] + [f"shared{i}" for i in range(100)]
        for _ in range(9):
            copy = list(words)
            for _ in range(rng.choice((0, 1, 2, 4, 7))):
                copy[rng.randrange(60)] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    linked = [(a, b) for a, x in rows for b, y in rows if a < b and similar(x, y) >= 0.8]
    groups, _, _ = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), crowd=crowd, hubs=hubs, bucket=bucket)
    assert groups.where("first").count() == len(set(components_of(range(len(rows)), linked).values()))


@pytest.mark.parametrize("least", [1, 7, 10**6])
def test_slices_change_no_mix_and_no_packing(spark, sf_dir, monkeypatch, least):
    docs = table(spark, sf_dir, "documents")
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "SLICE", least)
    assert sorted(map(str, mixing.mix(docs).collect())) == want
    rows = packing.pack(docs, TOKENIZER, per_slice=least).collect()
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and sum(fill.values()) / 2048 / len(fill) > 0.97 and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_a_crowd_of_copies_of_one_text_is_one_group(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(words))]
    for i in range(1, 200):
        copy = list(words)
        for _ in range(3):
            copy[rng.randrange(200)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    kept = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_pairs_inside_a_template_family_are_found(spark):
    rng = random.Random(6)
    passage, rows = [f"t{i}" for i in range(300)], []
    for pair in range(120):
        tail = [f"p{pair}w{i}" for i in range(rng.randrange(44, 54))]
        for copy in range(2):
            own = [f"c{pair}x{copy}y{i}" if copy and i % 7 == 3 and i < 7 * rng.choice((5, 6)) else w for i, w in enumerate(tail)]
            rows.append((len(rows), " ".join(passage + own)))
    linked = [(a, b) for a, x in rows for b, y in rows if a < b and similar(x, y) >= 0.8]
    assert len(linked) > 100 and all(b == a + 1 for a, b in linked)
    want = components_of(range(len(rows)), linked)
    firsts = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in firsts) == sorted(set(want.values()))


def test_packing_round_trip(spark, sf_dir, texts):
    reference = tokenizers.Tokenizer.from_file(TOKENIZER)
    want = {i: reference.encode(t, add_special_tokens=False).ids + [1] for i, t in texts.items()}
    rows = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=True).collect()
    found, sequences = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(found.setdefault(r["doc_id"], [])) and r["doc_tokens"] == len(want[r["doc_id"]])
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        found[r["doc_id"]] += r["ids"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert found == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(map(len, want.values())) / 2048 / len(sequences) > 0.97
    special = "a <|endoftext|> b  c'll  1234 \n\n x"
    assert packing.encoder(TOKENIZER).encode(special, allowed_special="all") == reference.encode(special, add_special_tokens=False).ids


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(1)
    demand = np.bincount(rng.integers(1, 257, 50_000), minlength=257)
    plan = packing.cutting_stock(demand, 256)
    supply = sum(count * pattern for count, pattern in plan)
    assert (supply >= demand).all() and all((pattern * np.arange(257)).sum() <= 256 for _, pattern in plan)
    used, least = sum(count for count, _ in plan), (demand * np.arange(257)).sum() / 256
    assert used <= 1.005 * max(least, demand[129:].sum())
    assert packing.cutting_stock(np.zeros(257, int), 256) == []


def test_mixing(spark):
    rows = [(i, "w " * (i % 17), ["a", "b", "c", None][i % 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    sizes, taken, targets = Counter(), Counter(), {}
    for r in out:
        source = rows[r["doc_id"]][2]
        assert r["size"] == rows[r["doc_id"]][0] % 17 and 0 <= r["taken"] <= 2 * r["size"]
        sizes[source] += r["size"]
        taken[source] += r["taken"]
        targets[source] = r["target"]
    share, weights, capped = 1.5 * sum(sizes.values()), dict(zip(("a", "b", "c", None), (5, 2, 1, 5), strict=True)), {}
    while True:  # what is above the limit is shared again
        rest = {s: w for s, w in weights.items() if s not in capped}
        want = {s: (share - sum(capped.values())) * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: 2 * sizes[s] for s, t in want.items() if t > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    for s, t in (want | capped).items():
        assert abs(targets[s] - t) < 1e-6 and taken[s] == int(t + 1e-9)
    copies = mixing.mixed(docs).collect()
    assert Counter({s: sum(len(r["text"].split()) for r in copies if r["source"] == s) for s in sizes}) == taken


def test_mpeg_round_trip_and_resync():
    rng = random.Random(2)
    for size in (0, 1, 72, 73, 937, 938, 5000, 100_000):
        payload = rng.randbytes(size)
        stream = mpeg.decode(mpeg.encode(payload, "a title"))
        assert stream.payload == payload and not stream.gaps and not stream.failed and stream.tags["TIT2"] == "a title"
        assert stream.samples == 1152 * len(stream.offsets) == 1152 * stream.table["frames"] and stream.duration_us == 24_000 * len(stream.offsets)
    payload = b"\xff\xfb" * 4000
    media = bytearray(mpeg.encode(payload))
    whole = mpeg.decode(bytes(media))
    assert whole.payload == payload
    second, third = whole.offsets[1:3]
    media[second : second + 2] = b"\0\0"  # a header is lost: its frame is a gap, the next ones are found again
    hurt = mpeg.decode(bytes(media))
    assert hurt.offsets == [o for o in whole.offsets if o != second] and hurt.gaps == [(second, third)]
    media[third + 8] ^= 1  # in the side information: the checksum tells
    assert mpeg.decode(bytes(media)).failed == 1
    joined = b"junk" + mpeg.encode(b"x" * 3000)[mpeg._tag(mpeg.encode(b""))[1] :] + b"TAG" + b"t" * 30 + bytes(95)
    assert mpeg.decode(joined).payload == b"x" * 3000
    assert mpeg.header_of(b"\xff\xfd\x80\x00").samples == 1152 and mpeg.header_of(b"\xff\xff\x90\x00").layer == 1 and mpeg.header_of(b"\xff\xe2\xf0\x00") is None


def test_mpeg_payloads_may_say_tag():
    for size in (192, 576, 1920):
        for at in range(size - 200, size - 2):
            payload = bytearray(b"a" * size)
            payload[max(at, 0) : max(at, 0) + 3] = b"TAG"
            assert mpeg.decode(mpeg.encode(bytes(payload))).payload == payload
    for skip in range(3):
        payload = (b"TAG" * 700)[skip:][:1920]
        media = mpeg.encode(payload)
        tagged = mpeg.decode(media + b"TAG" + b"Song".ljust(125, b"\0"))
        cut = mpeg.decode(media[:-50] + b"TAG" + b"Song".ljust(125, b"\0"))
        assert mpeg.decode(media).payload == payload == tagged.payload and not tagged.gaps and len(cut.gaps) == 1 and len(cut.offsets) == len(tagged.offsets) - 1


def test_mpeg_tags_of_all_versions():
    def tag(version, flags, frames):
        return b"ID3" + bytes((version, 0, flags)) + mpeg._syncsafe(len(frames)) + frames

    long = "x" * 300  # its size has another form as a plain number
    four = b"TIT2" + mpeg._syncsafe(len(long) + 1) + b"\0\0\x03" + long.encode() + b"TPE1" + mpeg._syncsafe(5) + b"\0\0\x01" + "ä".encode("utf-16")
    for data, want in (
        (tag(4, 0, four), {"TIT2": long, "TPE1": "ä"}),
        (tag(4, 0x40, mpeg._syncsafe(6) + b"\x01\0" + four), {"TIT2": long, "TPE1": "ä"}),
        (tag(3, 0, b"TIT2" + (6).to_bytes(4, "big") + b"\0\0\0Hello" + b"APIC" + (2).to_bytes(4, "big") + b"\0\0xy"), {"TIT2": "Hello"}),
        (tag(3, 0x80, b"TIT2" + (4).to_bytes(4, "big") + b"\0\0\x02\xff\0\0a"), None),
        (tag(2, 0, b"TT2" + (4).to_bytes(3, "big") + b"\0old"), {"TT2": "old"}),
    ):
        found, end = mpeg._tag(data + b"\xff\xfb")
        assert end == len(data) and (want is None or found == want)


def test_mpeg_vbri_table():
    payload = b"p" * 3000
    media = mpeg.encode(payload)
    start = mpeg._tag(media)[1]
    body = struct.pack(">4sHHHIIHHHH", b"VBRI", 1, 0, 75, 9999, 4, 2, 3, 2, 2) + struct.pack(">HH", 100, 200)
    first = (media[start : start + 4] + bytes(32) + body).ljust(192, b"\0")
    found = mpeg.decode(first + media[start + 192 :])
    assert found.table == {"kind": "VBRI", "bytes": 9999, "frames": 4, "stride": 2, "toc": [300, 600]} and found.payload == payload
    assert mpeg._table(first[:60], mpeg.header_of(first[:4])) == {}


def bit_sum(bits):
    value = 0xFFFF
    for bit in bits:
        value = (value << 1) & 0xFFFF ^ (0x8005 if (value >> 15) ^ int(bit) else 0)
    return value


@pytest.mark.parametrize(
    "head, covered",
    [
        (b"\xff\xfe\x40\x00", lambda body: 256),  # Layer I, stereo
        (b"\xff\xfe\x40\x50", lambda body: 4 * (2 * 8 + 24)),  # joint stereo, one allocation from the ninth subband on
        (b"\xff\xfe\x40\xc0", lambda body: 128),
        (b"\xff\xfc\x34\xc0", lambda body: None),  # Layer II, 56 kbit/s and one channel: table a
        (b"\xff\xf4\x80\x00", lambda body: None),  # MPEG-2
    ],
)
def test_mpeg_sums_of_the_other_layers(head, covered):
    rng, parsed = random.Random(head), mpeg.header_of(head)
    body = rng.randbytes(parsed.size - 6)
    bits = "".join(format(x, "08b") for x in head[2:4] + body)
    many = covered(body)
    if many is None:  # by hand: allocations subband by subband, then two bits for each that is not zero
        widths = [4] * 11 + [3] * 12 + [2] * 4 if parsed.version == 3 else [4] * 4 + [3] * 7 + [2] * 19
        at, chosen = 16, 0
        for width in widths:
            for _ in range(1 if parsed.mono else 2):
                chosen += "1" in bits[at : at + width]
                at += width
        many = at - 16 + 2 * chosen
    frame = head + bit_sum(bits[: 16 + many]).to_bytes(2, "big") + body
    found = mpeg.decode(frame * 3)
    assert found.checked == 3 and found.failed == 0 and found.samples == 3 * parsed.samples
    hurt = bytearray(frame * 3)
    hurt[6 + many // 8 - 1] ^= 0x10  # in what is covered: only the first frame fails
    hurt[parsed.size + 6 + many // 8 + 2] ^= 0x10
    assert mpeg.decode(bytes(hurt)).failed == 1


def test_mpeg_query_has_the_seek_offsets(spark, sf_dir):
    row = queries.op3_mpeg(spark, sf_dir).where("n_frames > 2").first()
    text = table(spark, sf_dir, "documents").where(F.col("doc_id") == row["doc_id"]).first()["text"] or ""
    raw = text.encode()
    media = mpeg.encode(raw.ljust(max(1, -(-len(raw) // 192)) * 192))
    assert hashlib.sha256(media).hexdigest() == row["media_sha256"] and len(row["seek_offsets"]) == row["n_frames"]
    assert all(mpeg.header_of(media[o : o + 4]) for o in row["seek_offsets"])


def test_mpeg_of_documents_against_brute_force(spark, sf_dir, texts):
    for r in queries.op3_mpeg(spark, sf_dir).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["frames_failed"] == r["gap_bytes"] == 0


def test_warc_salvage(spark):
    members = [warc.record("response", str(i), f"http://h/{i}", f"<p>{i}</p>".encode() * 50) for i in range(6)]
    data = bytearray(b"".join(members))
    starts = [sum(map(len, members[:i])) for i in range(7)]
    data[starts[2] + 40] ^= 0xFF
    plain = zlib.decompress(members[0], 31)
    data += b"rubbish" + plain + bytes(members[1][:50])
    found = list(warc.salvage(bytes(data)))
    ids = [x.record["heads"]["warc-record-id"] for x in found if x.record]
    assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5, 0)]
    end = starts[6] + 7
    assert [(x.start, x.end) for x in found if not x.record] == [(starts[2], starts[3]), (starts[6], end), (end + len(plain), len(data))]
    cut = plain.replace(b"<p>0</p>", b"<p>9</p>", 1)  # the block no longer has its digest
    assert [x.record for x in warc.salvage(cut)] == [None]


def test_warc_salvage_inside_members(spark):
    rng = random.Random(5)
    plains = [zlib.decompress(warc.record("response", str(i), f"http://h/{i}", rng.randbytes(3000)), 31) for i in range(5)]
    hurt = bytearray(plains[2])
    hurt[-500] ^= 1

    def packed(parts):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        return packer.compress(b"".join(parts)) + packer.flush()

    def ids(data):
        return [x.record and int(x.record["heads"]["warc-record-id"][10:-1]) for x in warc.salvage(data)]

    assert ids(packed(plains)) == [0, 1, 2, 3, 4]
    one_bad = packed([*plains[:2], bytes(hurt), *plains[3:]])
    assert ids(one_bad) == [0, 1, None, 3, 4]
    gap = next(x for x in warc.salvage(one_bad) if not x.record)
    assert gap.inner == (sum(map(len, plains[:2])), sum(map(len, plains[:3]))) and (gap.start, gap.end) == (0, len(one_bad))
    cut = packed(plains)[: -len(plains[4]) // 2]
    assert ids(cut) == [0, 1, 2, 3, None] and ids(cut + packed(plains[4:])) == [0, 1, 2, 3, None, 4]
    rows = warc.read(spark.createDataFrame([("a", bytearray(cut))], "archive string, content binary")).collect()
    assert [r["kind"] for r in rows] == ["record"] * 4 + ["gap"] and rows[0]["inner_start"] == 0 and rows[4]["end"] == len(cut)
    import time

    began = time.time()
    list(warc.salvage(b"\x1f\x8b\x08" * 50_000))
    assert time.time() - began < 30


def test_iblt_against_sets(spark, sf_dir, texts):
    def paragraphs(text):
        return {x for x in re.sub(r"([^\n]{160}\S*)\s", r"\1\n", text, flags=re.A).split("\n") if x}

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    found = {r["doc_id"]: r for r in iblt.compare(table(spark, sf_dir, "documents")).collect()}
    ids = sorted(texts, reverse=True)
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        text, n = texts[i], len(texts[i]) // 3
        edited = text[: len(text) - n] + texts[after][:n]
        own = [paragraphs(x) for x in (text, edited, texts[after])]
        r = found[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        assert r["near_edited"] == pytest.approx(like(own[0], own[1])) and r["near_next"] == pytest.approx(like(own[0], own[2]))
        assert len(r["removed"]) == len(own[0] - own[1]) and len(r["added"]) == len(own[1] - own[0])


@pytest.mark.parametrize("bounds, bucket", [(500, 1000), (4, 3), (1, 1)])
def test_next_documents(spark, monkeypatch, bounds, bucket):
    monkeypatch.setattr(iblt, "BOUNDS", bounds)
    monkeypatch.setattr(iblt, "BUCKET", bucket)
    rng = random.Random(9)
    ids = [rng.choice((rng.randrange(50), rng.randrange(10**6), -rng.randrange(10**18), 2**63 - 1 - rng.randrange(9))) for _ in range(60)] + [None, None, 7, 7]
    rows = [(i, f"text {n}") for n, i in enumerate(ids)] + [(7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.xxhash64("text").alias("text_hash"), F.array().cast("array<long>").alias("members"))
    order = sorted({(r["doc_id"] is None, -(r["doc_id"] or 0), -r["text_hash"], r["text"]) for r in docs.collect()})
    follows = {x[3]: order[(k + 1) % len(order)][3] for k, x in enumerate(order)}
    found = iblt.with_next(docs).select("text", "next_text").collect()
    assert len(found) == len(rows) and all(r["next_text"] == follows[r["text"]] for r in found)


def test_iblt_peels_and_grows(spark):
    rows = [(list(range(1, 400)), list(range(300, 440)))]
    df = spark.createDataFrame(rows, "l array<long>, r array<long>").select(*[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "lr"])
    small = df.select(F.slice("l", 1, 3).alias("l"), F.slice("l", 3, 2).alias("r"))
    peeled = small.select(iblt._emptied(iblt.peel(iblt.subtract(iblt.cells(F.col("l")), iblt.cells(F.col("r"))))).alias("x")).first()["x"]
    l, r = small.first()
    assert sorted((x["k"], x["n"]) for x in peeled) == sorted([(k, 1) for k in set(l) - set(r)] + [(k, -1) for k in set(r) - set(l)])
    l, r = df.first()
    want = sorted([(k, 1) for k in set(l) - set(r)] + [(k, -1) for k in set(r) - set(l)])
    for many in (1, 7, 100):  # however wrong the first size is, larger ones follow
        items = [(1, 0, 0, many, d, 1) for d in l] + [(1, 0, 0, many, d, -1) for d in r]
        items = spark.createDataFrame(items, "row long, pair int, block long, many long, digest long, side int")
        tables = [told.first() for _, told in iblt.larger(items)]
        assert sorted((x["k"], x["n"]) for t in tables for x in t["found"]) == want and sum(t["n"] for t in tables) == len(want)
        assert not tables[-1]["failed"] and all(t["failed"] for t in tables[:-1])


def test_iblt_estimates_the_difference(spark):
    rng = random.Random(11)
    for only_left, only_right in ((40, 40), (200, 0), (30, 120), (600, 600)):
        found = []
        for _ in range(12):
            common = [rng.getrandbits(63) for _ in range(100)]
            found.append((common + [rng.getrandbits(63) for _ in range(only_left)], common + [-rng.getrandbits(63) for _ in range(only_right)]))
        df = spark.createDataFrame(found, "l array<long>, r array<long>")
        many = [x[0] for x in df.select(iblt.blocks_for(iblt.subtract(iblt.cells(F.col("l")), iblt.cells(F.col("r"))))).collect()]
        assert 0.5 < np.mean(many) / (1.25 * (only_left + only_right) / iblt.LOAD) < 2


def test_iblt_levels(spark, sf_dir):
    levels = {}
    iblt.compare(table(spark, sf_dir, "documents"), levels).count()
    assert levels[0] + levels[1] >= 400 * 0.9 and sum(levels.values()) >= 400  # two pairs a document


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1><ul class="menu"><li><a href="/">Home</a></li></ul></header><nav><a href=x>News</a></nav>
<div class="cookie-notice"><p>We use cookies</p></div><div id="sidebar"><p>Side</p></div>
<{tag}><h2>Head {i} &amp; &#x41;</h2><p>First   para<b> of {i}</b><br>line<p>Second &lt;one&gt;<div class="ad">Buy</div><form><p>Mail?</p></form>
<ul><li>a<li>b</ul><!-- no --><div class="comments"><p>Reader says</p></div></{tag}><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "main", 'div class="body"'])
def test_html_main_text(spark, tag):
    rows = [(i, f"http://h{i % 2}.net/{i}", PAGE.format(i=i, tag=tag).replace(f"</{tag}", f"</{tag.split()[0]}")) for i in range(8)]
    for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        i = r["page_id"]
        assert r["text"] == f"Head {i} & A\nFirst para of {i} line\nSecond <one>\na\nb" and r["n_chars"] == len(r["text"])


def test_html_template_text_is_cut(spark):
    page = """<body><article><h1>Head {i}</h1><div class="tools"><p>Print this page</p><p>Send it</p></div><p class="lead">Lead {i}</p><p>Text {i}</p>{odd}<p class="x7">Our offer</p></article></body>"""
    rows = [(i, f"http://h/{i}", page.format(i=i, odd="<div class=y9>Now and then</div>" * (i % 2))) for i in range(8)]
    rows += [(i, "http://copies/", '<article><p class="a">The same article</p></article>') for i in range(8, 12)]
    rows += [(i, "http://two/", f'<article><p class="a">Shared by two</p><p class="b">Own {i}</p></article>') for i in range(12, 14)]
    found = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[i] for i in range(8)] == [f"Head {i}\nLead {i}\nText {i}" for i in range(8)]
    assert {found[i] for i in range(8, 12)} == {"The same article"} and found[12] == "Shared by two\nOwn 12"


def test_html_marks():
    page = """<body><div class="site-header"><h1>Site</h1></div><div class="layout has-sidebar"><div class="main with-ads"><article><div class="article-header"><h1>Title</h1><p>By me</p></div>
    <p>Text one</p><div class="ad-slot">Buy</div><section id="comments"><h3>2 replies</h3><p>No</p></section><div hidden>x</div></article></div><aside>Side</aside></div></body>"""
    assert html_template.main_text(page, None) == "Title\nText one"
    loose = "<p>Just a page<p>of two blocks &#8211; no more"
    assert html_template.main_text(loose, None) == "Just a page\nof two blocks – no more" and html_template.main_text("", None) == ""


def test_html_of_odd_pages_takes_no_time():
    import time

    began = time.time()
    for page in ("<a " * 200_000, "<!" * 200_000, "<div>" * 50_000 + "deep" + "</div>" * 50_000, '<p title="' * 100_000, "<!--" * 100_000, "<script>" * 50_000, "&" * 300_000):
        html_template.main_text(page, None)
    assert html_template.main_text("<div>" * 5000 + "deep <b>text</b>", None) == "deep text"
    assert time.time() - began < 20


def test_occurrence_classes_against_brute_force(spark):
    pages = [f"<body><article><p>{i}</p><p class=k>Same</p></article><footer>f</footer>{'<aside></aside>' * (i % 3)}{'<i>x</i><div>And</div>' * (i % 2)}</body>" for i in range(9)]
    rows = [(str(i), "h", page) for i, page in enumerate(pages)]
    vectors = {}
    for i, page in enumerate(pages):
        found = html_template.parse(page)
        for place, row in found.elements.items():
            vectors.setdefault((place, 0), [0] * 9)[i] = row[2]
        for place, text, _, main in found.texts:
            if main:
                vectors.setdefault((place, html_template.text_key(place, text)), [0] * 9)[i] += 1
    classes = {}
    for token, vector in vectors.items():
        classes.setdefault(tuple(vector), set()).add(token)
    tokens = html_template.occurrences(spark.createDataFrame(rows, "key string, host string, html string"))
    found = {}
    for r in tokens.collect():
        found.setdefault((r["vector"], r["pages"], r["total"]), set()).add((r["token"], r["text"]))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, classes.values()))
    # Valid classes: on two pages and a fifth of the host's; an element's two tokens are enough, a text needs another token.
    valid = {t for v, own in classes.items() if sum(n > 0 for n in v) >= 2 and sum(1 + (not x) for _, x in own) >= 2 for t in own}
    told = html_template.templates(tokens).first()["tokens"]
    assert {(r["token"], r["text"]) for r in told} == valid
    fixed = html_template.template_texts([r.asDict() for r in told])
    assert len(fixed) == 1 and fixed[0]["pages"] == 9  # the text in p.k; "And" is in an element that is on four pages only


UNNAMED = """<body><div class="qa"><div class="qb">The Daily {odd}</div><div class="qc"><a href=/a>One</a> <a href=/b>Two</a></div></div><div class="qd"><div class="qe"><h1>Title {i}</h1>{own}
<div class="qf">Tell your friends</div><p>Last words {i}.</p></div></div><div class="qg">Offer {i}: buy it</div><div class="qh">All rights kept</div></body>"""


def test_a_site_without_telling_names(spark):
    own = lambda i: "".join(f"<p>Paragraph {k} of text {i}, which goes on for a while and says no more than that.</p>" for k in range(1 + i % 4))
    pages = [UNNAMED.format(i=i, own=own(i), odd="") for i in range(12)]
    want = [f"Title {i}\n" + own(i).replace("<p>", "").replace("</p>", "\n") + f"Last words {i}." for i in range(12)]
    rows = [(i, f"http://site/{i}", page) for i, page in enumerate(pages)]
    found = {r["page_id"]: r for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[i]["text"] for i in range(12)] == want and {r["content"] for r in found.values()} == {"div.qe"}
    assert all(html_template.main_text(page) != text for page, text in zip(pages, want, strict=True))  # a page alone doesn't tell


def test_pages_of_a_nested_class(spark):
    kinds = ['<div class="n1"><p>Story {i} is told here at some length.</p></div><div class="n2">Teaser {i}</div>', '<section><p>Report {i} is given here, and is longer.</p></section><div class="n3">Aside {i}</div>']
    rows = [(i, f"http://site/{i}", f'<body><div class="top">Site {i}</div>{kinds[i % 2].format(i=i) * (1 + i % 1)}</body>') for i in range(10)]
    found = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(("Story" if i % 2 == 0 else "Report") in found[i] for i in range(10))


def test_urls(spark):
    rules = (("block", "com", "/en/1"), ("block", "bad.com", "/fr/1"), ("allow", "example.com", "/en/7"), ("block", "com", "/es/"))
    rows = [(i, f"http://www.Example.com/en/{i}/x.html?q") for i in range(60)] + [(100 + i, f"https://bad.com/{w}/{k}") for i, (w, k) in enumerate((w, k) for w, n in (("en", 190), ("fr", 190), ("es", 9), ("de", 2)) for k in range(n))]
    rows += [(900, "http://other.org/en/1"), (901, "http://xcom/en/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = {r["page_id"]: r for r in url_tree.judge_urls(pages, rules).collect()}
    assert out[7]["verdict"] == "allow" and out[7]["rule"] == "example.com/en/7" and out[18]["verdict"] == "block" and out[18]["host"] == "www.example.com"
    assert out[900]["rule"] is None and out[900]["verdict"] == "allow" and out[901]["rule"] is None
    # Most of what is labelled below /en/ and /fr/ is blocked, so their template is rejected; /de/ is not like them and has no labels.
    assert out[120]["template"] == out[320]["template"] == "/*/{n}" and out[120]["rule"] is None and out[120]["verdict"] == "block"
    assert out[490]["template"] == "/de/{n}" and out[490]["verdict"] == "allow" and out[484]["rule"] == "com/es/"
    twice = {r["page_id"]: r for r in url_tree.judge_urls(pages.union(pages), rules).distinct().collect()}
    assert twice == out


def brute_urls(rows, rules):
    def split(url):
        after = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", after)[0]
        return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", after[len(host) :])[0]

    def rule(host, path):
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        return max(fits, key=lambda r: len(r[1] + r[2]), default=None)

    def wild(x):
        return bool(re.fullmatch(r"(\{n\}(\.\w+)?)?", x))

    urls = {u: (*split(u), rule(*split(u))) for _, u in rows if u and split(u)[0]}
    shape = lambda path: re.sub("[0-9]+", "{n}", path)
    segments = {(h, shape(p)): shape(p)[1:].split("/") for h, p, _ in urls.values()}
    many = Counter((h, shape(p)) for h, p, _ in urls.values())
    named = {k: [] for k in segments}
    for level in range(max(map(len, segments.values()), default=0)):
        having, here, names = Counter(), Counter(), {}
        for (h, s), own in segments.items():
            if len(own) > level:
                having[h, tuple(named[h, s]), own[level]] += many[h, s]
                here[h, tuple(named[h, s])] += many[h, s]
                names.setdefault((h, tuple(named[h, s])), set()).add(own[level])
        for (h, s), own in segments.items():
            if len(own) > level:
                n = having[h, tuple(named[h, s]), own[level]]
                stays = n >= url_tree.LEAST and (len(names[h, tuple(named[h, s])]) <= url_tree.FEW or n >= url_tree.SHARE * here[h, tuple(named[h, s])])
                named[h, s].append((own[level], stays or wild(own[level])))
        for k in named:
            named[k] = [x if isinstance(x, str) else x[0] if x[1] else "*" for x in named[k]]
    template = {k: "".join("/" + x for x in own) for k, own in named.items()}
    flags = {u: ("?" in u, "#" in u, p.endswith("/"), bool(re.search(r"\.[A-Za-z]{2,5}$", p)), bool(r) and r[0] == "block", bool(r)) for u, (h, p, r) in urls.items()}
    branch, skeleton = {}, {}
    for u, (h, p, _) in urls.items():
        t = template[h, shape(p)]
        for group, key in ((branch, (h, t)), (skeleton, (h, re.sub(r"/[^/{*]+(?=/|$)", "/*", t)))):
            group.setdefault(key, []).append(flags[u])
    node, sums = {}, {}
    for (h, t), own in branch.items():
        key = (h, re.sub(r"/[^/{*]+(?=/|$)", "/*", t))
        off, near = 0.0, True
        for k in range(6):
            share, have = sum(f[k] for f in skeleton[key]) / len(skeleton[key]), sum(f[k] for f in own)
            off += (have - len(own) * share) ** 2 / (len(own) * share * (1 - share)) if 0 < share < 1 else 0
            near = near and (k < 4 or abs(have / len(own) - share) <= url_tree.NEAR)
        like = off <= url_tree.CHI_SQUARE and near
        node[h, t] = (*key, like) if like else (h, t, like)
        row = sums.setdefault(node[h, t], [0, 0, 0])
        for k, x in enumerate((len(own), sum(f[4] for f in own), sum(f[5] for f in own))):
            row[k] += x
    out = []
    for i, u in rows:
        host, path = split(u)
        own, found = rule(host, path), node.get((host, template.get((host, shape(path)))))
        purity = (sums[found][1] + 1) / (sums[found][2] + 2) if found else None
        bad = found and purity >= url_tree.PURITY and sums[found][2] >= url_tree.LABELLED * sums[found][0]
        out.append((i, host, path, own and own[1] + own[2], own[0] if own else "block" if bad else "allow", found and found[1], purity and round(purity, 9)))
    return sorted(map(str, out))


def test_urls_against_brute_force(spark, sf_dir):
    rng = random.Random(12)
    rules = (("block", "com", "/a/1"), ("block", "b.com", "/b/1"), ("allow", "a.com", "/a/12"), ("block", "net", "/deep/"))
    rows = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(['a.com', 'B.com', 'c.net'])}/{rng.choice('aabbc')}/{rng.choice([str(rng.randrange(300)), rng.choice('xyz'), f'p{rng.random()}', ''])}{rng.choice(['', '', '/', '.html', '/q/r/s', '?a=1', '#f'])}") for i in range(700)]
    rows += [(800 + i, "http://c.net/deep" + "/x" * (i % 30) + rng.choice(["", "/y", "/1"])) for i in range(60)] + [(900, None), (901, "nothing"), (902, "http://?x"), (903, "http://a.com")]
    for own, given in ((rows, rules), ([(r["page_id"], r["url"]) for r in table(spark, sf_dir, "pages").collect()], url_tree.RULES)):
        found = url_tree.judge_urls(spark.createDataFrame(own, "page_id long, url string"), given).collect()
        assert sorted(str((*tuple(r)[:6], r["purity"] and round(r["purity"], 9))) for r in found) == brute_urls(own, given)


def test_url_rules_in_sql(spark):
    sf = "/root/testdata/sf0.01"
    cases = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(url_tree.RULES, key=lambda r: -len(r[1] + r[2])))
    said = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in url_tree.RULES)
    want = duckdb.sql(f"""
        WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM '{sf}/pages.parquet'),
        b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        c AS (SELECT *, CASE {cases} END AS rule FROM b)
        SELECT page_id, host, path, rule, CASE {said} ELSE 'allow' END FROM c""").fetchall()
    found = url_tree.judge_urls(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    judged = toxicity.judge(docs.select("doc_id", "text"), labels.where(fold > 0))
    out = judged.join(labels.where(fold == 0), "doc_id").select("toxic", "tox_rejected").collect()
    right = sum(r["tox_rejected"] == (r["toxic"] == 1) for r in out) / len(out)
    assert right >= 0.9


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(0)
    first = rng.random(600) < 0.5
    rows = [np.array(sorted({int(a), 2 + int(x)}), np.int32) for a, x in zip(first, rng.integers(0, 3, 600), strict=True)]
    labels = np.column_stack([first, first]).astype(int)
    models = toxicity.fit_chain(rows, labels, np.arange(600) % 4, 5)
    assert len(models[0]) == 6 and len(models[1]) == 7 and models[1][5] > 0  # a column more, and it counts
    out = toxicity.apply_chain(models, rows, 5)
    assert ((out > 0.5) == labels).all()


def test_gru_counts_and_gain(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, own in tokens.items() if not out[i] for w in own)
    total, distinct = sum(c.values()), len(c)
    rows = gru_lm.score(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens[r["doc_id"]]
        assert r["held_out"] == out[r["doc_id"]] and r["n_tokens"] == len(own) and r["n_known"] == sum(c[w] > 0 for w in own) and r["train_tokens"] == total
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (total + distinct + 1)) for w in own))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_gru_counting_holds_distinct_words_only(monkeypatch):
    monkeypatch.setattr(gru_lm, "HELD_COUNTS", 4000)
    base, held, most = pa.total_allocated_bytes(), [], 0

    def tallies(pieces):
        nonlocal most
        for low in pieces:
            most = max(most, pa.total_allocated_bytes() - base)
            words = pa.array([f"word{low + i}".encode() for i in range(500)], pa.binary())
            held.append(words.nbytes)
            yield words, np.arange(1, 501)

    [(words, c)] = gru_lm.added(tallies([0] * 200))
    assert most < sum(held) / 8 and dict(zip(words.to_pylist(), c.tolist(), strict=True)) == {f"word{i}".encode(): 200 * (i + 1) for i in range(500)}
    parts = list(gru_lm.added(tallies(range(0, 20_000, 250))))
    want = Counter()
    for low in range(0, 20_000, 250):
        want.update({f"word{low + i}".encode(): i + 1 for i in range(500)})
    found = Counter()
    for words, c in parts:
        assert len(set(words.to_pylist())) == len(words) < 5000
        found.update(dict(zip(words.to_pylist(), c.tolist(), strict=True)))
    assert len(parts) > 3 and found == want


def test_gru_trains_on_every_token(spark):
    sizes = (0, 5, 31, 32, 700, 1500, 5000)
    rows = spark.createDataFrame([(i, " ".join(f"w{k % 37}" for k in range(n)), i == 1) for i, n in enumerate(sizes)], "doc_id long, text string, held_out boolean")
    found = gru_lm.encode(rows, gru_lm.vocabulary(gru_lm.counts(rows.where("NOT held_out")))).collect()
    assert [r["n_tokens"] for r in found] == [n + 1 for n in sizes] and [r["round"] < 0 for r in found] == [i == 1 for i in range(len(sizes))]
    for r in found:
        whole, at = np.frombuffer(r["symbols"], np.uint16), 0
        for warm, part in gru_lm.parts(whole):
            assert (part == whole[at - warm : at - warm + len(part)]).all() and warm == min(at, gru_lm.WINDOW)
            at += len(part) - warm
        assert at == len(whole) == r["n_tokens"]


def test_gru_goals_are_all_tokens_once():
    own, model = small_model()
    rng, seen = np.random.default_rng(2), []
    model.step = lambda x, y, keep, goal, h, squares, rate: (seen.extend(y[goal].tolist()) or 0.0, h)
    texts = [rng.integers(0, own.head, n).astype(np.int32) for n in (1, 3, 40, 3000, 64)]
    gru_lm.learn(model, [p for t in texts for p in gru_lm.parts(t)], {}, 0.1)
    assert Counter(seen) == Counter(x for t in texts for x in t.tolist())


def test_gru_holds_words_of_one_large_grade(spark):
    rows = spark.createDataFrame([(bytearray(f"w{i}".encode()), 1) for i in range(1000)] + [(bytearray(b"\n"), 1)], "word binary, c long")
    own = gru_lm.vocabulary(rows, held=200)
    assert 120 <= len(own.words) <= 280 and gru_lm.END in own.words and own.head == len(own.words) and own.total == own.distinct == 1001
    assert rows.where(gru_lm._held(own.least, own.below)).count() == len(own.words)


def small_model():
    rng = np.random.default_rng(3)
    words = [b"\n", *(f"w{i}".encode() for i in range(30))]
    counts = np.sort(rng.integers(1, 50, 31))[::-1].astype(float)
    tails = np.zeros(gru_lm.TAILS), np.zeros(gru_lm.TAILS)
    for w, n in zip(words, counts, strict=True):
        tails[0][gru_lm.tail_class(w)] += n
        tails[1][gru_lm.tail_class(w)] += 1
    own = gru_lm.Vocabulary(words, counts, int(counts.sum()), 31, *tails)
    model = gru_lm.Model(own)
    for name, value in model.weights.items():
        model.weights[name] = (value + rng.normal(0, 0.3, value.shape)).astype(np.float32)
    return own, model


def test_gru_probabilities_and_batches():
    own, model = small_model()
    rng = np.random.default_rng(5)
    symbols = own.head + gru_lm.TAILS
    h = rng.normal(0, 1, (1, gru_lm.HIDDEN)).astype(np.float32)
    assert np.exp(model.log_probs(np.repeat(h, symbols, 0), np.arange(symbols))).sum() == pytest.approx(1, abs=1e-4)
    sequences = [np.append(rng.integers(0, symbols, n), own.end) for n in (0, 1, 5, 70, 200, 33, 32, 31)]
    together = gru_lm.score_sequences(model, sequences, slots=3)
    alone = [gru_lm.score_sequences(model, [s])[0] for s in sequences]
    assert together == pytest.approx(alone, abs=1e-2)


def test_gru_gradient():
    own, model = small_model()
    rng = np.random.default_rng(6)
    shape = (gru_lm.WINDOW, 3)
    x, y = (rng.integers(0, own.head + gru_lm.TAILS, shape).astype(np.int32) for _ in range(2))
    keep, goal = np.ones(shape, np.float32), np.ones(shape, bool)
    keep[9, 1], goal[:10, 1], goal[-5:, 2] = 0, False, False
    h = rng.normal(0, 0.5, (3, gru_lm.HIDDEN)).astype(np.float32)

    def loss(weights):
        probe = gru_lm.Model(own, weights)
        squares = {k: np.full_like(v, 1e12) for k, v in probe.weights.items()}
        return probe.step(x, y, keep, goal, h, squares, 0.0)[0] / goal.sum()

    start = {k: v.copy() for k, v in model.weights.items()}
    squares = {k: np.ones_like(v) for k, v in start.items()}
    moved = gru_lm.Model(own, {k: v.copy() for k, v in start.items()})
    moved.step(x, y, keep, goal, h, squares, 1e-4)
    for name in gru_lm.Model.names:
        grad = (start[name] - moved.weights[name]) / 1e-4 * np.sqrt(squares[name])
        place = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        up, down = ({k: v.copy() for k, v in start.items()} for _ in range(2))
        up[name][place] += 0.02
        down[name][place] -= 0.02
        assert (loss(up) - loss(down)) / 0.04 == pytest.approx(grad[place], rel=0.1)
