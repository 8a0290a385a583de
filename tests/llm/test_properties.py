"""Properties on random input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from provenant.llm import mpeg, packing, simhash, toxicity, warc


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_any_demand_is_covered(sizes):
    demand = np.bincount(np.array(sizes, int), minlength=65)
    plan = packing.cutting_stock(demand, 64)
    supply = sum((count * pattern for count, pattern in plan), np.zeros(65, int))
    used = sum(count for count, _ in plan)
    assert (supply >= demand).all() and used <= max(1, len(sizes)) and all(pattern @ np.arange(65) <= 64 for _, pattern in plan)
    assert used <= 2 * -(-sum(sizes) // 64) + 1


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4000))
def test_any_bytes_come_back_from_audio(payload):
    stream = mpeg.decode(mpeg.encode(payload))
    assert stream.payload == payload and not stream.gaps and not stream.failed


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_any_bytes_can_be_read(data):
    stream = mpeg.decode(data)
    assert stream.offsets == sorted(stream.offsets) and all(a < b for a, b in stream.gaps)
    at = 0
    for found in warc.salvage(data):
        assert 0 <= found.start < found.end <= len(data)
        if found.inner is None:  # whole stretches cover the bytes in order
            assert found.start == at
            at = found.end
    assert at == len(data)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 5), st.integers(0, 10_000), st.binary(min_size=1, max_size=30))
def test_records_beside_the_damage_are_salvaged(which, where, junk):
    members = [warc.record("response", str(i), f"http://h/{i}", bytes([65 + i]) * 400 + str(i).encode()) for i in range(6)]
    own = bytearray(members[which])
    at = where % len(own)
    own[at : at + len(junk)] = junk
    hurt = bytes(own)
    data = b"".join(hurt if i == which else m for i, m in enumerate(members))
    found = [x.record["heads"]["warc-record-id"] for x in warc.salvage(data) if x.record]
    rest = [f"<urn:page:{i}>" for i in range(6) if i != which]
    assert [x for x in found if x in rest] == rest


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_features_ignore_case_and_outer_punctuation(value):
    assert (toxicity.feature_ids("Vile, word!") == toxicity.feature_ids("vile word")).all()
    ids = toxicity.feature_ids(value)
    assert (np.diff(ids) > 0).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc", "ddd"]), max_size=40))
def test_signatures_depend_on_words_alone(words):
    one, other = " ".join(words), "\t" + "\n ".join(w.upper() for w in words) + " "
    a, b = (simhash.shingle_hashes(x, 5) for x in (one, other))
    assert (a == b).all() and simhash.simhash(a) == simhash.simhash(b) and (not len(a) or simhash.bands(a) == simhash.bands(b))
