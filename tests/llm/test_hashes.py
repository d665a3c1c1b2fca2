"""Texts that polynomial hashes modulo a power of two take for one another, through each operator that hashes words or bytes."""

import hashlib

import numpy as np
import pytest

from touchtally.llm import bytesdup, cws, neardup, pieces, repeats
from touchtally.llm.common import _PRIME, _RANDOM_BYTE, _P, prefix, span_hash, words_of


def thue_morse(length):
    text = "a"
    while len(text) < length:
        text += text.translate(str.maketrans("ab", "ba"))
    return text


ONE = thue_morse(2048)
OTHER = ONE.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, ONE), (2, OTHER), (3, ONE)], "doc_id long, text string").coalesce(1)


def test_words_differ():
    raw = np.frombuffer(f"{ONE} {OTHER} {ONE}".encode(), dtype=np.uint8)
    hashes = words_of(raw, np.array([0, len(raw)])).hash
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_span_hashes_match_plain_arithmetic():
    data = np.frombuffer(b"some bytes, some bytes, and more", dtype=np.uint8)
    sums = prefix(_RANDOM_BYTE[data], _P)
    for lane, base in enumerate((_P % _PRIME, (_P >> 32) % _PRIME)):
        total = 0
        for i, byte in enumerate(data):
            total += (int(_RANDOM_BYTE[byte]) >> 31 * lane & _PRIME) * pow(base, i, _PRIME)
            assert int(sums[lane][i + 1]) % _PRIME == total % _PRIME
    same = span_hash(sums, np.array([0, 12, 0]), np.array([10, 22, 9]), _P)
    assert same[0] == same[1] != same[2]


def test_near_duplicates(pair):
    rows = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(pair).collect()}
    assert rows == {1: 1, 2: 2, 3: 1}


def test_round_trip(pair):
    assert all(r["round_trip"] for r in pieces.tokenize(pair, pieces.load_pieces()).collect())


def test_passages_and_bytes(spark):
    filler = " ".join(f"w{i}" for i in range(19))
    words = spark.createDataFrame([(1, f"{ONE} {filler}"), (2, f"{OTHER} {filler}"), (3, f"{ONE} {filler}")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(words).collect()} == {1: 0, 2: 0, 3: 20}
    docs = spark.createDataFrame([(1, f"{ONE} {filler[:40]}"), (2, f"{OTHER} x")], "doc_id long, text string").coalesce(1)
    gone = {r["doc_id"]: r["n_removed"] for r in bytesdup.remove_repeated_bytes(docs).collect()}
    # The two words share long stretches; brute force tells which bytes those are.
    texts = {1: f"{ONE} {filler[:40]}".encode(), 2: f"{OTHER} x".encode()}
    starts = [t[i : i + 400] for t in texts.values() for i in range(len(t) - 399)]
    for i, text in texts.items():
        covered = set()
        for at in range(len(text) - 399):
            if starts.count(text[at : at + 400]) > 1:
                covered |= set(range(at, at + 400))
        assert gone[i] == len(covered)


def test_fingerprints(spark):
    docs = spark.createDataFrame([(1, ONE), (2, OTHER)], "doc_id long, text string").coalesce(1)
    rows = {r["doc_id"]: r for r in cws.edited_likeness(docs).collect()}
    assert rows[1]["fingerprint"] != rows[2]["fingerprint"]
    assert rows[1]["edited_sha256"] == hashlib.sha256((ONE[:1024] + OTHER[:1024]).encode()).hexdigest()


@pytest.mark.parametrize("copies", [400])
def test_repeated_rows_stay_linear(spark, copies):
    """Equal rows share one set of places, so that each carries one list, not one for every copy."""
    text = " ".join(f"w{(i * i) % 97}" for i in range(400))
    docs = spark.createDataFrame([(5, text)] * copies + [(6, text)], "doc_id long, text string").repartition(4)
    rows = repeats.remove_repeats(docs).select("doc_id", "n_removed").distinct().collect()
    assert len(rows) == 2
    rows = bytesdup.remove_repeated_bytes(docs).select("doc_id", "n_removed", "n_bytes").distinct().collect()
    assert len(rows) == 2 and all(r["n_removed"] == r["n_bytes"] for r in rows)


def test_members_outside_the_main_component_in_block_pairs(spark, monkeypatch):
    """Documents that share a template for less than the threshold, with pairs across blocks: no link is lost."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "SHORT_LIST", 4)
    template = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = [f"d{i // 2}x{j}" for j in range(60)]
        if i % 2:
            own[7] = "changed"
        rows.append((i, " ".join(template + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: i // 2 * 2 for i in range(60)}


def test_one_run_of_powers_a_base():
    """Powers of all sizes are one four-byte array per base, or a worker holds several times the longest."""
    from touchtally.llm import common

    base = 1_000_003
    for n in (10, 5000, 70_000, 9000):
        got = common.powers(base, n)
        assert [int(x) for x in got[:5]] == [pow(base, i, 2**31 - 1) for i in range(5)] and int(got[-1]) == pow(base, n - 1, 2**31 - 1)
    assert common._POWERS[base].nbytes == 4 * 2**17
