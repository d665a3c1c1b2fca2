import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.brute import words
from touchtally.llm import cws, mixing
from touchtally.llm.common import string_buffer, word_count


def targets_by_hand(sizes):
    """Weights 5, 2, 1 over the sources, the excess over three times a source's size reshared until none is above."""
    order = sorted(k for k in sizes if k is not None) + ([None] if None in sizes else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [k for k in order if k not in capped]
        left = total - sum(capped.values())
        share = {k: left * weight[k] / sum(weight[j] for j in free) for k in free}
        above = [k for k in free if share[k] > 3 * sizes[k]]
        if not above:
            return capped | share
        capped |= {k: 3 * sizes[k] for k in above}


def test_mix(spark):
    rows = [(i, ["a", "b", "c", None, "d"][min(i % 13, 4)], i % 40) for i in range(3000)] + [(7, "zero", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumns({c: F.lit("x") for c in ("rank", "cut", "target", "share", "source_size", "bucket")})
    plan = mixing.mix_plan(docs)
    out = mixing.apply_mix(docs, plan).collect()
    again = mixing.apply_mix(docs.repartition(7), mixing.mix_plan(docs.repartition(3))).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = targets_by_hand(sizes)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6


def test_mix_cases(frame, odd, empty):
    for docs, n in ((frame.drop("size"), frame.count()), (odd, 5), (empty, 0)):
        sized = docs.withColumn("size", word_count())
        out = mixing.apply_mix(sized, mixing.mix_plan(sized.select("doc_id", "source", "size"))).collect()
        assert len(out) == n


def expected_edit(texts):
    out = []
    for i, t in enumerate(texts):
        half = len(t) // 2
        out.append(t[: len(t) - half] + texts[(i + 1) % len(texts)][:half])
    return out


def test_edited(frame, corpus):
    got = {r.doc_id: r for r in cws.edited_likeness(frame).collect()}
    texts = [t or "" for _, t in sorted(corpus)]
    assert len(got) == len(texts)
    for i, edited in enumerate(expected_edit(texts)):
        r = got[i]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1) == (got[(i + 1) % len(texts)].fingerprint == r.fingerprint)
    same = {}
    for i, t in enumerate(texts):
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    prints = {r.doc_id: r.fingerprint for r in cws.document_fingerprints(frame).collect()}
    assert prints == {i: r.fingerprint for i, r in got.items()}


def test_collisions_are_generalised_jaccard():
    rng = np.random.default_rng(4)
    pairs = []
    for _ in range(60):
        a = rng.choice(30, 40).tolist()
        b = a[: rng.integers(0, 40)] + rng.choice(60, rng.integers(1, 40)).tolist()
        pairs.append((" ".join(f"t{x}" for x in a), " ".join(f"t{x}" for x in b)))
    raw, at = string_buffer(pa.array([t for p in pairs for t in p]))
    prints = cws.fingerprints(raw, at, 512)
    got = cws.likeness(prints[::2], prints[1::2])
    want = []
    for a, b in pairs:
        x, y = Counter(words(a)), Counter(words(b))
        want.append(sum((x & y).values()) / sum((x | y).values()))
    assert np.abs(got - want).max() < 0.1 and abs(np.mean(got - np.array(want))) < 0.01


def test_edited_cases(spark, odd, empty):
    rows = cws.edited_likeness(odd).collect()
    assert len(rows) == 5 and sum(r.n_chars == 0 for r in rows) == 2
    assert cws.edited_likeness(empty).count() == 0
    one = cws.edited_likeness(spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest() and one.near_next == 1
