"""Manifest proofs against trees and proofs built one row at a time."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from touchtally.llm.manifest import level_sizes, manifest, missing_nodes

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def way(levels, at):
    """Per level: the siblings left and right of the node on the way up."""
    out = []
    for level in levels[:-1]:
        start = at // 3 * 3
        out.append((level[start:at], level[at + 1 : start + 3]))
        at //= 3
    return out


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        i, source, lang, n, text = row
        cut = None if text is None else text.replace("\n", "")
        bad = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        leaf, other = h(*map(field, row)), h(*map(field, (i, source, lang, n, cut)))
        groups[source].append((i is not None, i or 0, leaf, other if bad else leaf, i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([r[2] for r in sorted(groups[s])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (_, _, leaf, shown, i) in enumerate(sorted(groups[s])):
            path = way(trees[s], at) + way(top, k)
            folded = shown
            for left, right in path:
                folded = h(*left, folded, *right)
            siblings = [x for left, right in path for x in left + right]
            out.append((i, leaf, trees[s][-1][0], top[-1][0], h(*siblings), folded, folded == top[-1][0]))
    return out


def found(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return [tuple(r[c] for c in names) for r in df.collect()]


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest(spark, frame, height):
    rows = [tuple(r[c] for c in COLUMNS) for r in frame.collect()]
    assert sorted(found(manifest(frame, height)), key=key) == sorted(brute(rows), key=key)


def test_tampering_is_seen(spark, frame):
    seen = manifest(frame).collect()
    assert any(not r["verified"] for r in seen) and any(r["verified"] for r in seen)
    assert all(r["verified"] == (r["leaf"] == r["tampered_leaf"]) for r in seen)


def test_odd_rows(spark, odd):
    rows = [tuple(r[c] for c in COLUMNS) for r in odd.collect()]
    for height in (1, 7):
        assert sorted(found(manifest(odd, height)), key=key) == sorted(brute(rows), key=key)


def test_one_row_and_none(spark, empty):
    assert manifest(empty).collect() == []
    one = spark.createDataFrame([(7, "a\nb", "en", "s", 3)], empty.schema)
    row = manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == h("")
    assert row["verified"] == (zlib.crc32(b"7") % 2 == 1)


def test_many_sources(spark, empty):
    """A tree of sources that is itself cut into partitions."""
    rows = [(i, f"t\n{i}", None, None if i == 0 else f"host{i:03}", i) for i in range(60)]
    df = spark.createDataFrame(rows, empty.schema)
    expected = brute([(i, s, lang, n, t) for i, t, lang, s, n in rows])
    assert sorted(found(manifest(df, 1)), key=key) == sorted(expected, key=key)


def test_octopus_asks_for_what_cannot_be_derived():
    rng = np.random.default_rng(1)
    for _ in range(200):
        leaves = int(rng.integers(1, 90))
        sizes = level_sizes(leaves)
        asked = rng.choice(leaves, int(rng.integers(1, leaves + 1)), replace=False)
        got = missing_nodes(asked, sizes)
        have = set(map(lambda p: (0, int(p)), asked))
        assert len(got) == len(set(got)) and not have & set(got)
        for k in range(len(sizes) - 1):
            level = {p for a, p in have if a == k}
            for parent in {p // 3 for p in level}:
                run = {(k, c) for c in range(3 * parent, min(3 * parent + 3, sizes[k]))}
                # All of the run is there, and nothing was asked for that follows from the leaves.
                assert run <= have | set(got)
                have.add((k + 1, parent))
        assert not have & set(got)
