import hashlib
import random
import time
from collections import Counter

import pytest
from tests.llm.brute import Groups, words

from touchtally.llm import bytesdup, linedup, neardup, repeats


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def expected_components(corpus, n, percent):
    sets = {}
    for i, text in corpus:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    groups = Groups(sets)
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                groups.join(a, b)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("shingle, short_list, block", [(4, 32, 512), (4, 3, 8), (5, 2, 512)])
def test_near_duplicates(frame, corpus, monkeypatch, shingle, short_list, block):
    """Also with lists and blocks so short that the large group takes every path."""
    monkeypatch.setattr(neardup, "SHORT_LIST", short_list)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SHARED", min(block // 2, 48))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, shingle, 80).collect()}
    assert found == expected_components(corpus, shingle, 80)


def test_near_duplicates_odd(odd, empty):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == 5 and all(r.kept for r in rows)
    assert {r.component_id for r in rows if r.doc_id == 5} == {5}
    assert neardup.near_duplicates(empty).count() == 0


def test_common_passage_ties_no_unlike_documents(spark, monkeypatch):
    """Documents of which half is a common passage are no cluster; copies among them are still found."""
    common = [f"k{i}" for i in range(50)]
    texts = [" ".join(common + [f"w{d}x{i}" for i in range(50)]) for d in range(120)]
    texts += [f"{texts[7]} more", " ".join(common), " ".join(common + ["end"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(neardup, "SHORT_LIST", 8)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "SHARED", 8)
    compared, confirm = [], neardup.confirm
    monkeypatch.setattr(neardup, "confirm", lambda members, *a: compared.append(members.count()) or confirm(members, *a))
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 4, 80).collect()}
    assert found == {**{d: d for d in range(122)}, 120: 7, 122: 121}
    assert sum(compared) <= 12


def test_only_sets_of_like_size_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    band = {i: (0, 1, 5)[i % 3] for i in range(40)}
    members = spark.createDataFrame([(i, 9, b, i) for i, b in band.items()], "id long, component long, band long, label long")
    rows = neardup.block_pairs(members.filter("id >= 20"), members).collect()
    blocks = {}
    for r in rows:
        blocks.setdefault(r.block, {1: [], 2: []})[r.side].append(r.id)
    met = sorted((x, y) for b in blocks.values() for x in b[2] for y in b[1])
    assert met == [(x, y) for x in range(20, 40) for y in range(40) if abs(band[x] - band[y]) <= 1]


def test_repeated_passages(frame, corpus):
    seen, expect = set(), {}
    for i, text in sorted(corpus):
        w = words(text)
        gone = set()
        for j in range(len(w) - 19):
            window = tuple(w[j : j + 20])
            if window in seen:
                gone.update(range(j, j + 20))
            seen.add(window)
        expect[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(frame).collect()}
    assert got == expect


@pytest.mark.parametrize("run, group", [(300, 50), (64, 5)])
def test_trees_in_small_runs(corpus, run, group, monkeypatch):
    """The same marks when a task's memory holds a few suffixes only, large anchors included."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "RUN_SUFFIXES", run)
    monkeypatch.setattr(repeats, "GROUP_SUFFIXES", group)
    base = [f"v{j}" for j in range(60)]
    texts = [" ".join(base[:k] + [f"own{k}"] + base[k:]) for k in range(60)] * 2
    batch = [pa.record_batch([pa.array([i], pa.int64()), pa.array([t])], names=["key", "text"]) for i, t in enumerate(texts)]
    anchors = pa.Table.from_batches(repeats._anchor_rows(20)(batch)).sort_by("anchor").combine_chunks().to_batches()
    places = {}
    for out in repeats._repeated_only(iter(anchors)):
        for r in out.to_pylist():
            places.setdefault(r["key"], []).append(r["place"])
    segments = []
    for i, t in enumerate(texts):
        part = pa.record_batch([pa.array([i], pa.int64()), pa.array([t]), pa.array([places.get(i, [])], pa.list_(pa.int32()))], names=["key", "text", "places"])
        segments += list(repeats._segment_rows(20)([part]))
    table = pa.Table.from_batches(segments).sort_by([("anchor", "ascending"), ("key", "ascending"), ("first", "ascending")])
    marked = set()
    for out in repeats._tree_rows(20)(iter(table.combine_chunks().to_batches())):
        for r in out.to_pylist():
            marked.update((r["key"], r["first"] + k) for k in range(r["n"]))
    seen, expect = set(), set()
    for i, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - 19):
            window = tuple(w[j : j + 20])
            if window in seen:
                expect.add((i, j))
            seen.add(window)
    assert marked == expect


def test_repeated_passages_odd(odd, empty):
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in repeats.remove_repeats(odd).collect())
    # Inside the text the sentence comes four times; null is the smallest id, so the copies under 5 go.
    assert len(got) == 5 and all(g[2] == g[1] for g in got if g[0] == 5)
    assert repeats.remove_repeats(empty).count() == 0


def brute_bytes(corpus, size=400):
    data = [(i, (t or "").encode()) for i, t in corpus]
    count = Counter(b[j : j + size] for _, b in data for j in range(len(b) - size + 1))
    out = {}
    for i, b in data:
        cover = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if count[b[j : j + size]] > 1:
                cover[j : j + size] = b"\1" * size
        spans = sum(1 for j in range(len(b)) if cover[j] and (j == 0 or not cover[j - 1]))
        out[i] = (len(b), sum(cover), spans, sha(bytes(x for x, gone in zip(b, cover) if not gone)))
    return out


@pytest.mark.parametrize("shard", [4 << 20, 2000])
def test_repeated_bytes(frame, corpus, shard, monkeypatch):
    monkeypatch.setattr(bytesdup, "SHARD_BYTES", shard)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bytesdup.remove_repeated_bytes(frame).collect()}
    assert got == brute_bytes(corpus)


def test_repeated_bytes_odd(odd, empty):
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in bytesdup.remove_repeated_bytes(odd).collect()]
    assert len(got) == 5 and all(n == gone for _, n, gone in got)
    assert bytesdup.remove_repeated_bytes(empty).count() == 0


def expected_lines(corpus):
    places = [(i, n, line) for i, t in sorted(corpus) for n, line in enumerate((t or "").split("\n")) if words(line)]
    lines = sorted({line for _, _, line in places})
    sets = {line: {line[j : j + 8] for j in range(max(1, len(line) - 7))} for line in lines}
    groups = Groups(lines)
    for a in lines:
        for b in lines:
            common = len(sets[a] & sets[b])
            if a < b and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                groups.join(a, b)
    seen, gone = set(), set()
    for i, n, line in places:
        if groups.find(line) in seen:
            gone.add((i, n))
        seen.add(groups.find(line))
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in corpus}


@pytest.mark.parametrize("bucket", [32, 4])
def test_lines(frame, corpus, bucket, monkeypatch):
    monkeypatch.setattr(linedup, "SMALL_BUCKET", bucket)
    out = linedup.dedup_lines(frame.withColumn("dropped", frame.size).withColumn("n_lines", frame.size))
    assert {"size", "kept", "key"} <= set(out.columns)
    assert {r.doc_id: r.text for r in out.collect()} == expected_lines(corpus)


def test_lines_odd(odd, empty):
    rows = linedup.dedup_lines(odd).collect()
    assert len(rows) == 5
    assert all(r.text == "" for r in rows if r.doc_id == 5)
    assert sum(r.text is None for r in rows) == 1
    assert linedup.dedup_lines(empty).count() == 0


def test_native_lines(frame):
    """No Python in the plan."""
    plan = linedup.dedup_lines(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def hot_texts(n=70):
    """A passage that all texts share, with each one's own words around it, and some contexts twice."""
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randrange(900)}" for _ in range(150))
    own = [" ".join(f"{rng.randrange(10**6)}" for _ in range(80)) for _ in range(n - 10)]
    return [f"{own[k % (n - 20)]} {passage} {own[(7 * k) % (n - 10)]}" for k in range(n)]


def test_hot_byte_anchor(spark, monkeypatch):
    """Distinct contexts of one passage are not collected in a task."""
    corpus = list(enumerate(hot_texts()))
    monkeypatch.setattr(bytesdup, "SHARD_BYTES", 8000)
    starts = bytesdup.repeated_starts

    def bounded(segments, several, size):
        assert sum(len(s) for s in segments) <= 3 * 8000
        return starts(segments, several, size)

    monkeypatch.setattr(bytesdup, "repeated_starts", bounded)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bytesdup.remove_repeated_bytes(docs).collect()}
    assert got == brute_bytes(corpus)


def expected_passages(corpus):
    """(words, words gone, hash) of each text, in order of id."""
    seen, expect = set(), {}
    for i, text in sorted(corpus):
        w = words(text)
        gone = set()
        for j in range(len(w) - 19):
            window = tuple(w[j : j + 20])
            if window in seen:
                gone.update(range(j, j + 20))
            seen.add(window)
        expect[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return expect


def test_hot_passage_anchor(spark, monkeypatch):
    """Distinct contexts of one passage are not collected in a run."""
    corpus = list(enumerate(hot_texts(400)))
    monkeypatch.setattr(repeats, "RUN_SUFFIXES", 200)
    later = repeats._later_occurrences

    def bounded(codes, begins, counts, size):
        assert sum(counts) <= 3 * 200
        return later(codes, begins, counts, size)

    monkeypatch.setattr(repeats, "_later_occurrences", bounded)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert got == expected_passages(corpus)


def test_line_minima_are_independent(spark):
    """Short lines at similarity 0.8 meet as often as 30 independent minima let them: 0.1 % share no band."""
    rng = random.Random(4)
    rows = []
    for k in range(1500):
        # 25 shingles in the union: 20 of both, 5 of the longer line only.
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(32))
        rows += [(2 * k, line), (2 * k + 1, line[:27])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = {r.name: r.doc_id for r in linedup.exploded_lines(docs).select("doc_id", "name").collect()}
    minima = {names[r.name]: [r[f"m{i}"] for i in range(30)] for r in linedup.signatures(docs).collect()}
    equal = [[x == y for x, y in zip(minima[2 * k], minima[2 * k + 1])] for k in range(1500)]
    assert sum(not any(all(e[b : b + 3]) for b in range(0, 30, 3)) for e in equal) <= 5
    assert all(sum(e) >= linedup.AGREEING for e in equal)


@pytest.fixture(scope="module")
def twins(spark):
    """Ids, null too, with several texts: what is repeated in one is not in the other."""
    rng = random.Random(6)
    shared, *own = (" ".join(f"{rng.randrange(10**6)}" for _ in range(90)) for _ in range(5))
    rows = [(1, shared), (None, shared), (None, own[0]), (7, own[1] + "\n" + shared), (7, own[2] + "\n" + own[3])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_texts_under_one_id(twins):
    rows, docs = twins
    size = {text: (len(words(text)), len(text)) for _, text in rows}
    shared = rows[0][1]
    # Of the shared passage the row without an id keeps its words; bytes go from all three.
    passages = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in repeats.remove_repeats(docs).collect())
    assert passages == sorted((i or 0, size[t][0], 90 if shared in t and i else 0) for i, t in rows)
    strings = sorted((r.doc_id or 0, r.n_bytes, r.n_removed > 0) for r in bytesdup.remove_repeated_bytes(docs).collect())
    assert strings == sorted((i or 0, size[t][1], shared in t) for i, t in rows)


def test_lines_under_one_id(twins):
    rows, docs = twins
    shared = rows[0][1]
    got = sorted((r.doc_id or 0, r.text) for r in linedup.dedup_lines(docs).collect())
    assert got == sorted((i or 0, t.replace("\n" + shared, "").replace(shared, "") if i else t) for i, t in rows)


def test_lines_are_compared_once(frame, monkeypatch):
    """A pair that an earlier round has compared is in no later one, and the sizes of its sets allow the threshold."""
    seen = []
    monkeypatch.setattr(linedup, "SMALL_BUCKET", 2)
    confirm = linedup.confirm

    def kept(pairs, texts):
        out = confirm(pairs, texts)
        sizes = {r["name"]: r["size"] for r in texts.collect()}
        seen.extend((r["name"], r["name2"], sizes[r["name"]], sizes[r["name2"]]) for r in out[1].collect())
        return out

    monkeypatch.setattr(linedup, "confirm", kept)
    linedup.line_classes(frame).collect()
    assert seen and len({s[:2] for s in seen}) == len(seen)
    assert all(100 * min(s[2:]) >= linedup.PERCENT * max(s[2:]) for s in seen)


def test_texts_of_shared_lines_only(spark, frame):
    """Where the names are few, the texts of all other lines are in no shuffle."""
    names = linedup.exploded_lines(frame).select("name").distinct().limit(5).localCheckpoint()
    kept = linedup.lines_of(frame, names)
    assert {r["name"] for r in kept.collect()} == {r["name"] for r in names.collect()}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(name" not in plan


def test_long_line_is_not_copied_for_each_shingle(spark):
    """Shingles of a line of 300,000 characters take time in proportion to it: a copy for each would be 180 GB."""
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300_000))
    docs = spark.createDataFrame([(1, line)], "doc_id long, text string")
    lines = linedup.exploded_lines(docs).select("name", linedup.F.encode("line", "UTF-16BE").alias("coded")).localCheckpoint()
    began = time.monotonic()
    size = linedup.line_texts(lines).first()["size"]
    assert size == len({line[i : i + 8] for i in range(len(line) - 7)}) and time.monotonic() - began < 15
