import hashlib
import math
from collections import Counter

import corpus_pipeline as P
from tests.llm.brute import words
from tests.llm.test_dedup import expected_components, expected_lines
from tests.llm.test_mix_and_prints import targets_by_hand
from touchtally.llm import pieces


def test_stages(spark, frame, odd, empty, tmp_path):
    columns = P.COLUMNS
    for name, docs in (("corpus", frame.select(*columns)), ("odd", odd), ("empty", empty)):
        counts = [docs.count()]
        for k, (stage, apply) in enumerate(P.STAGES):
            path = str(tmp_path / f"{name}-{k}")
            apply(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
            counts.append(docs.count())
            if k < len(P.STAGES) - 1:
                assert docs.columns == columns
        assert all(r.round_trip for r in docs.select("round_trip").collect())
        if name == "empty":
            assert counts == [0] * 6
        if name == "corpus":
            # Copies go line by line, and then nothing of them is left.
            assert counts[0] > counts[1] > counts[2] >= counts[3] > 0


def mixed_by_hand(rows):
    """(id, copies) of rows (id, source, size): whole copies, and one more up to the target in order of the drawn number."""
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    targets, copies = targets_by_hand(sizes), {}
    for source, total in sizes.items():
        certain = math.floor(targets[source] / total) if total else 0
        rest, upto = targets[source] - certain * total, 0
        drawn = sorted((int(hashlib.md5(f"{i}:mix-1".encode()).hexdigest()[:13], 16), size, i) for i, s, size in rows if s == source)
        for _, size, i in drawn:
            upto += size
            copies[i] = certain + (rest > 0 and 2 * upto - size <= 2 * rest)
    return copies


def test_run(spark, frame, tmp_path):
    """All rows of run() are those of plain Python stages on what language identification keeps."""
    frame.select(*P.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    docs = P.identify_language(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "").collect()
    letters = {r.doc_id for r in frame.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in docs} <= letters
    lang, source = {r.doc_id: r.lang for r in docs}, {r.doc_id: r.source for r in docs}
    before = {r.doc_id: r.text for r in docs}
    lined = {i: t for i, t in expected_lines(list(before.items())).items() if words(t) or t == before[i]}
    assert len(lined) < len(before) and all(words(t) for t in lined.values())
    components = expected_components(list(lined.items()), 5, 80)
    single = {i: t for i, t in lined.items() if components[i][1] == i}
    copies = mixed_by_hand([(i, source[i], len(words(t))) for i, t in single.items()])
    expected = Counter()
    for i, n in copies.items():
        expected[i, lang[i], source[i], hashlib.sha256(single[i].encode()).hexdigest()] += n
    assert Counter((r.doc_id, r.lang, r.source, r.decoded_sha256) for r in got) == +expected
    assert all(r.n_tokens == len(r.ids) for r in got) and pieces.load_pieces().splits


def test_near_copies_go(spark, tmp_path):
    """Documents whose lines are too unlike for line dedup, but which are alike as a whole."""
    base = [f"word{i}" for i in range(120)]
    near = [*base[:60], "changed", *base[61:]]
    # The same words, with the lines cut elsewhere: no line is like another.
    texts = ["\n".join(" ".join(w[k : k + n]) for k in range(0, 120, n)) for w, n in ((base, 24), (near, 15), (base[::-1], 24))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    lined = P.dedup_lines(spark, docs, "")
    assert lined.count() == 3
    assert sorted(r.doc_id for r in P.dedup_documents(spark, lined, "").collect()) == [0, 2]
