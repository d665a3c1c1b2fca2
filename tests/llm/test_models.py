"""Operators with trained models: counts by brute force, verdicts by held-out accuracy on separable texts."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.brute import words
from touchtally.llm import language, passages, rules
from touchtally.llm.common import string_buffer, words_of

SYLLABLES = {"en": ["th", "ing", "and", "er", "ou"], "de": ["sch", "ung", "ä", "ich", "pf"], "fr": ["eau", "é", "tion", "qu", "ç"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        lang = rng.choice(list(SYLLABLES))
        text = "\n".join(prose(rng, lang, rng.randrange(12, 40)) + "." for _ in range(rng.randrange(1, 5)))
        good = i % 4 != 0
        if not good:
            text = "\n".join(" ".join(w + "$$$" for w in line.split()) for line in text.split("\n"))
        rows.append((i, text, lang, "s", len(text), int(good)))
    rows += [(900, None, "en", "s", 0, 1), (901, "", "de", "s", 0, 1), (902, "12 34 !!", None, "s", 8, 1), (903, "x " * 20000, "en", "s", 40000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int")
    labels = frame.filter("quality is not null AND doc_id < 900").select("doc_id", "quality").repartition(3)
    return frame.drop("quality").repartition(4).cache(), labels.cache(), {r[0]: r for r in rows}


def test_language(labelled, empty):
    docs, _, rows = labelled
    net = language.learn(docs)
    got = {r.doc_id: r for r in language.identify(docs.withColumnRenamed("n_chars", "score"), net).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum(got[i].lang_pred == rows[i][2] for i in held)
    assert len(held) > 30 and right / len(held) >= 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(empty, net).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.learn(empty)).collect()} == {"und"}


def test_language_ignores_labels_and_batches(labelled):
    docs, _, rows = labelled
    net = language.train(["a", "b"] * 20, [b"abab cdcd", b"xyzz yxyx"] * 20)
    texts = [rows[i][1] for i in range(40)]
    raw, at = string_buffer(pa.array(texts))
    together = language.document_distributions(net, raw, at)
    for i, text in enumerate(texts):
        raw, at = string_buffer(pa.array([text]))
        assert np.allclose(language.document_distributions(net, raw, at)[0], together[i], atol=1e-5)


def test_rule_counts(frame, corpus):
    got = {r.doc_id: r for r in rules.judge(frame, None).collect()}
    for i, text in corpus:
        text, w = text or "", words(text)
        windows = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {k for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in text.split("\n") if words(x)]
        expect = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expect
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert r.kept == (not r.base_failed)  # without labels every line is content


def test_rules_verdict(labelled, empty):
    docs, labels, rows = labelled
    field = rules.learn(docs, labels)
    got = {r.doc_id: r for r in rules.judge(docs, field).collect()}
    judged = [i for i in range(240) if not got[i].base_failed]
    assert sum(got[i].kept == bool(rows[i][5]) for i in judged) >= 0.98 * len(judged)
    assert not got[900].kept and not got[901].kept
    assert rules.judge(empty, field).count() == 0
    assert rules.learn(docs, labels.limit(0)) is None


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    field = rules.LineField(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    first = np.array([0, 1, 6, 6 + 4])
    feats = rng.normal(size=(10, 3))
    got = field.viterbi(feats, first)
    for a, b in zip(first[:-1], first[1:]):
        gain = feats[a:b] @ field.emit
        paths = [[(p >> t) & 1 for t in range(b - a)] for p in range(2 ** (b - a))]
        value = [field.begin[p[0]] + sum(gain[t, s] for t, s in enumerate(p)) + sum(field.step[x, y] for x, y in zip(p, p[1:])) for p in paths]
        assert got[a:b].tolist() == paths[int(np.argmax(value))]


def test_quality(labelled, empty):
    docs, labels, rows = labelled
    model = passages.learn(docs, labels)
    got = {r.doc_id: r for r in passages.score_documents(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == rows[i][5] for i in held) >= 0.95 * len(held)
    assert passages.score_documents(empty, model).count() == 0
    assert {r.score for r in passages.score_documents(docs, passages.learn(docs, labels.limit(0))).collect()} == {0.5}


def test_attention_gradients():
    """Against differences, for one weight of each kind."""
    texts = ["a b c d " * 40, "e f $$$ !! G", "", "h i"]
    raw, at = string_buffer(pa.array(texts))
    bags = passages.bags_of(raw, at, words_of(raw, at))
    model = passages.AttentionScorer()
    model.values = {k: v.astype(np.float64) for k, v in model.values.items()}
    target = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        s = model.forward(bags)["score"]
        return -np.mean(target * np.log(s) + (1 - target) * np.log(1 - s))

    grads = model.gradients(bags, model.forward(bags), target)
    for name, value in model.values.items():
        i = np.unravel_index(np.abs(grads[name]).argmax(), value.shape)
        value[i] += 1e-4
        up = loss()
        value[i] -= 2e-4
        down = loss()
        value[i] += 1e-4
        assert grads[name][i] == pytest.approx((up - down) / 2e-4, rel=2e-3, abs=1e-6), name
