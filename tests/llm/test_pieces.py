import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as pb

from touchtally.llm import pieces as P
from touchtally.llm.common import ARROW_BYTES, in_arrow

TEXTS = [
    "", "a", " a", "a ", "  a  b ", "Hello world, hello  world", "naïve café\n\n\tend", "日本語のテキスト", "🦙 llama▁literal ▁", "x" * 300,
    "ab" * 80 + " " * 40 + "é" * 50, "\x00\x01 odd", " ", "   ", "die Übermäßigkeit der ciónmente être",
]


def arrays(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])


@pytest.fixture(scope="module")
def pieces():
    return P.load_pieces()


def test_round_trip(pieces):
    ids, at = P.encode(pieces, *arrays(TEXTS))
    assert [t.decode() for t in P.decode(pieces, ids, at)] == TEXTS


def test_same_as_library_unigram(pieces):
    """The library, given the same pieces and scores as a unigram model, finds the same ids."""
    proto = pb.ModelProto()
    with open(P.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for piece, score in zip(proto.pieces, pieces.score):
        piece.score = float(score)
    library = SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [t for t in TEXTS if "▁" not in t and "\x00" not in t] + ["the therhean is the is esndha reedes ha " * 3]
    ids, at = P.encode(pieces, *arrays(texts))
    for i, text in enumerate(texts):
        ours, theirs = ids[at[i] : at[i + 1]].tolist(), library.encode(text)
        value = lambda found: sum(pieces.unknown_score / 4 if pieces.is_byte[j] else pieces.score[j] for j in found)
        assert ours == theirs or value(ours) == pytest.approx(value(theirs), abs=1e-3), text


def test_trie_finds_every_piece(pieces):
    for i in range(0, len(pieces.score), 7):
        key, state = pieces.data[pieces.at[i] : pieces.at[i + 1]], 0
        if not len(key) or pieces.is_byte[i]:
            continue
        for c in key:
            nxt = pieces.base[state] + c
            assert pieces.check[nxt] == state
            state = nxt
        assert pieces.value[state] == i


def test_frames(spark, pieces):
    rows = [(1, "a b", 5), (2, None, 6), (2, None, 6), (3, "", 7), (None, "é\n", 8)]
    out = P.tokenize(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), pieces).collect()
    assert len(out) == 5 and all(r.round_trip for r in out)
    assert sorted(r.n_tokens for r in out)[:3] == [0, 0, 0]
    assert P.tokenize(spark.createDataFrame([], "doc_id long, text string"), pieces).count() == 0


def test_worker_memory(pieces):
    """A batch of 2 MB of words that hardly repeat takes much less than its edges all at once."""
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(90)) for _ in range(2200)]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in P.token_batches(pieces, batch, "text", []))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts) and peak < 100 << 20


def test_batches_have_a_limit_in_bytes(spark):
    """Long texts come in batches of a few MB, whatever the rows a batch may have."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["size"])

    docs = spark.range(0, 3000, 1, 1).selectExpr("repeat(cast(id as string), 4000) AS text")
    sizes = [r["size"] for r in in_arrow(docs, run, "size long").collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * ARROW_BYTES
