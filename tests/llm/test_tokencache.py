"""Token counts against the libraries, and what the cache saves."""

import json

import pytest
import sentencepiece
from tokenizers import Tokenizer

from touchtally.llm import pieces
from touchtally.llm.tokencache import TokenizerVersion, stored_counts, token_counts

OTHER = pieces.MODEL.replace("piece_bpe_32k.model", "byte_bpe_50k.json")
WORDS = pieces.MODEL.replace("piece_bpe_32k.model", "word_bpe_49k.json")


def counter(path):
    if path.endswith(".model"):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(sp.encode(text))
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def rows_of(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["cached"]) for r in df.collect())


@pytest.mark.parametrize("path", [pieces.MODEL, OTHER, WORDS])
def test_counts(spark, frame, tmp_path, path):
    extra = spark.createDataFrame(
        [(500, "a <s> b </s> <|endoftext|> <unk>"), (501, "x " * 60_000), (502, "\0 ​ é"), (None, "null id"), (None, "another"), (None, "another")],
        "doc_id long, text string",
    )
    docs = frame.unionByName(extra, allowMissingColumns=True)
    count = counter(path)
    expected = sorted((i is not None, i or 0, len((t or "").encode()), count(t or ""), False) for i, t in docs.select("doc_id", "text").collect())
    assert rows_of(token_counts(docs, TokenizerVersion.load(path), str(tmp_path / "cache"))) == expected


def test_only_misses_are_encoded(spark, frame, tmp_path):
    cache, version = str(tmp_path / "cache"), TokenizerVersion.load(pieces.MODEL)
    first = frame.filter("doc_id < 40")
    token_counts(first, version, cache)
    distinct = first.selectExpr("coalesce(text, '') AS t").distinct().count()
    assert stored_counts(spark, cache, version).count() == distinct
    again = token_counts(frame, version, cache)
    seen = {r["t"] for r in first.selectExpr("coalesce(text, '') AS t").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
    assert all(r["cached"] == (texts[r["doc_id"]] in seen) for r in again.collect())
    # A planted count shows that stored ones are taken; another tokenizer doesn't see it.
    held = spark.read.parquet(f"{cache}/tokenizer={version.digest}")
    assert held.count() == held.select("digest").distinct().count() == len(set(texts.values()))
    token_counts(frame, version, cache)
    assert spark.read.parquet(f"{cache}/tokenizer={version.digest}").count() == held.count()
    other = TokenizerVersion.load(OTHER)
    assert other.digest != version.digest and stored_counts(spark, cache, other) is None


def test_stored_counts_are_used(spark, tmp_path):
    cache, version = str(tmp_path / "cache"), TokenizerVersion.load(pieces.MODEL)
    spark.sql("SELECT unhex(sha2('one', 256)) AS digest, 77L AS n_tokens UNION ALL SELECT unhex(sha2('one', 256)), 77L").write.parquet(f"{cache}/tokenizer={version.digest}")
    docs = spark.createDataFrame([(1, "one"), (2, "one"), (3, "two")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["cached"]) for r in token_counts(docs, version, cache).collect()}
    assert got[1] == got[2] == (77, True) and got[3] == (counter(pieces.MODEL)("two"), False)


def test_version_digest(tmp_path):
    text = json.loads(open(OTHER).read())
    changed = tmp_path / "changed.json"
    changed.write_text(json.dumps(text | {"truncation": None}, ensure_ascii=True))
    assert TokenizerVersion.load(str(changed)).digest != TokenizerVersion.load(OTHER).digest


def test_odd_and_empty(spark, odd, empty, tmp_path):
    version = TokenizerVersion.load(pieces.MODEL)
    assert token_counts(empty, version, str(tmp_path / "none")).collect() == []
    got = rows_of(token_counts(odd, version, str(tmp_path / "cache")))
    assert len(got) == odd.count() and [r[3] for r in got if r[2] == 0] == [0, 0]
