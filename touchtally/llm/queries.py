"""Queries of the corpus operators with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchtally.llm import bytesdup, cws, language, linedup, manifest, mixing, neardup, passages, pieces, repeats, rules, tokencache, whitening
from touchtally.llm.common import new_folder, read_documents, word_count, written


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = written(read_documents(spark, sf_dir).select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    plan = mixing.mix_plan(sized)
    return mixing.apply_mix(sized, plan).select("doc_id", "size", "source_size", "target", "taken")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.edited_likeness(read_documents(spark, sf_dir))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    found = language.identify(docs.select("doc_id", "text"), language.learn(docs))
    return found.select("doc_id", (language.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")



def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenize(read_documents(spark, sf_dir).select("doc_id", "text"), pieces.load_pieces())



def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return rules.judge(docs, rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))



def op9_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    scored = passages.score_documents(docs, passages.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (language.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")



def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_documents(spark, sf_dir), shingle=4)



def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.dedup_lines(read_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))



def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_documents(spark, sf_dir)).drop("kept_text")



def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytesdup.remove_repeated_bytes(read_documents(spark, sf_dir)).drop("kept")



def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``: proofs of all rows, and what a tampered row folds to."""
    return manifest.manifest(read_documents(spark, sf_dir)).drop("position", "tree", "tampered_leaf")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable rows of ``embeddings`` on the four leading components."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_token_counts(spark: SparkSession, sf_dir: str, model: str = pieces.MODEL, cache: str | None = None) -> DataFrame:
    """Tokens of all ``documents``. Without a cache folder a new one is begun, so that a run's work doesn't depend on earlier runs."""
    version = tokencache.TokenizerVersion.load(model)
    counted = tokencache.token_counts(read_documents(spark, sf_dir), version, cache or new_folder(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > tokencache.TOKEN_LIMIT).alias("over_limit"))


LLM_QUERIES = {
    "op5_mix_sources": op5_mix_sources,
    "op10_fingerprints": op10_fingerprints,
    "op1_language_id": op1_language_id,
    "op4_sentencepiece": op4_sentencepiece,
    "op6_quality_rules": op6_quality_rules,
    "op9_quality_score": op9_quality_score,
    "op2_near_duplicates": op2_near_duplicates,
    "op7_line_dedup": op7_line_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_token_counts": op13_token_counts,
}

_OP5 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size::DOUBLE * 3 AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size::DOUBLE) FROM w) - coalesce((SELECT sum(b.cap) FROM w b WHERE b.cap / b.weight < a.cap / a.weight), 0)) /
  (SELECT sum(b.weight) FROM w b WHERE b.cap / b.weight >= a.cap / a.weight) AS level FROM w a),
t AS (SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM l WHERE cap / weight >= level)) AS target FROM l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS certain FROM t),
r AS (SELECT d.doc_id, d.size, f.source, f.source_size, f.target, f.certain, f.target - f.certain * f.source_size AS rest,
  (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':mix-1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r)
SELECT doc_id, size, source_size, target,
  CAST((certain + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c
"""

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS k
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

_OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
f AS (SELECT k, min(struct_pack(a := doc_id, b := i)) AS first FROM p GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM (SELECT p.doc_id, p.i FROM p JOIN f USING (k) WHERE struct_pack(a := p.doc_id, b := p.i) <> first)),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
t AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.j) FILTER (c.j IS NULL) AS kept, count(c.j) AS gone FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.j = u.j GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

# Bytes as pairs of hexadecimal digits.
_OP8 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d)),
m AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p SEMI JOIN m USING (k)),
o AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 400 AS b FROM o GROUP BY doc_id, span),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM s),
t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, (2 * since + 1)::BIGINT, (2 * (a - since))::BIGINT), '' ORDER BY a) AS kept
      FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

_OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(string_split(text, chr(10)), []) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS j FROM d),
o AS (SELECT * FROM u WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
n AS (SELECT line, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM o)),
s AS (SELECT DISTINCT id, substr(line, i, 8) AS k FROM (SELECT id, line, unnest(range(1, greatest(length(line) - 6, 2))) AS i FROM n)),
z AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS m FROM s a JOIN s b ON a.k = b.k AND a.id < b.id GROUP BY a.id, b.id),
l AS (SELECT a, b FROM c JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT id, id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT a AS id, min(b) AS class FROM r GROUP BY a),
f AS (SELECT doc_id, j, row_number() OVER (PARTITION BY class ORDER BY doc_id, j) > 1 AS gone FROM o JOIN n USING (line) JOIN g USING (id)),
t AS (SELECT u.doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY u.j) FILTER (gone IS NOT TRUE) AS kept
      FROM u LEFT JOIN f ON f.doc_id = u.doc_id AND f.j = u.j GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

# The crc32 goes bit by bit over the digits of doc_id.
_OP11 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF} AS head, text,
  list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))) AS crc FROM documents),
e AS (SELECT doc_id, source, sha256(head || {_FIELD.format('text')}) AS leaf, sha256(head || {_FIELD.format("replace(text, chr(10), '')")}) AS other,
  coalesce(xor(crc, 4294967295) % 2 = 0, false) AS bad FROM d),
l AS (SELECT doc_id, source, leaf, CASE WHEN bad THEN other ELSE leaf END AS shown,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS m FROM e),
n(source, lvl, pos, m, h) AS (SELECT source, 0, pos, m, leaf FROM l
  UNION ALL SELECT source, lvl + 1, pos // 3, (m + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM n WHERE m > 1 GROUP BY source, lvl, pos // 3, m),
s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS m FROM n WHERE m = 1),
t(lvl, pos, m, h) AS (SELECT 0, pos, m, h FROM s
  UNION ALL SELECT lvl + 1, pos // 3, (m + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE m > 1 GROUP BY lvl, pos // 3, m),
a AS (SELECT x.source, x.lvl, x.pos, y.pos AS sib, y.h FROM n x JOIN n y ON x.source IS NOT DISTINCT FROM y.source AND x.lvl = y.lvl AND x.pos // 3 = y.pos // 3 WHERE x.m > 1),
b AS (SELECT x.lvl, x.pos, y.pos AS sib, y.h FROM t x JOIN t y ON x.lvl = y.lvl AND x.pos // 3 = y.pos // 3 WHERE x.m > 1),
w(source, leafpos, pos, lvl, m, h) AS (SELECT source, pos, pos, 0, m, shown FROM l
  UNION ALL SELECT w.source, w.leafpos, w.pos // 3, w.lvl + 1, (w.m + 2) // 3, sha256(string_agg(CASE WHEN a.sib = w.pos THEN w.h ELSE a.h END, '' ORDER BY a.sib))
  FROM w JOIN a ON a.source IS NOT DISTINCT FROM w.source AND a.lvl = w.lvl AND a.pos = w.pos GROUP BY w.source, w.leafpos, w.pos, w.lvl, w.m),
v(source, leafpos, pos, lvl, m, h) AS (SELECT w.source, w.leafpos, s.pos, 0, s.m, w.h FROM w JOIN s ON s.source IS NOT DISTINCT FROM w.source WHERE w.m = 1
  UNION ALL SELECT v.source, v.leafpos, v.pos // 3, v.lvl + 1, (v.m + 2) // 3, sha256(string_agg(CASE WHEN b.sib = v.pos THEN v.h ELSE b.h END, '' ORDER BY b.sib))
  FROM v JOIN b ON b.lvl = v.lvl AND b.pos = v.pos GROUP BY v.source, v.leafpos, v.pos, v.lvl, v.m),
g AS (SELECT w.source, w.leafpos, string_agg(a.h, '' ORDER BY a.lvl, a.sib) AS own
  FROM w JOIN a ON a.source IS NOT DISTINCT FROM w.source AND a.lvl = w.lvl AND a.pos = w.pos AND a.sib <> w.pos GROUP BY w.source, w.leafpos),
k AS (SELECT v.source, v.leafpos, string_agg(b.h, '' ORDER BY b.lvl, b.sib) AS top FROM v JOIN b ON b.lvl = v.lvl AND b.pos = v.pos AND b.sib <> v.pos GROUP BY v.source, v.leafpos)
SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM t WHERE m = 1) AS root, sha256(coalesce(g.own, '') || coalesce(k.top, '')) AS proof_sha256,
  v.h AS folded_root, v.h = (SELECT h FROM t WHERE m = 1) AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN v ON v.source IS NOT DISTINCT FROM l.source AND v.leafpos = l.pos AND v.m = 1
LEFT JOIN g ON g.source IS NOT DISTINCT FROM l.source AND g.leafpos = l.pos LEFT JOIN k ON k.source IS NOT DISTINCT FROM l.source AND k.leafpos = l.pos
"""

LLM_ORACLES = {
    "op11_merkle_manifest": _OP11,
    "op2_near_duplicates": _OP2,
    "op3_substring_dedup": _OP3,
    "op5_mix_sources": _OP5,
    "op7_line_dedup": _OP7,
    "op8_suffix_array_dedup": _OP8,
}
