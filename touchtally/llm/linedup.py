"""Fuzzy line dedup by MinHash, with DataFrame functions only.

1. Lines with a word are named by a 64-bit hash (a second hash finds the rare name that two
   texts share; such lines are left alone). Each of a line's 8-character shingles is hashed once,
   and ``BANDS * ROWS`` minima over that hash, times a fixed odd factor and plus a summand
   of each row's own, are the signature. One aggregate keyed by the line's name makes signatures and merges equal
   lines, before the shuffle already.
2. A band of three equal minima puts lines into one bucket: a pair at similarity 0.8 meets
   with probability 0.999. Every line meets its bucket's first. Pairs
   that this has not connected follow: all of a bucket of up to ``SMALL_BUCKET`` lines; in a larger one
   those with ``PIVOTS`` of its lines, and then those of lines outside the bucket's largest component
   with all lines whose signatures agree enough. That last step grows with the square of the lines that stay
   unconnected in one bucket; it caps nothing.
3. Pairs go on whose minima agree as often as a pair at the threshold's do but for five standard deviations, and whose sets'
   sizes allow the threshold. Exact Jaccard similarity on shingle sets confirms them, one row a pair and each pair once.
4. Components of confirmed pairs keep the one line that comes first: smallest doc_id, then line number.

Cases: lines without a word stay; lines shorter than a shingle are one shingle; null text stays null;
a text that loses all its lines becomes empty and its row stays; repeated rows count
as one document: their equal lines stay or go together; other texts under one doc_id are documents
of their own, in order of their hash; null doc_id comes first;
texts of any length are read whole.
Characters are UTF-16 units. An empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchtally.llm.common import WORD, last_table_only, row_keys, with_row_key, written
from touchtally.llm.components import components
from touchtally.sources.checkpoints import broadcast_if_small

SHINGLE = 8
PERCENT = 80
BANDS, ROWS = 10, 3
SMALL_BUCKET = 32
# Shingles that one row of the signature aggregate holds.
PER_ROW = 4
PIVOTS = 4
# Equal minima of 30 that a pair at 0.8 has, five standard deviations below its mean.
AGREEING = 13
# Line names are one long each.
MAX_BROADCAST_NAMES = 1_000_000
# Odd factor and summand of each row's mix of the shingle's hash.
_MIXES = [(r.getrandbits(31) | 1, r.getrandbits(31)) for r in (random.Random(f"line-{i}") for i in range(BANDS * ROWS))]


def exploded_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line and name of every line with a word."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike(WORD)).withColumn("name", F.xxhash64("line"))


def _starts(coded: Column) -> Column:
    """Byte offsets, from 1, of the shingles of a UTF-16 string."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(coded) - (2 * SHINGLE - 1)), F.lit(2))


def signatures(docs: DataFrame) -> DataFrame:
    """name, other (second hash, lowest and highest) and minima of every distinct line."""
    lines = exploded_lines(docs).select(
        "name", F.xxhash64(F.lit("second"), "line").alias("other"), F.encode("line", "UTF-16BE").alias("coded")
    )
    # A row holds several neighbouring shingles, so the aggregate is entered less often; past the end the last one repeats.
    last = F.greatest(F.lit(1), F.length("coded") - (2 * SHINGLE - 1))
    rows = lines.select("name", "other", "coded", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(2 * PER_ROW))).alias("at"))
    places = [F.least(F.col("at") + 2 * k, F.col("last")) for k in range(PER_ROW)]
    hashed = rows.select("name", "other", *[
        F.hash(F.substring(F.col("coded"), place, F.lit(2 * SHINGLE))).cast("long").alias(f"h{k}") for k, place in enumerate(places)
    ])
    hashes = [F.col(f"h{k}") for k in range(PER_ROW)]
    return hashed.groupBy("name").agg(
        F.min("other").alias("other"), F.max("other").alias("other_high"),
        *[F.min(F.least(*[_mixed(h, *mix) for h in hashes]).cast("int")).alias(f"m{i}") for i, mix in enumerate(_MIXES)],
    )


def _mixed(h: Column, factor: int, summand: int) -> Column:
    """31 bits of a 32-bit hash held as long; the product stays below 2**62."""
    return (h * F.lit(factor).cast("long") + F.lit(summand).cast("long")).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))


def _shingles(coded: str) -> Column:
    """Hashes of all shingles of a line, equal ones too.

    The line is a lambda's variable here: a column inside a lambda is read from its row for each shingle, and a read copies the whole line.
    """
    hashes = F.transform(F.array(F.col(coded)), lambda line: F.transform(_starts(line), lambda at: F.xxhash64(F.substring(line, at, F.lit(2 * SHINGLE)))))
    return hashes.getItem(0)


def lines_of(docs: DataFrame, names: DataFrame) -> DataFrame:
    """name and coded of the lines in ``names``, which are few: other lines go before their texts are shuffled."""
    own = exploded_lines(docs).join(broadcast_if_small(names, MAX_BROADCAST_NAMES), "name", "left_semi")
    return own.select("name", F.encode("line", "UTF-16BE").alias("coded"))


def line_texts(lines: DataFrame) -> DataFrame:
    """name, coded and size (of its shingle set) of every distinct line of ``lines``: a line's size is counted once, not once a pair."""
    return lines.dropDuplicates(["name"]).select("name", "coded", F.size(F.array_distinct(_shingles("coded"))).alias("size"))


def _agreeing(a: str, b: str) -> Column:
    equal = [(F.col(f"{a}.m{i}") == F.col(f"{b}.m{i}")).cast("int") for i in range(BANDS * ROWS)]
    total = equal[0]
    for one in equal[1:]:
        total = total + one
    return total


def _likely(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """Pairs (name, name2), each once, whose minima agree often enough for the threshold."""
    left = packed.select("name", F.col("s").alias("a"))
    right = packed.select(F.col("name").alias("name2"), F.col("s").alias("b"))
    both = pairs.select("name", "name2").distinct().join(left, "name").join(right, "name2")
    return both.filter(_agreeing("a", "b") >= AGREEING).select("name", "name2")


def confirm(pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of pairs (name, name2), those whose exact Jaccard similarity reaches the threshold, and all that have been compared.

    A pair is one row with both lines, from ``texts``; their shingles are made in its row, since texts are a tenth of
    their sets in a shuffle. Where the smaller set has too few for the threshold, nothing is compared.
    """
    with last_table_only(pairs.sparkSession):
        pairs = written(pairs, "line-pairs")
        second = texts.select(F.col("name").alias("name2"), F.col("coded").alias("coded2"), F.col("size").alias("size2"))
        both = pairs.join(texts, "name").join(second, "name2")
        both = both.filter(100 * F.least("size", "size2") >= PERCENT * F.greatest("size", "size2"))
        common = F.size(F.array_intersect(_shingles("coded"), _shingles("coded2"))).alias("common")
        # A filter right here would be moved below the sets and make them again; so it reads the written counts.
        counted = written(both.select("name", "name2", common, (F.col("size") + F.col("size2")).alias("sizes")), "line-counts")
    links = counted.filter(100 * F.col("common") >= PERCENT * (F.col("sizes") - F.col("common")))
    return links.select("name", "name2"), counted.select("name", "name2")


def _new(pairs: DataFrame, compared: DataFrame) -> DataFrame:
    """Pairs that no earlier round has compared; a pair that failed once shares buckets in later rounds too."""
    return pairs.join(compared, ["name", "name2"], "left_anti")


def line_classes(docs: DataFrame) -> DataFrame:
    """name and component of every line that is like another; component is the smallest name."""
    bands = F.explode(F.array(*[
        F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)
    ])).alias("bucket")
    minima = [f"m{i}" for i in range(BANDS * ROWS)]
    signed = written(signatures(docs).filter("other = other_high").select("name", *minima), "line-signatures")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = signed.select("name", bands).repartition(parts, "bucket")
    buckets = dealt.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    shared = written(dealt.join(buckets, "bucket").select("bucket", "name", "members"), "line-buckets")
    # From here on only lines that share a bucket are looked at.
    names = written(shared.select("name").distinct(), "line-names")
    packed = written(signed.join(broadcast_if_small(names, MAX_BROADCAST_NAMES), "name", "left_semi").select("name", F.struct(*minima).alias("s")), "line-minima")
    texts = written(line_texts(lines_of(docs, names)), "line-texts")
    heads = shared.groupBy("bucket").agg(F.min("name").alias("head"))
    stars = shared.join(heads, "bucket").filter(F.col("name") > F.col("head")).select(F.col("head").alias("name"), F.col("name").alias("name2"))
    links, compared = confirm(_likely(stars, packed), texts)

    def placed(shared: DataFrame, links: DataFrame) -> DataFrame:
        found = components(links, "name", "name2")
        component = F.coalesce("component", "name").alias("component")
        return written(shared.join(found, shared["name"] == found["node"], "left").select("bucket", "name", "members", component), "line-shared")

    # Lines that the heads have connected need no more pairs.
    shared = placed(shared, links)
    small = shared.filter(F.col("members") <= SMALL_BUCKET)
    other = small.select("bucket", F.col("name").alias("name2"), F.col("component").alias("component2"))
    pairs = small.join(other, "bucket").filter((F.col("name") < F.col("name2")) & (F.col("component") != F.col("component2"))).select("name", "name2")
    large = shared.filter(F.col("members") > SMALL_BUCKET)
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("name", "bucket"), "name")
    pivots = large.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOTS).select(
        "bucket", F.col("name").alias("pivot"), F.col("component").alias("component2")
    )
    more = large.join(pivots, "bucket").filter(F.col("component") != F.col("component2")).select(
        F.least("name", "pivot").alias("name"), F.greatest("name", "pivot").alias("name2")
    )
    found, also = confirm(_new(_likely(pairs.union(more), packed), compared), texts)
    links, compared = links.union(found), compared.union(also)
    if not large.isEmpty():
        large = placed(large.drop("component"), links)
        sizes = large.groupBy("bucket", "component").agg(F.count("*").alias("size"))
        main = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).getField("component").alias("main"), F.count("*").alias("parts"))
        split = large.join(main.filter("parts > 1"), "bucket")
        roaming = split.filter(F.col("component") != F.col("main")).select("bucket", "name", "component").join(packed, "name")
        settled = split.select("bucket", F.col("name").alias("name2"), F.col("component").alias("component2")).join(
            packed.select(F.col("name").alias("name2"), F.col("s").alias("s2")), "name2"
        )
        rest = roaming.join(settled, "bucket").filter(
            (F.col("component") != F.col("component2")) & (_agreeing("s", "s2") >= AGREEING)
        ).select(F.least("name", "name2").alias("name"), F.greatest("name", "name2").alias("name2"))
        links = links.union(confirm(_new(rest.distinct(), compared), texts)[0])
    return components(links, "name", "name2").select(F.col("node").alias("name"), "component")


def line_decisions(docs: DataFrame) -> DataFrame:
    """doc_id and dropped (line numbers) of every document that loses lines, written; other tables made on the way are deleted."""
    with last_table_only(docs.sparkSession):
        return written(_line_decisions(docs), "line-dropped")


def _line_decisions(docs: DataFrame) -> DataFrame:
    with last_table_only(docs.sparkSession):
        classes = written(line_classes(docs), "line-classes")
    own = exploded_lines(docs).select("doc_id", "line_no", "name")
    occurrences = written(own.join(broadcast_if_small(classes, MAX_BROADCAST_NAMES), "name", "left").select(
        "doc_id", "line_no", F.coalesce("component", "name").alias("class")
    ), "line-places")
    # First by document, then by line: two plain minima, so tasks combine them before the shuffle.
    doc = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    firsts = occurrences.groupBy("class").agg(F.min(doc).alias("first_doc"), F.count("*").alias("places")).filter("places > 1")
    firsts = written(firsts, "line-firsts")
    hosts = occurrences.join(firsts, "class").withColumn("doc", doc)
    hosts = written(hosts, "line-hosts")
    line = hosts.filter(F.col("doc") == F.col("first_doc")).groupBy("class").agg(F.min("line_no").alias("first_line"))
    gone = hosts.join(line, "class").filter((F.col("doc") != F.col("first_doc")) | (F.col("line_no") != F.col("first_line")))
    return gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("dropped"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with their kept lines as ``text``, and n_lines and n_removed."""
    keyed = with_row_key(docs.drop("n_lines", "n_removed"), row_keys(docs))
    decided = line_decisions(keyed.select(F.col("_key").alias("doc_id"), "text"))
    dropped = decided.select(F.col("doc_id").alias("_key"), F.col("dropped").alias("_dropped"))
    joined = keyed.join(dropped, "_key", "left").drop("_key")
    lines = F.split("text", "\n")
    kept = F.array_join(
        F.transform(F.filter(F.arrays_zip(lines.alias("line"), F.sequence(F.lit(0), F.size(lines) - 1).alias("no")),
                             lambda x: ~F.array_contains(F.col("_dropped"), x["no"])), lambda x: x["line"]), "\n")
    return (
        joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_removed", F.coalesce(F.size("_dropped"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(kept)).drop("_dropped")
    )
