"""Queries opN_<name> over the whole of their tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents; a row for each pair, none for tables that are empty."""
    from .decontam import find_leaks

    return find_leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and near-duplicate component."""
    from .jaccard import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, by a model fitted on rows that aren't held out."""
    from .quality import score, train

    docs = documents(spark, sf_dir)
    return score(docs, train(docs, documents(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without later copies of repeated runs of lines, and how many lines went."""
    from .line_dedup import line_dedup

    return line_dedup(documents(spark, sf_dir)).select("doc_id", "text", "n_deleted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    from .packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40, its slot there, and its shard of 41, by the law `key`."""
    from .sharding import grown, shard_rows, uniform_tree

    tree = uniform_tree(40)
    out = shard_rows(documents(spark, sf_dir), tree, grown(tree, 40))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and a digest of the base matches, and all spans."""
    from .pii import find

    return find(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, by a model fitted on rows that aren't held out."""
    from .toxicity import score, train

    docs = documents(spark, sf_dir)
    return score(docs, train(docs, documents(spark, sf_dir, "labels")))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum of ids, read back from bit-packed files."""
    from .token_file import round_trip

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's exact-duplicate group: which row stays, and the group's size."""
    from .exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

#: Words as the operators take them: A-Z lower-cased, runs outside [\\x20\\x09-\\x0D].
WORDS_SQL = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i + 4], ' ') ELSE array_to_string(ws, ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, links.b FROM r JOIN links ON r.m = links.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""

#: By counting instead of a suffix array: with runs of any length, what goes is every line that stands before, too.
OP4_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, {WORDS_SQL.format("line")} AS ws FROM l),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(ws, ' ') ORDER BY doc_id, pos) AS copy FROM w WHERE len(ws) > 0),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.copy IS NULL) AS text, count(g.copy) AS n FROM l LEFT JOIN (SELECT * FROM k WHERE copy > 1) g USING (doc_id, pos) GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, CAST(coalesce(n, 0) AS INTEGER) AS n_deleted FROM documents d LEFT JOIN kept USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (op1_decontam, op2_jaccard, op3_quality, op4_line_dedup, op5_packing, op6_sharding, op7_pii, op8_toxicity, op9_token_file, op10_exact_dedup)}
ORACLES = {"op2_jaccard": OP2_SQL, "op4_line_dedup": OP4_SQL, "op10_exact_dedup": OP10_SQL}
