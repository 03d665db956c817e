"""One query per operator over the given tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwatch.llm import (
    bpe,
    exactdup,
    langid,
    lexical,
    licences,
    neardup,
    packing,
    quality,
    secrets,
    suffixtree,
    surrogates,
    topk,
    vectorcode,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL counterpart if there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """
WITH sound AS (
  SELECT ROW_NUMBER() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS cells
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(q.cells, c.cells) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.r <> c.r
  WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20"""
)
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by integer inner product for every twentieth row."""
    return topk.search_embeddings(table(spark, sf_dir, "embeddings"))


@query(
    r"""
WITH clean AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, MIN(doc_id) OVER (PARTITION BY t) AS keep_id, COUNT(*) OVER (PARTITION BY t) AS group_size,
       doc_id = MIN(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM clean"""
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document that stays for its text."""
    return exactdup.exact_duplicates(table(spark, sf_dir, "documents"))


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes that they decode to, as digests."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    documents = table(spark, sf_dir, "documents")
    return bpe.encode(documents, ranks, public_tokenizers.PATTERN, digests=True)


@query()
def op3_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of near-duplicates that it belongs to."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated quality score of every document."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.languages(table(spark, sf_dir, "documents"))


@query()
def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability scores of every document, by token shares and by the suffix tree."""
    return suffixtree.corpus_scores(table(spark, sf_dir, "documents"))


@query()
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in the documents with the verdict of the forest."""
    return secrets.scan(table(spark, sf_dir, "documents"))


@query()
def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced by surrogates."""
    return surrogates.with_surrogates(table(spark, sf_dir, "documents"), "surrogate-key")


def _codebook_rounds(parts: int, entries: int, rounds: int) -> str:
    """SQL of the rounds of `vectorcode`, one pair of tables for each."""
    nearest = """
a{i} AS (
  SELECT r, part, cells, entry, gap FROM (
    SELECT p.r, p.part, p.cells, b.entry, list_sum(list_transform(list_zip(p.cells, b.cells), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS gap,
           ROW_NUMBER() OVER (PARTITION BY p.r, p.part ORDER BY gap, b.entry) AS nth
    FROM parts p JOIN b{i} b ON p.part = b.part)
  WHERE nth = 1)"""
    moved = """
s{i} AS (
  SELECT part, entry, place, CAST(SUM(x) AS BIGINT) AS s, COUNT(*) AS n FROM (
    SELECT part, entry, unnest(cells) AS x, unnest(range(len(cells))) AS place FROM a{i}) GROUP BY ALL),
m{i} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS cells FROM s{i} GROUP BY ALL),
b{j} AS (SELECT b.part, b.entry, coalesce(m.cells, b.cells) AS cells FROM b{i} b LEFT JOIN m{i} m USING (part, entry))"""
    steps = [nearest.format(i=i) + "," + moved.format(i=i, j=i + 1) for i in range(rounds)]
    return f"""
WITH kept AS (
  SELECT ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS cells
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT r, part, cells[part * len(cells) // {parts} + 1 : (part + 1) * len(cells) // {parts}] AS cells
  FROM kept, (SELECT unnest(range({parts})) AS part)),
b0 AS (SELECT part, r AS entry, cells FROM parts WHERE r < {entries}),{",".join(steps)},{nearest.format(i=rounds)},
codes AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(SUM(gap) AS BIGINT) AS error
  FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(cells, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM codes JOIN kept USING (r)"""


@query(_codebook_rounds(16, 64, 2))
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code under codebooks of its parts, with its error."""
    return vectorcode.vector_codes(table(spark, sf_dir, "embeddings"))


@query(
    r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
numbered AS (SELECT ROW_NUMBER() OVER () AS d, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM lowered WHERE len(terms) > 0),
totals AS (SELECT COUNT(*) AS docs, CAST(SUM(n) AS BIGINT) AS tokens FROM numbered),
tf AS (SELECT d, term, COUNT(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM numbered) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS w
  FROM tf, totals GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, d, doc_id, CAST(SUM(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // tokens)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN numbered USING (d), totals
  GROUP BY item_id, d, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10"""
)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every item of the benchmark."""
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op13_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document names."""
    return licences.scan(table(spark, sf_dir, "documents"))
