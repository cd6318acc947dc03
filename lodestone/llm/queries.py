"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bestfit, codes, embdup, lm, mixing, packing, pii, quality, simhash, substring, topk, toxicity, trie
from lodestone.llm._common import read


def tokenizer_path() -> str:
    """Where the public word-level vocabulary is; it is read in place, never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer_path() -> str:
    """Where the public byte-level vocabulary is."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost-balanced packing of all documents into sequences of 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every hundredth vector with all others."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document by context mixing."""
    return lm.score(read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a factorisation machine."""
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, digest and spans."""
    return pii.digest(pii.scan(read(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes of every document."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_embdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of every embedding."""
    return embdup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the units that an earlier one holds."""
    return substring.dedup(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by positive-unlabelled learning."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every embedding by codebooks of 4 x 256 entries, with errors."""
    return codes.compress(read(spark, sf_dir, "embeddings"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all rebuilt conversations."""
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op13_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents into sequences of 2048 tokens."""
    return bestfit.pack(read(spark, sf_dir, "documents"), byte_tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_topk": op2_topk,
    "op3_lm": op3_lm,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_embdup": op8_embdup,
    "op9_substring": op9_substring,
    "op10_toxicity": op10_toxicity,
    "op11_codes": op11_codes,
    "op12_trie": op12_trie,
    "op13_bestfit": op13_bestfit,
}

def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """SQL of op11: a round is a pair of tables, assignments and entries."""
    near = """a{n} AS (
            SELECT p.vec_id, p.label, p.part, b.entry, b.d AS error, p.x FROM p, LATERAL (
                SELECT entry, CAST(list_sum(list_transform(list_zip(p.x, k.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM k{n} AS k WHERE k.part = p.part
                ORDER BY d, entry LIMIT 1) AS b
        )"""
    move = """m{n} AS (
            SELECT part, entry, list(CAST(s - ((s % c) + c) % c AS BIGINT) // c ORDER BY pos) AS x FROM (
                SELECT part, entry, pos, CAST(sum(x[pos]) AS BIGINT) AS s, count(*) AS c FROM a{n}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS pos) GROUP BY part, entry, pos)
            GROUP BY part, entry
        ), k{next} AS (SELECT k.part, k.entry, coalesce(m.x, k.x) AS x FROM k{n} AS k LEFT JOIN m{n} AS m USING (part, entry))"""
    steps = ", ".join(f"{near.format(n=n)}, {move.format(n=n, next=n + 1)}" for n in range(rounds))
    return f"""
        WITH v AS (
            SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: CAST(floor(x * 1024.0) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT vec_id, label, part, e[part * (len(e) // {parts}) + 1:(part + 1) * (len(e) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS part)
        ), k0 AS (
            SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < {entries}
        ), {steps}, {near.format(n=rounds)},
        h AS (SELECT sha256(string_agg(c, ',' ORDER BY part, entry)) AS h FROM (SELECT part, entry, array_to_string(x, ',') AS c FROM k{rounds})),
        r AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.h AS codebooks_sha256 FROM r, h
    """


#: CRC-32 of `conv_id` as text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))))"""

ORACLE_SQL: dict[str, str] = {
    "op12_trie": f"""
        WITH t0 AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), t AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM t0
        ), c AS (
            SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)
        ), r AS (
            SELECT c.conv_id, 1 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE pos >= h
            UNION ALL SELECT c.conv_id, 0, pos, role, text FROM c JOIN t ON t.conv_id = c.base WHERE pos < h
        ), s AS (
            SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, pos) FILTER (part IS NOT NULL), []) AS seq FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id
        ), n AS (
            SELECT conv_id, d, len(seq) = d AS ends, CASE WHEN d > 0 THEN length(seq[d].text) ELSE 0 END AS chars, md5(d || CAST(to_json(seq[1:d]) AS VARCHAR)) AS k,
                CASE WHEN d > 0 THEN md5((d - 1) || CAST(to_json(seq[1:d - 1]) AS VARCHAR)) END AS up FROM s, LATERAL (SELECT unnest(range(len(seq) + 1)) AS d)
        ), g AS (
            SELECT k, any_value(up) AS up, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS own,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM n GROUP BY k
        ), kids AS (
            SELECT up AS k, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up
        ), w AS (
            SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN kids USING (k)
        ), sub AS (
            SELECT n.k, count(*) FILTER (w.n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM w JOIN n ON n.conv_id = w.conv_id AND n.d <= w.depth GROUP BY n.k
        )
        SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256 FROM w JOIN sub USING (k) LEFT JOIN g AS p ON p.k = w.up
    """,
    "op11_codes": _codes_sql(),
    "op2_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(floor(x * 1024.0) AS BIGINT)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op8_embdup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e, coalesce(embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0, false) AS ok FROM embeddings
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.ok AND b.ok AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95
        ), r AS (
            SELECT vec_id AS node, vec_id AS root FROM v
            UNION
            SELECT l.b, r.root FROM r JOIN l ON r.node = l.a
        ), c AS (
            SELECT node, min(root) AS component_id FROM r GROUP BY node
        ), n AS (
            SELECT a, count(*) AS n FROM l GROUP BY a
        )
        SELECT c.node AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.node = c.component_id AS kept
        FROM c LEFT JOIN n ON n.a = c.node
    """,
}
