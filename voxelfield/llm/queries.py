"""Queries that apply the operators to the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelfield.llm import (
    bpe_monoid,
    cuckoo,
    hmm,
    langid,
    length_histogram,
    merkle_log,
    minhash_bayes,
    mixing,
    pii,
    ranked_search,
    sp_encoding,
    spotsigs,
    warc,
)

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.tiktoken"
MULTI = "byte_bpe_multi_50k.tiktoken"
CRAWLED = "2024-01-01T00:00:00Z"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_spotsigs(spark: SparkSession, sf: str) -> DataFrame:
    return spotsigs.fingerprints_with_next(read(spark, sf, "documents"))


def op2_warc_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    source = warc.responses(read(spark, sf, "pages"), CRAWLED)
    return warc.derivatives(source)


def op3_pii_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest_columns(pii.find_personal_data(read(spark, sf, "documents")))


def op4_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf, "documents"))


def op5_cuckoo_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return cuckoo.exact_duplicates(read(spark, sf, "documents"))


def op6_nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(read(spark, sf, "documents"))


def op7_hidden_markov(spark: SparkSession, sf: str) -> DataFrame:
    return hmm.score_documents(read(spark, sf, "documents"))


def op8_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    documents = read(spark, sf, "documents")
    return sp_encoding.digest_columns(sp_encoding.encode_documents(documents, public_tokenizers.path(PIECES), ["doc_id"]))


def op9_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    lengths = length_histogram.encoded_lengths(
        read(spark, sf, "documents"), public_tokenizers.path(BYTES), public_tokenizers.PATTERN, ["source"]
    )
    return length_histogram.suffix_sums(length_histogram.histogram(lengths, ["source"]), ["source"])


def op10_minhash_bayes(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_bayes.near_duplicates(read(spark, sf, "documents"))


def op11_merkle_log(spark: SparkSession, sf: str) -> DataFrame:
    return merkle_log.manifest(read(spark, sf, "documents")).drop("siblings")


def op12_bpe_monoid(spark: SparkSession, sf: str) -> DataFrame:
    documents = read(spark, sf, "documents")
    return bpe_monoid.digest_columns(
        bpe_monoid.encode_documents(documents, public_tokenizers.path(MULTI), public_tokenizers.PATTERN, ["doc_id"])
    )


def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search.search(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_spotsigs, op2_warc_derivatives, op3_pii_bootstrap, op4_mix_sources, op5_cuckoo_dedup, op6_nearest_centroid,
        op7_hidden_markov, op8_sentencepiece, op9_length_histogram, op10_minhash_bayes, op11_merkle_log,
        op12_bpe_monoid, op13_ranked_search,
    )
}

ORACLE: dict[str, str] = {
    "op5_cuckoo_dedup": """
        WITH d AS (
            SELECT doc_id,
                   sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op10_minhash_bayes": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS shingle
            FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_sides AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id),
        links AS (
            SELECT x, y FROM both_sides JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
            WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
        reach(origin, node) AS (
            SELECT doc_id, doc_id FROM d UNION SELECT r.origin, l.y FROM reach r JOIN links l ON l.x = r.node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id
        JOIN (SELECT origin, min(node) AS component_id FROM reach GROUP BY origin) r ON r.origin = d.doc_id
    """,
    # The low bit of a CRC-32 is worked out byte by byte; DuckDB has no such function.
    "op11_merkle_log": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, n_chars, text, lang,
                   list_reduce(
                       list_prepend(4294967295::BIGINT, [unicode(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
                       lambda crc, b: list_reduce(
                           list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) & 1 = 1 AS touched
            FROM documents),
        f AS (
            SELECT *,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
            FROM d),
        leaves AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   CASE WHEN touched THEN sha256(head || coalesce(
                       strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered,
                   coalesce('s' || source, '-') AS tree,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i,
                   count(*) OVER (PARTITION BY source) AS n, row_number() OVER (ORDER BY doc_id, source, text) AS row_no
            FROM f),
        lv(tree, k, j, node, n) AS (
            SELECT tree, 0, i, leaf, n FROM leaves
            UNION ALL
            SELECT tree, k + 1, j // 3, sha256(string_agg(node, '' ORDER BY j)), (n + 2) // 3 FROM lv WHERE n > 1 GROUP BY tree, k, j // 3, n),
        subroots AS (
            SELECT tree, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
        tops(tree, k, j, node, n) AS (
            SELECT '', 0, i, node, n FROM subroots
            UNION ALL
            SELECT '', k + 1, j // 3, sha256(string_agg(node, '' ORDER BY j)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY k, j // 3, n),
        runs AS (
            SELECT tree, k, j // 3 AS q, coalesce(max(node) FILTER (j % 3 = 0), '') AS a, coalesce(max(node) FILTER (j % 3 = 1), '') AS b,
                   coalesce(max(node) FILTER (j % 3 = 2), '') AS c, any_value(n) AS n
            FROM (SELECT * FROM lv UNION ALL SELECT * FROM tops) GROUP BY tree, k, j // 3),
        up(row_no, tree, k, j, node, proof, n) AS (
            SELECT row_no, tree, 0, i, coalesce(tampered, leaf), '', n FROM leaves
            UNION ALL
            SELECT row_no, u.tree, u.k + 1, j // 3,
                   sha256(CASE j % 3 WHEN 0 THEN node || b || c WHEN 1 THEN a || node || c ELSE a || b || node END),
                   proof || CASE j % 3 WHEN 0 THEN b || c WHEN 1 THEN a || c ELSE a || b END, (u.n + 2) // 3
            FROM up u JOIN runs r ON r.tree = u.tree AND r.k = u.k AND r.q = u.j // 3 WHERE u.n > 1),
        top_up(row_no, k, j, node, proof, n) AS (
            SELECT row_no, 0, s.i, u.node, u.proof, s.n FROM up u JOIN subroots s ON s.tree = u.tree WHERE u.n = 1
            UNION ALL
            SELECT row_no, u.k + 1, j // 3,
                   sha256(CASE j % 3 WHEN 0 THEN node || b || c WHEN 1 THEN a || node || c ELSE a || b || node END),
                   proof || CASE j % 3 WHEN 0 THEN b || c WHEN 1 THEN a || c ELSE a || b END, (u.n + 2) // 3
            FROM top_up u JOIN runs r ON r.tree = '' AND r.k = u.k AND r.q = u.j // 3 WHERE u.n > 1)
        SELECT l.doc_id, l.i AS source_index, l.n AS source_size, l.leaf, s.node AS subroot, t.node AS root,
               sha256(p.proof) AS proof_sha256, p.node AS folded_root, p.node = t.node AS verified
        FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN top_up p ON p.row_no = l.row_no AND p.n = 1
        CROSS JOIN (SELECT node FROM tops WHERE n = 1) t
    """,
    "op13_ranked_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
            FROM documents),
        q AS (
            SELECT DISTINCT query, item_id, unnest(words) AS term FROM (
                SELECT row_number() OVER () AS query, item_id, regexp_extract_all(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
                FROM benchmark)),
        totals AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS length FROM d WHERE len(words) > 0),
        p AS (
            SELECT row_no, doc_id, n, term, count(*) AS tf
            FROM (SELECT row_no, doc_id, len(words) AS n, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q)
            GROUP BY ALL),
        w AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM p GROUP BY term) CROSS JOIN totals),
        scored AS (
            SELECT query, item_id, doc_id, row_no,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))))::BIGINT AS score
            FROM q JOIN p USING (term) JOIN w USING (term) CROSS JOIN totals
            GROUP BY query, item_id, doc_id, row_no)
        SELECT item_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0
        QUALIFY rank <= 50
    """,
}
