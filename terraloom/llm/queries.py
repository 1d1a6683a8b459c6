"""The queries that this subpackage registers, each an operator applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraloom.llm import bpe, chat, language, line_dedup, mpeg, near_join, packing, secret_scan, spelling, substring_dedup, token_counts, topk, vector_codes
from terraloom.llm.common import table


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_de_bruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op3_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.classes(table(spark, sf_dir, "documents"))


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(turns.unionByName(chat.probe_conversation(spark))))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.evaluated(table(spark, sf_dir, "documents"))


def op8_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.digests(table(spark, sf_dir, "documents"))


def op9_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_aho_corasick_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_filtering_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_de_bruijn_dedup": op2_de_bruijn_dedup,
    "op3_lsh_forest_join": op3_lsh_forest_join,
    "op4_chat_windows": op4_chat_windows,
    "op5_line_dedup": op5_line_dedup,
    "op6_sum_of_squares_packing": op6_sum_of_squares_packing,
    "op7_language_id": op7_language_id,
    "op8_mpeg_media": op8_mpeg_media,
    "op9_mtree_top_k": op9_mtree_top_k,
    "op10_token_counts": op10_token_counts,
    "op11_aho_corasick_halves": op11_aho_corasick_halves,
    "op12_filtering_lloyd_codes": op12_filtering_lloyd_codes,
    "op13_secret_scan": op13_secret_scan,
}



def _lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd rounds spelled out, each with all distances."""

    def nearest(k: int) -> str:
        return f"""n{k} AS MATERIALIZED (
            SELECT x.id, x.p, min(CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * {entries} + b.e) AS de
            FROM x JOIN b{k} b USING (p) GROUP BY ALL
        )"""

    def means(k: int) -> str:
        return f"""b{k + 1} AS MATERIALIZED (
            SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (
                SELECT p, e, list(v ORDER BY j) AS v FROM (
                    SELECT p, de % {entries} AS e, j, CAST(floor(sum(v[j]) / count(*)) AS BIGINT) AS v
                    FROM n{k} JOIN x USING (id, p), LATERAL (SELECT unnest(generate_series(1, len(v))) AS j) GROUP BY ALL
                ) GROUP BY ALL
            ) m USING (p, e)
        )"""

    ctes = [f"""k AS MATERIALIZED (
            SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda c: CAST(floor({vector_codes.SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), x AS MATERIALIZED (
            SELECT id, vec_id, p, v[len(v) // {parts} * p + 1:len(v) // {parts} * (p + 1)] AS v FROM k, (SELECT unnest(generate_series(0, {parts - 1})) AS p)
        ), b0 AS MATERIALIZED (
            SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS BIGINT) AS e, v
            FROM x WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries})
        )"""]  # fmt: skip
    ctes += [f"{nearest(k)}, {means(k)}" for k in range(rounds)] + [nearest(rounds)]
    return f"""
        WITH {", ".join(ctes)}, h AS (
            SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}
        ), c AS (
            SELECT id, string_agg(format('{{:02x}}', de % {entries}), '' ORDER BY p) AS code, CAST(sum(de // {entries}) AS BIGINT) AS error FROM n{rounds} GROUP BY id
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (id), h
    """


ORACLE_SQL: dict[str, str] = {
    "op2_de_bruijn_dedup": """
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), k AS (
            SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS i, w FROM w WHERE len(w) >= 13
        ), k2 AS (
            SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS kmer FROM k
        ), f AS (
            SELECT kmer, min(doc_id) AS first FROM k2 GROUP BY kmer
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM k2 JOIN f USING (kmer) WHERE first < doc_id
        ), x AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w WHERE len(w) > 0
        ), r AS (
            SELECT x.doc_id, count(*) AS n_words, count(gone.i) AS n_removed,
                sha256(coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
            FROM x LEFT JOIN gone USING (doc_id, i) GROUP BY x.doc_id
        )
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
        FROM w LEFT JOIN r USING (doc_id)
    """,
    "op5_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
            FROM documents
        ), k AS (
            SELECT doc_id, i, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ), r AS (
            SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r.key IS NOT NULL AND doc_id <> last) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (r.key IS NULL OR doc_id = last), '')) AS kept_sha256
        FROM k LEFT JOIN r USING (key) GROUP BY doc_id
    """,
    "op9_mtree_top_k": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        ), p AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op11_aho_corasick_halves": """
        WITH RECURSIVE crc AS MATERIALIZED (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t
        ), run AS MATERIALIZED (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL
        ), bytes AS (
            SELECT run, n, hex(encode(concat(doc_id, ':', run))) AS x FROM run WHERE length(run) >= 7
        ), sums AS (
            SELECT run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda k: CAST('0x' || substr(x, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT)),
                lambda c, b: xor(t[CAST(xor(c, b) % 256 + 1 AS BIGINT)], c // 256), 4294967295), 4294967295) AS h
            FROM bytes, crc
        ), words AS MATERIALIZED (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
                SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM sums
            ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
        ), without AS MATERIALIZED (
            SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, LATERAL (SELECT unnest(generate_series(1, length(word))) AS i)
        ), near AS MATERIALIZED (
            SELECT a.word, b.word AS other FROM without a JOIN without b USING (i, rest) WHERE a.word <> b.word
            UNION SELECT w.word, rest FROM without w JOIN words o ON o.word = rest
            UNION SELECT rest, w.word FROM without w JOIN words o ON o.word = rest
        ), best AS (
            SELECT near.word, count(*) AS n_near, min({'minus': -o.n, 'other': other}) AS best FROM near JOIN words o ON o.word = other GROUP BY near.word
        ), forms AS MATERIALIZED (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.minus >= 10 * n THEN best.other END AS form, CASE WHEN -best.minus >= 10 * n THEN -best.minus END AS form_n
            FROM words LEFT JOIN best USING (word)
        ), chain AS (
            SELECT word, word AS root, form FROM forms
            UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.form
        )
        SELECT word, forms.form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM chain WHERE form IS NULL) USING (word)
    """,
    "op12_filtering_lloyd_codes": _lloyd_sql(),
}
