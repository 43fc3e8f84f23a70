"""Queries over the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, exact_dedup, hamming_index, html_extract, merkle, ngram_join, packing, pii, quality, substring_dedup, token_counts, url_filter
from .common import table


#: Whoever runs the pipeline sets a key of their own.
PII_KEY = "sparkward"


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "n_entities")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filtered(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_itemset_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_index.nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_harmonic_packing,
        op2_tree_bpe,
        op3_html_crf,
        op4_pii_surrogates,
        op5_substring_dedup,
        op6_ngram_join,
        op7_token_counts,
        op8_exact_dedup,
        op9_url_rules,
        op10_quality_rules,
        op11_itemset_phrases,
        op12_merkle_manifest,
        op13_hamming_search,
    )
}

#: Levels of 16 for which the SQL below has steps: 16 ** 6 rows of a source, and as many sources.
LEVELS = 6


def merkle_sql() -> str:
    """Level by level, with the digests to either side by windows over the runs of 16."""
    side = lambda frame: f"coalesce(string_agg(h, '') OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN {frame}), '')"
    left, right = side("UNBOUNDED PRECEDING AND 1 PRECEDING"), side("1 FOLLOWING AND UNBOUNDED FOLLOWING")

    def tree(x: str) -> str:
        parts = []
        for k in range(LEVELS):
            parts.append(f"{x}s{k} AS (SELECT tree, i, h, n, {left} AS l, {right} AS r FROM {x}{k})")
            up = "CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END"
            parts.append(f"{x}{k + 1} AS (SELECT tree, i // 16 AS i, {up} AS h, (any_value(n) + 15) // 16 AS n FROM {x}{k} GROUP BY tree, i // 16)")
        return ", ".join(parts)

    def climb(x: str, rows: str, at: str, to: str) -> str:
        """Adds each level's siblings to the proof and folds the digest, up to the root of tree `at` (on which rows of `rows` are joined)."""
        parts, last = [], rows
        for k in range(LEVELS):
            fold = "CASE WHEN s.n = 1 THEN d.fold ELSE sha256(s.l || d.fold || s.r) END"
            parts.append(
                f"{to}{k} AS (SELECT d.* EXCLUDE (i, proof, fold), d.i // 16 AS i, d.proof || s.l || s.r AS proof, {fold} AS fold "
                f"FROM {last} d JOIN {x}s{k} s ON s.tree IS NOT DISTINCT FROM d.{at} AND s.i = d.i)"
            )
            last = f"{to}{k}"
        return ", ".join(parts)

    field = lambda c, how: f"coalesce(strlen({how}) || ':' || {how}, '-')"
    fields = lambda text: " || ".join([field(c, f"({c})::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars")] + [field("text", text)])
    bits = "flatten(list_transform(range(length(doc_id::VARCHAR)), lambda k: list_transform(range(8), lambda b: (ascii(substr(doc_id::VARCHAR, k + 1, 1)) >> b) & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH leaves AS (
            SELECT doc_id, source, sha256({fields("text")}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({fields(lower)}) END AS changed FROM documents
        ),
        docs AS (
            SELECT doc_id, source, leaf, row_number() OVER w - 1 AS i, '' AS proof, coalesce(changed, leaf) AS fold
            FROM leaves WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)
        ),
        a0 AS (SELECT source AS tree, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM docs),
        {tree("a")},
        b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM a{LEVELS}),
        places AS (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place FROM a{LEVELS}),
        {tree("b")},
        {climb("a", "docs", "source", "up")},
        over AS (
            SELECT d.doc_id, d.leaf, p.subroot, 0 AS top, p.place AS i, d.proof, d.fold
            FROM up{LEVELS - 1} d JOIN places p ON p.source IS NOT DISTINCT FROM d.source
        ),
        {climb("b", "over", "top", "out")}
        SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified
        FROM out{LEVELS - 1}, b{LEVELS}
    """


ORACLE_SQL: dict[str, str] = {
    "op11_itemset_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece
            FROM documents
        ),
        split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces),
        runs AS (SELECT lang, ws, k, unnest(range(1, length(ws) - k + 2)) AS i FROM split, (SELECT unnest([1, 2, 3, 4]) AS k)),
        f AS (SELECT lang, ws[i : i + k - 1] AS p, count(*) AS n FROM runs GROUP BY ALL),
        cand AS (SELECT lang, p, n AS a FROM f WHERE length(p) > 1 AND n >= 30),
        cuts AS (SELECT *, unnest(range(1, length(p))) AS k FROM cand),
        sides AS (
            SELECT c.lang, c.p, c.a, c.k, x.n AS l, y.n AS r, (2000000::HUGEINT * c.a) // (x.n + y.n) AS score
            FROM cuts c
            JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : c.k]
            JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1 :]
        ),
        best AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        covers AS (
            SELECT lang, p[i : i + k - 1] AS p, max(a) AS most
            FROM (SELECT lang, p, a, k, unnest(range(1, length(p) - k + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS k) WHERE k < length(p))
            GROUP BY ALL
        ),
        open AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN covers v ON v.lang = b.lang AND v.p = b.p WHERE v.most IS NULL OR 100 * v.most < 80 * b.a),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM open),
        total AS (SELECT lang, sum(length(ws))::BIGINT AS n FROM split GROUP BY lang)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM placed JOIN total USING (lang) WHERE rank <= 2000
    """,
    "op12_merkle_manifest": merkle_sql(),
    "op8_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256
        FROM t
        WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
}
