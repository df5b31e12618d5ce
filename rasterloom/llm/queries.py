"""Queries opN_<name> of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import divergence, exact_dedup, extraction, near_dedup, packing, pieces, prefix_trie, quality, repetition, suffix_tree, syncmers, urls, warc
from rasterloom.llm.common import table


def tokenizer_path(name: str) -> str:
    """A file of the folder RASTERLOOM_TOKENIZERS, or of the installed package public_tokenizers."""
    if folder := os.environ.get("RASTERLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


#: Entries of the URL filter: host, start of the path, action.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, action string"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op11_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judged(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def _repetition_sql() -> str:
    """Base and method of op11 in SQL: words numbered, n-grams as lists, windows over their places."""
    words = "SELECT k, p, w, length(w) AS n FROM (SELECT k, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM d)"
    parts, columns = [], []
    for n in sorted({*repetition.MOST_TOP, *repetition.MOST_DUPLICATED}):
        gram = "md5(" + " || ' ' || ".join(["w", *[f"lead(w, {j}) OVER s" for j in range(1, n)]]) + ")"
        chars = " + ".join(["n", *[f"lead(n, {j}) OVER s" for j in range(1, n)]])
        parts.append(f"g{n} AS MATERIALIZED (SELECT k, p, n, {gram} AS g, {chars} AS c FROM w WINDOW s AS (PARTITION BY k ORDER BY p))")
        parts.append(f"f{n} AS (SELECT k, g, count(*) AS f, min(c) AS c, min(p) AS p FROM g{n} WHERE g IS NOT NULL GROUP BY k, g HAVING count(*) > 1)")
        wanted = f"SELECT k, g FROM f{n}"
        if n in repetition.MOST_TOP:
            wanted = f"SELECT k, g FROM f{n} QUALIFY row_number() OVER (PARTITION BY k ORDER BY f DESC, c DESC, p) = 1"
        inside = f"SELECT g{n}.k, n, max(CASE WHEN t.g IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY g{n}.k ORDER BY p ROWS {n - 1} PRECEDING) AS inside FROM g{n} LEFT JOIN ({wanted}) t ON g{n}.k = t.k AND g{n}.g = t.g"
        name = f"top_{n}_chars" if n in repetition.MOST_TOP else f"dup_{n}_chars"
        parts.append(f"c{n} AS (SELECT k, CAST(sum(n * inside) AS BIGINT) AS {name}, CAST(sum(inside) AS BIGINT) AS words{n} FROM ({inside}) GROUP BY k)")
        columns.append(name)
    lines = r"SELECT k, row_number() OVER (PARTITION BY k, line ORDER BY p) AS nth, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS n FROM (SELECT k, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM (SELECT k, string_split(text, chr(10)) AS ls FROM d)) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')"
    shares = [("dup_line_chars", repetition.MOST_LINE_CHARS, "word_chars", "line_chars")]
    shares += [(f"top_{n}_chars", most, "word_chars", f"top_{n}") for n, most in repetition.MOST_TOP.items()] + [(f"dup_{n}_chars", most, "word_chars", f"dup_{n}") for n, most in repetition.MOST_DUPLICATED.items()]
    broken = "CASE WHEN base_failed THEN 'base' " + " ".join(f"WHEN {part} * 100 > {whole} * {most} THEN '{name}'" for part, most, whole, name in shares) + " END"
    counts = ", ".join(f"coalesce({c}, 0) AS {c}" for c in columns)
    joins = " ".join(f"LEFT JOIN c{c.split('_')[1]} USING (k)" for c in columns)
    return rf"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        w AS MATERIALIZED ({words}), {', '.join(parts)},
        l AS (SELECT k, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines, CAST(sum(CASE WHEN nth > 1 THEN n ELSE 0 END) AS BIGINT) AS dup_line_chars FROM ({lines}) GROUP BY k),
        m AS (SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(words5, 0) AS n_repeat_words, {counts} FROM d LEFT JOIN l USING (k) {joins}),
        b AS (SELECT *, n_words < {repetition.LEAST_WORDS} OR n_repeat_words * 100 > n_words * {repetition.BASE_PERCENT} AS base_failed FROM m)
        SELECT *, {broken} AS broken, {broken} IS NULL AS kept FROM b
    """


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_url_filter": op2_url_filter,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_extraction": op4_extraction,
    "op5_fingerprints": op5_fingerprints,
    "op6_quality": op6_quality,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_near_dedup": op8_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_warc": op10_warc,
    "op11_repetition": op11_repetition,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_divergence": op13_divergence,
}

ORACLES: dict[str, str] = {
    "op13_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        ), w AS (
            SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), kept AS MATERIALIZED (
            SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 3
        ), l AS (
            SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang
        ), c AS MATERIALIZED (
            SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
        ), g AS (
            SELECT lang, source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN (SELECT lang, v FROM l) USING (lang)
        ), p AS MATERIALIZED (
            SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT // (g.n + g.v) AS p, 1 + 1000000000 * (kept.total + 1)::HUGEINT // (l.n + l.v) AS q
            FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
        ), pair AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ), every_row AS (
            SELECT lang, source, 'pair' AS part, item, value FROM pair
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every_row QUALIFY part = 'pair' OR rank <= 200
    """,
    "op12_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), k AS (
            SELECT c, c - c % 100 AS b, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
                lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 6 AS h
            FROM (SELECT c, count(*) AS n FROM t GROUP BY c)
        ), r AS (
            SELECT k.c, pos AS d, role, text FROM k JOIN t ON t.c = k.b AND pos <= h
            UNION ALL SELECT k.c, pos - k.h + least(k.h, coalesce(base.n, 0)), role, text FROM k JOIN t USING (c) LEFT JOIN k base ON base.c = k.b WHERE pos > k.h
        ), p AS (
            SELECT c, d, length(text) AS size, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS key FROM r
            UNION ALL SELECT c, 0, 0, '' FROM k
        ), n AS (
            SELECT key, d, min(c) AS owner, count(*) AS n_convs, min(size) AS size FROM p GROUP BY key, d
        ), f AS (
            SELECT n.key, count(child.key) AS n_children FROM n LEFT JOIN n child ON child.d = n.d + 1 AND substr(child.key, 1, 32 * n.d) = n.key GROUP BY n.key
        ), s AS (
            SELECT substr(key, 1, 32 * e) AS key, sum((n_convs - 1) * size) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM n JOIN f USING (key)) GROUP BY 1
        ), l AS (
            SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, key FROM p QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1) GROUP BY key
        )
        SELECT n.owner AS conv_id, n.d AS depth, up.owner AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
        FROM n JOIN f USING (key) JOIN s USING (key) LEFT JOIN l USING (key) LEFT JOIN n up ON n.d > 0 AND up.d = n.d - 1 AND up.key = substr(n.key, 1, 32 * (n.d - 1))
    """,
    "op11_repetition": _repetition_sql(),
    "op2_url_filter": r"""
        WITH r AS (
            SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) v(rhost, rpath, action)
        ), u AS (
            SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
        ), b AS (
            SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
            FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n
        )
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN b USING (n)
    """,
    "op10_warc": r"""
        WITH t AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM t),
        bits AS (SELECT page_id, n, first, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', h[i + 1]) - 1) AS nibbles FROM d),
        digits AS (SELECT page_id, n, first, list_transform(range(0, 32), lambda k: list_sum(list_transform(range(0, 5), lambda j: ((nibbles[1 + (5 * k + j) // 4] >> (3 - (5 * k + j) % 4)) & 1) << (4 - j)))) AS fives FROM bits)
        SELECT page_id, n AS payload_bytes, array_to_string(list_transform(fives, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x::INT + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM digits
    """,
    "op9_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents
        ), g AS (
            SELECT bare, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM t GROUP BY bare
        )
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.bare) AS text_sha256 FROM t JOIN g USING (bare)
    """,
}
