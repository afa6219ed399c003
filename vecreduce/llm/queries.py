"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (decontaminate, exact_dedup, html_extract, language_id, lexical_search, mixing, packing, pii, simhash,
               token_alignment, token_counts, toxicity, url_filter)
from .common import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's size and target in words: the part of the mix that SQL can express."""
    sizes = table(spark, sf_dir, "documents").select("source", mixing.size_of(F.col("text")).alias("size"))
    return mixing.targets(sizes)


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.verdicts(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    base = [k.name for k in pii.KINDS if k.base]
    every = F.concat(*[F.col(k.name) for k in pii.KINDS])
    return found.select(F.col("id").alias("doc_id"),
                        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
                        F.sha2(pii.listed(*map(F.col, base)), 256).alias("base_sha256"),
                        pii.listed(every).alias("spans"), F.size(every).cast("long").alias("n_spans"),
                        F.array_max(F.transform(every, lambda s: s.score)).alias("top_score"))


def _remainder(key: str, of: int):
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn_from=_remainder("id", 4) != 2)
    return toxicity.scored(docs, model).select(
        F.col("id").alias("doc_id"), F.coalesce(_remainder("id", 4) == 2, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and of its lines: how many, the most in one, and a digest of all."""
    found = token_counts.counted(table(spark, sf_dir, "documents"))
    lines = F.transform("sections", lambda s: F.concat_ws(
        ":", s.start.cast("string"), s.end.cast("string"), s.tokens.cast("string")))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.size("sections").cast("long").alias("n_lines"),
                        F.array_max(F.transform("sections", lambda s: s.tokens)).alias("longest_line_tokens"),
                        F.sha2(F.array_join(lines, ","), 256).alias("lines_sha256"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extracted(table(spark, sf_dir, "pages"), keep=("url",))
    return found.select(F.col("id").alias("page_id"), "url", "text",
                        F.char_length("text").cast("long").alias("n_chars"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, learn_from=_remainder("id", 5) != 0)
    return language_id.predicted(docs, model).select(
        F.col("id").alias("doc_id"), F.coalesce(_remainder("id", 5) == 0, F.lit(False)).alias("held_out"),
        "lang_pred", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit",
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"),
                        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
                        F.col("component_id"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.encoded(table(spark, sf_dir, "documents"))
    found = packing.placed(pieces.withColumn("ids_crc32", F.crc32("tokens")).drop("tokens"))
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.aligned(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    kept = saved(found.withColumn("groups_sha256", digest).drop("groups"), "alignment")
    return token_alignment.with_pair_counts(kept).withColumnRenamed("id", "doc_id")


def _pii_sql() -> str:
    """Matches and the pieces between them for each kind; starts are sums of their lengths."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (f"list_sum(list_transform(range(1, len({digits}) + 1), lambda i: "
            f"(CAST(substr(reverse({digits}), i, 1) AS INT) * (1 + (i - 1) % 2)) - "
            f"CASE WHEN CAST(substr(reverse({digits}), i, 1) AS INT) * (1 + (i - 1) % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0")
    account = "substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4)"
    mod97 = (f"list_reduce(list_concat([0], list_transform(range(1, len({account}) + 1), lambda i: ord(substr({account}, i, 1)))), "
             "lambda r, c: CASE WHEN c < 58 THEN (r * 10 + c - 48) % 97 ELSE (r * 100 + c - 55) % 97 END) = 1")
    credential = "token|secret|passw|credential|bearer|authori|[ _-]key|key ?[:=]"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", "mail|contact|write to", 0.8, 0.2, 0),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 "
         "AND CAST('0' || right(p, 3) AS INT) <= 255))", "host|server|address|login", 0.6, 0.3, 0),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({digits}) BETWEEN 13 AND 19 AND {luhn}",
         "card|visa|credit|payment", 0.7, 0.3, 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15",
         "phone|tel|call|mobile|fax", 0.6, 0.3, 0),
        ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", mod97, "iban|account|bank", 0.8, 0.2, 0.5),
        ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
         "substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 5, 2) <> '00' "
         "AND substr(m, 8) <> '0000'", "ssn|social security", 0.3, 0.4, 0.5),
        ("key", r"\b(?:A[KS]IA[A-Z0-9]{16}\b|gh[pousr]_[A-Za-z0-9]{36,200}|xox[abprs]-[A-Za-z0-9-]{10,200}"
         r"|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,200})"
         r"|-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----[^-]*(?:-----END (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----)?",
         "regexp_matches(m, '[0-9]|PRIVATE KEY')", credential, 0.8, 0.2, 0.5),
        ("secret", r"\b[A-Za-z0-9_]{20,200}\b",
         "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') "
         "AND len(list_distinct(regexp_extract_all(m, '.'))) >= 8", credential, 0.3, 0.4, 0.5)]
    parts = ["WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"]
    near = "substr(text, greatest(s - 40, 0) + 1, least(s, 40)) || ' ' || substr(text, s + length(m) + 1, 20)"
    for name, pattern, check, context, prior, boost, least in kinds:
        parts.append(f"""
        {name}_m AS (SELECT doc_id, text, found, pieces, unnest(range(1, len(found) + 1)) AS k
                  FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS found,
                               string_split_regex(text, '{pattern}') AS pieces FROM d) WHERE len(found) > 0),
        {name}_s AS (SELECT doc_id, '{name}' AS kind, s, s + length(m) AS e,
                         round(CAST({prior} AS DOUBLE) + CASE WHEN regexp_matches(lower({near}), '{context}')
                               THEN CAST({boost} AS DOUBLE) ELSE 0 END, 2) AS score
                  FROM (SELECT doc_id, text, found[k] AS m,
                               CAST(list_sum(list_transform(pieces[1:k], lambda x: length(x)))
                                    + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s
                        FROM {name}_m) WHERE {check} AND score >= {least})""")
    every = " UNION ALL ".join(f"SELECT *, {i} AS o FROM {name}_s" for i, (name, *_) in enumerate(kinds))
    parts.append(f"""
        spans AS (SELECT doc_id, o, s, kind, kind || ':' || s || ':' || e AS span, score FROM ({every})),
        listed AS (SELECT doc_id, string_agg(span, ',' ORDER BY o, s) AS spans,
                          string_agg(span, ',' ORDER BY o, s) FILTER (o < 4) AS base,
                          {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in kinds[:4])}
                   , count(*) AS n_spans, max(score) AS top_score
                   FROM spans GROUP BY doc_id)""")
    return ",".join(parts) + f"""
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in kinds[:4])},
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
               coalesce(n_spans, 0) AS n_spans, top_score
        FROM d LEFT JOIN listed USING (doc_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_mix_sources, op3_url_filter, op4_pii, op5_toxicity, op6_token_counts, op7_html_extract,
        op8_language_id, op9_decontaminate, op10_simhash_dedup, op11_lexical_search, op12_best_fit_packing,
        op13_token_alignment, mixing_targets)}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY norm)""",
    "mixing_targets": r"""
        WITH RECURSIVE d AS (
            SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS bound,
                     [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
              FROM d GROUP BY source),
        shared AS (
            SELECT 0 AS step, *, false AS stopped, 1.5::DOUBLE * sum(source_size) OVER () / sum(weight) OVER () AS level
            FROM s
            UNION ALL
            SELECT step + 1, source, source_size, bound, weight, above,
                   (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(bound) FILTER (above) OVER (), 0))
                   / sum(weight) FILTER (NOT above) OVER ()
            FROM (SELECT *, stopped OR weight * level > bound AS above FROM shared)
            WHERE step < (SELECT count(*) FROM s))
        SELECT source, source_size, CASE WHEN stopped THEN bound ELSE weight * level END AS target
        FROM shared WHERE step = (SELECT max(step) FROM shared)""",
    "op3_url_filter": """
        WITH u AS (SELECT page_id,
                          translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(h, p, verdict))
        SELECT page_id, any_value(host) AS host, any_value(path) AS path,
               arg_max(h || p, length(h || p)) AS rule,
               coalesce(arg_max(verdict, length(h || p)), 'allow') AS verdict
        FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        GROUP BY page_id""",
    "op4_pii": _pii_sql(),
    "op9_decontaminate": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        item_windows AS (
            SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS run
            FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
                  FROM (SELECT *, least(10, len(w)) AS k FROM items WHERE len(w) > 0))),
        doc_windows AS (
            SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS run
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
                  FROM words, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k)),
        found AS (SELECT doc_id, k, i, item_id FROM doc_windows JOIN item_windows USING (k, run)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found
                        WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op11_lexical_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        corpus AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
        asked AS (
            SELECT DISTINCT i, item_id, term
            FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
        times AS (
            SELECT r, doc_id, n, term, count(*) AS tf
            FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) SEMI JOIN asked USING (term)
            GROUP BY ALL),
        weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
            FROM (SELECT term, count(*) AS df FROM times GROUP BY term), corpus),
        gains AS (
            SELECT r, doc_id, term, weight * ((1000000000 * tf)
                   // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS gain
            FROM times JOIN weights USING (term), corpus),
        scored AS (
            SELECT i, item_id, r, doc_id, CAST(sum(gain) AS BIGINT) AS score
            FROM asked JOIN gains USING (term) GROUP BY ALL HAVING sum(gain) > 0)
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored)
        WHERE rank <= 10""",
}
