"""Queries of the training-data operators over the whole test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostlake.llm import exact_dedup, fingerprints, html_extraction, mixing, packing, pii, quality, simhash, substring_dedup, toxicity
from frostlake.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    in_test = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 0, F.lit(False))
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"), learn=~in_test("id"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", in_test("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Target shares of tokens by language.
MIX = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    model = mixing.classifier(docs, labelled, list(MIX))
    rated = mixing.copies(mixing.rates(mixing.posteriors(docs, model), list(MIX.values())))
    return rated.select(F.col("id").alias("doc_id"), "tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(MIX)], "rate", "copies")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    graded = quality.grade(docs, quality.fitted(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    return graded.select("row.doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("selected"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then how many spans there are, how many of the kinds that the method adds, and the best score."""
    found = pii.find(table(spark, sf_dir, "documents"))
    base = tuple(k.name for k in pii.BASE)
    counts = [F.expr(f"size(filter(spans, z -> z.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts, F.sha2(F.encode(pii.told(F.col("spans"), base), "UTF-8"), 256).alias("base_sha256"), pii.told(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), F.expr(f"size(filter(spans, z -> z.rank >= {len(base)}))").cast("long").alias("n_added"), F.expr("coalesce(array_max(transform(spans, z -> z.score)), 0D)").alias("score"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.vocabulary())


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_html_extraction": op3_html_extraction,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_fingerprints": op10_fingerprints,
}

#: DuckDB's patterns take the same blanks. Of the kinds of personal data that the operator adds to the base, account numbers
#: and numbers of insured persons are not in the test tables, so that they are left out there.
ORACLES = {
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS seq FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
        f AS (SELECT seq, min(doc_id) AS least FROM s GROUP BY seq),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM s JOIN f USING (seq) WHERE least < doc_id)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
                 FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op7_pii": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        k(kind, rank, p, own, near, gain) AS (VALUES ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 0.9::DOUBLE, 'mail|contact', 0.1::DOUBLE), ('ip', 1, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', 0.6, '\bip\b|address|host|server', 0.3),
            ('card', 2, '[0-9](?:[\x20-]?[0-9])+', 0.8, 'card|visa|credit|payment', 0.2), ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]', 0.6, 'phone|tel|call|mobile', 0.3),
            ('secret', 6, '[A-Za-z0-9_-]{20,}', 0.3, 'token|secret|api.?key|access.?key|passw|bearer|credential', 0.5)),
        m AS (SELECT doc_id, kind, rank, own, near, gain, regexp_extract_all(t, p) AS m, string_split_regex(t, p) AS g FROM t, k WHERE regexp_matches(t, p)),
        u AS (SELECT doc_id, kind, rank, own, near, gain, unnest(m) AS m, unnest(g[1:len(m)]) AS g, unnest(range(1, len(m) + 1)) AS i FROM m),
        s AS (SELECT doc_id, kind, rank, own, near, gain, m, regexp_replace(m, '[^0-9]', '', 'g') AS d,
                     CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(m) AS BIGINT) AS a FROM u),
        c AS (SELECT *, a + length(m) AS e FROM s WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN length(d) BETWEEN 10 AND 15
                  WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: coalesce(TRY_CAST(x AS INT), 999) > 255)) = 0
                  WHEN 'secret' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND len(list_distinct(string_split(m, ''))) >= 9
                  ELSE length(d) BETWEEN 14 AND 19 AND list_sum([CASE WHEN j % 2 = 1 THEN CAST(d[-j] AS INT) WHEN CAST(d[-j] AS INT) > 4 THEN 2 * CAST(d[-j] AS INT) - 9 ELSE 2 * CAST(d[-j] AS INT) END FOR j IN range(1, length(d) + 1)]) % 10 = 0 END),
        v AS (SELECT doc_id, kind, rank, a, e, least(1.0::DOUBLE, own + CASE WHEN regexp_matches(lower(substring(t, greatest(1, a + 1 - 48), least(48, a)) || ' ' || substring(t, e + 1, 48)), near) THEN gain ELSE 0.0 END) AS score
              FROM c JOIN t USING (doc_id)),
        r AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
                     string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank) FILTER (rank < 4) AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank) AS spans,
                     count(*) AS n_spans, count(*) FILTER (rank >= 4) AS n_added, max(score) AS score FROM v WHERE score >= 0.5 GROUP BY doc_id)
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans, coalesce(n_added, 0) AS n_added, coalesce(score, 0.0) AS score
        FROM t LEFT JOIN r USING (doc_id)
    """,
    "op8_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)
    """,
}
