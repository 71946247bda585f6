"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.llm import components, encoding, fusion, leakage, matching, names, scans, splitting, subjects
from litmill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    # the rule stated asks for trust and time and keeps every claimed tag, so the model has no say: see p1_model
    out = fusion.paper_fusion(table(spark, d, "papers"), table(spark, d, "paper_sources")).survivors(fit=False)
    return out.select("canonical_id", "field_name", "field_value")


def p1_model(spark: SparkSession, d: str) -> DataFrame:
    """The survivors that the quality model alone chooses: single values by posterior, every tag judged true."""
    out = fusion.paper_fusion(table(spark, d, "papers"), table(spark, d, "paper_sources")).survivors(by_trust=False)
    return out.select("canonical_id", "field_name", "field_value", F.round("posterior", 6).alias("posterior"))


def p1_source_quality(spark: SparkSession, d: str) -> DataFrame:
    return fusion.paper_fusion(table(spark, d, "papers"), table(spark, d, "paper_sources")).source_quality()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.canonical_groups(table(spark, d, "papers"), table(spark, d, "duplicate_pairs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, d, "papers"), "paper_id", "documents")
    return pieces.where("piece_no = 1").select("paper_id", "boundary").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "papers"), "paper_id", "documents").drop("boundary")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_papers(table(spark, d, "papers"), table(spark, d, "resolved")).select("paper_id", "result_no").distinct()


def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_papers(table(spark, d, "papers"), table(spark, d, "resolved"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.find_noise(table(spark, d, "papers")).distinct()


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair_texts(table(spark, d, "papers"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_spellings(table(spark, d, "papers"), table(spark, d, "author_registry"))


def p7_links(spark: SparkSession, d: str) -> DataFrame:
    spellings = table(spark, d, "papers").select(F.explode("authors"))
    return names.link_names(spellings, table(spark, d, "author_registry")).select("name", "entity_no", "cost", "tied")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign_subjects(table(spark, d, "documents"), table(spark, d, "subject_areas")).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    found = subjects.assign_subjects(table(spark, d, "documents"), table(spark, d, "subject_areas"))
    return found.groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.sum("share"), 4).alias("weight"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_model, p1_source_quality, p2_found, p4_found, p4_pieces, p5_found, p5_confidence, p6_found, p6_repaired, p7_found, p7_links, p8_ids, p9_found, p9_cleaned, p10_found, p10_composition)
}

_STRIP = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
_WORDS = r"regexp_extract_all(lower(nfc_normalize({0})), '[\p{{L}}\p{{N}}]+')"
_RUNS = "unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' ')))"

SQL: dict[str, str] = {
    "p2_found": f"""
        WITH RECURSIVE k AS (SELECT DISTINCT canonical_id, {_STRIP.format('canonical_id')} AS key FROM papers WHERE canonical_id IS NOT NULL),
        e AS (SELECT DISTINCT {_STRIP.format('paper_a')} AS a, {_STRIP.format('paper_b')} AS b FROM duplicate_pairs), f AS (SELECT a, b FROM e WHERE a <> '' AND b <> '' AND a <> b),
        u AS (SELECT a, b FROM f UNION SELECT b, a FROM f), r AS (SELECT DISTINCT a AS m, a AS reach FROM u UNION SELECT r.m, u.b FROM r JOIN u ON r.reach = u.a),
        g AS (SELECT m, min(reach) AS label FROM r GROUP BY m), x AS (SELECT canonical_id, label FROM k JOIN g ON key = m)
        SELECT canonical_id, min(canonical_id) OVER (PARTITION BY label) AS group_id FROM x QUALIFY count(*) OVER (PARTITION BY label) > 1""",
    "p4_found": r"""
        WITH d AS (SELECT paper_id, documents AS t FROM papers WHERE length(documents) > 1000),
        p AS (SELECT paper_id, t, regexp_replace(t, '\n\s*\n', chr(1), 'g') AS para FROM d), s AS (SELECT *, regexp_replace(para, '([.!?])\s+', '\1' || chr(1), 'g') AS sent FROM p),
        l AS (SELECT paper_id, list_max(list_transform(string_split(para, chr(1)), lambda u: length(regexp_replace(u, '^\s+|\s+$', '', 'g')))) AS np,
            list_max(list_transform(string_split(sent, chr(1)), lambda u: length(regexp_replace(u, '^\s+|\s+$', '', 'g')))) AS ns, list_max(list_transform(regexp_split_to_array(t, '\s+'), lambda u: length(u))) AS nw FROM s)
        SELECT DISTINCT paper_id, CASE WHEN np <= 1000 THEN 'paragraph' WHEN ns <= 1000 THEN 'sentence' WHEN nw <= 1000 THEN 'word' ELSE 'none' END AS boundary FROM l""",
    "p9_found": f"""
        WITH i AS (SELECT DISTINCT item_id, {_RUNS} AS run FROM (SELECT item_id, {_WORDS.format('text')} AS ws FROM eval_items) WHERE len(ws) >= 12),
        d AS (SELECT doc_id, {_RUNS} AS run FROM (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents WHERE text IS NOT NULL) WHERE len(ws) >= 12)
        SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)""",
}
