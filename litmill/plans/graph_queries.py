"""Queries over citation networks and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.operators import graph as gr
from litmill.plans.catalog import query
from litmill.plans.library_queries import papers
from litmill.session import table


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citation_edges")


CIT = "cit AS (SELECT DISTINCT src, dst FROM citation_edges WHERE src IS NOT NULL AND dst IS NOT NULL), lib AS (SELECT DISTINCT paper_id FROM papers), inl AS (SELECT src, dst FROM cit WHERE src IN (FROM lib) AND dst IN (FROM lib)), own AS (SELECT src, dst FROM cit WHERE src IN (FROM lib)), ext AS (SELECT src, dst FROM cit WHERE dst NOT IN (FROM lib))"


def pairs_sql(name: str, links: str, member: str, shared: str) -> str:
    return f"""{name}_d AS (SELECT {shared} AS s, count(*) AS n FROM {links} GROUP BY 1), {name}_m AS (SELECT l.{shared} AS s, l.{member} AS m, n FROM {links} l JOIN {name}_d ON s = l.{shared}),
 {name}_p AS (SELECT x.m AS a, y.m AS b, count(*) AS weight, count(*) FILTER (x.n <= {gr.HUB}) AS cool FROM {name}_m x JOIN {name}_m y ON x.s = y.s AND x.m < y.m GROUP BY ALL),
 {name} AS (SELECT 'pair' AS kind, a, b, weight FROM {name}_p WHERE cool > 0 UNION ALL SELECT 'hub', m, s, n FROM {name}_m WHERE n > {gr.HUB})"""


COC, COU = pairs_sql("coc", "inl", "dst", "src"), pairs_sql("cou", "own", "src", "dst")


@query(sql=f"WITH {CIT} SELECT * FROM inl")
def citation_graph(spark: SparkSession, d: str) -> DataFrame:
    return gr.in_library(edges(spark, d), papers(spark, d)).select("src", "dst")


@query(sql=f"WITH {CIT} SELECT * FROM ext")
def external_references(spark: SparkSession, d: str) -> DataFrame:
    return gr.external_refs(edges(spark, d), papers(spark, d))


@query(sql=f"WITH {CIT}, {COC} SELECT * FROM coc")
def cocitation(spark: SparkSession, d: str) -> DataFrame:
    return gr.cocitation(edges(spark, d), papers(spark, d))


@query(sql=f"WITH {CIT}, {COU} SELECT * FROM cou")
def coupling(spark: SparkSession, d: str) -> DataFrame:
    return gr.coupling(edges(spark, d), papers(spark, d))


@query(sql=f"WITH nm AS (SELECT DISTINCT paper_id, name FROM (SELECT paper_id, unnest(authors) AS name FROM papers) WHERE name IS NOT NULL AND trim(name) <> ''), {pairs_sql('coa', 'nm', 'name', 'paper_id')} SELECT * FROM coa")
def coauthor(spark: SparkSession, d: str) -> DataFrame:
    return gr.coauthors(papers(spark, d))


# all pairs, those that only hubs make too
COMBINED = """comb AS (SELECT a, b, round(sum(w), 6)::DOUBLE AS weight, max(plain) AS plain FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, 1.0::DOUBLE AS w, 1 AS plain FROM inl WHERE src <> dst
 UNION ALL SELECT a, b, 0.8 + least(2.0, weight * 0.15)::DOUBLE, (cool > 0)::INT FROM coc_p UNION ALL SELECT a, b, 0.7 + least(2.0, weight * 0.12)::DOUBLE, (cool > 0)::INT FROM cou_p) GROUP BY ALL)"""


def combined(spark: SparkSession, d: str) -> DataFrame:
    e, p = edges(spark, d), papers(spark, d)
    return gr.combined(gr.in_library(e, p), gr.cocitation(e, p), gr.coupling(e, p))


@query(sql=f"WITH {CIT}, {COC}, {COU}, {COMBINED} SELECT 'pair' AS kind, a, b, weight FROM comb WHERE plain = 1 UNION ALL SELECT 'hub', a, 'cocitation:' || b, NULL FROM coc WHERE kind = 'hub' UNION ALL SELECT 'hub', a, 'coupling:' || b, NULL FROM cou WHERE kind = 'hub'")
def combined_graph(spark: SparkSession, d: str) -> DataFrame:
    return combined(spark, d)


@query(sql=f"WITH {CIT}, {COC}, {COU}, {COMBINED} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM comb UNION ALL SELECT b FROM comb) GROUP BY 1")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return gr.degrees(combined(spark, d))


@query(sql=f"""WITH {CIT}, {COC}, {COU},
 dc AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM inl UNION ALL SELECT dst FROM inl) GROUP BY 1),
 d1 AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM coc_p UNION ALL SELECT b FROM coc_p) GROUP BY 1),
 d2 AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM cou_p UNION ALL SELECT b FROM cou_p) GROUP BY 1)
SELECT paper_id, title, coalesce(dc.n, 0) AS citation_links, coalesce(d1.n, 0) AS cocitation_links, coalesce(d2.n, 0) AS coupling_links,
 round((2.0 * coalesce(dc.n, 0) + 1.2 * coalesce(d1.n, 0) + 1.0 * coalesce(d2.n, 0))::DOUBLE, 3) AS score
FROM papers LEFT JOIN dc ON dc.node = paper_id LEFT JOIN d1 ON d1.node = paper_id LEFT JOIN d2 ON d2.node = paper_id WHERE NOT coalesce(in_reading_list, false) ORDER BY score DESC, paper_id LIMIT 10""")
def unread_recs(spark: SparkSession, d: str) -> DataFrame:
    e, p = edges(spark, d), papers(spark, d)
    cit = gr.in_library(e, p)
    return gr.unread(p, cit, gr.cocited_at(cit), gr.coupled_at(e, p))


@query(sql=f"""WITH {CIT}, nmd AS (SELECT ext.src, ext.dst, coalesce(title, 'Unknown') AS t FROM ext JOIN papers ON paper_id = ext.src),
 s AS (SELECT dst, count(DISTINCT src) AS support_count FROM nmd GROUP BY 1 HAVING count(DISTINCT src) >= 2),
 r AS (SELECT s.*, i.title AS rt, coalesce(pub_year, 0) AS y, coalesce(citation_count, 0) AS c FROM s LEFT JOIN external_ref_info i ON i.ref_id = s.dst),
 t AS (SELECT *, round((2.5 * support_count + least(3.0, ln(1 + greatest(0, c))) + CASE WHEN y >= 2018 THEN 0.4 ELSE 0.0 END)::DOUBLE, 4) AS score FROM r ORDER BY score DESC, support_count DESC, dst LIMIT 12),
 f AS (SELECT dst, t, row_number() OVER (PARTITION BY dst ORDER BY lower(t), src) AS rn FROM nmd WHERE dst IN (SELECT dst FROM t)),
 l AS (SELECT dst, list(t ORDER BY rn) AS sup FROM f WHERE rn <= 6 GROUP BY 1)
SELECT t.dst AS paper_id, coalesce(rt, t.dst) AS title, score, support_count, array_to_string(sup, '|') AS supporting_titles,
 array_to_string([sup[1] || ' -> ' || coalesce(rt, t.dst) || ' <- ' || sup[2]] || CASE WHEN len(sup) > 2 THEN [sup[1] || ' -> ' || coalesce(rt, t.dst) || ' <- ' || sup[3]] ELSE [] END
  || CASE WHEN len(sup) > 3 THEN [sup[1] || ' -> ' || coalesce(rt, t.dst) || ' <- ' || sup[4]] WHEN len(sup) = 3 THEN [sup[2] || ' -> ' || coalesce(rt, t.dst) || ' <- ' || sup[3]] ELSE [] END, '|') AS path_examples
FROM t JOIN l USING (dst)""")
def missing_recs(spark: SparkSession, d: str) -> DataFrame:
    e, p = edges(spark, d), papers(spark, d)
    return gr.missing(gr.external_refs(e, p), table(spark, d, "external_ref_info"), p)


@query(sql=f"WITH {CIT} SELECT nodes, edges, round((edges / (nodes * (nodes - 1)))::DOUBLE, 8) AS density FROM (SELECT (SELECT count(*) FROM lib) AS nodes, (SELECT count(*) FROM inl) AS edges)")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    return gr.statistics(p.select("paper_id").distinct(), gr.in_library(edges(spark, d), p))


@query()
def bridges(spark: SparkSession, d: str) -> DataFrame:
    return gr.bridges(combined(spark, d))
