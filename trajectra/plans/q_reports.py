"""Registered queries: scanning texts into lines, sections, facts and messages.

On the driver's tables the texts are ``documents``; each document plays the
part of one report file (path = doc_id).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trajectra.operators import compare as CM
from trajectra.operators import panel as P
from trajectra.plans.panels import table
from trajectra.plans.registry import query
from trajectra.sources import reports as RP

SHORT_HEADING = r"^\s*\S+(\s+\S+){0,3}\s*$"          # a line of at most four words
LICENSE_PHRASES = ["MIT License", "Apache License", "GNU General Public License", "CC BY"]
LICENSE_RE = P.any_pattern(LICENSE_PHRASES)
PAIR_RE = r"([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*\"?([^\"\s,;]+)"

LINES_SQL = """WITH lines AS (
  SELECT CAST(doc_id AS VARCHAR) AS path, CAST(generate_subscripts(parts, 1) AS INTEGER) AS line_no,
         unnest(parts) AS line
  FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS parts FROM documents) d)
"""


def doc_lines(spark, sf):
    return RP.lines_of(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query("s3_scan_lines", sql=LINES_SQL + "SELECT path, line_no, line FROM lines")
def s3_scan_lines(spark, sf):
    """Whole texts to (path, line_no, line)."""
    return doc_lines(spark, sf)


@query("s6_fill_section", sql=LINES_SQL + f"""
SELECT path, line_no,
       last_value(CASE WHEN regexp_matches(line, '{SHORT_HEADING}') THEN trim(line) END IGNORE NULLS)
         OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
FROM lines""")
def s6_fill_section(spark, sf):
    """Carry the last heading-like line (at most four words) down each text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    s = RP.lines_with_sections(docs, "doc_id", "text", {"section": (SHORT_HEADING, 0, None)})
    return s.select("path", "line_no", "section")


@query("s4_extract_pairs", sql=LINES_SQL + f"""
SELECT path, line_no, CAST(generate_subscripts(names, 1) AS INTEGER) AS pair_no, unnest(names) AS name, unnest(vals) AS value
FROM (SELECT path, line_no, regexp_extract_all(line, '{PAIR_RE}', 1) AS names, regexp_extract_all(line, '{PAIR_RE}', 2) AS vals FROM lines) x
WHERE len(names) > 0""")
def s4_extract_pairs(spark, sf):
    """Every name/value fact of lines that hold name = value or name: value."""
    return RP.extract_pairs(doc_lines(spark, sf), PAIR_RE)


@query("s8_extract_messages", sql=LINES_SQL + """
SELECT path, line_no, trim(line) AS text, regexp_matches(line, '""" + P.any_pattern(RP.RELEVANT_WARNINGS) + """') AS relevant
FROM lines WHERE regexp_matches(line, '(?i)licen[cs]e') OR regexp_matches(line, '""" + P.any_pattern(RP.RELEVANT_WARNINGS) + """')""")
def s8_extract_messages(spark, sf):
    """Message lines (here: license notices) with their line numbers and relevance flag."""
    m = RP.extract_messages(doc_lines(spark, sf), RP.RELEVANT_WARNINGS, r"(?i)licen[cs]e")
    return m.select("path", "line_no", "text", "relevant")


@query("f4_keep_match_any", sql=LINES_SQL + f"""
SELECT path, line_no, line FROM lines WHERE regexp_matches(line, '{LICENSE_RE}')""")
def f4_keep_match_any(spark, sf):
    """Lines matching any phrase of a list (one alternation)."""
    return P.keep_match_any(doc_lines(spark, sf), "line", LICENSE_PHRASES)


OPENINGS = 6                # words of the phrases: how every benchmark text begins
OPENING_RE = r"^(\S+(\s+\S+){5})"


@query("f4_keep_match_list", sql=LINES_SQL + f""",
p AS (SELECT DISTINCT regexp_extract(text, '{OPENING_RE}', 1) AS phrase FROM benchmark WHERE text IS NOT NULL)
SELECT path, line_no, line FROM lines WHERE EXISTS (SELECT 1 FROM p WHERE phrase <> '' AND contains(line, phrase))""")
def f4_keep_match_list(spark, sf):
    """Lines that hold any phrase of a long list: the first six words of every benchmark text, each found by its rarest word."""
    phrases = table(spark, sf, "benchmark").select(F.regexp_extract("text", OPENING_RE, 1).alias("phrase")).distinct()
    return P.keep_match_list(doc_lines(spark, sf), "line", phrases)


@query("a1_collapse_text", sql=LINES_SQL + """
SELECT path, string_agg(trim(line), ',' ORDER BY line_no) AS notices
FROM lines WHERE regexp_matches(line, '(?i)licen[cs]e') GROUP BY path""")
def a1_collapse_text(spark, sf):
    """Per text, its notice lines collapsed in line order, comma separated."""
    ls = doc_lines(spark, sf).where(F.col("line").rlike(r"(?i)licen[cs]e")).withColumn("t", F.trim("line"))
    return CM.collapse_text(ls, ["path"], "t", "line_no", ",", "notices")


@query("j5_flag_distinct", sql=LINES_SQL + f"""
, d AS (SELECT DISTINCT line FROM lines)
SELECT l.path, l.line_no, f.flag FROM lines l
LEFT JOIN (SELECT line, regexp_matches(line, '{LICENSE_RE}') AS flag FROM d) f ON l.line = f.line""")
def j5_flag_distinct(spark, sf):
    """A regex flag computed once per distinct line and joined back to every line."""
    d = RP.flag_distinct(doc_lines(spark, sf), "line", F.col("line").rlike(LICENSE_RE), "flag")
    return d.select("path", "line_no", "flag")
