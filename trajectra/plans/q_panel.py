"""Registered queries: panel verbs (W1, V*, P*, F*, D*, O*, U*, W2, W3, W6) and description."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajectra.functions import columns as C
from trajectra.operators import describe as D
from trajectra.operators import panel as P
from trajectra.plans.panels import PANEL_E_SQL, PANEL_P_SQL, cells, cells_sql, panel_e, panel_p, table, wide_p, y_cols
from trajectra.plans.registry import query

R = 4  # decimals kept for computed doubles in both twins


def _r(c, d=R):
    return F.round(c, d) + F.lit(0.0)   # + 0.0 turns a rounded -0.0 into 0.0


# ------------------------------------------------------------------ W1, P1, P2

@query("w1_visit_number", sql="WITH" + PANEL_P_SQL + " SELECT subject, wave, y FROM panel_p")
def w1_visit_number(spark, sf):
    """Visit number within subject on panel P, all visits (one exchange)."""
    return panel_p(spark, sf).select("subject", "wave", "y")


@query("w1_visit_number_events", sql="WITH" + PANEL_E_SQL + " SELECT subject, outcome, wave, y FROM panel_e")
def w1_visit_number_events(spark, sf):
    """Visit number within (user, event type) on panel E."""
    return panel_e(spark, sf)


@query("p1_p2_derived_time", sql="WITH" + PANEL_P_SQL + """
SELECT subject, wave, CAST(wave * wave AS DOUBLE) AS wave_sq,
       y - first_value(y) OVER (PARTITION BY subject ORDER BY wave) AS y_change,
       CAST(date_diff('day', min(order_date) OVER (PARTITION BY subject), order_date) AS BIGINT) AS days_since_first
FROM panel_p""")
def p1_p2_derived_time(spark, sf):
    """P1 differences (change since the first visit, days since it) and P2 square of time."""
    from pyspark.sql import Window
    by_subject = Window.partitionBy("subject")
    p = panel_p(spark, sf)
    p = (p.withColumn("first_date", F.min("order_date").over(by_subject))
          .withColumn("y_first", F.first("y").over(by_subject.orderBy("wave"))))
    p = P.add_powers(p.withColumn("wave_d", F.col("wave").cast("double")), "wave_d", 2, "wave_sq")
    p = P.difference(p, "y", "y_first", "y_change")
    return p.select("subject", "wave", "wave_sq", "y_change",
                    F.datediff(F.col("order_date"), F.col("first_date")).cast("long").alias("days_since_first"))


# ------------------------------------------------------------------ V1, V3, V4, P4, P6, P7, F5

@query("v1_to_wide", sql="WITH" + PANEL_P_SQL + cells_sql())
def v1_to_wide(spark, sf):
    """Long panel P to one row per subject with one column per wave, every cell listed."""
    return cells(wide_p(spark, sf))


@query("v3_to_long_all", sql="WITH" + PANEL_P_SQL + """
SELECT subject, 'y_' || wave AS variable, y AS value FROM panel_p WHERE y IS NOT NULL""")
def v3_to_long_all(spark, sf):
    """Every wave column back to long (NULL cells dropped, as unpivot does)."""
    return P.to_long(wide_p(spark, sf), ["subject"]).where(F.col("value").isNotNull())


@query("v4_to_long_some", sql="WITH" + PANEL_P_SQL + """
SELECT subject, 'y_' || wave AS variable, y AS value FROM panel_p WHERE y IS NOT NULL AND wave < 3""")
def v4_to_long_some(spark, sf):
    """Three chosen wave columns to long."""
    return P.to_long(wide_p(spark, sf), ["subject"], ["y_0", "y_1", "y_2"]).where(F.col("value").isNotNull())


@query("p4_p6_rename_generated", sql="WITH" + PANEL_P_SQL + cells_sql("round(y * 10000.0, 2)", "price_"))
def p4_p6_rename_generated(spark, sf):
    """Select by prefix, then one expression over many columns with generated names."""
    w = P.pick_prefix(wide_p(spark, sf), "y_", keep=["subject"])
    return cells(P.map_columns(w, y_cols(w), lambda c: F.round(c * 10000.0, 2), [c.replace("y_", "price_") for c in y_cols(w)]))


@query("p7_sentinel_to_null", sql="WITH" + PANEL_P_SQL + cells_sql("nullif(floor(y), 20)"))
def p7_sentinel_to_null(spark, sf):
    """A sentinel (here the whole value 20) becomes NULL in every wave column."""
    w = wide_p(spark, sf)
    w = w.select("subject", *[F.floor(F.col(c)).cast("double").alias(c) for c in y_cols(w)])
    return cells(P.sentinel_to_null(w, y_cols(w), 20))


@query("f5_keep_present", sql="WITH" + PANEL_P_SQL + cells_sql(
    where="s.subject IN (SELECT subject FROM panel_p WHERE wave < 5 AND y IS NOT NULL GROUP BY subject HAVING count(*) = 5)"))
def f5_keep_present(spark, sf):
    """Subjects present at waves 0..4."""
    return cells(P.keep_present(wide_p(spark, sf), [f"y_{t}" for t in range(5)]))


# ------------------------------------------------------------------ P3, P5, P8, P9, P12-P14, P16, P17, P11

@query("p3_p5_select_rename", sql="""
SELECT o_orderkey AS order_id, o_custkey AS subject, o_totalprice AS price FROM orders""")
def p3_p5_select_rename(spark, sf):
    """Select, drop and rename (by name and by position)."""
    o = P.pick(table(spark, sf, "orders"), keep=["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"],
               drop=["o_orderstatus"])
    return P.rename(o, {"o_custkey": "subject"}, by_position={0: "order_id", 2: "price"})


@query("p8_cast_numeric", sql="""
SELECT event_id, TRY_CAST(regexp_extract(props, ':\\s*([^}]*)', 1) AS DOUBLE) AS k,
       TRY_CAST(event_type AS DOUBLE) AS event_type_num
FROM events""")
def p8_cast_numeric(spark, sf):
    """Text to number; text that is not a number becomes NULL."""
    e = table(spark, sf, "events").select(
        "event_id", F.regexp_extract("props", r":\s*([^}]*)", 1).alias("k"),
        F.col("event_type").alias("event_type_num"))
    return P.cast_numeric(e, ["k", "event_type_num"])


@query("p9_recode", sql="""
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high'
                        WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
       CASE WHEN o_totalprice >= 300000 THEN 3 WHEN o_totalprice >= 100000 THEN 2 ELSE 1 END AS price_band
FROM orders""")
def p9_recode(spark, sf):
    """Recode by cases."""
    o = table(spark, sf, "orders")
    pr = F.col("o_orderpriority")
    return o.select("o_orderkey",
                    C.recode(pr, [(pr.isin("1-URGENT", "2-HIGH"), "high"), (pr == "3-MEDIUM", "medium")], "low")
                    .alias("priority"),
                    C.recode(F.col("o_totalprice"), [(F.col("o_totalprice") >= 300000, 3),
                                                     (F.col("o_totalprice") >= 100000, 2)], 1)
                    .alias("price_band"))


@query("p11_p12_parse_ids", sql="""
SELECT p_partkey,
       CASE WHEN regexp_extract(p_name, '^(\\w+)\\s', 1) = '' THEN NULL ELSE regexp_extract(p_name, '^(\\w+)\\s', 1) END AS adjective,
       CASE WHEN regexp_extract(p_name, '(\\w+)$', 1) = '' THEN NULL ELSE regexp_extract(p_name, '(\\w+)$', 1) END AS noun,
       TRY_CAST(regexp_replace(p_brand, '\\D', '', 'g') AS INTEGER) AS brand_no
FROM part""")
def p11_p12_parse_ids(spark, sf):
    """Parse parts of an id text by regex and keep the digits of the brand."""
    p = table(spark, sf, "part")
    first = F.regexp_extract("p_name", r"^(\w+)\s", 1)
    last = F.regexp_extract("p_name", r"(\w+)$", 1)
    return p.select("p_partkey",
                    F.when(first == "", None).otherwise(first).alias("adjective"),
                    F.when(last == "", None).otherwise(last).alias("noun"),
                    C.digits(F.col("p_brand")).try_cast("int").alias("brand_no"))


@query("p13_unite", sql="WITH" + PANEL_P_SQL + """
SELECT subject, string_agg(CAST(CAST(floor(y) AS BIGINT) AS VARCHAR), ',' ORDER BY wave) AS visits FROM panel_p GROUP BY subject""")
def p13_unite(spark, sf):
    """Join the wave values of a subject to text, skipping missing waves."""
    w = wide_p(spark, sf)
    w = w.select("subject", *[F.floor(F.col(c)).cast("long").alias(c) for c in y_cols(w)])
    return P.unite(w, "visits", y_cols(w), sep=",", remove=True)


@query("p14_p16_constant_key", sql="""
SELECT o_orderkey, CAST(NULL AS VARCHAR) AS note, CAST(1 AS INTEGER) AS source,
       concat_ws('.', o_orderstatus, o_orderpriority) AS group_key
FROM orders""")
def p14_p16_constant_key(spark, sf):
    """Typed-NULL and constant columns, and one group key from two columns."""
    o = table(spark, sf, "orders")
    o = P.constant(P.constant(o, "note", None, "string"), "source", 1, "int")
    return o.select("o_orderkey", "note", "source",
                    C.combine_key("o_orderstatus", "o_orderpriority").alias("group_key"))


@query("p17_round", sql="""
SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 5) AS root_price,
       round(ln(l_extendedprice), 2) AS log_price
FROM lineitem""")
def p17_round(spark, sf):
    """Rounding to 5 decimals and to 2 (values chosen so no half-way ties occur)."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.sqrt("l_extendedprice").alias("root_price"),
        F.ln("l_extendedprice").alias("log_price"))
    return P.round_cols(P.round_cols(li, ["root_price"], 5), ["log_price"], 2)


# ------------------------------------------------------------------ F1-F4

@query("f1_one_wave", sql="WITH" + PANEL_P_SQL + " SELECT subject, wave, y FROM panel_p WHERE wave = 1")
def f1_one_wave(spark, sf):
    """Rows of one wave (the reference's 'baseline' is wave 1)."""
    return P.one_wave(panel_p(spark, sf), wave=1).select("subject", "wave", "y")


@query("f2_keep_in", sql="""
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def f2_keep_in(spark, sf):
    """Membership in a list."""
    return P.keep_in(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"),
                     "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("f3_keep_match", sql="""
SELECT doc_id, lang, n_chars FROM documents WHERE regexp_matches(text, '(?i)\\blicen[cs]e\\b')""")
def f3_keep_match(spark, sf):
    """Regex match on whole document texts."""
    d = table(spark, sf, "documents")
    return P.keep_match(d, "text", r"(?i)\blicen[cs]e\b").select("doc_id", "lang", "n_chars")


# ------------------------------------------------------------------ D1-D4

@query("d1_distinct_values", sql="SELECT DISTINCT o_orderpriority FROM orders")
def d1_distinct_values(spark, sf):
    return P.distinct_values(table(spark, sf, "orders"), "o_orderpriority")


@query("d2_distinct_rows", sql="SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def d2_distinct_rows(spark, sf):
    return P.distinct_rows(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("d3_first_per_key", sql="""
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT o_custkey, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM orders) t WHERE rn = 1""")
def d3_first_per_key(spark, sf):
    """Largest order per customer (ties broken by order key)."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return P.first_per_key(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


@query("d4_surrogate_id", sql="""
SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS BIGINT) AS priority_id
FROM orders""")
def d4_surrogate_id(spark, sf):
    """Dense id over distinct priorities, numbered on the distinct keys only."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return P.surrogate_id(o, ["o_orderpriority"], "priority_id")


# ------------------------------------------------------------------ O1, O2, U1, U2

@query("o1_sort_missing_last", sql="""
SELECT c_custkey, c_mktsegment, c_acctbal, row_number() OVER (ORDER BY c_mktsegment DESC NULLS LAST, c_acctbal NULLS LAST, c_custkey) AS position
FROM customer""")
def o1_sort_missing_last(spark, sf):
    """Sort by three keys, one falling, NULLs last, with each row's place in the order."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return P.number_rows(P.sort_missing_last(c, ["c_mktsegment", "c_acctbal", "c_custkey"], [True, False, False]), "position")


@query("o2_head", sql="""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def o2_head(spark, sf):
    """Top 10 orders by price: the limit is the feature."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return P.head(o, ["o_totalprice", "o_orderkey"], 10, [True, False])


@query("u1_stack", sql="""
SELECT 'customer' AS source, c_custkey AS id, c_name AS name, c_acctbal AS balance, CAST(NULL AS INTEGER) AS nation
FROM customer
UNION ALL
SELECT 'supplier', s_suppkey, s_name, s_acctbal, s_nationkey FROM supplier""")
def u1_stack(spark, sf):
    """Stack two tables by name; absent columns are NULL."""
    c = table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"),
                                            F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"),
                                            F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"),
                                            F.col("s_nationkey").alias("nation"))
    return P.stack(c, s)


@query("u2_append_rows", sql="""
SELECT r_regionkey AS region_id, r_name AS name FROM region
UNION ALL SELECT CAST(-1 AS INTEGER), 'UNKNOWN'""")
def u2_append_rows(spark, sf):
    """Append a literal row to a table."""
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("name"))
    extra = spark.range(1).select(F.lit(-1).cast("int").alias("region_id"), F.lit("UNKNOWN").alias("name"))
    return P.append_rows(r, extra)


# ------------------------------------------------------------------ W2, W3, W6

@query("w2_number_in_group", sql="WITH" + PANEL_P_SQL + """,
v AS (SELECT subject, string_agg(wave || ':' || CAST(floor(y / 20.0) AS BIGINT), ',' ORDER BY wave) AS vector FROM panel_p GROUP BY subject)
SELECT subject, vector, row_number() OVER (PARTITION BY vector ORDER BY subject) AS n_in_group FROM v""")
def w2_number_in_group(spark, sf):
    """Row number within groups of identical score vectors over all waves."""
    v = P.score_vectors(panel_p(spark, sf).withColumn("y", F.floor(F.col("y") / 20.0).cast("long")))
    return P.number_in_group(v, ["vector"], ["subject"])


@query("w3_position_in_block", sql="""
SELECT o_custkey, o_orderkey, CAST(pos AS BIGINT) AS pos, CAST(floor((pos - 1) / 4) + 1 AS INTEGER) AS block,
       CAST((pos - 1) % 4 AS INTEGER) AS pos_in_block
FROM (SELECT o_custkey, o_orderkey,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos
      FROM orders) t""")
def w3_position_in_block(spark, sf):
    """Position within customer, block of width 4 and position in the block."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return P.position_in_block(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 4).drop("o_orderdate")


@query("w6_ordered_id", sql="""
SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY
  CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END,
  o_orderpriority) AS BIGINT) AS order_id
FROM orders""")
def w6_ordered_id(spark, sf):
    """Id of each priority by a custom order; unlisted values after, in natural order."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return P.ordered_id(o, "o_orderpriority", ["5-LOW", "1-URGENT", "3-MEDIUM"])


# ------------------------------------------------------------------ A2-A7, A14

@query("a2_frequency", sql="""
SELECT quality, n, round(CAST(n AS DOUBLE) * 100.0 / sum(n) OVER (), 4) AS pct,
       round(CASE WHEN quality IS NULL THEN NULL ELSE CAST(n AS DOUBLE) * 100.0 / sum(CASE WHEN quality IS NULL THEN 0 ELSE n END) OVER () END, 4) AS valid_pct
FROM (SELECT l.quality, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
      GROUP BY l.quality) t""")
def a2_frequency(spark, sf):
    """Frequency of the quality label over all documents; unlabelled is its own row."""
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    f = D.frequency(d, "quality")
    return f.select("quality", "n", _r(F.col("pct")).alias("pct"), _r(F.col("valid_pct")).alias("valid_pct"))


@query("a3_wave_moments", sql="WITH" + PANEL_P_SQL + """,
c AS (SELECT wave, y - avg(y) OVER (PARTITION BY wave) AS d, y, avg(y) OVER (PARTITION BY wave) AS mean,
             min(y) OVER (PARTITION BY wave) AS lo, max(y) OVER (PARTITION BY wave) AS hi FROM panel_p WHERE y IS NOT NULL),
m AS (SELECT wave, count(*) AS n, any_value(mean) AS mean, avg(d * d) AS v, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4,
             any_value(lo) AS lo, any_value(hi) AS hi, count(*) FILTER (y = lo) AS n_lo, count(*) FILTER (y = hi) AS n_hi
      FROM c GROUP BY wave)
SELECT wave, n, round(mean, 4) AS mean, round(v, 4) AS variance, CASE WHEN v > 0 THEN round(m3 / power(v, 1.5), 4) + 0.0 END AS skewness,
       CASE WHEN v > 0 THEN round(m4 / (v * v) - 3.0, 4) + 0.0 END AS kurtosis, round(lo, 4) AS min, round(hi, 4) AS max,
       round(100.0 * n_lo / n, 4) AS pct_min, round(100.0 * n_hi / n, 4) AS pct_max FROM m""")
def a3_wave_moments(spark, sf):
    """Per wave n, mean, variance, skewness, kurtosis, min, max, % at min and max."""
    m = D.wave_moments(panel_p(spark, sf))
    return m.select("wave", F.col("n").cast("long").alias("n"),
                    *[_r(F.col(c)).alias(c) for c in
                      ["mean", "variance", "skewness", "kurtosis", "min", "max", "pct_min", "pct_max"]])


@query("a4_wave_percentiles", sql="WITH" + PANEL_P_SQL + """,
ranked AS (SELECT wave, y, row_number() OVER (PARTITION BY wave ORDER BY y) AS r,
                  count(*) OVER (PARTITION BY wave) AS n
           FROM panel_p WHERE y IS NOT NULL),
ps AS (SELECT CAST(p AS DOUBLE) AS p FROM (SELECT unnest([0.2, 0.4, 0.5, 0.6, 0.8]) AS p) u)
SELECT wave, p, n, y AS value FROM ranked JOIN ps ON r = greatest(1, floor(p * n + 0.5))""")
def a4_wave_percentiles(spark, sf):
    """Exact 20/40/50/60/80 percentiles per wave by the half-up nearest-rank rule."""
    return D.wave_percentiles(panel_p(spark, sf))


_PAIRS_SQL = """,
pairs AS (SELECT a.wave AS i, b.wave AS j, count(*) AS n_both FROM panel_p a JOIN panel_p b ON a.subject = b.subject AND b.wave <= a.wave
          WHERE a.y IS NOT NULL AND b.y IS NOT NULL GROUP BY a.wave, b.wave),
cov AS (SELECT i, j, n_both, n_both / (SELECT count(DISTINCT subject) FROM panel_p) AS share FROM pairs)
SELECT i, j, CAST(n_both AS BIGINT) AS n_both, round(share, 4) AS coverage FROM cov"""


@query("a5_coverage", sql="WITH" + PANEL_P_SQL + _PAIRS_SQL)
def a5_coverage(spark, sf):
    """Covariance coverage: share of subjects present at both waves, lower triangle."""
    w = wide_p(spark, sf)
    return D.coverage(w, y_cols(w)).withColumn("coverage", _r(F.col("coverage")))


@query("a6_low_coverage", sql="WITH" + PANEL_P_SQL + _PAIRS_SQL + " WHERE share < 0.1")
def a6_low_coverage(spark, sf):
    """Pairs whose coverage falls below the report's default limit."""
    w = wide_p(spark, sf)
    return D.low_coverage(D.coverage(w, y_cols(w)), 0.1).withColumn("coverage", _r(F.col("coverage")))


_PATTERN_SQL = """,
cells AS (SELECT s.subject, w.wave, p.y FROM (SELECT DISTINCT subject FROM panel_p) s CROSS JOIN (SELECT DISTINCT wave FROM panel_p) w
          LEFT JOIN panel_p p ON p.subject = s.subject AND p.wave = w.wave),
pat AS (SELECT subject, string_agg(CASE WHEN y IS NULL THEN '.' ELSE 'x' END, '' ORDER BY wave) AS pattern FROM cells GROUP BY subject)"""


@query("a7_missing_patterns", sql="WITH" + PANEL_P_SQL + _PATTERN_SQL + """
SELECT pattern, count(*) AS n FROM pat GROUP BY pattern""")
def a7_missing_patterns(spark, sf):
    """Missing-data patterns with their subject counts."""
    w = wide_p(spark, sf)
    return D.missing_patterns(w, y_cols(w))


@query("a14_pattern_stats", sql="WITH" + PANEL_P_SQL + _PATTERN_SQL + """,
n AS (SELECT pattern, count(*) AS n FROM pat GROUP BY pattern),
z AS (SELECT pat.pattern, cells.subject, cells.wave, coalesce(cells.y, 0.0) AS y FROM cells JOIN pat ON pat.subject = cells.subject),
v AS (SELECT pattern, wave AS t, CAST(NULL AS INTEGER) AS s, sum(y) AS value FROM z GROUP BY pattern, wave
      UNION ALL
      SELECT a.pattern, a.wave, b.wave, sum(a.y * b.y) FROM z a JOIN z b ON a.subject = b.subject AND b.wave <= a.wave
      GROUP BY a.pattern, a.wave, b.wave)
SELECT v.pattern, n.n, t, s, round(value, 6) AS value FROM v JOIN n ON n.pattern = v.pattern""")
def a14_pattern_stats(spark, sf):
    """Per missing pattern: n, sums and cross-products (sufficient statistics), as rows."""
    w = wide_p(spark, sf)
    s = D.pattern_stats_long(D.pattern_stats(w, y_cols(w)), len(y_cols(w)))
    return s.select("pattern", "n", "t", "s", _r(F.col("value"), 6).alias("value"))


# ------------------------------------------------------------------ S1, S2

@query("s1_s2_panel_file", sql="WITH" + PANEL_P_SQL + cells_sql())
def s1_s2_panel_file(spark, sf):
    """Wide panel P written as a headerless tab-separated panel file ('.' for missing) under the
    checkpoint folder, then scanned back with its positional schema."""
    import uuid

    from trajectra.session import ensure_checkpoint_dir
    from trajectra.sources.panel_files import read_panel, write_panel
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/panel-files/{uuid.uuid4().hex}"
    w = wide_p(spark, sf)
    write_panel(w, path, keep=w.columns)
    return cells(read_panel(spark, path, w.columns, key="subject"))
