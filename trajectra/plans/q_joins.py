"""Registered queries: joins (J1-J4) and model specification grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajectra.functions import columns as C
from trajectra.operators import fit as FT
from trajectra.operators import grid as G
from trajectra.operators import joins as J
from trajectra.plans.panels import PANEL_E_SQL, PANEL_P_SQL, panel_e, panel_p, table, waves_e, wide_p, y_cols
from trajectra.plans.registry import query


def _r(c, d=4):
    return F.round(c, d) + F.lit(0.0)


# ----------------------------------------------------------------- J1-J4

@query("j1_left_lookup", sql="""
SELECT o.o_orderkey, c.c_mktsegment, c.c_nationkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def j1_left_lookup(spark, sf):
    """Customer attributes looked up for every order (left join on one key)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return J.left_lookup(o, c, ["o_custkey"]).drop("o_custkey")


@query("j2_left_two_keys", sql="WITH" + PANEL_E_SQL + """,
s AS (SELECT subject, outcome, regr_slope(y, wave) AS slope FROM panel_e GROUP BY subject, outcome)
SELECT p.subject, p.outcome, p.wave, round(s.slope, 8) + 0.0 AS slope
FROM panel_e p LEFT JOIN s ON p.subject = s.subject AND p.outcome = s.outcome""")
def j2_left_two_keys(spark, sf):
    """Per-subject, per-outcome slopes joined back to the long panel on two keys."""
    pe = panel_e(spark, sf)
    sk = pe.withColumn("sk", F.struct("subject", "outcome"))
    sl = FT.subject_slopes(sk, "sk").select("sk.subject", "sk.outcome", "slope")
    out = J.left_lookup(pe, sl, ["subject", "outcome"])
    return out.select("subject", "outcome", "wave", _r(F.col("slope"), 8).alias("slope"))


@query("j3_left_null_safe", sql="WITH" + PANEL_P_SQL + """,
v AS (SELECT subject, list(floor(y / 10.0) ORDER BY wave) AS k FROM panel_p GROUP BY subject)
SELECT subject, min(subject) OVER (PARTITION BY k) AS vector_id FROM v""")
def j3_left_null_safe(spark, sf):
    """Subjects matched to their (coarsened, nullable) score vector on one key per wave; missing matches missing."""
    w = wide_p(spark, sf)
    keys = [c.replace("y_", "k_") for c in y_cols(w)]
    v = w.select("subject", *[F.floor(F.col(c) / 10.0).alias(k) for c, k in zip(y_cols(w), keys)])
    ids = v.groupBy(*keys).agg(F.min("subject").alias("vector_id"))
    out = J.left_null_safe(v, ids, [(k, k) for k in keys])
    return out.select("subject", "vector_id")


@query("w2_j3_j4_score_vectors", sql="WITH" + PANEL_P_SQL + """,
v AS (SELECT subject, string_agg(wave || ':' || CAST(floor(y / 20.0) AS BIGINT), ',' ORDER BY wave) AS vector FROM panel_p GROUP BY subject)
SELECT subject, vector, dense_rank() OVER (ORDER BY vector) AS vector_id, row_number() OVER (PARTITION BY vector ORDER BY subject) AS n_in_vector
FROM v""")
def w2_j3_j4_score_vectors(spark, sf):
    """Score vectors over all waves as one pipeline: unique vectors numbered, joined back null-safely, and the number within the vector."""
    from trajectra.operators import panel as P
    v = P.score_vectors(panel_p(spark, sf).withColumn("y", F.floor(F.col("y") / 20.0).cast("long")))
    ids = P.surrogate_id(v, ["vector"], "vector_id")
    return P.number_in_group(ids, ["vector"], ["subject"], "n_in_vector")


@query("j4_assert_unique", sql="""
SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_distinct FROM orders GROUP BY o_custkey
HAVING count(DISTINCT o_orderpriority) > 1""")
def j4_assert_unique(spark, sf):
    """Keys whose lookup value is not unique (fan-out guard before a join)."""
    return J.assert_unique(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


# ----------------------------------------------------------------- J6-J8, A15, P11

def _outcomes(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("outcome")).distinct()


def model_grid(spark, sf):
    """All three grids over the outcomes found in the data."""
    out = _outcomes(spark, sf)
    lst = lambda name, vals, t: spark.createDataFrame([(v,) for v in vals], f"{name} {t}")
    growth = G.cross_grid(out, lst("degree", [0, 1, 2], "int"), lst("shared_residual", [True, False], "boolean"))
    growth = growth.select("outcome", F.lit("lgca").alias("family"), "degree",
                           F.lit(None).cast("string").alias("restriction"), F.lit(1).alias("n_classes"),
                           "shared_residual", (F.col("degree") + 1).alias("n_factors"))
    growth = G.title(growth.withColumn("__t", F.element_at(F.array(*[F.lit(G.GROWTH_TITLES[d]) for d in range(3)]),
                                                           F.col("degree") + 1))
                     .withColumn("__r", F.when(F.col("shared_residual"), "constrained").otherwise("unconstrained")),
                     "%s-lgca%d - %s-residuals %13s", ["outcome", "degree", "__t", "__r"]).drop("__t", "__r")
    cls = G.cross_grid(out, lst("restriction", ["iq@0", "sq@0"], "string"), lst("n_classes", [1, 2, 3, 4], "int"))
    cls = cls.select("outcome", F.lit("lcga").alias("family"), F.lit(2).alias("degree"), "restriction", "n_classes",
                     F.lit(False).alias("shared_residual"), F.lit(3).alias("n_factors"))
    cls = G.title(cls, "%s-lcga2 - unconditional quadratic model - %s -%d classes-residuals unconstrained",
                  ["outcome", "restriction", "n_classes"])
    mix = G.cross_grid(out, lst("restriction", G.RESTRICTIONS, "string"), lst("n_classes", [2], "int"))
    mix = mix.select("outcome", F.lit("gmm_").alias("family"), F.lit(3).alias("degree"), "restriction", "n_classes",
                     F.lit(False).alias("shared_residual"), F.lit(3).alias("n_factors"))
    mix = G.title(mix, "%s-gmm_3 - unconditional quadratic model - %s -%d classes-residuals unconstrained",
                  ["outcome", "restriction", "n_classes"])
    grid = growth.unionByName(cls).unionByName(mix)
    return grid.withColumn("parameters", G.free_parameters(F.col("n_factors"), F.col("n_classes"),
                                                           F.col("restriction"), F.col("shared_residual"),
                                                           waves_e(spark, sf)))


GRID_SQL = f"""WITH o AS (SELECT DISTINCT event_type AS outcome FROM events),
w AS (SELECT max(n) AS waves FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type) c),
growth AS (
  SELECT outcome, 'lgca' AS family, degree, CAST(NULL AS VARCHAR) AS restriction, 1 AS n_classes, shared_residual,
         degree + 1 AS n_factors,
         printf('%s-lgca%d - %s-residuals %13s', outcome, degree,
                CASE degree WHEN 0 THEN '{G.GROWTH_TITLES[0]}' WHEN 1 THEN '{G.GROWTH_TITLES[1]}'
                            ELSE '{G.GROWTH_TITLES[2]}' END,
                CASE WHEN shared_residual THEN 'constrained' ELSE 'unconstrained' END) AS title
  FROM o CROSS JOIN (SELECT unnest([0, 1, 2]) AS degree) d CROSS JOIN (SELECT unnest([true, false]) AS shared_residual) r),
cls AS (
  SELECT outcome, 'lcga' AS family, 2 AS degree, restriction, n_classes, false AS shared_residual, 3 AS n_factors,
         printf('%s-lcga2 - unconditional quadratic model - %s -%d classes-residuals unconstrained', outcome, restriction, n_classes) AS title
  FROM o CROSS JOIN (SELECT unnest(['iq@0', 'sq@0']) AS restriction) r CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n_classes) k),
mix AS (
  SELECT outcome, 'gmm_' AS family, 3 AS degree, restriction, 2 AS n_classes, false AS shared_residual, 3 AS n_factors,
         printf('%s-gmm_3 - unconditional quadratic model - %s -%d classes-residuals unconstrained', outcome, restriction, 2) AS title
  FROM o CROSS JOIN (SELECT unnest(['iq@0', 'sq@0', ' q@0', 'c. i', 'c.is']) AS restriction) r),
grid AS (SELECT * FROM growth UNION ALL SELECT * FROM cls UNION ALL SELECT * FROM mix),
g AS (SELECT *, CAST(n_classes * n_factors
         + CASE WHEN restriction IS NULL THEN n_factors * (n_factors + 1) / 2 WHEN restriction = 'iq@0' THEN 0
                WHEN restriction = 'sq@0' THEN 1 WHEN restriction = ' q@0' THEN 3
                WHEN restriction = 'c. i' THEN n_classes + 2 WHEN restriction = 'c.is' THEN 3 * n_classes END
         + CASE WHEN shared_residual THEN 1 ELSE (SELECT waves FROM w) END + n_classes - 1 AS INTEGER) AS parameters FROM grid)
"""


@query("j6_j8_a15_model_grid", sql=GRID_SQL + """
SELECT outcome, family, CAST(degree AS INTEGER) AS degree, restriction, CAST(n_classes AS INTEGER) AS n_classes,
       shared_residual, title, parameters FROM g""")
def j6_j8_a15_model_grid(spark, sf):
    """Cross product of the spec lists per outcome, titles, and free-parameter counts."""
    g = model_grid(spark, sf)
    return g.select("outcome", "family", F.col("degree").cast("int").alias("degree"), "restriction",
                    F.col("n_classes").cast("int").alias("n_classes"), "shared_residual", "title", "parameters")


@query("j7_expand_spec", sql=GRID_SQL + """
SELECT title, CAST(k.class AS INTEGER) AS class,
       CASE WHEN restriction IN ('c. i', 'c.is') THEN 'class-specific' ELSE 'shared' END AS variance_block
FROM g CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS class) k WHERE k.class <= g.n_classes AND family <> 'lgca'""")
def j7_expand_spec(spark, sf):
    """One row per class block of every class model, with its variance block from a lookup list."""
    g = model_grid(spark, sf).where(F.col("family") != "lgca")
    g = G.expand_classes_of_spec(g)
    idx = F.when(F.col("restriction").isin("c. i", "c.is"), 2).otherwise(1)
    g = G.lookup_by_index(g.withColumn("__i", idx), "__i", ["shared", "class-specific"], "variance_block")
    return g.select("title", F.col("class").cast("int").alias("class"), "variance_block")


@query("p11_parse_model_id", sql=GRID_SQL + f"""
, p AS (SELECT title, regexp_extract(title, '{C.MODEL_ID_PATTERN}', 1) AS outcome,
              regexp_extract(title, '{C.MODEL_ID_PATTERN}', 2) AS family,
              regexp_extract(title, '{C.MODEL_ID_PATTERN}', 5) AS restriction,
              regexp_extract(title, '{C.MODEL_ID_PATTERN}', 6) AS classes,
              regexp_extract(title, '{C.MODEL_ID_PATTERN}', 7) AS residuals FROM g)
SELECT title, lower(outcome) AS outcome, family, CASE WHEN restriction = '' THEN NULL ELSE trim(restriction) END AS restriction,
       coalesce(TRY_CAST(classes AS INTEGER), 1) AS n_classes, residuals FROM p""")
def p11_parse_model_id(spark, sf):
    """Model ids parsed back from the generated titles by regex (never by fixed offsets)."""
    g = model_grid(spark, sf).select("title")
    parts = C.parse_model_id(F.col("title"))
    return g.select("title", parts["outcome"].alias("outcome"), parts["family"].alias("family"),
                    parts["restriction"].alias("restriction"), parts["n_classes"].alias("n_classes"),
                    parts["residuals"].alias("residuals"))
