"""Registered queries: reports of a grid of class models, written and scanned back.

The models are class growth models of panel E after a fixed number of EM steps, for
every event type in every cohort of users, so reports and lines grow with ``events``.
Each model becomes a text report in the layout of the scanned reports, one file per
model, under the checkpoint folder: starts with their seeds, messages, fit, class
counts on three bases, the class-count test, classes with their curves.  The twins do not parse texts: they
give the numbers of the same steps in SQL as the report prints them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trajectra.operators import compare as CM
from trajectra.plans.grid_sql import grid_sql
from trajectra.plans.panels import PANEL_E_SQL, panel_e
from trajectra.plans.q_grid import fixed_grid
from trajectra.plans.registry import query
from trajectra.session import ensure_checkpoint_dir, stage
from trajectra.sources import reports as RP

COHORT = 50                        # users of a cohort
SHELVES = 200                      # folders that hold the reports' folders
LISTS = dict(classes=(1, 2, 3), restrictions=("iq@0", "sq@0"), rules=(True,))
STEPS, STARTS = 3, 3
# fixed values: messages of the reports, and how the counts' headings end
REPLICATED = "THE BEST LOGLIKELIHOOD VALUE HAS BEEN REPLICATED.  RERUN WITH AT LEAST TWICE THE"
NOT_REPLICATED = "WARNING:  THE BEST LOGLIKELIHOOD VALUE WAS NOT REPLICATED.  THE"
BASES = [("model", "BASED ON THE ESTIMATED MODEL"), ("posterior", "BASED ON ESTIMATED POSTERIOR PROBABILITIES"),
         ("most_likely", "BASED ON THEIR MOST LIKELY LATENT CLASS MEMBERSHIP")]
COUNTS = {"model": "model_count", "posterior": "posterior_count", "most_likely": "likely_count"}
START_LINE, COUNT_LINE, MEAN_LINE = "%20.3f  %d %11d", "%8d %20.5f %16.5f", "    %s %20.3f %10.3f %10.3f    999.000"
CURVE = (("I", "i"), ("S", "s"), ("Q", "q"))


def cohort_panel(spark, sf):
    """Panel E with one outcome per event type and cohort of users; names are letters only."""
    cohort = F.translate(F.floor(F.col("subject") / COHORT).cast("string"), "0123456789", "abcdefghij")
    return panel_e(spark, sf).withColumn("outcome", F.concat(F.regexp_replace("outcome", "[^A-Za-z]", ""), cohort))


def _lines():
    """The report's lines as one array of texts."""
    def fixed(*texts):
        return F.array(*[F.lit(t) for t in texts])

    def of(template, *cols):
        return F.array(F.format_string(template, *[F.col(c) for c in cols]))

    k, ll = F.col("parameters"), F.col("ll")
    several = lambda a: F.when(F.col("n_classes") > 1, a).otherwise(F.array().cast("array<string>"))
    count_lines = lambda x: F.transform("classes", lambda c: F.format_string(COUNT_LINE, c["class"], c[x], c[x] / F.col("n")))
    counts = [F.concat(fixed("FINAL CLASS COUNTS AND PROPORTIONS FOR THE LATENT CLASSES", heading, ""), count_lines(COUNTS[b]), fixed(""))
              for b, heading in BASES]

    def class_block(c):
        head = F.when(F.col("n_classes") > 1, F.array(F.format_string("Latent Class %d", c["class"]), F.lit(""))).otherwise(
            F.array().cast("array<string>"))
        means = [F.format_string(MEAN_LINE, F.lit(p), c[x], F.coalesce(c[f"se_{x}"], F.lit(999.0)),
                                 F.coalesce(c[x] / c[f"se_{x}"], F.lit(999.0))) for p, x in CURVE]
        return F.concat(head, F.array(F.lit(" Means"), *means, F.lit("")))

    return F.concat(
        fixed("Estimator version 1.0", "", "SUMMARY OF ANALYSIS", ""), of("Number of observations %36d", "n"),
        fixed("", "RANDOM STARTS RESULTS RANKED FROM THE BEST TO THE WORST LOGLIKELIHOOD VALUES", ""),
        F.transform("starts", lambda s: F.format_string(START_LINE, s["ll"], s["seed"], s["start"])), fixed(""),
        F.array(F.when(F.col("best_replicated"), REPLICATED).otherwise(NOT_REPLICATED)), fixed("", "MODEL FIT INFORMATION", ""),
        of("Number of Free Parameters %24d", "parameters"), of("          H0 Value %31.3f", "ll"),
        F.array(F.format_string("          Akaike (AIC) %27.3f", -2.0 * ll + 2.0 * k),
                F.format_string("          Bayesian (BIC) %25.3f", -2.0 * ll + k * F.log(F.col("n").cast("double"))),
                F.format_string("          Sample-Size Adjusted BIC %15.3f", -2.0 * ll + k * F.log((F.col("n") + 2.0) / 24.0))),
        fixed(""), several(F.concat(*counts, fixed("CLASSIFICATION QUALITY", ""), F.array(F.format_string("     Entropy %25.3f", F.col("entropy"))),
                                    fixed("", "VUONG-LO-MENDELL-RUBIN LIKELIHOOD RATIO TEST", ""),
                                    of("          H0 Loglikelihood Value %21.3f", "km1"),
                                    F.array(F.format_string("          2 Times the Loglikelihood Difference %10.3f", 2.0 * (ll - F.col("km1")))),
                                    fixed(""))),
        fixed("MODEL RESULTS", ""), F.flatten(F.transform("classes", class_block)))


def report_rows(spark, sf):
    """One row per model: its id and its report's text."""
    t = fixed_grid(spark, cohort_panel(spark, sf), STEPS, STARTS, **LISTS)
    # the class-count test has the likelihood of one class less from that model's first start, not from its best
    one_less = t.select("outcome", "restriction", (F.col("n_classes") + 1).alias("n_classes"),
                        F.filter("starts", lambda s: s["start"] == 1)[0]["ll"].alias("km1"))
    t = t.join(one_less, ["outcome", "restriction", "n_classes"], "left")
    return t.select(F.col("model").alias("report"), F.concat_ws("\n", _lines()).alias("value"))


def report_writer(rows):
    """A writer of report rows, one file each: spread over every core and more, as few bytes are many files, and put in place by the tasks.

    Their folders stand on ``SHELVES`` folders, so that a listing is a fixed number of tasks, not one for each report.
    """
    spread = rows.withColumn("shelf", F.pmod(F.xxhash64("report"), F.lit(SHELVES))).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "report")
    return spread.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("shelf", "report")


def scanned(spark, sf, sections: bool = True):
    """The reports written as files and scanned back, with the model id as path."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/reports-{uuid.uuid4().hex}"
    report_writer(report_rows(spark, sf)).text(path)
    lines = (RP.scan_sections if sections else RP.scan_reports)(spark, path, "*.txt")
    return lines.withColumn("path", F.regexp_extract("path", r"report=([^/]+)/", 1))


# ----------------------------------------------------------------- SQL twins

_PANEL = PANEL_E_SQL + f""",
panel_g AS (SELECT regexp_replace(outcome, '[^A-Za-z]', '', 'g') || translate(CAST(subject // {COHORT} AS VARCHAR), '0123456789', 'abcdefghij') AS outcome,
                   subject, wave, y FROM panel_e WHERE y IS NOT NULL)"""
REPORTS_SQL = grid_sql(_PANEL, LISTS["classes"], LISTS["restrictions"], LISTS["rules"], STEPS, STARTS) + f""",
rep AS MATERIALIZED (
  SELECT b.*, -2.0 * b.ll + 2.0 * b.parameters AS aic, -2.0 * b.ll + b.parameters * ln(b.n) AS bic,
         -2.0 * b.ll + b.parameters * ln((b.n + 2.0) / 24.0) AS abic, p.ll AS km1,
         CASE WHEN b.best_replicated THEN '{REPLICATED}' ELSE '{NOT_REPLICATED}' END AS message
  FROM best b LEFT JOIN ranked p ON p.outcome = b.outcome AND p.restriction = b.restriction AND p.classes = b.classes - 1 AND p.start = 0),
tries AS (SELECT model, k, ll, seed, start + 1 AS start FROM ranked),
grp AS MATERIALIZED (
  SELECT c.*, r.n, r.classes, c.class AS kk FROM best_classes c JOIN rep r ON r.model = c.model)
"""


def _text_sql() -> str:
    """(path, part, pos, sub, line): the report's lines in order, without numbers."""
    out, part = [], 0

    def add(text, source="rep", at="0", sub="0", where="TRUE"):
        out.append(f"SELECT model AS path, {part} AS part, {at} AS pos, {sub} AS sub, {text} AS line FROM {source} WHERE {where}")

    fit = [("'Estimator version 1.0'",), ("''",), ("'SUMMARY OF ANALYSIS'",), ("''",), ("printf('Number of observations %36d', n)",), ("''",),
           ("'RANDOM STARTS RESULTS RANKED FROM THE BEST TO THE WORST LOGLIKELIHOOD VALUES'",), ("''",),
           (f"printf('{START_LINE}', ll, seed, start)", "tries", "k"), ("''",), ("message",), ("''",), ("'MODEL FIT INFORMATION'",), ("''",),
           ("printf('Number of Free Parameters %24d', parameters)",), ("printf('          H0 Value %31.3f', ll)",),
           ("printf('          Akaike (AIC) %27.3f', aic)",), ("printf('          Bayesian (BIC) %25.3f', bic)",),
           ("printf('          Sample-Size Adjusted BIC %15.3f', abic)",), ("''",)]
    for line in fit:
        add(*line)
        part += 1
    for b, heading in BASES:
        for line in ("'FINAL CLASS COUNTS AND PROPORTIONS FOR THE LATENT CLASSES'", f"'{heading}'", "''"):
            add(line, where="classes > 1")
            part += 1
        add(f"printf('{COUNT_LINE}', class, {COUNTS[b]}, {COUNTS[b]} / n)", "grp", "kk", where="classes > 1")
        part += 1
        add("''", where="classes > 1")
        part += 1
    for line in ("'CLASSIFICATION QUALITY'", "''", "printf('     Entropy %25.3f', entropy)", "''", "'VUONG-LO-MENDELL-RUBIN LIKELIHOOD RATIO TEST'", "''",
                 "printf('          H0 Loglikelihood Value %21.3f', km1)",
                 "printf('          2 Times the Loglikelihood Difference %10.3f', 2.0 * (ll - km1))", "''"):
        add(line, where="classes > 1")
        part += 1
    for line in ("'MODEL RESULTS'", "''"):
        add(line)
        part += 1
    block = [("printf('Latent Class %d', class)", "classes > 1"), ("''", "classes > 1"), ("' Means'", "TRUE")]
    block += [(f"printf('{MEAN_LINE}', '{p}', a{j}, coalesce(se_{j}, 999.0), coalesce(a{j} / se_{j}, 999.0))", "TRUE")
              for j, (p, _) in enumerate(CURVE)] + [("''", "TRUE")]
    for sub, (line, where) in enumerate(block):
        add(line, "grp", "kk", str(sub), where)
    part += 1
    add("''")                       # behind the file's last line break
    return "\nUNION ALL ".join(out)


_LINES_SQL = f", texts AS ({_text_sql()})"


@query("s3_scan_reports", sql=REPORTS_SQL + _LINES_SQL + """
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY part, pos, sub) AS INTEGER) AS line_no, line FROM texts""")
def s3_scan_reports(spark, sf):
    """Report files scanned to numbered lines."""
    return scanned(spark, sf, sections=False)


_FACTS_SQL = " UNION ALL ".join(
    f"SELECT model AS path, '{name}' AS name, printf('{fmt}', {col}) AS value FROM rep{where}" for name, fmt, col, where in [
        ("Observations", "%d", "n", ""), ("Parameters", "%d", "parameters", ""), ("LL", "%.3f", "ll", ""),
        ("AIC", "%.3f", "aic", ""), ("BIC", "%.3f", "bic", ""), ("aBIC", "%.3f", "abic", ""), ("Entropy", "%.3f", "entropy", " WHERE classes > 1"),
        ("T11_KM1LL", "%.3f", "km1", " WHERE classes > 1"), ("T11_VLMR_2xLLDiff", "%.3f", "2.0 * (ll - km1)", " WHERE classes > 1")])


@query("s4_extract_facts", sql=REPORTS_SQL + _FACTS_SQL)
def s4_extract_facts(spark, sf):
    """Facts by the section-aware rules."""
    return RP.extract_facts(scanned(spark, sf)).select("path", "name", "value")


def _printed(col: str, digits: int = 3) -> str:
    return f"CAST(printf('%.{digits}f', {col}) AS DOUBLE)"


@query("s5_extract_params", sql=REPORTS_SQL + " UNION ALL ".join(
    f"SELECT model AS path, CASE WHEN classes > 1 THEN CAST(class AS INTEGER) END AS class, 'Means' AS header, '{p}' AS param, {_printed(f'a{a}')} + 0.0 AS est, "
    f"nullif({_printed(f'coalesce(se_{a}, 999.0)')}, 999.0) AS se, nullif({_printed(f'coalesce(a{a} / se_{a}, 999.0)')} + 0.0, 999.0) AS est_se, "
    f"CAST(NULL AS DOUBLE) AS pval FROM grp" for a, (p, _) in enumerate(CURVE)))
def s5_extract_params(spark, sf):
    """Parameter rows with their class and heading; 999 is not applicable."""
    p = RP.extract_params(scanned(spark, sf))
    return p.select("path", "class", "header", "param", (F.col("est") + 0.0).alias("est"), "se", (F.col("est_se") + 0.0).alias("est_se"), "pval")


@query("s7_extract_class_counts", sql=REPORTS_SQL + " UNION ALL ".join(
    f"SELECT model AS path, '{b}' AS basis, CAST(class AS INTEGER) AS class, {_printed(COUNTS[b], 5)} AS count, {_printed(f'{COUNTS[b]} / n', 5)} AS proportion "
    f"FROM grp WHERE classes > 1" for b, _ in BASES))
def s7_extract_class_counts(spark, sf):
    """Class counts and proportions on the three bases."""
    return RP.extract_class_counts(scanned(spark, sf))


@query("s8_report_messages", sql=REPORTS_SQL + f"""
SELECT model AS path, CAST({9 + STARTS + 1} AS INTEGER) AS line_no, message AS text, TRUE AS relevant, CASE WHEN best_replicated THEN 'info' ELSE 'warning' END AS severity
FROM rep""")
def s8_report_messages(spark, sf):
    """Messages with their relevance and severity."""
    return RP.extract_messages(scanned(spark, sf))


@query("s9_extract_starts", sql=REPORTS_SQL + f"""
SELECT model AS path, {_printed('ll')} AS ll, CAST(seed AS BIGINT) AS seed, CAST(start AS INTEGER) AS start FROM tries""")
def s9_extract_starts(spark, sf):
    """Ranked starts with seed and start number."""
    return RP.extract_starts(scanned(spark, sf)).drop("line_no")


_TABLE_SQL = REPORTS_SQL + f""",
shown AS (
  SELECT model, string_agg(printf('%.0f', {_printed('likely_count', 5)}), ',' ORDER BY class) AS class_counts,
         string_agg(printf('%.3f', {_printed('likely_count / n', 5)}), ',' ORDER BY class) AS class_shares
  FROM grp WHERE classes > 1 GROUP BY model),
tab AS (
  SELECT r.model AS path, CAST(parameters AS INTEGER) AS parameters, {_printed('ll')} AS ll, {_printed('aic')} AS aic, {_printed('bic')} AS bic,
         {_printed('abic')} AS abic, CASE WHEN classes > 1 THEN {_printed('entropy')} END AS entropy, CAST(n AS INTEGER) AS n, lower(outcome) AS outcome,
         CASE WHEN classes > 1 THEN {_printed('km1')} END AS km1, trim(restriction) AS restriction, CAST(classes AS INTEGER) AS n_classes, class_counts, class_shares, message
  FROM rep r LEFT JOIN shown s ON s.model = r.model)
"""


FIT_TABLE_SQL = _TABLE_SQL + """
SELECT path, parameters AS "Parameters", ll AS "LL", aic AS "AIC", bic AS "BIC", abic AS "aBIC", entropy AS "Entropy", n AS "Observations", outcome,
       'lcga' AS family, '2' AS degree, restriction, n_classes, 'constrained' AS residuals, class_counts, class_shares, message AS warning,
       round(lag(-2.0 * ll) OVER w + 2.0 * ll, 4) AS chisq, parameters - lag(parameters) OVER w AS dif_df
FROM tab WINDOW w AS (PARTITION BY outcome, restriction ORDER BY n_classes)"""


@query("m14_report_fit_table", sql=FIT_TABLE_SQL)
def m14_report_fit_table(spark, sf):
    """One row per report: facts, model id parts, class counts and shares as text, messages, and the test against one class less."""
    return _tested(RP.report_fit_table(scanned(spark, sf)))


def _tested(t):
    t = CM.lr_test(t, ["outcome", "restriction"], ["n_classes"], "LL", "Parameters")
    return t.select("path", "Parameters", "LL", "AIC", "BIC", "aBIC", "Entropy", "Observations", "outcome", "family", "degree", "restriction",
                    "n_classes", "residuals", "class_counts", "class_shares", "warning", F.round("chisq", 4).alias("chisq"), "dif_df")


@query("m14_incremental_fit_table", sql=FIT_TABLE_SQL)
def m14_incremental_fit_table(spark, sf):
    """The fit table kept in a stored table: reports of two thirds of the models first, the rest when they are there, each read once."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages"
    folder, stored = f"{base}/reports-{uuid.uuid4().hex}", f"{base}/fit-table-{uuid.uuid4().hex}"
    rows = stage(report_rows(spark, sf), "report-texts")
    name = F.regexp_extract("path", r"report=([^/]+)/", 1)
    later = F.col("report").contains("-3 classes")
    for part in (~later, later):
        report_writer(rows.where(part)).mode("append").text(folder)
        table = RP.update_fit_table(spark, folder, stored, "*.txt", model_id=name)
    return _tested(table.withColumn("path", name))


@query("c10_step_gap", sql=_TABLE_SQL + """
SELECT t.path, t.outcome, t.restriction, t.n_classes, t.km1, p.ll AS ll_prev_own, round(t.km1 - p.ll, 4) AS gap
FROM tab t LEFT JOIN tab p ON p.outcome = t.outcome AND p.restriction = t.restriction AND p.n_classes = t.n_classes - 1""")
def c10_step_gap(spark, sf):
    """The log-likelihood of one class less that each report's class-count test prints, against that model's own best one."""
    # both sides of the step are this table
    t = CM.step_gap(stage(RP.report_fit_table(scanned(spark, sf)), "fit-table"), ["outcome", "restriction"])
    return t.select("path", "outcome", "restriction", "n_classes", F.col("T11_KM1LL").alias("km1"), "ll_prev_own", F.round("gap", 4).alias("gap"))
