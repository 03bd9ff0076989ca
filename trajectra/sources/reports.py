"""Scanning plain-text model reports into tidy tables.

Lines are ``(path, line_no, line)``.  Sections are carried down the lines with
``last(.., ignorenulls) over (partition by path order by line_no)``: one report
is one window group, and its size is that of one text file.  Every extractor is
a set of regular expressions applied as column expressions; rule lists are
fixed and small, so they become CASE chains rather than joins.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectra.operators.joins import BROADCAST_ROWS
from trajectra.session import stage

# ----------------------------------------------------------------- fixed values
# Relevant warning texts (kept exactly as the reference lists them, in its order).
RELEVANT_WARNINGS = [
    "SOLUTION MAY NOT BE TRUSTWORTHY DUE TO LOCAL MAXIMA",
    "THE COVARIANCE COVERAGE FALLS BELOW THE SPECIFIED LIMIT",
    "THE BEST LOGLIKELIHOOD VALUE HAS BEEN REPLICATED",
    "IS NOT POSITIVE DEFINITE",
    "IS NOT POSITIVE",
    "WARNING:  THE BEST LOGLIKELIHOOD VALUE WAS NOT REPLICATED.  THE",
    "SOLUTION MAY NOT BE TRUSTWORTHY DUE TO LOCAL MAXIMA.  INCREASE THE",
    "TRUSTWORTHY FOR SOME PARAMETERS DUE TO A NON-POSITIVE DEFINITE",
    "ONE OR MORE PARAMETERS WERE FIXED TO AVOID SINGULARITY OF THE",
    "INFORMATION MATRIX. THE SINGULARITY IS MOST LIKELY BECAUSE THE",
    "MODEL IS NOT IDENTIFIED, OR BECAUSE OF EMPTY CELLS IN THE JOINT",
    "IS NOT POSITIVE DEFINITE.  THIS COULD INDICATE A NEGATIVE VARIANCE/",
]
# Harmless messages among them (severity "info").
INFO_WARNINGS = ["THE BEST LOGLIKELIHOOD VALUE HAS BEEN REPLICATED"]

# Report layout: a section heading is an upper-case line without lower-case
# letters, digits-with-decimals or punctuation other than ( ) - / , :
HEADING = r"^\s*[A-Z][A-Z0-9 ()\-/,:]*[A-Z)]\s*$"
NUM = r"-?\d+\.\d+"
# (section pattern, line pattern, fact name): the value is group 1 of the line pattern.
FACT_RULES = [
    (r"SUMMARY OF ANALYSIS", r"^\s*Number of observations\s+(\d+)\s*$", "Observations"),
    (r"MODEL FIT INFORMATION", r"^\s*Number of Free Parameters\s+(\d+)\s*$", "Parameters"),
    (r"MODEL FIT INFORMATION", rf"^\s*H0 Value\s+({NUM})\s*$", "LL"),
    (r"MODEL FIT INFORMATION", rf"^\s*H0 Scaling Correction Factor\s+({NUM})\s*$", "LLCorrectionFactor"),
    (r"MODEL FIT INFORMATION", rf"^\s*Akaike \(AIC\)\s+({NUM})\s*$", "AIC"),
    (r"MODEL FIT INFORMATION", rf"^\s*Bayesian \(BIC\)\s+({NUM})\s*$", "BIC"),
    (r"MODEL FIT INFORMATION", rf"^\s*Sample-Size Adjusted BIC\s+({NUM})\s*$", "aBIC"),
    (r"CLASSIFICATION QUALITY", rf"^\s*Entropy\s+({NUM})\s*$", "Entropy"),
    (r"VUONG-LO-MENDELL-RUBIN", rf"^\s*H0 Loglikelihood Value\s+({NUM})\s*$", "T11_KM1LL"),
    (r"VUONG-LO-MENDELL-RUBIN", rf"^\s*2 Times the Loglikelihood Difference\s+({NUM})\s*$", "T11_VLMR_2xLLDiff"),
    (r"VUONG-LO-MENDELL-RUBIN", rf"^\s*Mean\s+({NUM})\s*$", "T11_VLMR_Mean"),
    (r"VUONG-LO-MENDELL-RUBIN", rf"^\s*Standard Deviation\s+({NUM})\s*$", "T11_VLMR_SD"),
    (r"VUONG-LO-MENDELL-RUBIN", rf"^\s*P-Value\s+({NUM})\s*$", "T11_VLMR_PValue"),
    (r"LO-MENDELL-RUBIN ADJUSTED", rf"^\s*Value\s+({NUM})\s*$", "T11_LMR_Value"),
    (r"LO-MENDELL-RUBIN ADJUSTED", rf"^\s*P-Value\s+({NUM})\s*$", "T11_LMR_PValue"),
    (r"PARAMETRIC BOOTSTRAPPED", rf"^\s*H0 Loglikelihood Value\s+({NUM})\s*$", "BLRT_KM1LL"),
    (r"PARAMETRIC BOOTSTRAPPED", rf"^\s*2 Times the Loglikelihood Difference\s+({NUM})\s*$", "BLRT_2xLLDiff"),
    (r"PARAMETRIC BOOTSTRAPPED", rf"^\s*Approximate P-Value\s+({NUM})\s*$", "BLRT_PValue"),
    (r"PARAMETRIC BOOTSTRAPPED", r"^\s*Successful Bootstrap Draws\s+(\d+)\s*$", "BLRT_Draws"),
]
PARAM_ROW = rf"^\s+(\S+)\s+({NUM})\s+({NUM})\s+({NUM})\s+({NUM})\s*$"
PARAM_HEADER = r"^ (\S[^|]*?)\s*(\|)?\s*$"
CLASS_LINE = r"^(?:Latent Class|Class)\s+(\d+)\s*$"
COUNT_ROW = r"^\s+(\d+)\s+(\d+(?:\.\d+)?)\s+(\d\.\d+)\s*$"
START_ROW = rf"^\s+({NUM})\s+(\d+)\s+(\d+)\s*$"
MESSAGE_LINE = r"\*\*\* (WARNING|ERROR)|WARNING:|ERROR:|^\s*THE (BEST LOGLIKELIHOOD|MODEL ESTIMATION|STANDARD ERRORS)"


# ----------------------------------------------------------------- S3

def report_texts(spark: SparkSession, path: str, glob: str = "*.out", modified_after: str | None = None) -> DataFrame:
    """Every report under ``path`` (recursively) as (path, value), one row per file.

    ``modified_after`` skips unchanged files, as the reference's runner skips
    reports newer than their input.
    """
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if modified_after:
        r = r.option("modifiedAfter", modified_after)
    return r.text(path, wholetext=True).select(F.url_decode(F.col("_metadata.file_path")).alias("path"), "value")


def scan_reports(spark: SparkSession, path: str, glob: str = "*.out", modified_after: str | None = None) -> DataFrame:
    """S3: every report under ``path`` (recursively) as (path, line_no, line).

    Each file is read whole (reports are a few hundred lines) so line numbers are
    exact; files are spread over tasks.
    """
    return lines_of(report_texts(spark, path, glob, modified_after), "path", "value")


SECTION_FILLS = {"section": (HEADING, 0, None),
                 "class": (CLASS_LINE, 1, r"^[A-Z][A-Za-z ]+Variables\s*$"),
                 "header": (PARAM_HEADER, 1, None)}


def scan_sections(spark: SparkSession, path: str, glob: str = "*.out", modified_after: str | None = None) -> DataFrame:
    """S3 + S6: report lines with their section, class and heading, carried inside each file's row.

    Every extractor takes these lines and then needs no exchange of its own.
    """
    return lines_with_sections(report_texts(spark, path, glob, modified_after), "path", "value", SECTION_FILLS)


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """Split whole texts into (key as path, line_no from 1, line); narrow."""
    return df.select(F.col(key).cast("string").alias("path"),
                     F.posexplode(F.split(F.col(text), r"\r?\n")).alias("pos", "line")).select(
        "path", (F.col("pos") + 1).cast("int").alias("line_no"), "line")


# ----------------------------------------------------------------- S6

def _marks(pattern: str, group: int, reset: str | None):
    """Line column -> the value it sets, '' where it clears it, NULL where it leaves it."""
    def mark(line: Column) -> Column:
        v = F.regexp_extract(line, pattern, group) if group else F.trim(line)
        m = F.when(line.rlike(pattern), v)
        return m.when(line.rlike(reset), F.lit("")) if reset else m
    return mark


def fill_section(lines: DataFrame, pattern: str, name: str = "section", group: int = 0,
                 reset: str | None = None) -> DataFrame:
    """Carry the last line matching ``pattern`` (or its regex group) down the lines.

    ``reset``: a pattern whose lines clear the carried value (e.g. a new top section).
    For lines that come from whole texts use ``lines_with_sections``, which needs
    no exchange; here the lines of a path are put in order again.
    """
    w = (Window.partitionBy("path").orderBy("line_no")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = F.last(_marks(pattern, group, reset)(F.col("line")), ignorenulls=True).over(w)
    return lines.withColumn(name, F.when(filled == "", F.lit(None).cast("string")).otherwise(filled))


def lines_with_sections(df: DataFrame, key: str, text: str, fills: dict[str, tuple]) -> DataFrame:
    """S3 + S6 on whole texts: (path, line_no, line) with carried values, without an exchange.

    ``fills`` names each carried column and its (pattern, group, reset).  A text is
    one row, so its values are carried inside the row: one pass over its lines in
    order keeps the current values, and the lines are exploded last.
    """
    names = list(fills)
    cells = ",".join(f"v{i}:string" for i in range(len(names)))
    kind = f"struct<out:array<struct<{cells}>>,{cells}>"
    start = F.struct(F.array().cast(f"array<struct<{cells}>>").alias("out"),
                     *[F.lit("").alias(f"v{i}") for i in range(len(names))]).cast(kind)

    def step(acc, line):
        now = [F.coalesce(_marks(*fills[n])(line), acc[f"v{i}"]).alias(f"v{i}") for i, n in enumerate(names)]
        return F.struct(F.concat(acc["out"], F.array(F.struct(*now))).alias("out"), *now).cast(kind)

    rows = df.select(F.col(key).cast("string").alias("path"), F.split(F.col(text), r"\r?\n").alias("__l"))
    rows = rows.withColumn("__v", F.aggregate("__l", start, step, lambda acc: acc["out"]))
    out = rows.select("path", F.posexplode(F.arrays_zip(F.col("__l").alias("l"), F.col("__v").alias("v"))).alias("__at", "__c"))
    return out.select("path", (F.col("__at") + 1).cast("int").alias("line_no"), F.col("__c.l").alias("line"),
                      *[F.nullif(F.col(f"__c.v.v{i}"), F.lit("")).alias(n) for i, n in enumerate(names)])


def with_sections(lines: DataFrame) -> DataFrame:
    """Lines with their section: as they are if they carry it (``scan_sections``), filled by a window if not."""
    return lines if "section" in lines.columns else fill_section(lines, *SECTION_FILLS["section"][:1], "section")


# ----------------------------------------------------------------- S4

def extract_facts(lines: DataFrame, rules: Sequence[tuple[str, str, str]] = FACT_RULES) -> DataFrame:
    """(path, name, value text) from section-aware line rules."""
    s = with_sections(lines)
    name = None
    value = None
    for sec, pat, nm in rules:
        cond = F.coalesce(F.col("section"), F.lit("")).rlike(sec) & F.col("line").rlike(pat)
        name = F.when(cond, F.lit(nm)) if name is None else name.when(cond, F.lit(nm))
        value = (F.when(cond, F.regexp_extract("line", pat, 1)) if value is None
                 else value.when(cond, F.regexp_extract("line", pat, 1)))
    return (s.select("path", "line_no", name.alias("name"), value.alias("value"))
            .where(F.col("name").isNotNull()))


def extract_pairs(lines: DataFrame, pattern: str = r"([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*\"?([^\"\s,;]+)") -> DataFrame:
    """S4 on free text: every ``name = value`` / ``name: value`` pair of a line, numbered from 1 in it."""
    found = F.arrays_zip(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)).alias("name"),
                         F.regexp_extract_all("line", F.lit(pattern), F.lit(2)).alias("value"))
    return lines.where(F.col("line").rlike(pattern)).select("path", "line_no", F.posexplode(found).alias("__i", "__p")).select(
        "path", "line_no", (F.col("__i") + 1).alias("pair_no"), "__p.name", "__p.value")


# ----------------------------------------------------------------- S5

def _na999(c: Column) -> Column:
    return F.when(c == 999.0, F.lit(None).cast("double")).otherwise(c)


def extract_params(lines: DataFrame) -> DataFrame:
    """Parameter rows with their class and heading; 999 (not applicable) -> NULL."""
    s = with_sections(lines)
    for name in ("class", "header"):
        if name not in s.columns:
            pattern, group, reset = SECTION_FILLS[name]
            s = fill_section(s, pattern, name, group, reset)
    rows = s.where((F.col("section") == "MODEL RESULTS") & F.col("line").rlike(PARAM_ROW))
    g = lambda i: F.regexp_extract("line", PARAM_ROW, i)
    return rows.select("path", "line_no", F.col("class").cast("int").alias("class"), "header",
                       g(1).alias("param"), g(2).cast("double").alias("est"),
                       _na999(g(3).cast("double")).alias("se"), _na999(g(4).cast("double")).alias("est_se"),
                       _na999(g(5).cast("double")).alias("pval"))


# ----------------------------------------------------------------- S7

def extract_class_counts(lines: DataFrame) -> DataFrame:
    """Class, count, proportion for the three bases (model, posterior, most likely)."""
    s = with_sections(lines)
    basis = (F.when(F.col("section").rlike("ESTIMATED MODEL"), "model")
             .when(F.col("section").rlike("POSTERIOR PROBABILITIES"), "posterior")
             .when(F.col("section").rlike("MOST LIKELY"), "most_likely"))
    rows = s.withColumn("basis", basis).where(F.col("basis").isNotNull() & F.col("line").rlike(COUNT_ROW))
    g = lambda i: F.regexp_extract("line", COUNT_ROW, i)
    return rows.select("path", "basis", g(1).cast("int").alias("class"), g(2).cast("double").alias("count"),
                       g(3).cast("double").alias("proportion"))


# ----------------------------------------------------------------- S8

def extract_messages(lines: DataFrame, patterns: Sequence[str] = RELEVANT_WARNINGS,
                     message_line: str = MESSAGE_LINE) -> DataFrame:
    """Warning and error lines (line level, with line number), flagged when they
    match any relevant pattern; known harmless ones get severity 'info'."""
    import re
    relevant = "|".join(re.escape(p) for p in patterns)
    info = "|".join(re.escape(p) for p in INFO_WARNINGS)
    m = lines.where(F.col("line").rlike(message_line) | F.col("line").rlike(relevant))
    return m.select("path", "line_no", F.trim("line").alias("text"),
                    F.col("line").rlike(relevant).alias("relevant"),
                    F.when(F.col("line").rlike(info), "info")
                     .when(F.col("line").rlike("ERROR"), "error").otherwise("warning").alias("severity"))


# ----------------------------------------------------------------- S9

def extract_starts(lines: DataFrame) -> DataFrame:
    """Ranked final-stage log-likelihoods with seed and initial start number."""
    s = with_sections(lines)
    rows = s.where(F.col("section").rlike("RANDOM STARTS RESULTS") & F.col("line").rlike(START_ROW))
    g = lambda i: F.regexp_extract("line", START_ROW, i)
    return rows.select("path", "line_no", g(1).cast("double").alias("ll"), g(2).cast("long").alias("seed"),
                       g(3).cast("int").alias("start"))


# ----------------------------------------------------------------- J5

def flag_distinct(lines: DataFrame, col: str, flag: Column, name: str = "flag") -> DataFrame:
    """Compute an expensive flag once per distinct value, then join it back.

    When the distinct values are few, their digests and flags are broadcast, a
    fixed number of bytes each.  Beyond that the flag is computed on each row: a join
    on the text would send all rows of a common value (the empty line) to one task,
    and costs more than a column expression.
    """
    d = stage(lines.select(col).distinct().select(F.md5(col).alias("__d"), flag.alias(name)), "distinct")
    if d.count() > BROADCAST_ROWS:
        return lines.withColumn(name, F.when(F.col(col).isNotNull(), flag))
    return lines.join(F.broadcast(d), F.md5(col) == F.col("__d"), "left").drop("__d")


# ----------------------------------------------------------------- M14 from reports

FIT_TARGETS = ["Parameters", "LL", "LLCorrectionFactor", "AIC", "BIC", "aBIC", "Entropy", "Observations",
               "T11_KM1LL", "T11_VLMR_PValue", "T11_LMR_PValue", "BLRT_PValue"]
_INT_TARGETS = {"Parameters", "Observations"}


def report_fit_table(lines: DataFrame, targets: Sequence[str] = FIT_TARGETS, model_id: Column | None = None) -> DataFrame:
    """M14 over a folder of reports: one row per report with its fit facts (V2 pivot
    with a fixed target list, text cast to numbers), the parts of its model id (P11),
    most-likely class counts and shares as text (S7 + A1, in class order) and its
    relevant messages collapsed in line order (S8 + A1; NULL when there are none).

    Every input is a per-report aggregate, so each join is one row per report.  The
    lines are staged with their sections, so every report is read and parsed once.
    ``model_id``: where the model id stands, if not at the end of path.
    """
    from trajectra.functions.columns import parse_model_id
    from trajectra.operators.compare import collapse_text
    from trajectra.operators.panel import cast_numeric, facts_to_rows

    lines = stage(with_sections(lines).select("path", "line_no", "line", "section"), "report-lines")
    facts = facts_to_rows(extract_facts(lines), "path", "name", "value", list(targets), "line_no")
    facts = cast_numeric(facts, [t for t in targets if t not in _INT_TARGETS])
    facts = cast_numeric(facts, [t for t in targets if t in _INT_TARGETS], "int")
    parts = parse_model_id(F.col("path") if model_id is None else model_id)
    facts = facts.select("*", *[v.alias(k) for k, v in parts.items() if k != "title"])
    cc = extract_class_counts(lines).where(F.col("basis") == "most_likely")
    counts = collapse_text(cc.withColumn("t", F.format_string("%.0f", F.col("count"))), ["path"], "t", "class",
                           ",", "class_counts")
    shares = collapse_text(cc.withColumn("t", F.format_string("%.3f", F.col("proportion"))), ["path"], "t",
                           "class", ",", "class_shares")
    msgs = extract_messages(lines).where(F.col("relevant"))
    warn = collapse_text(msgs, ["path"], "text", "line_no", ",", "warning")
    return (facts.join(counts, "path", "left").join(shares, "path", "left").join(warn, "path", "left"))


# ----------------------------------------------------------------- M14, incremental

def update_fit_table(spark: SparkSession, folder: str, table: str, glob: str = "*.out", targets: Sequence[str] = FIT_TARGETS,
                     model_id: Column | None = None) -> DataFrame:
    """A stored fit table brought up to date: only reports changed since its last version are read.

    ``table``: a folder of its own; every run that finds changes adds a version below it,
    a whole table keyed by path with each report's change time.  Rows of reports read
    again are replaced, the others are carried over; a run without changes adds none.
    The result has the columns of ``report_fit_table``, and modified.
    """
    from pyspark.errors import AnalysisException
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(table)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted(int(s.getPath().getName()[1:]) for s in (fs.listStatus(at) if fs.exists(at) else [])
                      if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))
    old = spark.read.parquet(f"{table}/v{versions[-1]}") if versions else None
    # a second earlier, as the reader's option has whole seconds; reports seen at that time are left out below
    since = old.agg(F.date_format(F.max("modified") - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0] if old is not None else None
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if since is not None:
        texts = texts.option("modifiedAfter", since)
    try:
        texts = texts.text(folder, wholetext=True)
    except AnalysisException as e:
        if old is None or "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        return old
    found = texts.select(F.url_decode(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    if old is not None:
        seen = old.select(F.col("path").alias("__p"), F.col("modified").alias("__m"))
        found = found.join(seen, (F.col("path") == F.col("__p")) & (F.col("modified") <= F.col("__m")), "left_anti")
    found = stage(found, "changed-reports")
    if found.isEmpty():
        return old if old is not None else report_fit_table(lines_with_sections(found, "path", "value", SECTION_FILLS), targets, model_id).withColumn(
            "modified", F.lit(None).cast("timestamp"))
    new = report_fit_table(lines_with_sections(found, "path", "value", SECTION_FILLS), targets, model_id).join(found.select("path", "modified"), "path")
    if old is not None:
        new = new.unionByName(old.join(found.select("path"), "path", "left_anti"))
    path = f"{table}/v{versions[-1] + 1 if versions else 0}"
    new.write.parquet(path)
    return spark.read.parquet(path)

