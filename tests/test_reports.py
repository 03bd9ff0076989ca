"""Report scanning on our own fixture reports."""

import os

import pytest
from pyspark.sql import functions as F

from trajectra.sources import reports as RP

HERE = os.path.join(os.path.dirname(__file__), "fixtures")


@pytest.fixture(scope="module")
def lines(spark):
    return RP.scan_reports(spark, os.path.join(HERE, "reports")).cache()


def test_scan_finds_files_recursively(lines):
    paths = [r[0] for r in lines.select("path").distinct().collect()]
    assert len(paths) == 2
    assert any("sq@0 -2 classes" in p for p in paths)      # file names are URL-decoded
    # lines are numbered from 1 as in the file
    for p in paths:
        with open(p.replace("file://", "").replace("file:", ""), encoding="utf-8") as fh:
            want = fh.read().split("\n")
        got = [r["line"] for r in lines.where(F.col("path") == p).orderBy("line_no").collect()]
        assert got == want
        assert lines.where(F.col("path") == p).agg(F.countDistinct("line_no")).first()[0] == len(want)


def test_sections_inside_the_row_match_the_window(spark, lines):
    one = RP.scan_sections(spark, os.path.join(HERE, "reports")).select("path", "line_no", "section", "class", "header")
    two = lines
    for name, (pattern, group, reset) in RP.SECTION_FILLS.items():
        two = RP.fill_section(two, pattern, name, group, reset)
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, two.select(one.columns).collect()), key=repr)


def test_facts(lines):
    f = {(os.path.basename(r["path"])[:8], r["name"]): r["value"] for r in RP.extract_facts(lines).collect()}
    two = "abc-lcga"
    assert f[(two, "Parameters")] == "9"
    assert f[(two, "LL")] == "-1200.500"
    assert f[(two, "LLCorrectionFactor")] == "1.2500"
    assert f[(two, "aBIC")] == "2415.636"
    assert f[(two, "Entropy")] == "0.750"
    assert f[(two, "Observations")] == "120"
    assert f[(two, "T11_VLMR_PValue")] == "0.0010"
    assert f[(two, "T11_LMR_Value")] == "95.000"
    assert f[(two, "BLRT_PValue")] == "0.0000"
    assert f[("abc-lgca", "LL")] == "-300.250"
    assert ("abc-lgca", "Entropy") not in f                 # one-class report has no class sections


def test_params(lines):
    p = RP.extract_params(lines).where(F.col("path").contains("lcga2")).collect()
    means = {(r["class"], r["param"]): r["est"] for r in p if r["header"] == "Means"}
    assert means[(1, "I")] == 10.0 and means[(2, "S")] == 0.5
    loadings = [r for r in p if r["header"] == "I"]
    assert loadings and all(r["se_"] is None if False else r["est_se"] is None for r in loadings)
    logit = [r for r in p if r["param"] == "C#1"]
    assert logit and logit[0]["class"] is None and logit[0]["est"] == 0.711


def test_class_counts(lines):
    c = {(r["basis"], r["class"]): (r["count"], r["proportion"]) for r in RP.extract_class_counts(lines).collect()}
    assert c[("model", 1)] == (80.5, 0.67083)
    assert c[("posterior", 2)] == (39.5, 0.32917)
    assert c[("most_likely", 1)] == (82.0, 0.68333)


def test_messages_and_starts(lines):
    m = RP.extract_messages(lines).collect()
    texts = [r["text"] for r in m]
    assert any(t.startswith("*** WARNING in MODEL command") for t in texts)
    rep = [r for r in m if "HAS BEEN REPLICATED" in r["text"]]
    assert rep and rep[0]["relevant"] and rep[0]["severity"] == "info"
    s = RP.extract_starts(lines).orderBy("line_no").collect()
    assert [(r["ll"], r["seed"], r["start"]) for r in s] == [(-1200.5, 111111, 7), (-1200.5, 222222, 3),
                                                            (-1203.25, 333333, 9)]


def test_report_fit_table(lines):
    from trajectra.operators.compare import lr_test
    t = RP.report_fit_table(lines).cache()
    rows = {r["family"]: r for r in t.collect()}
    two, one = rows["lcga"], rows["lgca"]
    assert (two["Parameters"], two["LL"], two["Entropy"], two["n_classes"]) == (9, -1200.5, 0.75, 2)
    assert (two["restriction"], two["outcome"]) == ("sq@0", "abc")
    assert two["class_counts"] == "82,38" and two["class_shares"] == "0.683,0.317"
    assert "HAS BEEN REPLICATED" in two["warning"]
    assert (one["Parameters"], one["LL"], one["n_classes"], one["residuals"]) == (6, -300.25, 1, "constrained")
    assert one["Entropy"] is None and one["class_counts"] is None
    # tests between consecutive models of a group work directly on the table
    lr = lr_test(t.withColumnRenamed("LL", "ll").withColumnRenamed("Parameters", "parameters"),
                 ["outcome"], ["n_classes"]).where(F.col("n_classes") == 2).first()
    assert lr["chisq"] == pytest.approx(2 * (-1200.5 - (-300.25))) and lr["dif_df"] == 3


def test_step_gap(lines):
    from trajectra.operators.compare import step_gap
    t = RP.report_fit_table(lines)
    g = step_gap(t, ["outcome"]).where(F.col("n_classes") == 2).first()
    # the two-class fixture prints -1250.000 for its one-class model; the one-class report has -300.250
    assert g["T11_KM1LL"] == -1250.0 and g["ll_prev_own"] == -300.25
    assert g["gap"] == pytest.approx(-949.75)


def test_fit_table_reads_its_reports_once(spark, tmp_path):
    """The table's plan holds no scan of the files (one per fact, count and message rule before); of a repeated fact the first line counts."""
    text = "\n".join(["MODEL FIT INFORMATION", "Number of Free Parameters 7", "          H0 Value -10.500", "          H0 Value -99.500"])
    (tmp_path / "abc-lcga2 - a model - sq@0 -2 classes.out").write_text(text)
    t = RP.report_fit_table(RP.scan_sections(spark, str(tmp_path)))
    assert "FileScan text" not in t._jdf.queryExecution().toString()
    row = t.first()
    assert (row["Parameters"], row["LL"]) == (7, -10.5)


def test_incremental_fit_table(spark, tmp_path):
    """A second run reads nothing, a changed report changes its row only, a new one adds its row."""
    import shutil
    import time
    folder, table = tmp_path / "reports", str(tmp_path / "table")
    shutil.copytree(os.path.join(HERE, "reports"), folder)
    rows = lambda df: {os.path.basename(r["path"]): r.asDict() for r in df.collect()}
    one = rows(RP.update_fit_table(spark, str(folder), table))
    full = rows(RP.report_fit_table(RP.scan_sections(spark, str(folder))))
    assert len(one) == 2 and all({k: v for k, v in one[p].items() if k != "modified"} == full[p] for p in full)
    again = rows(RP.update_fit_table(spark, str(folder), table))
    assert again == one and os.listdir(table) == ["v0"]
    path = next(folder.glob("*.out"))
    time.sleep(1.1)
    path.write_text(path.read_text().replace("-300.250", "-299.125"))
    changed = rows(RP.update_fit_table(spark, str(folder), table))
    assert sorted(os.listdir(table)) == ["v0", "v1"] and changed[path.name]["LL"] == -299.125
    assert all(changed[p] == one[p] for p in one if p != path.name)
    time.sleep(1.1)
    shutil.copy(path, folder / path.name.replace("abc-", "xyz-"))
    more = rows(RP.update_fit_table(spark, str(folder), table))
    assert len(more) == 3 and all(more[p] == changed[p] for p in changed)


def test_pairs_of_a_line(spark):
    df = spark.createDataFrame([("p", 1, "a=1, b = 2; c: \"x y\""), ("p", 2, "none"), ("p", 3, None)], "path string, line_no int, line string")
    got = [(r.line_no, r.pair_no, r.name, r.value) for r in RP.extract_pairs(df).orderBy("line_no", "pair_no").collect()]
    assert got == [(1, 1, "a", "1"), (1, 2, "b", "2"), (1, 3, "c", "x")]


def test_a_long_list_of_phrases(spark):
    import random

    from trajectra.operators import panel as P
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["été", "a.b", "--"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 25))) for _ in range(300)] + [None, "", "xw1 w2 w3y"]
    phrases = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 5))) for _ in range(200)] + ["w1 w2 w3", "--", " w7 ", "", None, "(w1", "2 w3y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:5])], "id int, line string")
    listed = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    for some in (phrases, phrases[:20], ["w1 w2 w3"], []):
        got = P.keep_match_list(df, "line", listed.where(F.col("phrase").isin(some) if some else F.lit(False)))
        want = [i for i, t in enumerate(texts + texts[:5]) if t is not None and any(p and p in t for p in some if p is not None)]
        assert sorted(r.id for r in got.collect()) == want and got.columns == ["id", "line"]
