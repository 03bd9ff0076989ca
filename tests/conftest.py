import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


def pytest_sessionfinish(session, exitstatus):
    """A skipped test is missing evidence: it fails the run."""
    skipped = session.config.pluginmanager.get_plugin("terminalreporter").stats.get("skipped", [])
    if skipped and exitstatus == 0:
        session.exitstatus = 1

@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trajectra-test-ckpt-", dir="/tmp"))
    yield s


PANEL_WAVES = 9


def made_panel(n: int = 500, seed: int = 11):
    """Two trajectory classes with a random intercept, over nine waves of whole scores; subjects drop out, miss waves
    in between, and some share their scores."""
    import numpy as np
    rng = np.random.default_rng(seed)
    t = np.arange(PANEL_WAVES)
    rows = []
    for i in range(n):
        k = rng.random() < 0.2
        a = (24.0, -1.6, -0.1) if k else (27.5, -0.1, -0.02)
        y = np.round(a[0] + a[1] * t + a[2] * t * t + rng.normal(0, 1.5) + rng.normal(0, 1.2 + 0.1 * t))
        last = rng.integers(1, PANEL_WAVES + 1)
        gone = (t >= last) | (rng.random(PANEL_WAVES) < 0.1)
        if i % 50 == 7:
            gone[:] = t > 2
            y[:3] = (28, 27, 29)                       # equal score vectors
        if gone.all():
            gone[0] = False
        rows.append((i + 1, *[None if g else float(v) for v, g in zip(y, gone)]))
    return rows


@pytest.fixture(scope="session")
def wide_panel(spark):
    cols = ", ".join(f"y_{w} double" for w in range(PANEL_WAVES))
    return spark.createDataFrame(made_panel(), f"subject long, {cols}").cache()
