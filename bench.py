"""Headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is executed in full through the ``noop`` sink (no driver transfer);
fits run their whole EM.  A warm-up query runs first so JVM start-up is not
charged to the first headline query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "w1_visit_number",          # W1: visit numbering (group limit before the shuffle)
    "v1_to_wide",               # V1: long -> wide
    "a3_wave_moments",          # A3: moments per wave
    "a4_wave_percentiles",      # A4: exact percentiles (distributed order statistics)
    "a5_coverage",              # A5: covariance coverage
    "flagship_score_classes",   # M5 -> A8/A9 -> M12: score every subject, class curves
    "a13_factor_moments",       # M9 -> A13: factor scores and their moments
    "m4_growth_curve",          # M4: one-class growth curve
    "m6_class_growth",          # M6: two-class growth with random intercept
    "c5_w5_scaled_lr_test",     # M2 + C5: fits and scaled LR tests
    "s6_fill_section",          # S3 + S6: text lines and section fill
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    from trajectra.plans import load_all
    from trajectra.session import build_session
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="trajectra-bench")
    qs = load_all()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    qs["a3_wave_moments"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
    times = {}
    for name in names:
        t0 = time.time()
        qs[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
