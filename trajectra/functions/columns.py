"""Column functions (return a Column) for ids, recodes and keys."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_number(pos: Column, width: int) -> Column:
    """P10: 1-based block of a 1-based position: floor((pos - 1) / width) + 1."""
    return (F.floor((pos - 1) / F.lit(width)) + 1).cast("int")


def recode(col: Column, cases: Sequence[tuple[Column, object]], default=None) -> Column:
    """CASE WHEN cond THEN value ... ELSE default (a NULL test falls to the default)."""
    out = None
    for cond, val in cases:
        v = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(d) if out is not None else d


def list_rank(col: Column, values: Sequence) -> Column:
    """1-based place of a value in a list, len(list)+1 when absent (W6 helper)."""
    out = None
    for i, v in enumerate(values, start=1):
        out = F.when(col == F.lit(v), F.lit(i)) if out is None else out.when(col == F.lit(v), F.lit(i))
    return out.otherwise(F.lit(len(values) + 1)) if out is not None else F.lit(1)


def digits(col: Column) -> Column:
    """Keep only the digits of a text."""
    return F.regexp_replace(col, r"\D", "")


def combine_key(*cols: Column | str, sep: str = ".") -> Column:
    """One group key from several columns (text, NULL parts skipped)."""
    return F.concat_ws(sep, *[F.col(c) if isinstance(c, str) else c for c in cols])


# Fixed file-name grammar of a model report, e.g.
#   "abc-lcga2 - unconditional quadratic model - sq@0 -2 classes-residuals unconstrained.out"
#   "xyz-lgca1 - unconditional linear    model-residuals   constrained.out"
MODEL_ID_PATTERN = (
    r"^([A-Za-z]+)-([a-z_]+?)(\d)?"                          # 1 outcome, 2 family, 3 degree
    r"\s*-\s*(unconditional\s+\w+\s+model)"                 # 4 title
    r"(?:\s*-\s*(.{3,4}?)\s*-(\d+)\s+classes)?"              # 5 restriction, 6 classes
    r"\s*-\s*residuals\s+(\w+)"                              # 7 residuals
)

_GROUPS = ["outcome", "family", "degree", "title", "restriction", "classes", "residuals"]


def parse_model_id(col: Column) -> dict[str, Column]:
    """Split a model file name into its parts by regex (never fixed offsets).

    Returns columns outcome, family, degree, title, restriction, n_classes,
    residuals.  Parts that are absent are NULL; one-class growth curves (no
    ``classes`` part) get n_classes = 1.  All parts of a name outside the grammar
    are NULL, its number of classes too.
    """
    base = F.regexp_replace(col, r"^.*/", "")
    out = {}
    for i, g in enumerate(_GROUPS, start=1):
        v = F.regexp_extract(base, MODEL_ID_PATTERN, i)
        out[g] = F.when(v == "", F.lit(None).cast("string")).otherwise(F.trim(v))
    out["n_classes"] = F.when(base.rlike(MODEL_ID_PATTERN), F.coalesce(out.pop("classes").cast("int"), F.lit(1)))
    out["outcome"] = F.lower(out["outcome"])
    return out
