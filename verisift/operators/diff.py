"""Differences of two texts. The matching algorithm (Ratcliff-Obershelp, as in difflib) has no native form: one Arrow function over pairs."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_COUNTS = ["lines_added", "lines_removed", "lines_unchanged", "chars_added", "chars_removed"]
DIFF_TYPE = T.StructType([*(T.StructField(c, T.IntegerType()) for c in _COUNTS), T.StructField("identical", T.BooleanType()), T.StructField("diff_ratio", T.DoubleType()), T.StructField("summary", T.StringType()), T.StructField("unified_diff", T.StringType())])
_ARROW = to_arrow_type(DIFF_TYPE)


def compare(a: str, b: str, name_a: str, name_b: str, *, fix_headers: bool = False) -> dict:
    """Counts, ratio, summary and unified diff of two texts. By default header lines run together, as line ends are kept in the lines only."""
    left, right = a.splitlines(keepends=True), b.splitlines(keepends=True)
    out: dict = dict.fromkeys(_COUNTS, 0)
    if left == right:
        return out | {"lines_unchanged": len(left), "identical": True, "diff_ratio": 1.0, "summary": "Files are identical", "unified_diff": ""}
    matcher = difflib.SequenceMatcher(None, left, right)
    ratio = round(matcher.ratio(), 3)
    for tag, i1, i2, j1, j2 in matcher.get_opcodes():
        if tag == "equal":
            out["lines_unchanged"] += i2 - i1
            continue
        out["lines_removed"] += i2 - i1
        out["lines_added"] += j2 - j1
        out["chars_removed"] += sum(map(len, left[i1:i2]))
        out["chars_added"] += sum(map(len, right[j1:j2]))
    said = [f"+{out['lines_added']} lines added"] * bool(out["lines_added"]) + [f"-{out['lines_removed']} lines removed"] * bool(out["lines_removed"]) + [f"{out['lines_unchanged']} unchanged"] * bool(out["lines_unchanged"])
    unified = "".join(difflib.unified_diff(left, right, fromfile=name_a, tofile=name_b, lineterm="\n" if fix_headers else ""))
    return out | {"identical": False, "diff_ratio": ratio, "summary": ", ".join([*said, f"{int(ratio * 100)}% similar"]), "unified_diff": unified}


def _differ(fix_headers: bool):
    @F.arrow_udf(DIFF_TYPE)
    def differ(a: pa.Array, b: pa.Array, name_a: pa.Array, name_b: pa.Array) -> pa.Array:
        clean = lambda x: (x or "").replace("\r\n", "\n").replace("\r", "\n")
        return pa.array([compare(clean(w), clean(x), str(y), str(z), fix_headers=fix_headers) for w, x, y, z in zip(*(c.to_pylist() for c in (a, b, name_a, name_b)))], _ARROW)

    return differ


def diff_pairs(pairs: DataFrame, *, fix_headers: bool = False) -> DataFrame:
    """pairs: path_a, path_b, text_a, text_b. Null text is a file without lines."""
    diff = _differ(fix_headers)(F.col("text_a"), F.col("text_b"), F.col("path_a").cast("string"), F.col("path_b").cast("string"))
    return pairs.select("path_a", "path_b", diff.alias("d")).select("path_a", "path_b", "d.*")
