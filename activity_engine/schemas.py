"""Schemas of the activity logs by dataset version. Columns not listed as numbers are text."""

from __future__ import annotations

from pyspark.sql import types as T

VERSIONS = ("r4.1", "r4.2", "r5.1", "r5.2", "r6.1", "r6.2")

# Column names in file order.
_BASE = "id date user pc"
_COLUMNS = {
    4: {
        "logon": f"{_BASE} activity",
        "device": f"{_BASE} activity",
        "http": f"{_BASE} url content",
        "email": f"{_BASE} to cc bcc from size n_att content",
        "file": f"{_BASE} filename content",
    },
    5: {
        "logon": f"{_BASE} activity",
        "device": f"{_BASE} content activity",
        "http": f"{_BASE} url content",
        "email": f"{_BASE} to cc bcc from activity size att content",
        "file": f"{_BASE} filename activity to from content",
    },
    6: {
        "logon": f"{_BASE} activity",
        "device": f"{_BASE} content activity",
        "http": f"{_BASE} url activity content",
        "email": f"{_BASE} to cc bcc from activity size att content",
        "file": f"{_BASE} filename activity to from content",
    },
}
ACTIVITY_TYPES = ("logon", "device", "http", "email", "file")
_INTS = {"size", "n_att"}


def log_schema(version: str, activity: str) -> T.StructType:
    """The schema of one activity file of a dataset version such as r4.2."""
    names = _COLUMNS[int(version[1])][activity].split()
    return T.StructType([T.StructField(n, T.IntegerType() if n in _INTS else T.StringType()) for n in names])


def employee_schema(version: str) -> T.StructType:
    names = "employee_name user_id email role project business_unit functional_unit department team supervisor".split()
    if version[1] == "4":
        names.remove("project")
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


PSYCHOMETRIC = T.StructType([T.StructField("employee_name", T.StringType()), T.StructField("user_id", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in "OCEAN"]])
INSIDERS = T.StructType([T.StructField(n, T.StringType()) for n in "dataset scenario details user start end".split()])
SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in "user max_z_score is_actual_insider".split()])
COMMUNICATION = T.StructType([T.StructField("kind", T.StringType()), T.StructField("mb", T.DoubleType())])
