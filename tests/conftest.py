import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from reachspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", 4, "tests")


@pytest.fixture(scope="session")
def table(spark):
    """Rows to DataFrame: ``table([(0, 0, 1.0)], "r int, c int, v double")``."""
    from reachspark.session import values_table

    return lambda rows, ddl: values_table(spark, rows, ddl)


@pytest.fixture(scope="session")
def grid_table(spark):
    """A 2-D list or array (None/NaN is NoData) to ``r, c, v``."""

    def make(array, value="v", **extra):
        rows = [(r, c, float(v), *extra.values()) for r, line in enumerate(array) for c, v in enumerate(line) if v is not None and v == v]
        pdf = pd.DataFrame(rows, columns=["r", "c", value, *extra]).astype({"r": "int32", "c": "int32"})
        return spark.createDataFrame(pdf)

    return make


@pytest.fixture(scope="session")
def as_grid():
    """``r, c, value`` back to nested lists, None where absent."""

    def make(df, nrows, ncols, value="v"):
        out = [[None] * ncols for _ in range(nrows)]
        for row in df.collect():
            out[row["r"]][row["c"]] = row[value]
        return out

    return make
