import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session, ship  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = ship(build_session("tests", f"local[{os.environ.get('TEST_CPUS', '4')}]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__adaptive__coalescePartitions__parallelismFirst="false"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the driver's tables as views."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}"
        con.execute(f"CREATE VIEW \"{f.split('.')[0]}\" AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(rows, expected):
    """Equal as multisets, floats within 1e-9."""

    def norm(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, float):
            return "None" if v != v else f"{v:.9g}"
        if hasattr(v, "item"):
            return norm(v.item())
        return str(v)

    a, b = (sorted(tuple(norm(x) for x in r) for r in t) for t in (rows, expected))
    assert a == b
