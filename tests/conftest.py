import math
import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def spark():
    from lodestrand.session import local_session

    s = local_session(8, "tests", memory="6g", spark__sql__shuffle__partitions="4", spark__sql__adaptive__coalescePartitions__initialPartitionNum="4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        if name.endswith(".parquet"):
            c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def bag(rows):
    return Counter(repr(tuple(map(plain, r))) for r in rows)


@pytest.fixture(scope="session")
def same():
    """Compares a query with its SQL: column names and rows, without order."""

    def check(df, duck, sql):
        cols = sorted(df.columns)
        rel = duck.sql(sql)
        assert cols == sorted(rel.columns)
        a = bag(df.select(*[f"`{c}`" for c in cols]).collect())
        b = bag(duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql.strip().rstrip(';')})").fetchall())
        assert a == b, (list((a - b))[:3], list((b - a))[:3])

    return check
