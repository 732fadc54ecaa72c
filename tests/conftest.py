import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session, ship

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows_of(pdf):
    """The rows of a pandas frame, columns by name, as a sorted list of comparable texts."""
    import pandas as pd

    pdf = pdf[sorted(pdf.columns)]

    def cell(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        return None if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x) else x

    return sorted(repr(tuple(cell(x) for x in r)) for r in pdf.itertuples(index=False, name=None))
