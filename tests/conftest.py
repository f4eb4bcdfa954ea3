import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="session")
def spark():
    from tidepool.session import local_session

    s = local_session(4, shuffle_partitions=8, app="tidepool-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()

    def at(sf_dir):
        for t in TABLES:
            con.sql(f"create or replace view {t} as select * from '{sf_dir}/{t}.parquet'")
        return con

    return at
