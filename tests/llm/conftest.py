import duckdb
import pytest

from studyloom.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def texts():
    """Texts every text operator must take: null, empty, odd and long ones, and repeats."""
    return [None, "", " \t\n", "!?", "a", "Grüße, señor 你好", "one two three four five six", "one two three four five six", "x" * 5000, "word " * 4000, "tab\tand\x0bline\x0cfeeds\r\nhere"]

