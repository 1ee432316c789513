import os

import duckdb
import pytest
from oracle import DATA

FOLDER = f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def rows():
    """``rows("documents", "doc_id, text")``: rows of a table of the test data, read without Spark."""
    if not os.path.isdir(FOLDER):
        pytest.skip("test data not present")
    return lambda name, columns: duckdb.sql(f"SELECT {columns} FROM '{FOLDER}/{name}.parquet'").fetchall()


@pytest.fixture(scope="session")
def folder(rows):
    return FOLDER
