import pytest

from tessera.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def texts():
    """Rows (doc_id, text) with every awkward case: nulls, empty and blank texts,
    repeated rows, one very long text, separators other than ASCII white space."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    base = " ".join(f"alpha{i}" for i in range(60))
    return [
        (1, base), (2, base), (3, base + " tail of its own here"), (4, None), (5, ""), (6, " \t\n "),
        (7, "one two"), (8, "ONE two"), (9, long), (10, long + " end"), (11, "a b c d \x1c e"),
        (12, "rep " * 100), (None, base), (13, "Grüße aus Köln\nzweite Zeile\r\ndritte Zeile"), (7, "one two"),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The awkward rows with extra columns that clash with names used inside the operators."""
    return spark.createDataFrame([(i, t, "x", i, None) for i, t in texts],
                                 "doc_id long, text string, id string, n long, component string")
