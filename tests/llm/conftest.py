import pytest

from gridloom.session import local_session

# Texts that break careless code: null, empty, white space, repeats, signs of all widths, a very long word and text.
ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n\t \r\x0b\x0c"), (5, "a"), (6, "a"), (7, "A  b\u00a0c\u2028d  \u3000e"), (8, "x" * 5000),
    (9, "déjà vu — naïve \U0001f600 ok 's 're\n\n  end  "), (10, "word " * 3000), (11, "\u0000\u0001 |endoftext| <|endoftext|> \u202f"), (None, "no id"),
    (5, "a"), (12, "日本語 テキスト と spaces in between"), (13, "tail space "), (14, " head space"), (15, "a" * 70000 + " b"),
]


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores="4", shuffle_partitions=4)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with odd texts and a column whose name clashes with results."""
    rows = [(i, t, "en" if t and len(t) > 1 else None, None if k % 5 == 0 else f"s{k % 2}", 7) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "1 as kept", "2 as start", "'x' as part", "3 as tokens", "4 as key", "5 as row_id", "6 as weight"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def compare(spark):
    """Run a registered query beside its SQL over the tables of a folder; the difference as text."""
    import duckdb

    import __spark_entry__ as entry
    from check import TABLES, differences, normal

    def run(name, folder):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        return differences(normal(entry.queries()[name](spark, folder).toPandas()), normal(con.execute(entry.oracle_sql()[name]).df()))

    return run
