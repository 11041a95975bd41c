import pytest
from brute import TEXTS


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, very long and repeated texts, repeated and
    null ids, columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 1.0, "x") for i, t in enumerate(TEXTS)]
    rows += [(3, "one", None, None, None, None, None), (3, "one", None, None, None, None, None),
             (None, "no id here", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "score double, fp string").withColumnsRenamed({}) \
        .selectExpr("*", "fp as counts", "fp as found", "fp as kept", "fp as `__row`", "fp as root", "fp as bucket")


@pytest.fixture(scope="session")
def no_docs(edge):
    return edge.limit(0)


@pytest.fixture
def as_table(spark, tmp_path):
    """Writes frames as the tables of a folder and gives its path."""
    def put(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return put
