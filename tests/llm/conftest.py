import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Documents with columns that operators don't know, some with clashing names."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long, fp string, th int, component_id string"):
        width = len(schema.split(","))
        return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)

    return make
