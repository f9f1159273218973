import pytest

from lodeseek.llm import queries
from tests.compare import same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


def test_linked_secrets_in_sql(spark, tmp_path):
    """The test tables hold few access identifiers; these documents link all kinds of parts."""
    import random

    rng = random.Random(9)
    parts = ["AKIA" + "B7C8" * 4, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "https://e.example/x", "Token='abcdefgh'", "é", "0123456789abcdef" * 2, "f" * 40]
    data = [(i, "".join(rng.choice([*parts, " y" * rng.randint(1, 250)]) + " " for _ in range(12))) for i in range(60)] + [(99, None)]
    spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    same(queries.op8_secret_scan(spark, str(tmp_path)), queries.OP8_SQL, str(tmp_path))
