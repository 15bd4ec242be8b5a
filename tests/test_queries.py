import subprocess
import sys

import pytest
from rows import same_rows

from paramspark import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_equals_sql(spark, duck, small, name):
    same_rows(Q.QUERIES[name](spark, small).toPandas(), duck.sql(Q.ORACLE_SQL[name]).df())


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_does_not_need_the_training_data_operators():
    hide = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['paramspark.llm'] = None\n"
    code = hide + "import importlib.abc\nimport paramspark.queries, paramspark.jobs, paramspark.streaming.jobs; print(len(paramspark.queries.QUERIES))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0]).stdout) > 50
