import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
# Python workers import the operators from here
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(HERE)), os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep)


@pytest.fixture(scope="session")
def awkward(spark):
    import llm_rows

    return spark.createDataFrame(llm_rows.awkward_rows(), llm_rows.SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    import llm_rows

    return spark.createDataFrame([], llm_rows.SCHEMA)
