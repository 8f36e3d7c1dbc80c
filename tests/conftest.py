import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ferryload.session import local_session

    session = local_session(cores="8", shuffle_partitions=8, app="tests", checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def one(spark):
    """Value of an expression over a single row given as keyword columns (all as text unless typed)."""

    def evaluate(expression, schema="x string", **values):
        names = [part.strip().split(" ")[0] for part in schema.split(",")]
        frame = spark.createDataFrame([tuple(values.get(n) for n in names)], schema)
        return frame.select(expression.alias("v")).first()["v"]

    return evaluate
