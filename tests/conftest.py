import os
import time

import pytest

os.environ["TZ"] = "UTC"
time.tzset()

from tonetape.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows from tuples; fields named ``*time*`` or given as stamp are cast from text."""

    def build(rows, schema, stamps=()):
        made = spark.createDataFrame(rows, schema)
        for name in stamps:
            made = made.withColumn(name, made[name].cast("timestamp"))
        return made

    return build
