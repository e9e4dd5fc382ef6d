import os

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

import pytest


@pytest.fixture(scope="session")
def spark():
    from lexforge.session import session

    s = session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
