import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from keystrata.session import local_session

    session = local_session(4, **{"spark_sql_shuffle_partitions": "4", "spark_driver_memory": "4g", "spark_sql_streaming_stateStore_providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    yield session
    session.stop()
