import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from callspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4)


@pytest.fixture(scope="session")
def kpi_calls(spark):
    return spark.sql(
        """SELECT * FROM VALUES
        (1L, 'connected', 120L, 100.0D, TIMESTAMP_NTZ '2024-01-01', 'agent-1', 'alpha'),
        (2L, 'missed', 60L, 0.0D, TIMESTAMP_NTZ '2024-01-02', 'agent-2', 'beta'),
        (3L, 'connected', 180L, 150.0D, TIMESTAMP_NTZ '2024-01-03', 'agent-1', 'alpha')
        AS t(call_id, outcome, duration, revenue, timestamp, agent_id, campaign)"""
    )
