import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelmill.session import get_spark


@pytest.fixture(scope="session")
def spark():
    """Many small partitions are kept, so that groups do lie in several shards."""
    return get_spark(8, 6, **{"spark.sql.adaptive.coalescePartitions.enabled": "false"})
