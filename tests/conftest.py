import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from millrace.session import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session("4", 4, "3g", **{"spark.sql.warehouse.dir": "/tmp/millrace-warehouse"})
    ship(made)
    yield made
    made.stop()
