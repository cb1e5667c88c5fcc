import sys
import uuid
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from holdfast.session import local_session, new_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", 4, "8g")


@pytest.fixture
def folder(spark):
    return new_folder(spark, f"test-{uuid.uuid4().hex[:6]}")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def warehouse(spark, sf):
    from holdfast.plans.warehouse import sample_warehouse

    return sample_warehouse(spark, sf)


def dicts(df, *order):
    """Rows as dicts, ordered on the driver."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[c]) for c in order)) if order else rows
