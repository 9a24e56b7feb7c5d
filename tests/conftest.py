import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from spectralake.session import build

    return build("tests", "local[*]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
