import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_library():
    """Python workers start in another process, which learns of the repository by its environment."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (root, os.environ.get("PYTHONPATH")) if x)
