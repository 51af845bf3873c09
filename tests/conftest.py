import os
import sys

# One thread per process: the linear algebra library's thread pool does not survive the start of the JVM.
for name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(name, "1")

import pytest  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.harness import make_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = make_spark("4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
