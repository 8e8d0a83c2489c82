import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from webtrail.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


REQUEST_SCHEMA = ("ip string, epoch long, tz int, method string, uri string, leaf string, status int, size long,"
                  " referrer string, agent string, source string, pos long")


@pytest.fixture(scope="session")
def make_requests(spark):
    """Requests from short tuples: (ip, epoch, method, uri, status[, agent, size, tz])."""
    def make(rows):
        out = []
        for i, row in enumerate(rows):
            ip, epoch, method, uri, status, *rest = row
            agent, size, tz = (list(rest) + ["Mozilla/5.0", 100, 0][len(rest):])
            leaf = uri.split("?")[0].split("#")[0].rstrip("/").rsplit("/", 1)[-1].lower()
            out.append((ip, epoch, None if epoch is None else tz, method, uri, leaf, status, size, "-", agent, "/l/access.log", i))
        return spark.createDataFrame(out, REQUEST_SCHEMA)

    return make
