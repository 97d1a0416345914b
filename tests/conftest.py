import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from scangrove.session import local_session

    session = local_session(8, 4, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    from scangrove.schemas import FILES

    def make(rows, repo="r"):
        """Rows of (path, language, content) as a files table."""
        return spark.createDataFrame(
            [(repo, i, p, lang, len(c.encode()), c) for i, (p, lang, c) in enumerate(rows)], FILES,
        )
    return make
