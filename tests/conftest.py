import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pagesieve.session import build_session  # noqa: E402
from pagesieve.sources.pages import pages_from_html  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(8, shuffle_partitions=4, shared=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def pages(spark):
    return lambda *htmls: pages_from_html(spark, list(htmls))


@pytest.fixture
def value(spark):
    """Evaluate a Column once."""
    return lambda column: spark.range(1).select(column.alias("v")).first()["v"]
