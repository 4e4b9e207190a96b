import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plumbline.session import build_session, release  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session("tests", cores="4", partitions=4, spark__checkpoint__dir=str(shared))
    yield session
    release(session)
    session.stop()


@pytest.fixture
def frame(spark):
    """Evaluation rows from (y_true, probability) pairs, predicted at 0.5 or at a given threshold."""

    def make(pairs, threshold=0.5, **columns):
        rows = []
        for i, (truth, p) in enumerate(pairs):
            guess = None if p is None else str(int(p >= threshold))
            rows.append((i, str(truth), guess or "0", p, *[v[i] for v in columns.values()]))
        extra = "".join(f", `{c}` string" for c in columns)
        return spark.createDataFrame(rows, f"row_id long, y_true string, y_pred string, y_probability double{extra}")

    return make


@pytest.fixture
def values():
    """metric -> value of a long measurement table."""
    return lambda df: {r.metric: r.value for r in df.collect()}
