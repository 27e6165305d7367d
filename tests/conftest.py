import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ.setdefault("OMP_NUM_THREADS", "1")  # before numpy is loaded: its threads would contend with Spark's
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for Spark's workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from groupstats.session import local_session

    folder = tmp_path_factory.mktemp("checkpoint")
    session = local_session(
        "8", 4, **{"spark.checkpoint.dir": str(folder), "spark.driver.memory": "8g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def heavy_everything(spark):
    """Every group of two rows is heavy and every fitted table is large."""
    from groupstats.session import HEAVY_ROWS, SMALL_ROWS

    spark.conf.set(HEAVY_ROWS, "1")
    spark.conf.set(SMALL_ROWS, "1")
    yield
    spark.conf.unset(HEAVY_ROWS)
    spark.conf.unset(SMALL_ROWS)
