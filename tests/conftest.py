from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


#: Parts of test names that take ten seconds and more, or belong to such a file.
SLOW = (
    "tests/llm/", "test_live", "test_similar", "test_large_groups", "test_stream_delivery", "take_evaluation", "two_stage", "target_by", "ingest_plan", "appended_and_never", "takes_to_delivery", "diverse_top",
    "stream", "[live_", "[op", "[pipeline", "wer_pairs", "cer_pairs", "text_normalise", "repeated_ngram", "best_window", "picked_target", "dominant_target", "density_clusters",
)


def pytest_configure(config):
    config.addinivalue_line("markers", "slow: left out by -m 'not slow'")


def pytest_collection_modifyitems(items):
    for item in items:
        if any(part in item.nodeid for part in SLOW):
            item.add_marker("slow")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
