from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with a few columns more, whose names the operators use themselves."""

    def make(rows, extra=True):
        full = [(d, t, "en", s, None if t is None else len(t)) for d, t, s in [(*r, "s0")[:3] for r in rows]]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("pos", "word", "h1", "slice", "fp", "key", "length", "component_id", "size", "shard", "n", "dropped", "__lines", "__doc", "__own", "row", "keeper"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df.repartition(3)

    return make
