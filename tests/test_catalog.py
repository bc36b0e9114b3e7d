"""Every registered query against its SQL in DuckDB."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from tidemark import catalog
from tidemark.plans import views

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    con = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in con.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_other_queries_have_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_full_bootstraps_draw_1000_replicates(spark, monkeypatch):
    """Against plain Python on three types of four episodes."""
    rows = [(t, f"e{e}", k % 2 == 0, (k * 7 + e * 5 + len(t)) % 3 == 0, (k + e) % 3 == 1) for t in ("a", "bb", "ccc") for e in range(4) for k in range(6)]
    outs = spark.createDataFrame(rows, "question_type string, episode_id string, known boolean, correct boolean, abstained boolean")
    monkeypatch.setattr(views, "outs", lambda *_: outs)

    def h(own):
        ka, ar = [sum(r[c] for r in own if r[2] is k) / sum(1 for r in own if r[2] is k) for k, c in ((True, 3), (False, 4))]
        return 0.0 if ka + ar == 0 else 2 * ka * ar / (ka + ar)

    def drawn(rep, own):
        slots = [int(hashlib.md5(f"{rep}:{turn}".encode()).hexdigest()[:8], 16) % 4 for turn in range(4)]
        return h([r for s in slots for r in own if r[1] == f"e{s}"])

    pooled = sorted(drawn(rep, rows) for rep in range(1000))
    macro = [np.mean([drawn(rep, [r for r in rows if r[0] == t]) for t in ("a", "bb", "ccc")]) for rep in range(1000)]
    want = {"bootstrap_ci_h_full": (pooled[24], pooled[974]), "macro_bootstrap_full": tuple(np.percentile(macro, [2.5, 97.5]))}
    for name, bounds in want.items():
        got = catalog.queries()[name](spark, SF).first()
        assert (got.low, got.high) == pytest.approx(bounds, abs=1e-6) and got.replicates == 1000, name
