"""The driver contract, the subpackage boundary, and a sample of queries against DuckDB."""

import os
import re
from pathlib import Path

import duckdb
import pytest

from panelmill.queries import registry

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"
SAMPLE = ["p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "market_excess", "capm_alpha_beta", "rank_scale", "momentum_factor", "second_moments_w", "clean_pipeline", "history_json",
          "p5_masks", "edge_spread", "weekly_pipeline", "partitioned_table", "latex_table", "als_rounds_k1", "asset_r2_fixed_gamma", "oos_betas", "correlation_matrix"]


def test_nothing_else_imports_the_llm_subpackage():
    for f in ROOT.glob("panelmill/**/*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"panelmill\.llm|import llm|from \.llm", f.read_text()), f


def test_queries_and_sql_have_the_same_names():
    queries, oracles = registry.core()
    assert set(oracles) <= set(queries) and len(queries) > 90
    assert all(callable(q) for q in queries.values())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    queries, oracles = registry.core()
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    mine, theirs = queries[name](spark, SMALL).toPandas(), con.execute(oracles[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    as_rows = lambda d: sorted(tuple(str(v)[:10] if hasattr(v, "year") else "" if v is None or v != v else str(v) for v in r) for r in d[cols].itertuples(index=False))
    assert as_rows(mine) == as_rows(theirs)
