"""Registered queries against their SQL twins. The numeric audits and the whole plans take
minutes; they run when FULL_ORACLE is set, or with ``python tests/oracle.py``."""
import os

import pytest
from oracle import compare, duck

from tabaudit.catalog import all_queries, all_sql

SLOW = ("q_numeric", "q_crossfit", "q_refine", "q_dedupe", "q_demote_natural", "q_mirrors", "q_rank_findings", "q_cap", "q_apply_all", "q_window_growth",
        "q_merge", "q_demote_windows", "q_rough", "q_profile", "q_panel_load", "q_cross_summ", "q_ks_pair", "q_offsets", "q_collapse", "q_split3_exact",
        "q_fd_violation", "q_corrupt_quantile", "q_robust_z", "q_repair_sql", "q_overwrite", "q_align_key", "q_cell_report_by_key")
FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
NAMES = [n for n in all_sql() if os.environ.get("FULL_ORACLE") or not n.startswith(SLOW)]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert compare(all_queries()[name](spark, FOLDER), con, all_sql()[name]) is None


def test_every_twin_has_a_query():
    assert set(all_sql()) <= set(all_queries())
