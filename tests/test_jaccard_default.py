import os

import pytest

from normlattice.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_default_threshold_reports_every_label(spark):
    rows = catalog.QUERIES["jaccard_pairs_default"](spark, SF).collect()
    assert {r.predicted_rel for r in rows} == {"EQUIVALENCE", "OVERLAP", "COMPLEMENTARITY", "NO_RELATION"}
    assert 0.05 <= min(r.score for r in rows) < 0.15
