import os
import re

import pytest

from normlattice.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(catalog.QUERIES["score_labels"](spark, SF)))
    assert [sorted(c.split(":")[0] for c in r.split(",")) for r in read] == [["l_discount", "l_linenumber", "l_orderkey", "l_tax"]]
    text = plan(catalog.QUERIES["pair_except"](spark, SF))
    assert "html" not in text and "text:string" not in text


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[[^\]]*Not\(EqualTo\(lang,fr\)\)", plan(catalog.QUERIES["comparison"](spark, SF)))


@pytest.mark.parametrize("name", ["jaccard_pairs", "tfidf_pairs"])
def test_lexical_pairs_meet_on_terms(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and not re.search("Python|Pandas|Arrow", text)


def test_only_dense_vectors_and_models_use_python(spark):
    for name, f in catalog.QUERIES.items():
        assert bool(re.search("Python|Pandas|InArrow", plan(f(spark, SF)))) == (name in ("cosine_pairs", "topk_pairs")), name
