import datetime

import pytest

from normlattice import schemas as S
from normlattice.operators import evaluation as E
from normlattice.plans import align
from normlattice.sources import sinks

C, Q, N, O, U = "COMPLEMENTARITY", "EQUIVALENCE", "NO_RELATION", "OVERLAP", "SUBSUMPTION"
# fixed values: published confusion counts of seven methods over 107 labelled pairs
COUNTS = {
    "tfidf": "C->N:22 E->C:1 E->N:2 N->N:22 O->C:1 O->N:50 S->N:9",
    "jaccard": "C->N:22 E->E:1 E->N:2 N->N:22 O->C:4 O->N:46 O->O:1 S->N:9",
    "sentence": "C->C:2 C->N:20 E->C:1 E->N:1 E->O:1 N->N:22 O->C:10 O->N:41 S->N:9",
    "encoder": "C->E:5 C->O:17 E->E:1 E->O:2 N->N:2 N->O:20 O->E:12 O->N:1 O->O:38 S->O:9",
    "domain_encoder": "C->E:22 E->E:3 N->E:22 O->E:51 S->E:9",
    "remote_embedding": "C->C:6 C->O:16 E->E:1 E->O:2 N->C:11 N->O:11 O->C:9 O->O:42 S->C:2 S->O:7",
    "remote_label": "C->C:13 C->N:5 C->O:4 E->C:1 E->N:1 E->O:1 N->C:18 N->N:2 N->O:2 O->C:41 O->N:8 O->O:2 S->C:8 S->O:1",
}
# fixed values: published metrics: precision, recall, F1 of detection; accuracy; macro precision, recall, F1
PUBLISHED = {
    "tfidf": (1.0, 0.0235, 0.0460, 0.2056, 0.0419, 0.2, 0.0693),
    "jaccard": (1.0, 0.0706, 0.1319, 0.2243, 0.4436, 0.2706, 0.1792),
    "sentence": (1.0, 0.1647, 0.2828, 0.2243, 0.0781, 0.2182, 0.0994),
    "encoder": (0.8077, 0.9882, 0.8889, 0.3832, 0.2328, 0.2339, 0.1620),
    "domain_encoder": (0.7944, 1.0, 0.8854, 0.0280, 0.0056, 0.2, 0.0109),
    "remote_embedding": (0.7944, 1.0, 0.8854, 0.4579, 0.3506, 0.2859, 0.2782),
    "remote_label": (0.7802, 0.8353, 0.8068, 0.1589, 0.0971, 0.1442, 0.0847),
}
ERRORS = {"tfidf": (83, 2), "jaccard": (79, 4), "sentence": (71, 12), "encoder": (1, 65), "domain_encoder": (0, 104), "remote_embedding": (0, 58), "remote_label": (14, 76)}
FULL = {"C": C, "E": Q, "N": N, "O": O, "S": "SUBSUMPTION_A_BROADER"}


def expand():
    """Truth and predictions with these counts: each method's cells are dealt to the pairs of their true label."""
    size = {"C": 22, "E": 3, "N": 22, "O": 51, "S": 9}
    ids = {k: [(f"{k}{i}", f"t{i}") for i in range(n)] for k, n in size.items()}
    truth = [(*p, FULL[k], "made up", 1) for k, ps in ids.items() for p in ps]
    preds = []
    for method, cells in COUNTS.items():
        left = {k: iter(ps) for k, ps in ids.items()}
        for cell in cells.split():
            pair, n = cell.split(":")
            a, b = pair.split("->")
            for _ in range(int(n)):
                p = next(left[a])
                if b != "N":
                    preds.append((method, *p, 0.5, FULL[b]))
        assert not any(list(x) for x in left.values())
    return truth, preds


@pytest.fixture(scope="module")
def evaluated(spark):
    truth, preds = expand()
    truth, preds = spark.createDataFrame(truth, S.TRUTH), spark.createDataFrame(preds, S.PREDICTION)
    return truth, align.evaluate(truth, preds, E.method_dimension(spark))


def test_published_metrics(evaluated):
    _, out = evaluated
    d = {r.method: r for r in out["detection"].collect()}
    m = {r.method: r for r in out["macro"].collect()}
    for k, want in PUBLISHED.items():
        got = (d[k].precision, d[k].recall, d[k].f1, m[k].accuracy, m[k].macro_precision, m[k].macro_recall, m[k].macro_f1)
        assert got == pytest.approx(want, abs=1.01e-4), k
        assert d[k].positive_pairs == 85 and d[k].negative_pairs == 22
        assert d[k].true_positives + d[k].false_negatives == 85


def test_errors(evaluated):
    _, out = evaluated
    got = {(r.method, r.error_type): r.n for r in E.value_counts(out["errors"], "method", "error_type").collect()}
    assert got == {(m, t): n for m, ns in ERRORS.items() for t, n in zip(("FALSE_NEGATIVE", "WRONG_LABEL"), ns) if n}
    strict = E.error_analysis(out["comparison"], strict=True).filter("error_type = 'FALSE_POSITIVE_ON_NEGATIVE'")
    assert strict.count() == 20 + 22 + 22 + 20


def test_best_method_and_report(spark, evaluated):
    truth, out = evaluated
    dim = E.method_dimension(spark)
    assert E.best_method(out["macro"], dim).first().method == "remote_embedding"
    rows = [r.method for r in E.report_rows(out["detection"], out["macro"], dim).collect()]
    assert rows == S.METHOD_ORDER
    text = sinks.markdown_report(out["summary"], S.METHOD_ORDER, truth, datetime.date(2020, 1, 2))
    assert "107 (85 related, 22 not)" in text and "2020-01-02" in text
    assert "| tfidf | 100.0% |" in text and "Best by macro-F1: remote_embedding" in text
    tie = spark.createDataFrame([("encoder", 0.5), ("tfidf", 0.5)], "method string, macro_f1 double")
    assert E.best_method(tie, dim).first().method == "tfidf"


def test_edges(spark):
    truth = spark.createDataFrame([("a", "x", O), ("b", "x", N), ("c", "x", Q)], "src_id string, tgt_id string, relationship string")
    preds = spark.createDataFrame(
        [("m", "a", "x", N, 1), ("m", "a", "x", O, 0), ("m", "z", "z", O, 2), ("m", "c", "x", "SUBSUMPTION_B_BROADER", 3)],
        "method string, src_id string, tgt_id string, predicted_rel string, ord int",
    )
    methods = spark.createDataFrame([("m",), ("none",)], "method string")
    d = {r.method: r for r in E.detection_metrics(truth, preds, methods).collect()}
    assert (d["m"].true_positives, d["m"].predicted_pairs) == (2, 2)  # any prediction counts, others' pairs don't
    assert (d["none"].precision, d["none"].recall, d["none"].f1) == (0, 0, 0)
    pairs = E.compared(truth, preds, methods)
    got = {(r.method, r.src_id): r.pred_rel for r in pairs.collect()}
    assert got["m", "a"] == N and got["m", "c"] == U and got["none", "c"] == N  # the last one counts
    # without ord a repeated pair still counts once, by the last label in the alphabet
    loose = E.compared(truth, preds.drop("ord"), methods)
    assert loose.count() == 6 and {r.src_id: r.pred_rel for r in loose.filter("method = 'm'").collect()} == {"a": O, "b": N, "c": U}
    labels = {r.label for r in E.class_metrics(E.confusion_matrix(pairs)).filter("method = 'm'").collect()}
    assert labels == {O, N, Q}
    assert E.error_analysis(pairs.limit(0)).count() == 0


def test_sets(spark):
    a = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", "x")], "src_id string, tgt_id string")
    b = spark.createDataFrame([("2", "x"), ("3", "x")], "src_id string, tgt_id string")
    ids = lambda df: sorted(r.src_id for r in df.collect())
    assert (ids(E.pair_union(a, b)), ids(E.pair_intersect(a, b)), ids(E.pair_except(a, b))) == (["1", "2", "3"], ["2"], ["1"])
