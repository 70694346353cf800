import hashlib
from collections import Counter

from pyspark.sql import functions as F

from normlattice.llm import warc

ROWS = [(i, f"http://h{i % 3}.example.com/{i}", f"<p>é {i}\r\n\r\nWARC/1.0\r\n</p>" * (i % 5)) for i in range(0, 9000, 9)]
ODD = [(None, "u", "x"), (None, None, None), (3, None, "y"), (4, "http://a\r\nb", None), (5, "", ""), (18, ROWS[2][1], ROWS[2][2])]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as idx", "2 as shard", "'z' as hash")


def audited(a, b):
    return [r.asDict() for r in warc.audit(warc.tree(warc.leaves(a)), warc.tree(warc.leaves(b))).collect()]


def brute(a, b):
    """(page_id, status) by the multisets of records of each id."""
    own, other = {}, {}
    for side, rows in ((own, a), (other, b)):
        for r in rows.collect():
            side.setdefault(r.page_id, Counter())[bytes(r.record)] += 1
    out = []
    for k in {*own, *other}:
        x, y = own.get(k, Counter()), other.get(k, Counter())
        gone, new = (x - y).total(), (y - x).total()
        out += [(k, "changed")] if gone == new == 1 else [(k, "missing")] * gone + [(k, "extra")] * new
    return sorted(out, key=str)


def found(rows):
    return sorted(((r["page_id"], r["status"]) for r in rows), key=str)


def test_damage_is_located(spark):
    recs = warc.records(pages(spark, ROWS + ODD))
    assert audited(recs, recs) == []
    got, copy = audited(recs, warc.damaged(recs)), warc.damaged(recs)
    assert found(got) == brute(recs, copy) and {r["status"] for r in got} == {"changed", "missing", "extra"}
    assert found(audited(copy, recs)) == brute(copy, recs)
    cut = {i for i, *_ in ROWS if hashlib.md5(str(i).encode()).hexdigest()[:2] == "01"}
    size = {r.page_id: len(r.record) for r in recs.collect()}
    for r in got:
        if r["status"] == "changed":
            assert r["end"] - r["start"] == size[r["page_id"]]
            assert (r["end"] - r["start"]) - (r["copy_end"] - r["copy_start"]) == (3 if r["page_id"] in cut else 0)


def test_a_lost_or_added_record_moves_no_other(spark):
    recs = warc.records(pages(spark, ROWS))
    first = recs.filter("page_id <> 18")
    assert found(audited(recs, first)) == [(18, "missing")] and found(audited(first, recs)) == [(18, "extra")]
    assert len(audited(recs, recs.filter("shard <> 1"))) == recs.filter("shard = 1").count()
    assert audited(recs.limit(0), recs.limit(0)) == []


def test_repeated_and_missing_ids(spark):
    # a third of the rows share an id, others have none; some repeat in full
    rows = [(7, f"u{i}", "x" * i) for i in range(40)] + [(None, f"u{i}", None) for i in range(40)] + [(7, "u1", "x")] * 3 + [(None, "u1", None)] * 2
    recs = warc.records(pages(spark, rows))
    assert audited(recs, recs.orderBy(F.desc("record"))) == []
    fewer = pages(spark, rows[1:60] + rows[61:-1])
    got = audited(recs, warc.records(fewer))
    assert found(got) == [(7, "missing"), (None, "missing"), (None, "missing")]


def test_files_round_trip(spark, tmp_path):
    recs = warc.records(pages(spark, ROWS + ODD))
    warc.write_warc(recs, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert sorted(bytes(r.record) for r in back.collect()) == sorted(bytes(r.record) for r in recs.collect())
    one = back.filter("seq = 1").first()
    with open(one.file.removeprefix("file:"), "rb") as f:
        assert f.read()[one.start :].startswith(bytes(one.record))
