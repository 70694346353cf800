"""WARC records and a Merkle fixity audit of their replicas, in DataFrame functions.

Pages become WARC/1.0 records. A record's place follows from its page id alone: 2 ** SHARD_BITS ids
are a shard, and the lowest bits the slot in it; pages without an id are dealt to buckets and slots
by a hash of the record. So a lost or added record moves no other. A place's leaf is the SHA-256 of
its record; of several records (a repeated id) it is a hash of the sum of their hashes, which
partial aggregation finds, so no task gathers the records of an id. A node hashes its FANOUT
children's hashes and the lengths of the ranges that they cover, in order. An audit compares the
nodes at the top of each shard and follows only those that differ, level by level, down to the
places and the records in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
#: Page ids of a shard: 2 ** SHARD_BITS, a power of FANOUT.
SHARD_BITS = 12
LEVELS = SHARD_BITS // FANOUT_BITS
#: Buckets of pages without an id.
BUCKETS = 1 << 20
DATE = "1970-01-01T00:00:00Z"
SHARD = ("shard", "bucket")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """(page_id, shard, bucket, slot, record): WARC response records as binary, each with its place.

    Null url: no target; null html: no content. Pages without an id have a null shard and a bucket;
    others bucket 0. Repeated rows stay. Empty input: empty result. Other columns are ignored.
    """
    url, html = F.col(url_col).cast("string"), F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    name = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), url))
    uuid = F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    crlf = "\r\n"
    head = F.concat(
        F.lit(f"WARC/1.0{crlf}WARC-Type: resource{crlf}WARC-Record-ID: <urn:uuid:"),
        uuid,
        F.lit(f">{crlf}WARC-Date: {date}{crlf}"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, "[\r\n]", ""), F.lit(crlf)), F.lit("")),
        F.lit(f"Content-Type: text/html{crlf}Content-Length: "),
        F.octet_length(html).cast("string"),
        F.lit(crlf * 2),
    )
    record = F.concat(head, html, F.lit(crlf * 2)).cast("binary")
    return placed(pages.select(F.col(id_col).alias("page_id"), record.alias("record")))


def placed(recs: DataFrame) -> DataFrame:
    """(page_id, record) with the shard, bucket and slot of each."""
    page = F.col("page_id").cast("long")
    digest = F.xxhash64("record")
    last = F.lit((1 << SHARD_BITS) - 1).cast("long")
    return recs.select(
        "page_id",
        F.shiftright(page, SHARD_BITS).alias("shard"),
        F.when(page.isNull(), F.pmod(digest, F.lit(BUCKETS))).otherwise(0).cast("long").alias("bucket"),
        F.coalesce(page, F.shiftrightunsigned(digest, 32)).bitwiseAND(last).alias("slot"),
        "record",
    )


def write_warc(recs: DataFrame, path: str) -> None:
    """Writes records as WARC files in a folder for each shard, ordered by page."""
    body = F.call_function("substring", F.decode("record", "utf-8"), F.lit(1), F.char_length(F.decode("record", "utf-8")) - 2)  # the writer ends each record with the last one
    rows = recs.repartition(*SHARD).sortWithinPartitions(*SHARD, "page_id", F.sha2("record", 256))
    rows.select("shard", body.alias("value")).write.partitionBy("shard").option("lineSep", "\r\n").text(path)


def read_warc(spark, path: str) -> DataFrame:
    """(file, seq, start, record) of the WARC files under path; what isn't a record ends a file.

    A file is one task's row, so it must fit a worker; write_warc makes one for each shard of 2 ** SHARD_BITS ids.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = list(parse(content.as_py()))
                cols = [[file] * len(rows), list(range(len(rows))), [a for a, _ in rows], [r for _, r in rows]]
                types = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["file", "seq", "start", "record"])

    return files.mapInArrow(run, "file string, seq long, start long, record binary")


def parse(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each record of a WARC file."""
    at = 0
    while raw.startswith(b"WARC/", at):
        end = raw.find(b"\r\n\r\n", at)
        fields = dict(x.split(b": ", 1) for x in raw[at:end].split(b"\r\n")[1:] if b": " in x)
        if end < 0 or not fields.get(b"Content-Length", b"").isdigit():
            return
        stop = end + 4 + int(fields[b"Content-Length"]) + 4
        yield at, raw[at:stop]
        at = stop


def leaves(recs: DataFrame) -> DataFrame:
    """(shard, bucket, slot, page_id, hash, size, n): the different records of each place, n times each.

    Records without an id have a bucket in place of a shard; ids may repeat, as may whole rows. The
    order of rows doesn't matter. Empty input: empty result.
    """
    hashed = recs.select(*SHARD, "slot", "page_id", F.sha2("record", 256).alias("hash"), F.octet_length("record").cast("long").alias("size"))
    return hashed.groupBy(*hashed.columns).agg(F.count("*").alias("n"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """The records of leaves(), then the levels of the trees: (shard, bucket, idx, hash, size, start).

    Level 1 has a node for each place, the last one for each shard. A shard has at most
    2 ** SHARD_BITS places, whatever the number of records. No records: empty levels.
    """
    levels = [materialise(leaf, "leaves")]
    part = lambda at: F.sum(F.conv(F.substring("hash", at, 15), 16, 10).cast("decimal(20,0)") * F.col("n"))
    total = F.sum("n")
    many = F.sha2(F.concat_ws(":", *(part(1 + 15 * i) for i in range(4)), total), 256)
    place = levels[0].groupBy(*SHARD, F.col("slot").alias("idx"))
    place = place.agg(F.when(total == 1, F.max("hash")).otherwise(many).alias("hash"), F.sum(F.col("size") * F.col("n")).alias("size"))
    before = Window.partitionBy(*SHARD).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    levels.append(materialise(place.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))), "places"))
    for _ in range(LEVELS):
        child = F.struct("idx", "hash", "size")
        up = levels[-1].groupBy(*SHARD, F.shiftright("idx", FANOUT_BITS).alias("idx"))
        up = up.agg(F.array_sort(F.collect_list(child)).alias("c"), F.min("start").alias("start"))
        text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x.idx, x.hash, x["size"])), ",")
        size = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x["size"])
        levels.append(materialise(up.select(*SHARD, "idx", F.sha2(text, 256).alias("hash"), size.alias("size"), "start"), "nodes"))
    return levels


def _met(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of a and b with equal keys (null equal to null) in one row, values as a_ and b_; a full join."""
    a = a.select(F.struct(*(F.coalesce(k, F.lit(-(1 << 63))) if k == "shard" else F.col(k) for k in keys)).alias("key"), *(F.col(k).alias(f"x_{k}") for k in keys), *(F.col(v).alias(f"a_{v}") for v in values))
    b = b.select(F.struct(*(F.coalesce(k, F.lit(-(1 << 63))) if k == "shard" else F.col(k) for k in keys)).alias("key"), *(F.col(k).alias(f"y_{k}") for k in keys), *(F.col(v).alias(f"b_{v}") for v in values))
    both = a.join(b, "key", "full")
    return both.select(*(F.coalesce(f"x_{k}", f"y_{k}").alias(k) for k in keys), *(F.col(f"{s}_{v}") for s in "ab" for v in values))


def _within(rows: DataFrame, differ: DataFrame, idx, bits: int) -> DataFrame:
    """rows of the places or nodes under differing nodes."""
    up = differ.toDF("_s", "_b", "_i")
    on = F.col("shard").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")) & (F.shiftright(idx, bits) == F.col("_i"))
    return rows.join(up, on, "left_semi")


def audit(first: list[DataFrame], second: list[DataFrame]) -> DataFrame:
    """Records in which two replicas differ: (shard, seq, page_id, start, end, copy_start, copy_end, status).

    status: changed (each replica has one record there that the other lacks), missing (the second
    lacks it) or extra (the first lacks it). seq is the slot in the shard. Offsets are those of the
    place in the first replica and in the second, null where a replica has nothing there; where
    several records share a place (a repeated id, or none), the place's range holds them all. A
    record that is there several times is reported once for each time more. Only children of
    differing nodes are compared. Equal replicas, and empty ones: empty result.
    """
    differ = None
    for level in reversed(range(1, LEVELS + 2)):
        a, b = first[level], second[level]
        if differ is not None:
            a, b = (_within(x, differ, F.col("idx"), FANOUT_BITS) for x in (a, b))
        pairs = _met(a, b, [*SHARD, "idx"], ["hash", "size", "start"])
        pairs = materialise(pairs.filter(~F.col("a_hash").eqNullSafe(F.col("b_hash")) | ~F.col("a_size").eqNullSafe(F.col("b_size"))), "differ")
        differ = pairs.select(*SHARD, "idx")
    ranges = pairs.select(
        *(F.col(c).alias(f"r_{c}") for c in (*SHARD, "idx")),
        F.col("a_start").alias("start"),
        (F.col("a_start") + F.col("a_size")).alias("end"),
        F.col("b_start").alias("copy_start"),
        (F.col("b_start") + F.col("b_size")).alias("copy_end"),
    )
    a, b = (_within(x[0], differ, F.col("slot"), 0) for x in (first, second))
    odd = _met(a, b, [*SHARD, "slot", "hash"], ["page_id", "n"])
    gone, new = (F.greatest(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)), F.lit(0)) for x, y in (("a_n", "b_n"), ("b_n", "a_n")))
    odd = odd.select(*SHARD, "slot", F.coalesce("a_page_id", "b_page_id").alias("page_id"), gone.alias("gone"), new.alias("new")).filter("gone + new > 0")
    # a place with one record on either side has a changed one; others have records lost and added
    by = odd.groupBy(*SHARD, "slot").agg(F.sum("gone").alias("gone"), F.sum("new").alias("new"), F.min("page_id").alias("page_id"))
    one = by.filter("gone = 1 and new = 1").select(*SHARD, "slot", "page_id", F.lit("changed").alias("status"))
    rest = by.filter("not (gone = 1 and new = 1)").select(*SHARD, "slot", "page_id", F.explode(F.array(F.struct(F.lit("missing").alias("status"), F.col("gone").alias("times")), F.struct(F.lit("extra").alias("status"), F.col("new").alias("times")))).alias("s"))
    rest = rest.filter("s.times > 0").select(*SHARD, "slot", "page_id", "s.status", F.explode(F.sequence(F.lit(1).cast("long"), F.col("s.times"))).alias("_t")).drop("_t")
    on = F.col("shard").eqNullSafe(F.col("r_shard")) & (F.col("bucket") == F.col("r_bucket")) & (F.col("slot") == F.col("r_idx"))
    out = one.unionByName(rest).join(ranges, on)
    return out.select("shard", F.col("slot").alias("seq"), "page_id", "start", "end", "copy_start", "copy_end", "status")


def damaged(recs: DataFrame) -> DataFrame:
    """A replica with damage at known places, for tests of an audit, by the start of the page id's MD5.

    00: a byte changed; 01: three bytes lost at the end; 02: the record lost; 03: the record there,
    and a second one of that id besides, which has lost its last byte.
    """
    mark = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    r, n = F.col("record"), F.octet_length("record")
    flipped = F.concat(F.substring("record", 1, 9), F.lit(b"?"), F.call_function("substring", r, F.lit(11), n))
    shorter = lambda by: F.call_function("substring", r, F.lit(1), n - by)
    now = F.when(mark == "00", F.array(flipped)).when(mark == "01", F.array(shorter(3))).when(mark == "02", F.array().cast("array<binary>")).when(mark == "03", F.array(r, shorter(1)))
    return placed(recs.select("page_id", F.explode(now.otherwise(F.array(r))).alias("record")))


ORACLE_SQL = rf"""
WITH r AS (
  SELECT page_id, page_id >> {SHARD_BITS} AS shard, page_id & {(1 << SHARD_BITS) - 1} AS seq, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS mark,
         strlen('WARC/1.0') + 2 + strlen('WARC-Type: resource') + 2 + strlen('WARC-Record-ID: <urn:uuid:') + 36 + 1 + 2
         + strlen('WARC-Date: {DATE}') + 2
         + coalesce(strlen('WARC-Target-URI: ') + strlen(regexp_replace(url, '[\r\n]', '', 'g')) + 2, 0)
         + strlen('Content-Type: text/html') + 2 + strlen('Content-Length: ') + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + 4
         + strlen(coalesce(html, '')) + 4 AS n
  FROM pages
), p AS (
  SELECT *, CASE mark WHEN '01' THEN n - 3 WHEN '02' THEN 0 WHEN '03' THEN 2 * n - 1 ELSE n END AS m FROM r
), s AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY shard ORDER BY seq) AS BIGINT) AS stop,
         CAST(sum(m) OVER (PARTITION BY shard ORDER BY seq) AS BIGINT) AS copy_stop
  FROM p
)
SELECT shard, seq, page_id, stop - n AS start, stop AS "end",
       CASE WHEN mark <> '02' THEN copy_stop - m END AS copy_start, CASE WHEN mark <> '02' THEN copy_stop END AS copy_end,
       CASE mark WHEN '02' THEN 'missing' WHEN '03' THEN 'extra' ELSE 'changed' END AS status
FROM s WHERE mark IN ('00', '01', '02', '03')
"""
