"""WARC archives with revisit resolution.

Headers alone are shuffled by payload digest to find each payload's original; the archives then hold every
payload once, and revisit records that refer to it. Pages are staged by the task that read them, and written out group by
group of staged parts, with that group's revisits, a counted number, at hand: payloads are never shuffled. The archives are written by Spark's text writer (a record is
a value, the blank lines between records its line separator), gzipped, and so survive lost executors and
lie wherever Spark can write. A reader follows the content lengths, so payloads may hold anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.session import BROADCAST_ROWS, work_folder

LEAST_BYTES = 100  # shorter payloads are kept as they are
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"


def _record_id(seed: Column) -> Column:
    h = F.md5(seed)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _headers(*fields: tuple[str, Column]) -> Column:
    """Lines of a header; a null field has none."""
    return F.concat_ws("\r\n", *(F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields))


def write_archives(
    pages: DataFrame,
    folder: str,
    date: str = "2026-01-01T00:00:00Z",
    least: int = LEAST_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    most: int = BROADCAST_ROWS,
) -> None:
    """One record for each row of ``pages``: the first of equal payloads is a response, the others revisit it.

    Equal payloads of at least ``least`` bytes have their response at the smallest id (a null id counts as the
    largest; of rows that share the id, one). Null html is an empty payload. A null url or id
    leaves its header out; characters that can't stand in a header are percent-encoded. Other
    columns are not read. ``most`` revisits go to the tasks at a time.
    """
    session = pages.sparkSession
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20\x7f]", "%20")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), html.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("bytes"), F.sha2(F.col("payload").cast("binary"), 256).alias("digest"), F.monotonically_increasing_id().alias("nth"))
    staged = work_folder(session, "pages")
    rows = rows.withColumn("part", F.shiftright("nth", 33).cast("int"))  # the task that staged it: each writes one folder
    rows.write.option("compression", "zstd").partitionBy("part").parquet(staged)  # the numbers of rows must not change any more
    rows = session.read.schema(rows.schema).parquet(staged)

    long = rows.filter(F.col("bytes") >= least).select("digest", "id", "nth", "url")
    first = F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "nth", "url")).alias("first")
    shared = long.groupBy("digest").agg(first, F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    revisits = long.join(shared, "digest").filter("nth <> first.nth").select("nth", F.col("first.nth").alias("first_nth"), F.col("first.url").alias("first_url"))
    kept = work_folder(session, "revisits")
    revisits = revisits.withColumn("part", F.shiftright("nth", 33).cast("int"))
    revisits.write.parquet(kept)
    revisits = session.read.schema(revisits.schema).parquet(kept)
    counts = revisits.groupBy("part").agg(F.count("*").alias("n")).collect()  # two numbers for each staging task

    record_id = lambda nth, digest: _record_id(F.concat_ws(":", nth.cast("string"), digest))
    again = F.col("first_nth").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _headers(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("bytes"))), F.lit(_END))
    block = F.when(again, http).otherwise(F.concat(http, "payload"))
    head = _headers(
        ("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", record_id(F.col("nth"), F.col("digest"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("X-Page-ID", F.col("id")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        ("WARC-Profile", F.when(again, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(again, record_id(F.col("first_nth"), F.col("digest")))),
        ("WARC-Refers-To-Target-URI", F.when(again, F.col("first_url"))),
        ("WARC-Refers-To-Date", F.when(again, F.lit(date))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block)),
    )
    record = F.concat(F.lit("WARC/1.1\r\n"), head, F.lit(_END), block)
    for first_part, last_part in part_groups({r["part"]: r["n"] for r in counts}, most):
        here = F.col("part").between(first_part, last_part)
        some = F.broadcast(revisits.filter(here).drop("part"))  # at most ``most`` rows, or those of one staging task
        records = rows.filter(here).join(some, "nth", "left").select(record.alias("value"))
        records.write.mode("append").option("lineSep", _END).option("compression", "gzip").text(folder)


def part_groups(counts: dict[int, int], most: int) -> list[tuple[int, int]]:
    """Ranges of parts, the last one open, with at most ``most`` revisits each where a part has no more."""
    groups, first, size = [], 0, 0
    for part, n in sorted(counts.items()):
        if size and size + n > most:
            groups.append((first, part - 1))
            first, size = part, 0
        size += n
    return [*groups, (first, (1 << 31) - 1)]


_RECORD = "record_id string, record_type string, page_id long, url string, date string, header_digest string, refers_to_id string, payload binary"
_FIELDS = {b"warc-record-id": 0, b"warc-type": 1, b"x-page-id": 2, b"warc-target-uri": 3, b"warc-date": 4, b"warc-payload-digest": 5, b"warc-refers-to": 6}
_SCHEMA = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in _RECORD.split(", ")])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records out of the lines of whole files, by their content lengths."""
    rows, size = [], 0
    head: list | None = None  # of the record that is being read
    body: list[bytes] = []
    need = got = 0  # bytes of its block; -1 while its header is read
    for batch in batches:
        for line in batch.column(0).to_pylist():
            if head is None:
                if line.startswith(b"WARC/"):
                    head, need = [None] * 7, -1
                    length = 0
                continue
            if need < 0:
                if line != b"\r":
                    key, _, value = line.rstrip(b"\r").partition(b":")
                    key, value = key.strip().lower(), value.strip()
                    if key == b"content-length":
                        length = int(value)
                    elif key in _FIELDS:
                        head[_FIELDS[key]] = value.decode("utf-8", "replace")
                    continue
                need, got, body = length, 0, []
                if need:
                    continue
            else:
                body += (line, b"\n")
                got += len(line) + 1
                if got < need:
                    continue
            block = b"".join(body)[:need]
            payload = block.partition(b"\r\n\r\n")[2]
            rows.append((head[0], head[1], None if head[2] is None else int(head[2]), *head[3:], payload))
            size += need
            head = None
            if size > 4 << 20 or len(rows) > 5000:
                yield _made(rows)
                rows, size = [], 0
    if head is not None:
        raise ValueError("an archive ends within a record")
    yield _made(rows)


def _made(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of gzipped archives, each file read by one task line by line."""
    lines = spark.read.option("lineSep", "\n").text(folder).select(F.col("value").cast("binary"))
    return lines.mapInArrow(_parse, _RECORD)


def resolve_revisits(spark: SparkSession, records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of each record: revisits take the first two
    from the response they refer to. Lengths and digests are those of the payload as read."""
    digest = F.sha2("payload", 256)
    index = records.select("record_id", "record_type", "page_id", "refers_to_id", F.octet_length("payload").cast("long").alias("bytes"), digest.alias("digest"))
    kept = work_folder(spark, "index")
    index.write.parquet(kept)
    index = spark.read.schema(index.schema).parquet(kept)
    original = index.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest")
    )
    own = index.filter("record_type <> 'revisit'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    again = index.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to_id").join(original, "refers_to_id", "left")
    return own.unionByName(again.drop("refers_to_id"))
