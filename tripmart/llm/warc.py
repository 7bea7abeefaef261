"""WARC archives: writing, and a normaliser of monolithic gzip files.

``write_archives`` writes pages as WARC records in files that are one gzip stream
each, as some crawlers do.  Spark's text writer makes them, through the session's
own file system and commit protocol; the terminator of a record is its line end.

``normalise`` inflates every file once, as a stream, cuts it into records by their
Content-Length, and rewrites every record as a gzip member of its own, so that one
can be read by its offset alone.  Beside the new archives it writes the offset
index (a Parquet table).  A task holds one record and one piece of stream.  An
output file gets its final name when it is whole; a task that runs again replaces it.

Records with equal payloads of at least ``MIN_REVISIT`` bytes: the one with the
largest page id is a response, the others revisit it and carry no payload.

Defined results: null html is an empty payload; a null url or id is written as an
empty header; null ids never are revisits nor what revisits refer to.  Line ends
in urls are percent-coded.  Rows that share an id and a payload are all responses if they
hold the largest id.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.session import scratch_dir

MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PIECE = 1 << 20
INDEX = ("archive string, offset long, length long, page_id long, url string, record_type string, "
         "refers_to long, payload_bytes long, payload_digest string")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to); the response
    of each payload is found by a grouped maximum over digests alone."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                     html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"),
                     F.sha1(html.cast("binary")).alias("payload_digest"))
    first = (p.where((F.col("payload_bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull())
             .groupBy("payload_digest", "payload_bytes")
             .agg(F.max("page_id").alias("top"), F.min("page_id").alias("low")).where("low < top").drop("low"))
    return (p.join(first, ["payload_digest", "payload_bytes"], "left")
            .withColumn("refers_to", F.when(F.col("page_id") < F.col("top"), F.col("top"))).drop("top"))


def record_text() -> F.Column:
    """One WARC/1.1 record without its terminator, from the columns of plan_records."""
    end = F.lit("\r\n")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("refers_to").isNotNull()

    def header(name, value):
        return F.concat(F.lit(f"{name}: "), value, end)

    def urn(col):
        return F.concat(F.lit("<urn:page:"), F.coalesce(col.cast("string"), F.lit("")), F.lit(">"))

    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", urn(F.col("page_id"))), header("WARC-Date", F.lit(DATE)),
        header("WARC-Target-URI", url),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(header("WARC-Refers-To", urn(F.col("refers_to"))), header(
            "WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.octet_length(body).cast("string")), end, body)


def write_archives(pages: DataFrame, path: str, records_per_file: int = 20_000, **columns) -> None:
    """One gzip stream a file: at most ``records_per_file`` records each."""
    (plan_records(pages, **columns).select(record_text().alias("value")).write
     .option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file)
     .text(path))


def open_fs(uri: str):
    """(pyarrow file system, path) of a uri; Hadoop's ``file:/x`` form included."""
    from pyarrow import fs
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    elif "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def inflate(read) -> Iterator[bytes]:
    """Plain bytes of a gzip stream, whether it has one member or many."""
    z, open_ = zlib.decompressobj(31), False
    data = read(PIECE)
    while data:
        open_ = True
        if plain := z.decompress(data, PIECE):
            yield plain
        data = z.unused_data if z.eof else z.unconsumed_tail
        if z.eof:
            z, open_ = zlib.decompressobj(31), False
        data = data or read(PIECE)
    if open_:
        yield z.flush()
        if not z.eof:
            raise ValueError("gzip stream ends early")


def records(plain: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, head, body) of each record of a stream of plain WARC bytes."""
    held, at = bytearray(), 0

    def fill(upto) -> bool:
        nonlocal held, at
        while len(held) - at < upto:
            if at > PIECE:
                del held[:at]
                at = 0
            piece = next(plain, None)
            if piece is None:
                return False
            held += piece
        return True

    while True:
        while fill(1) and held[at:at + 2] in (b"\r\n", b"\r"):      # terminators
            if not fill(2):
                break
            at += 2
        if not fill(1):
            return
        seen = 0
        while (end := held.find(b"\r\n\r\n", at + max(0, seen - 3))) < 0:
            seen = len(held) - at
            if not fill(seen + 1):
                raise ValueError("WARC record without an end of its headers")
        head = bytes(held[at:end + 4])
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                       for line in head[:-4].decode("utf-8", "replace").split("\r\n")[1:])
        at = end + 4
        n = int(headers["Content-Length"])
        if not fill(n):
            raise ValueError("WARC record shorter than its Content-Length")
        yield headers, head, bytes(held[at:at + n])
        at += n


def _id(urn: str | None) -> int | None:
    digits = (urn or "")[len("<urn:page:"):-1]
    return int(digits) if digits else None


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrites every ``*.gz`` file below ``source``; returns the index that it wrote."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")

    def work(batches):
        for pdf in batches:
            for path in pdf["path"]:
                in_fs, in_path = open_fs(path)
                out_fs, folder = open_fs(target)
                name = hashlib.sha1(in_path.encode()).hexdigest()[:20] + ".warc.gz"
                part, rows, at = f"{folder}/.{name}.{uuid.uuid4().hex}", [], 0
                out_fs.create_dir(folder, recursive=True)
                with in_fs.open_input_stream(in_path, compression=None) as src, \
                        out_fs.open_output_stream(part, compression=None) as out:
                    for h, head, body in records(inflate(src.read)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(head) + z.compress(body) + z.compress(b"\r\n\r\n") + z.flush()
                        out.write(member)
                        kind = h["WARC-Type"]
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{path}: payload digest of {h['WARC-Record-ID']} differs")
                        rows.append((f"{target}/{name}", at, len(member), _id(h["WARC-Record-ID"]),
                                     h["WARC-Target-URI"], kind, _id(h.get("WARC-Refers-To")),
                                     int(h["WARC-Payload-Length"]), digest))
                        at += len(member)
                        if len(rows) >= 5000:
                            yield _frame(rows)
                            rows = []
                out_fs.move(part, f"{folder}/{name}")
                if rows:
                    yield _frame(rows)

    index = f"{target}-index"
    files.repartition(max(1, files.count())).mapInPandas(work, INDEX).write.parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def _frame(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_record(index_row) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record, by its offset alone."""
    fs, path = open_fs(index_row["archive"])
    with fs.open_input_file(path) as f:
        f.seek(index_row["offset"])
        headers, _, body = next(records(iter([zlib.decompress(f.read(index_row["length"]), 31)])))
    return headers, body


def archive(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes ``pages`` as monolithic archives, normalises them and returns the index."""
    spark = pages.sparkSession
    folder = folder or scratch_dir(spark, "llm-warc")
    write_archives(pages, f"{folder}/raw", **columns)
    return normalise(spark, f"{folder}/raw", f"{folder}/archives")
