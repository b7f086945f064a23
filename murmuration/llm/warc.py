"""WARC archives: written by Spark's text writer, read by a Python data source.

Writing needs no code on executors: a WARC record ends with two line ends, so records as rows with that line separator
make valid archives in any store that Spark writes to. Equal payloads are stored once; the others are revisit records.

The reader plans one partition per group of files, tests record type and named headers before it looks at a payload,
and skips a payload's bytes undecoded where the query does not ask for it. Comparisons on rec_type, page_id and refers_to
in a filter are pushed down to it.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull

LEAST_BYTES = 100
SPLIT_BYTES = 64 << 20
SCHEMA = "page_id bigint, url string, rec_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload string"
#: Names of the format's headers.
H_TYPE, H_ID, H_REFERS, H_DIGEST, H_LENGTH, H_URI = "WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Payload-Digest", "Content-Length", "WARC-Target-URI"
H_PAYLOAD = "X-Payload-Bytes"
URN = "urn:page:"


def to_records(pages: DataFrame, least: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One column, record: a WARC record without its last two line ends.

    The payload is html in UTF-8 (null: empty). Of the rows with equal payloads of at least `least` bytes that with the
    smallest id is a response and the others are revisits of it; all else are responses. Rows that repeat that id are
    responses too. Line ends in a url are dropped. An empty table gives archives without records.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(url_col, F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.withColumns({"n": F.octet_length("html").cast("bigint"), "digest": F.sha2("html", 256)})
    first = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    rows = rows.join(first, "digest", "left").withColumn("again", F.coalesce(F.col("first") != F.col("id"), F.lit(False)))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *[F.lit(v) if isinstance(v, str) else v for v in value], F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line(H_TYPE, F.when(F.col("again"), "revisit").otherwise("response")),
        line(H_ID, f"<{URN}", F.coalesce(F.col("id").cast("string"), F.lit("")), ">"),
        line(H_URI, F.col("url")),
        line("WARC-Date", "1970-01-01T00:00:00Z"),
        line(H_DIGEST, "sha256:", F.col("digest")),
        line(H_PAYLOAD, F.col("n").cast("string")),
        F.when(F.col("again"), F.concat(line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), line(H_REFERS, f"<{URN}", F.col("first").cast("string"), ">"))).otherwise(""),
        line("Content-Type", "application/http; msgtype=response"),
    )
    block = F.when(F.col("again"), F.lit(http)).otherwise(F.concat(F.lit(http), F.col("html")))
    return rows.select(F.concat(head, line(H_LENGTH, F.octet_length(block).cast("string")), F.lit("\r\n"), block).alias("record"))


def write_warc(pages: DataFrame, path: str, compression: str = "gzip", **columns) -> None:
    to_records(pages, **columns).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


class _Group(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _open(path: str):
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_stream(inner, compression=None)


def _records(stream, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers of each record that wanted(headers) accepts, and its block if wanted gives "block" (else None)."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip()] = value.strip()
        size, want = int(head[H_LENGTH]), wanted(head)
        if want == "block":
            yield head, stream.read(size)
        else:
            while size > 0:
                size -= len(stream.read(min(size, 1 << 20))) or size
            if want:
                yield head, None


def _page(value: str | None) -> int | None:
    return int(value.strip("<>").removeprefix(URN)) if value and value.strip("<>") != URN else None


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.files = [f for f in options["files"].split("\n") if f]
        self.sizes = [int(s) for s in options["sizes"].split(",") if s]
        self.payload = options.get("payload", "text")
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else ""
            if name in ("rec_type", "page_id", "refers_to") and isinstance(f, EqualTo | In | IsNull | IsNotNull):
                values = (f.value,) if isinstance(f, EqualTo) else tuple(f.value) if isinstance(f, In) else (None,) if isinstance(f, IsNull) else ()
                self.tests.append((name, values))
            else:
                yield f

    def partitions(self):
        groups: list[list[str]] = []
        held = SPLIT_BYTES
        for size, file in sorted(zip(self.sizes, self.files), reverse=True):
            if held + size > SPLIT_BYTES and (not groups or held):
                groups.append([])
                held = 0
            groups[-1].append(file)
            held += size
        return [_Group(g) for g in groups]

    def read(self, partition):
        def wanted(head):
            got = {"rec_type": head.get(H_TYPE), "page_id": _page(head.get(H_ID)), "refers_to": _page(head.get(H_REFERS))}
            for name, values in self.tests:
                if (got[name] is None) if values == () else (got[name] not in values):
                    return ""
            return "block" if self.payload != "none" and got["rec_type"] == "response" else "head"

        for file in partition.files if partition else []:
            stream = _open(file)
            if file.endswith(".gz"):
                stream = gzip.GzipFile(fileobj=stream)
            for head, block in _records(stream, wanted):
                n, digest, text = int(head.get(H_PAYLOAD, 0)), head.get(H_DIGEST, "").removeprefix("sha256:"), None
                if block is not None:
                    payload = block.partition(b"\r\n\r\n")[2]
                    n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    text = payload.decode("utf-8", "replace") if self.payload == "text" else None
                yield _page(head.get(H_ID)), head.get(H_URI), head.get(H_TYPE), _page(head.get(H_REFERS)), n, digest, text
            stream.close()


class WarcSource(DataSource):
    """Format "warc". Options: files and sizes (set by read_warc), payload = text, digest or none."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: str = "text") -> DataFrame:
    """Records of the archives below a folder: page_id, url, rec_type, refers_to, payload_bytes, payload_digest, payload.

    payload: "text" decodes payloads, "digest" hashes their bytes only, "none" skips them and takes size and digest from
    the headers. A revisit has no payload; its size and digest come from its headers. An empty folder gives no rows.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    found = [(f.getPath().toString(), f.getLen()) for f in listed if not f.getPath().getName().startswith(("_", "."))]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    options = {"files": "\n".join(f for f, _ in found), "sizes": ",".join(str(n) for _, n in found), "payload": payload}
    return spark.read.format("warc").options(**options).load()
