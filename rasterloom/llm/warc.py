"""WARC archives: writing, reading, and resolution of revisits.

Archives are gzipped files of records, written with Spark's text writer and read with its binary reader, so that any
file system Spark knows holds them. A record ends with two line ends, which are the writer's line separator.

Resolution reads the headers of an archive, groups them by payload digest (before any payload moves), names one original
in each group, and writes archives anew: originals as responses with their payload, the others as revisit records that
refer to it. Reading joins revisits to the responses they refer to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import Stage, batches_of, drop_path, new_path, stored

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: A file has at most so many records, and fewer where so many bytes of payload are expected to be in fewer.
RECORDS_PER_FILE, BYTES_PER_FILE = 2000, 64_000_000
_NAMESPACE = uuid.UUID("5f1a3c2e-7d3b-4f0e-9a55-3f6d0f3a9b11")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, page_id: int | None, uri: str | None, sha1: str, n_payload: int, payload: str, refers_to: str | None = None) -> str:
    """A record without the two line ends after it. The block is an HTTP response; a revisit's has headers alone."""
    http = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {n_payload}{END}{END}"
    n_block = len(http) + (n_payload if kind == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + quote(uri, safe="/:?#[]@!$&'()*+,;=%-._~"))
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {n_block}"]
    return END.join(lines) + END + END + http + (payload if kind == "response" else "")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, memoryview]]:
    """Headers (names in lower case), length of the full payload and the payload that is there, of each record."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.decode("ascii").lower()] = value.strip().decode("utf-8")
        block = end + 4
        after = block + int(headers["content-length"])
        body = data.index(b"\r\n\r\n", block) + 4
        sizes = [int(x.partition(b":")[2]) for x in data[block:body].split(b"\r\n") if x.lower().startswith(b"content-length:")]
        yield headers, sizes[0] if sizes else after - body, view[body:after]
        if data[after : after + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end where its length says")
        at = after + 4


def records_per_file(payload_bytes: float | None) -> int:
    """For payloads of so many bytes on the average."""
    return max(1, min(RECORDS_PER_FILE, int(BYTES_PER_FILE / max(payload_bytes or 0, 1))))


def write_text_records(records: DataFrame, path: str, per_file: int) -> None:
    records.write.option("lineSep", END + END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """A response record for each row. A null payload is empty; a null URL or id leaves its header out."""
    source = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, payloads in batches_of(batch, "payload"):
                out = []
                for row, page_id, url, payload in zip(piece.column("row").to_pylist(), piece.column("page_id").to_pylist(), piece.column("url").to_pylist(), payloads):
                    data = payload.encode("utf-8", "surrogatepass")
                    out.append(record("response", str(uuid.uuid5(_NAMESPACE, f"{page_id}:{row}")), page_id, url, digest(data), len(data), payload))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    size = source.agg(F.avg(F.octet_length("payload"))).first()[0]
    write_text_records(source.mapInArrow(make, "value string"), path, records_per_file(size))


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """record_id, page_id, url, record_type, payload_bytes, payload_digest, refers_to_record (and payload) of each record.

    The digest of a response is taken from its payload anew and must be the one its header names. An archive without records
    gives no rows; a record that isn't whole raises.
    """
    fields = [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_record", pa.string())]
    schema = pa.schema(fields + [("payload", pa.string())] * with_payload)
    ddl = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to_record string" + ", payload string" * with_payload

    def rows(content: bytes) -> Iterator[tuple]:
        data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
        bare = lambda x: x[10:-1] if x else None  # noqa: E731  <urn:uuid:...>
        for headers, size, payload in parse(data):
            kind, named = headers["warc-type"], headers["warc-payload-digest"].partition(":")[2]
            if kind == "response" and (digest(payload) != named or len(payload) != size):
                raise ValueError(f"payload of {headers['warc-record-id']} isn't what its header names")
            page_id = headers.get("warc-page-id")
            yield (bare(headers["warc-record-id"]), int(page_id) if page_id else None, headers.get("warc-target-uri"), kind, size, named, bare(headers.get("warc-refers-to")), *([str(payload, "utf-8")] * with_payload))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found: list[tuple] = []
                for row in rows(content.as_py()):
                    found.append(row)
                    if len(found) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(read, ddl)


def resolve_revisits(spark: SparkSession, path: str, out: str, min_bytes: int = 0) -> None:
    """Writes the archives of `path` anew to `out`. Of records with equal payloads of at least min_bytes bytes, the one with
    the largest page_id (null is the least; then the largest record id) stays a response; the others become revisits. Archives
    without records give one without records."""
    head_stage = Stage(read_archives(spark, path), "headers")
    headers = head_stage.df
    long_enough = headers.where(F.col("payload_bytes") >= min_bytes)
    original_stage = Stage(long_enough.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "record_id")).alias("original")), "originals")
    originals = original_stage.df
    decided = long_enough.join(originals, ["payload_digest", "payload_bytes"]).where(F.col("record_id") != F.col("original.record_id")).select("record_id", F.col("original.record_id").alias("refers_to"))
    records = read_archives(spark, path, with_payload=True).drop("refers_to_record").join(decided, "record_id", "left")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "page_id", "url", "payload_digest", "payload_bytes", "refers_to"]
        for batch in batches:
            for piece, payloads in batches_of(batch, "payload"):
                values = zip(*(piece.column(n).to_pylist() for n in names), payloads)
                out = [record("revisit" if to else "response", rid, page_id, url, sha1, size, payload, to) for rid, page_id, url, sha1, size, to, payload in values]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    size = headers.where("record_type = 'response'").agg(F.avg("payload_bytes")).first()[0]
    write_text_records(records.mapInArrow(make, "value string"), out, records_per_file(size))
    head_stage.drop(), original_stage.drop()


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of `pages` (page_id, url, html), resolves revisits, and reads the archives back:
    page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response, null for responses).

    Null payloads are empty and, as empty ones, equal to each other. Repeated rows are records of their own: one is the
    response, the others revisit it. An empty table gives no rows; other columns aren't looked at.
    """
    spark = pages.sparkSession
    first, second = new_path(spark, "archives"), new_path(spark, "archives")
    write_archives(pages, first)
    resolve_revisits(spark, first, second, min_bytes)
    records = stored(read_archives(spark, second), "records")
    drop_path(spark, first), drop_path(spark, second)
    shown = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_record")
    responses, revisits = shown.where("record_type = 'response'"), shown.where("record_type <> 'response'")
    targets = responses.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(revisits.join(targets, "refers_to_record", "left").select(columns))
