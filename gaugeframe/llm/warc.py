"""WARC archives with an index first (operator 8).

Writing: each task appends its rows as gzip members, one member for each WARC
1.1 record, to files of its own in a shared folder and returns one index row
for each record: file, offset, length, page_id, url, digest, type.  The index
is written as a table; it is the commit record, so what a lost or repeated task
left behind is never referred to.  A payload that several rows share is stored
once: the row with the largest page_id is the response, the others are revisit
records that name it and keep only the HTTP head.

Reading: index rows (any selection of them) are dealt by file and region of the
file to as many tasks as their bytes need, sorted by offset, and neighbouring byte ranges are read together; each
record is then unpacked and its payload checked against its digest.

Files are reached through the shared folder's own file system (``pyarrow.fs``:
local, HDFS, S3, GCS), pages only through Spark's readers.

Defined cases: a null or empty html has an empty payload (a response like any
other, unless copies exist: payloads of at least ``least_bytes`` bytes are
revisited); a null url is written as ``urn:page:<page_id>``; a null page_id
takes no part; rows that share a page_id are each written: with one payload one
of them is the response (the first by url) and the others revisit it, with other
payloads they are records like any others; control characters in a url are percent-encoded;
extra columns are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeframe.llm import _text
from gaugeframe.sources.scratch import materialize, materialize_observed, scratch_path

#: A file is closed beyond this size; a read covers gaps of at most GAP and at most SPAN bytes, if one record isn't longer.
FILE_BYTES = 512 << 20
GAP = 64 << 10
SPAN = 8 << 20
REGION = 64 << 20
#: Rows of the table of revisits (some 50 bytes each) that may be broadcast.
REVISIT_BROADCAST_ROWS = 500_000
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int, url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def _record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"


def record(page_id: int, url: str | None, payload: bytes, sha: str, refers_to: int | None, own: str = "") -> bytes:
    """One WARC record with its closing empty lines; a revisit has the HTTP head only.

    ``own`` (file and offset) makes the id of a record that no other refers to its own, even where page and payload repeat.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Target-URI: {_uri(page_id, url)}", f"WARC-Date: {DATE}",
        f"WARC-Record-ID: {_record_id(f'{page_id}|{sha}{own}')}", f"WARC-Page-ID: {page_id}", f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(f'{refers_to}|{sha}')}", f"WARC-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, length of the full payload and stored payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, int(re.search(rb"Content-Length: (\d+)", http)[1]), payload


def _with_responses(rows: DataFrame, least_bytes: int) -> DataFrame:
    """``rows`` (page_id, url, html) with ``keep``: the page whose response a revisit names, null for a response."""
    sha = F.unhex(F.sha1(F.col("html").cast("binary")))
    rows = rows.withColumn("sha", sha)
    # one narrow pass over the payloads finds the copies
    sums = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha", "page_id").agg(F.count("*").alias("rows"))
    first = sums.groupBy("sha").agg(F.max("page_id").alias("keep"), F.sum("rows").alias("n")).where("n > 1").select("sha", "keep")
    again = sums.join(materialize(first, "copies").hint("merge"), "sha").where("page_id != keep or rows > 1")
    again = again.select(F.col("page_id").alias("copy"), F.col("sha").alias("copy_sha"), "keep", (F.col("page_id") == F.col("keep")).alias("twice"))
    again, seen = materialize_observed(again, "revisits", F.count(F.lit(1)).alias("n"), F.count_if("twice").alias("twice"))
    again = again.hint("broadcast" if seen["n"] <= REVISIT_BROADCAST_ROWS else "merge")
    rows = rows.join(again, (rows["page_id"] == again["copy"]) & (rows["sha"] == again["copy_sha"]), "left")
    if not seen["twice"]:
        return rows.select("page_id", "url", "html", "keep")
    # rows that repeat both page and payload of a response: the first by url is the response
    once = rows.where("twice is null or not twice").select("page_id", "url", "html", "keep")
    order = Window.partitionBy("page_id", "sha").orderBy(F.col("url").asc_nulls_last())
    many = rows.where("twice").withColumn("k", F.row_number().over(order))
    return once.unionByName(many.select("page_id", "url", "html", F.when(F.col("k") > 1, F.col("keep")).alias("keep")))


def write_archives(
    spark: SparkSession, pages: DataFrame, folder: str | None = None, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write every page as a record below ``folder`` (default: the shared scratch folder) and return the written index."""
    folder = folder or scratch_path(spark, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = _with_responses(rows.where("page_id is not null"), least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                for part in _text.chunks(batch, "html", 4 << 20):
                    found = []
                    for page_id, url, html, keep in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "keep")), strict=True):
                        if out is None or at > FILE_BYTES:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        payload = html.encode()
                        sha = digest(payload)
                        pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                        own = f"|{name}|{at}" if keep is not None or len(payload) < least_bytes else ""
                        body = pack.compress(record(page_id, url, payload, sha, keep, own)) + pack.flush()
                        out.write(body)
                        found.append((page_id, url, sha, "response" if keep is None else "revisit", keep, name, at, len(body)))
                        at += len(body)
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*found, strict=True)), strict=True)), schema=schema)
        finally:
            if out is not None:
                out.close()

    names = [c.split(" ")[0] for c in INDEX.split(", ")]
    schema = pa.schema([(c.split(" ")[0], pa.int64() if c.endswith("long") else pa.string()) for c in INDEX.split(", ")])
    return materialize(rows.mapInArrow(run, INDEX), "warc-index").withColumn("folder", F.lit(folder))


def read_archives(index: DataFrame) -> DataFrame:
    """The records that ``index`` (as written, or any selection of its rows) names: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to and payload (null for a revisit, whose payload is the record's it refers to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = (None, None)

        def flush(folder: str, name: str, want: list[tuple[int, int]]):
            nonlocal opened
            if opened[0] != (folder, name):
                fs, root = pafs.FileSystem.from_uri(folder)
                if opened[1] is not None:
                    opened[1].close()
                opened = ((folder, name), fs.open_input_file(f"{root}/{name}"))
            start = want[0][0]
            body = opened[1].read_at(want[-1][0] + want[-1][1] - start, start)
            found = []
            for offset, length in want:
                fields, full, payload = parse(zlib.decompress(body[offset - start : offset - start + length], 31))
                sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                whole = fields["WARC-Type"] == "response"
                if whole and (len(payload) != full or digest(payload) != sha):
                    raise ValueError(f"damaged record at {name}:{offset}")
                refers = fields.get("WARC-Refers-To-Page-ID")
                found.append((int(fields["WARC-Page-ID"]), fields["WARC-Target-URI"], full, sha, fields["WARC-Type"], int(refers) if refers else None, payload if whole else None))
            return pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*found, strict=True)), strict=True)), schema=schema)

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        where, want = None, []
        for batch in batches:
            for folder, name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("folder", "file", "offset", "length")), strict=True):
                if want and (where != (folder, name) or offset > want[-1][0] + want[-1][1] + GAP or offset + length - want[0][0] > SPAN):
                    yield flush(*where, want)
                    want = []
                where = (folder, name)
                want.append((offset, length))
        if want:
            yield flush(*where, want)

    # the index is small, what it names is not: regions of the files are dealt to a number of tasks that follows from the bytes
    total = index.agg(F.sum("length")).first()[0] or 0
    region = min(REGION, max(SPAN // 4, total // (4 * index.sparkSession.sparkContext.defaultParallelism)))
    dealt = index.select("folder", "file", F.floor(F.col("offset") / region).alias("region"), "offset", "length")
    dealt = dealt.repartition(max(1, -(-total // region)), "folder", "file", "region").sortWithinPartitions("folder", "file", "offset")
    return dealt.select("folder", "file", "offset", "length").mapInArrow(run, RECORDS)
