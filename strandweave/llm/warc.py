"""WARC archives of pages: writing with segmented records, and reassembly.

Writing: of pages with equal payloads the one with the largest id becomes a
response record and the others revisit records that refer to it. A response is
an HTTP message in chunked transfer framing; one above the segment size is
split into a first record and continuation records. Each record is a gzip
member of a .warc.gz file in the shared folder, one or more files a task.

Reading: records are read file by file; those of one origin are grouped by the
origin's identifier, ordered by segment number, checked against the stated
total length, joined, and the chunked framing is decoded. Records that were
never split need no shuffle.

Edge cases: a null payload counts as empty; equal payloads are equal bytes;
repeated rows with the keeper's id are all responses; a null id is never a
keeper; a missing, doubled or short segment, a wrong digest or broken framing
raises ``ValueError``; an empty table gives no archives and no rows. A file
left by a lost task is in no list of files and is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.common import broadcast_if_small, persisted, prepare, shared_dir

#: Largest record block, largest chunk of the transfer framing, and file size.
SEGMENT_BYTES, CHUNK_BYTES, FILE_BYTES = 16_384, 4_096, 64_000_000
#: Repeated digests (of 28 bytes each) that may be sent to every executor.
KEEPER_ROWS = 500_000
#: Tasks that read archives, at most; each then reads a few files.
READ_TASKS = 50_000
_DATE = "2024-01-01T00:00:00Z"
PARSED = (
    "record_id string, origin string, segment int, total long, page_id long, record_type string, refers_to long,"
    " stated string, payload_bytes long, payload_digest string, block binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_keeper(pages: DataFrame, payload: str = "html", key: str = "page_id", least: int = 0) -> DataFrame:
    """(page_id, payload, refers_to): who keeps the payload, null for keepers.

    Only digests with more than one page go to the other side of the join, and
    their largest id is aggregated before the shuffle. That side is broadcast if
    its counted rows are few, and then no payload moves; else a hot digest's
    payloads can be split by the shuffled join.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), body.alias("payload"))
    keyed = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    counted = keyed.filter(F.octet_length("payload") >= least).groupBy("sha")
    keepers = counted.agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = keyed.join(broadcast_if_small(persisted(keepers), KEEPER_ROWS), "sha", "left")
    refers = F.when((F.octet_length("payload") >= least) & (F.col("keeper") != F.coalesce("page_id", F.lit(None))), F.col("keeper"))
    null_id = F.when(F.col("page_id").isNull() & (F.octet_length("payload") >= least), F.col("keeper"))
    return joined.select("page_id", "payload", F.coalesce(refers, null_id).alias("refers_to"))


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is short")
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, wbits=31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def records(page_id: int | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The gzip members of one page's records."""
    target = None if page_id is None else f"urn:page:{page_id}"
    own, sha = f"<urn:uuid:{uuid.uuid4()}>", f"sha1:{digest(payload)}"
    common = [("WARC-Record-ID", own), ("WARC-Date", _DATE), ("WARC-Target-URI", target)]
    http = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _record(
            [("WARC-Type", "revisit"), *common, http, ("WARC-Payload-Digest", sha), ("WARC-Refers-To-Target-URI", f"urn:page:{refers_to}"),
             ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], head,
        )
        return
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [message[i : i + segment] for i in range(0, len(message), segment)]
    first = [("WARC-Type", "response"), *common, http, ("WARC-Payload-Digest", sha)]
    if len(parts) == 1:
        yield _record(first, message)
        return
    yield _record([*first, ("WARC-Segment-Number", 1)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = len(message) if n == len(parts) else None
        yield _record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE),
             ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n),
             ("WARC-Segment-Total-Length", total)], part,
        )


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a folder and the path in it. Local, HDFS, S3 and GCS
    addresses are known; credentials are the environment's, not Spark's."""
    scheme, colon, rest = folder.partition("://")
    return fs.FileSystem.from_uri("s3" + colon + rest if scheme in ("s3a", "s3n") else folder)


def write(rows: DataFrame, folder: str, segment: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (page_id, payload, refers_to) rows; returns (file, n_records)."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        done, out, held, n = [], None, 0, 0
        for batch in batches:
            for page_id, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                for member in records(page_id, payload, refers_to, segment):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, held, n = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    out.write(member)
                    held, n = held + len(member), n + 1
                if held >= file_bytes:
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n))
        if done:
            yield pa.RecordBatch.from_pydict({"file": [f for f, _ in done], "n_records": pa.array([n for _, n in done], pa.int64())})

    return persisted(rows.select("page_id", "payload", "refers_to").mapInArrow(run, "file string, n_records long"))


def members(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one after the other."""
    data = b""
    while True:
        if not data:
            data = stream.read(piece)
            if not data:
                return
        unpack, parts = zlib.decompressobj(wbits=31), []
        while not unpack.eof:
            if not data:
                data = stream.read(piece)
                if not data:
                    raise ValueError("archive ends inside a record")
            parts.append(unpack.decompress(data))
            data = unpack.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    end = member.find(b"\r\n\r\n")
    lines = member[:end].decode().split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = member[end + 4 : end + 4 + int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]):
        raise ValueError("record is short")
    return headers, block


def message_payload(message: bytes) -> bytes:
    head, _, body = message.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _page(uri: str | None) -> int | None:
    return int(uri.removeprefix("urn:page:")) if uri and uri.startswith("urn:page:") else None


def _row(headers: dict[str, str], block: bytes) -> dict:
    kind, segment = headers["WARC-Type"], headers.get("WARC-Segment-Number")
    row = dict.fromkeys(("origin", "segment", "total", "refers_to", "stated", "payload_bytes", "payload_digest", "block"))
    row |= {"record_id": headers["WARC-Record-ID"], "record_type": kind, "page_id": _page(headers.get("WARC-Target-URI"))}
    stated = row["stated"] = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        row["refers_to"], row["payload_digest"] = _page(headers.get("WARC-Refers-To-Target-URI")), stated
        row["payload_bytes"] = int(block.split(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0])
    elif segment is not None:
        row |= {"origin": headers.get("WARC-Segment-Origin-ID", headers["WARC-Record-ID"]), "segment": int(segment), "block": block}
        row["total"] = int(headers["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in headers else None
    else:
        payload = message_payload(block)
        row["payload_bytes"], row["payload_digest"] = len(payload), digest(payload)
        if stated and stated != row["payload_digest"]:
            raise ValueError(f"{row['record_id']}: digest differs")
    return row


def read(files: DataFrame, folder: str) -> DataFrame:
    """Parsed records of the listed files; blocks are kept of segments only."""
    spark = files.sparkSession
    prepare(spark)
    schema = spark.createDataFrame([], PARSED).schema
    names = schema.names
    kinds = dict(zip(names, [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)

        def pack(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in names], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows = []
                    for member in members(stream):
                        rows.append(_row(*parse(member)))
                        if len(rows) == 500:
                            yield pack(rows)
                            rows = []
                    if rows:
                        yield pack(rows)

    return spread(files).mapInArrow(run, schema)


def spread(files: DataFrame) -> DataFrame:
    """File names dealt to as many tasks as there are files. The number is given,
    as names are so short that a task would otherwise get all of them."""
    n = files.count()
    return files.select("file").repartitionByRange(max(1, min(n, READ_TASKS)), "file")


def join_segments(segments: list[tuple[int, bytes]], total: int | None) -> bytes:
    """Ordered segment blocks as one message; every number once, from 1 on."""
    if [n for n, _ in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("segments are missing or doubled")
    message = b"".join(b for _, b in segments)
    if total is None or len(message) != total:
        raise ValueError(f"{len(message)} bytes of segments, {total} stated")
    return message


def reassemble(parsed: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of
    segmented records, one row for each origin."""
    grouped = parsed.groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("total").alias("total"), F.max("stated").alias("stated"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("segments"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                payload = message_payload(join_segments([(s["segment"], s["block"]) for s in row["segments"]], row["total"]))
                if row["stated"] and digest(payload) != row["stated"]:
                    raise ValueError(f"{row['origin']}: digest differs")
                out.append((row["page_id"], len(payload), digest(payload), payload))
            a, b, c, d = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.binary())],
                names=["page_id", "payload_bytes", "payload_digest", "payload"],
            )

    joined = grouped.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, payload binary")
    return joined.select(
        "page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload"
    )


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Write archives of all pages to the shared folder and read them back."""
    folder = shared_dir(spark)
    files = write(with_keeper(pages, least=least), folder, segment)
    parsed = persisted(read(files, folder))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = parsed.filter("origin is null").select(*columns)
    return whole.unionByName(reassemble(parsed.filter("origin is not null")).select(*columns))
