"""WARC archives: one gzip member per record, written by tasks and read by byte ranges.

The writer stores each payload once: of pages with equal payloads the one of
least id is a response, the others are revisits that refer to it.  The reader
cuts every file into byte ranges of equal size.  A task looks for the gzip magic
inside its range, takes a candidate for a record only if it inflates to a WARC
header, and owns the records that start in its range; the last one may be read
past the end.  Payloads are inflated piece by piece and hashed on the way.

Archives are opened with ``pyarrow.fs``, from the driver's and any executor's
side by the same URI, so the folder must be shared.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import materialise, work_root

#: Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"

#: Payloads below this size are always stored.
MIN_PAYLOAD = 100
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 18
#: A WARC or HTTP header longer than this is not taken for one.
HEADER_BYTES = 1 << 20
LEVEL = 6
#: Rows that the writer turns into Python values at a time.
WRITE_ROWS = 64
#: Keys with a larger share of all rows are joined by broadcast: at most 1 / HOT_SHARE of them exist.
HOT_SHARE = 0.001
ID = "urn:page:"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def lookup(rows: DataFrame, key: str, found: DataFrame, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Left join of ``rows`` with ``found`` (``key``, ``copies``, values), without a hot task.

    ``copies`` counts the rows of a key.  Keys with more than ``share`` of
    ``total`` rows are fewer than ``1 / share`` and are broadcast; their rows take
    a spread key in the shuffle join that serves all others.
    """
    often = F.col("copies") > F.lit(max(1.0, share * total))
    values = [c for c in found.columns if c not in (key, "copies")]
    hot = F.broadcast(found.where(often).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot")))
    rest = found.where(~often).select(F.col(key).alias("_rest_key"), F.struct(*values).alias("_rest"))
    spread = F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string"))
    first = rows.join(hot, F.col(key) == F.col("_hot_key"), "left")
    keyed = first.withColumn("_key", F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(spread))
    both = keyed.join(rest, F.col("_key") == F.col("_rest_key"), "left")
    value = F.coalesce("_hot", "_rest")
    return both.select(*rows.columns, *[value.getField(v).alias(v) for v in values])


def with_references(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``pages`` (``page_id, url, html``) with ``digest, size, kind, refers_to``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(
        "page_id", F.col("url").cast("string").alias("url"), payload.alias("html"),
        F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"),
    )
    first = (
        keyed.where(F.col("size") >= min_payload)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
    marked = lookup(keyed, "digest", materialise(first, "payloads"), keyed.count())
    stays = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    return marked.select(
        "page_id", "url", "html", "digest", "size",
        F.when(stays, F.lit(RESPONSE)).otherwise(F.lit(REVISIT)).alias("kind"),
        F.when(~stays, F.col("first")).alias("refers_to"),
    )


def _name(page_id) -> str:
    return f"<{ID}{'' if page_id is None else page_id}>"


def _one_line(value: str) -> str:
    """A header value with its line ends escaped."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def as_uri(path: str) -> str:
    """``path`` as a URI that Spark and ``pyarrow.fs`` read alike."""
    if "://" in path:
        return path
    return "file://" + path.removeprefix("file:")


def record_head(page_id, url: str | None, kind: str, digest: str, size: int, refers_to, date: str) -> bytes:
    """WARC header, blank line and HTTP header of a record; the payload follows, if it is stored."""
    http = HTTP.format(size)
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == REVISIT:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if kind == RESPONSE else 0)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + http.encode()


def _gzip(parts: list[bytes]) -> bytes:
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return b"".join([*(pack.compress(p) for p in parts), pack.flush()])


def write_warc(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) to ``path`` and return ``(file, records, bytes)``.

    Each task writes one file under a name of its own attempt and renames it when
    complete, so a repeated or lost task leaves no half file behind.  Null html
    is an empty payload, a null url has no target URI.  Pages that share the
    least id of a payload are all responses; a null id is never least unless
    all are null.  Files without records are not written.
    """
    marked = with_references(pages, min_payload)
    stored = F.when(F.col("kind") == RESPONSE, F.col("html").cast("binary"))
    rows = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", stored.alias("html"), "digest", "size", "kind", F.col("refers_to").cast("string").alias("refers_to"))
    run_id = uuid.uuid4().hex[:12]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(as_uri(path))
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{run_id}.warc.gz"
        draft = f"{folder}/_draft-{part:06d}-{uuid.uuid4().hex}"
        out, records = None, 0
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, WRITE_ROWS) for r in batch.slice(at, WRITE_ROWS).to_pylist()):
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(draft, compression=None)
                head = record_head(row["page_id"], row["url"], row["kind"], row["digest"], row["size"], row["refers_to"], date)
                out.write(_gzip([head, row["html"] or b"", b"\r\n\r\n"]))
                records += 1
        if out is None:
            return
        size = out.tell()
        out.close()
        store.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

    return materialise(rows.mapInArrow(run, "file string, records long, bytes long"), "warc-files")


def byte_ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(file, start, stop)`` for all archives of a folder; only file lengths are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length").where("length > 0")
    cut = files.select(
        F.col("path").alias("file"), "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut.select("file", "start", F.least(F.col("start") + split_bytes, F.col("length")).alias("stop")).repartition(parts, "file", "start")


@dataclass
class Record:
    """A record read back; ``payload`` is empty unless it was asked for."""

    start: int
    end: int
    headers: dict[str, str]
    size: int
    digest: str
    payload: bytes = field(default=b"", repr=False)


class _NotARecord(Exception):
    pass


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise _NotARecord
        out[name.strip().lower()] = value.strip()
    return out


def read_member(source, start: int, whole: bool) -> Record:
    """Inflate the member at ``start``; raises when it is no complete WARC record.

    The WARC header is checked as soon as it is there, before any more is read.
    """
    source.seek(start)
    inflate = zlib.decompressobj(31)
    digest, size, kept = hashlib.sha256(), 0, []
    head, headers, left, http, raw, ended = b"", None, 0, None, 0, b""
    while not inflate.eof:
        data = inflate.unconsumed_tail
        if not data:
            data = source.read(READ_BYTES)
            raw += len(data)
        try:
            piece = inflate.decompress(data, READ_BYTES)
        except zlib.error as wrong:
            raise _NotARecord from wrong
        if not data and not piece and not inflate.eof:
            raise _NotARecord
        if headers is None:
            head += piece
            if head[: len(b"WARC/1.")] != b"WARC/1."[: len(head)]:
                raise _NotARecord
            at = head.find(b"\r\n\r\n")
            if at < 0:
                if len(head) > HEADER_BYTES:
                    raise _NotARecord
                continue
            headers = _headers(head[:at])
            if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
                raise _NotARecord
            left, piece = int(headers["content-length"]), head[at + 4 :]
            http = b"" if headers.get("content-type", "").startswith("application/http") else None
        block, over = piece[:left], piece[left:]
        left -= len(block)
        ended = (ended + over)[:5]
        if http is not None:
            http += block
            at = http.find(b"\r\n\r\n")
            if at < 0:
                if len(http) > HEADER_BYTES:
                    raise _NotARecord
                continue
            block, http = http[at + 4 :], None
        digest.update(block)
        size += len(block)
        if whole:
            kept.append(block)
    if headers is None or left or ended != b"\r\n\r\n":
        raise _NotARecord
    end = start + raw - len(inflate.unused_data)
    return Record(start, end, headers, size, digest.hexdigest(), b"".join(kept))


def _candidates(source, start: int, stop: int) -> int | None:
    """The first place of the gzip magic that starts in ``start..stop-1``, or None."""
    while start < stop:
        source.seek(start)
        data = source.read(min(READ_BYTES, stop - start) + len(MAGIC) - 1)
        at = data.find(MAGIC)
        if at >= 0:
            return start + at
        if len(data) < len(MAGIC):
            return None
        start += len(data) - len(MAGIC) + 1
    return None


def records_of_range(source, start: int, stop: int, whole: bool = False) -> Iterator[Record]:
    """The records that start in ``start..stop-1``.

    After a record the next is expected right behind it; anything else, and a
    candidate that does not inflate to a record, is searched byte by byte.
    """
    at = start
    while (at := _candidates(source, at, stop)) is not None:
        try:
            found = read_member(source, at, whole)
        except _NotARecord:
            at += 1
            continue
        yield found
        at = found.end


READ_SCHEMA = (
    "file string, start long, end long, record_type string, record_id string, target_uri string, refers_to string, "
    "header_digest string, size long, digest string, payload binary"
)
OUT_BYTES = 8 << 20


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``; see ``READ_SCHEMA``.

    ``size`` and ``digest`` are measured on the stored payload (0 and the empty
    digest for revisits), ``payload`` is null unless asked for.  Damaged members
    and bytes between members are passed over.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("file", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
            + [(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "refers_to", "header_digest")]
            + [("size", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for name, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3))):
                store, inner = fs.FileSystem.from_uri(as_uri(name))
                rows, held = [], 0
                with store.open_input_file(inner) as source:
                    for r in records_of_range(source, start, stop, payloads):
                        h = r.headers
                        rows.append(
                            (name, r.start, r.end, h["warc-type"], h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"),
                             h.get("warc-payload-digest"), r.size, r.digest, r.payload if payloads else None)
                        )
                        held += len(r.payload) + 500
                        if held > OUT_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return byte_ranges(spark, path, split_bytes).mapInArrow(run, READ_SCHEMA)


def page_of(record_id: Column, kind: str) -> Column:
    """The page id inside a record id; an empty one is null."""
    inner = F.regexp_extract(record_id, f"^<{ID}(.*)>$", 1)
    return F.when(inner != "", inner).cast(kind)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with ``full_size`` and ``full_digest``: of a revisit, those of the payload it refers to."""
    stored = records.where(F.col("record_type") == RESPONSE).groupBy("record_id").agg(F.min("size").alias("full"))
    asked = records.where(F.col("record_type") == REVISIT).groupBy(F.col("refers_to").alias("record_id")).agg(F.count(F.lit(1)).alias("copies"))
    found = materialise(asked.join(stored, "record_id").withColumnRenamed("record_id", "refers_to"), "revisited")
    joined = lookup(records, "refers_to", found, records.count())
    revisit = F.col("record_type") == REVISIT
    return joined.select(
        *records.columns,
        F.when(revisit, F.col("full")).otherwise(F.col("size")).alias("full_size"),
        F.when(revisit, F.expr("substring(header_digest, 8)")).otherwise(F.col("digest")).alias("full_digest"),
    )


def archive_and_read(pages: DataFrame, min_payload: int = MIN_PAYLOAD, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write ``pages`` to a new folder of the shared work folder and read them back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``
    as told by the archives, one row per page.  Repeated rows are records of
    their own.  An empty table gives no rows.  Other columns are not read.
    """
    spark = pages.sparkSession
    path = f"{as_uri(work_root(spark))}/warc/{uuid.uuid4().hex}"
    kind = pages.schema["page_id"].dataType.simpleString()
    wrote = write_warc(pages, path, min_payload)
    if wrote.isEmpty():
        return spark.createDataFrame([], f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
    records = materialise(read_warc(spark, path, split_bytes).drop("payload"), "warc-records")
    full = resolve_revisits(records)
    return full.select(
        page_of(F.col("record_id"), kind).alias("page_id"), F.col("full_size").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"),
        "record_type", page_of(F.col("refers_to"), kind).alias("refers_to"),
    )
