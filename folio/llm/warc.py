"""WARC archives: a normaliser for monolithic gzip, with a sidecar offset index.

Archives are rows (archive string, data binary) of tables in the cluster's shared folder, so any
store that Spark reads will do; the functions on bytes serve for files as well. A monolithic archive
is one gzip stream. The normaliser inflates it once in steps, writes each record as a gzip member of
its own and notes the offset and length of each. Records are then read by their offsets alone. exported()
writes the archives as files, each with its index beside it.

Records follow WARC/1.1: responses hold an HTTP head and the payload, revisits the head alone, with the
digest of the payload they stand for; reading checks a response by its payload, a revisit by the response
that it names. Pages carry no time of capture, so WARC-Date is the parameter DATE.

Defined results: null html is an empty payload; payloads under 100 bytes are never revisits; of rows
with equal payloads those with the smallest page_id are responses; a null page_id is a response unless
another row has its payload and an id, and its record has an id of its own; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import dropped, table, written

LEAST = 100
#: Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 8_000_000
END = b"\r\n\r\n"


#: Time of capture in all records.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, uri: str, record_id: str, payload: bytes, digest: str, length: int, refers_to: str | None = None) -> bytes:
    """A record; payload is empty for a revisit, digest and length are always those of the whole payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}".encode() + END
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <{record_id}>", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(http) + len(payload)}"]).encode("utf-8", "surrogatepass") + END + http + payload + END


def inflated(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or many, in steps."""
    rest = data
    while rest:
        d = zlib.decompressobj(31)
        while not d.eof:
            got = d.decompress(rest, step)
            rest = d.unconsumed_tail
            if got:
                yield got
            elif not rest and not d.eof:
                raise ValueError("the gzip stream ends too early")
        rest = d.unused_data


def parsed(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, block and all bytes of each record of an inflated archive; one record at a time is in memory."""
    buf = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        got = next(chunks, None)
        if got is not None:
            buf.extend(got)
        return got is not None

    while True:
        while (at := buf.find(END)) < 0:
            if not more():
                if buf.strip():
                    raise ValueError("the archive ends within a header")
                return
        first, *lines = bytes(buf[:at]).decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record begins here")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        need = at + 4 + int(head["content-length"]) + 4
        while len(buf) < need:
            if not more():
                raise ValueError("the archive ends within a record")
        block = bytes(buf[at + 4 : need - 4])
        yield head, block, bytes(buf[:need])
        del buf[:need]


def normalised(data: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The archive with a gzip member per record, and the offset and length of each member."""
    out, index = bytearray(), []
    for _, _, raw in parsed(inflated(data)):
        member = gzip.compress(raw, 1, mtime=0)
        index.append((len(out), len(member)))
        out += member
    return bytes(out), index


def read_at(data: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers (those of HTTP as http-<name>) and payload of the record of one member."""
    head, block, _ = next(parsed(inflated(data[offset : offset + length])))
    http, _, payload = block.partition(END)
    lines = http.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return head | {f"http-{k.strip().lower()}": v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload binary (empty for revisits), payload_bytes, payload_digest, refers_to."""
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    full = full.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # digests and ids alone are gathered; the few digests that repeat meet the pages again, without their texts moving where Spark can broadcast them
    firsts = full.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first")
    met = full.join(firsts, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return met.select("page_id", "url", F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(again, F.col("first")).alias("refers_to"))


def archives(roles: DataFrame) -> DataFrame:
    """archive string, data binary: monolithic gzip archives of about ARCHIVE_BYTES of records each."""

    def run(batches):
        part, k, z, size, parts, nameless = TaskContext.get().partitionId(), 0, None, 0, [], 0
        for b in batches:
            for cols in zip(*b.columns):
                page, url, payload, n, digest, first = (c.as_py() for c in cols)
                kind = "response" if first is None else "revisit"
                nameless += page is None
                rec = record(kind, url.replace("\r", "%0D").replace("\n", "%0A"), f"urn:page:null-{part}-{nameless}" if page is None else f"urn:page:{page}", payload, digest, n, None if first is None else f"urn:page:{first}")
                z = z or zlib.compressobj(1, zlib.DEFLATED, 31)
                parts.append(z.compress(rec))
                size += len(rec)
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{k:05d}.warc.gz"]), pa.array([b"".join([*parts, z.flush()])], pa.binary())], names=["archive", "data"])
                    k, z, size, parts = k + 1, None, 0, []
        if z:
            yield pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{k:05d}.warc.gz"]), pa.array([b"".join([*parts, z.flush()])], pa.binary())], names=["archive", "data"])

    return roles.mapInArrow(run, "archive string, data binary")


def normalise(stored: DataFrame) -> DataFrame:
    """archive, data binary (a member per record), offsets, lengths array<long>: the sidecar index."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0), b.column(1)):
                out, index = normalised(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([out], pa.binary()), pa.array([[o for o, _ in index]], pa.list_(pa.int64())), pa.array([[n for _, n in index]], pa.list_(pa.int64()))], names=["archive", "data", "offsets", "lengths"])

    return stored.mapInArrow(run, "archive string, data binary, offsets array<bigint>, lengths array<bigint>")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def read_back(normal: DataFrame) -> DataFrame:
    """A row of READ for each record, read by the index; payloads of responses are checked by their digests."""
    number = lambda s: None if (x := s.strip("<>").rsplit(":", 1)[1]).startswith("null") else int(x)

    def run(batches):
        for b in batches:
            for name, data, offsets, lengths in zip(*b.columns):
                data, rows = data.as_py(), []
                for o, n in zip(offsets.as_py(), lengths.as_py()):
                    head, block = read_at(data, o, n)
                    digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(head["http-content-length"])
                    kind = head["warc-type"]
                    if kind == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != size):
                        raise ValueError(f"{name} at {o}: the payload is damaged")
                    to = number(head["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((number(head["warc-record-id"]), size, digest, kind, to, name.as_py(), o, n))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in READ.split(", ")])

    return normal.mapInArrow(run, READ)


def checked(read: DataFrame) -> DataFrame:
    """The rows; fails where a revisit names a record that is no response or has another digest."""
    own = read.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("of")).distinct()
    named = read.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    wrong = named.join(own, "refers_to", "left").where("of is null or of <> payload_digest").limit(1).collect()
    if wrong:
        raise ValueError(f"a revisit names record {wrong[0].refers_to}, which has not its payload")
    return read


def exported(normal: DataFrame, uri: str) -> DataFrame:
    """Write each archive to the folder as a file, its index beside it (offset and length of each member by line). archive, bytes, records."""

    def run(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(uri)
        store.create_dir(top, recursive=True)
        for b in batches:
            for name, data, offsets, lengths in zip(*b.columns):
                name, data = name.as_py(), data.as_py()
                index = "".join(f"{o} {n}\n" for o, n in zip(offsets.as_py(), lengths.as_py())).encode()
                for suffix, content in (("", data), (".idx", index)):
                    with store.open_output_stream(f"{top}/{name}{suffix}", compression=None) as out:
                        out.write(content)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64()), pa.array([len(offsets.as_py())], pa.int64())], names=["archive", "bytes", "records"])

    return normal.mapInArrow(run, "archive string, bytes long, records long")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of all pages, normalise them and read every record back."""
    stored = written(archives(with_roles(pages)), "warc")
    normal = written(normalise(stored), "warc-normal")
    dropped(stored)
    return checked(written(read_back(normal), "warc-read"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as read back from the archives."""
    return warc_round_trip(table(spark, sf_dir, "pages"))
