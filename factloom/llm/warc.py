"""WARC: a deterministic sharded writer and a reader of what its manifest lists.

Writing: payload digests are computed once into a small table; records whose payload occurs again
are assigned to the response they refer to; a histogram of payload bytes over ranges of the id
gives shard bounds that depend on the data only. Rows are dealt to shards, sorted by id and
streamed into gzip members; a file is closed when its compressed size reaches ``roll_bytes``. Each
file is written under a temporary name that no other attempt uses and renamed when whole. The
manifest is a table that Spark commits, so it lists the files of committed tasks only; a file that
no manifest lists does not exist for the reader. Two attempts at a shard write the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Stash, drop_folder, pick, range_shards, slices

#: Payloads below this many bytes are stored again rather than revisited.
REVISIT_LEAST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All records carry one date, so that equal input gives equal bytes; callers may pass another.
DATE = "2024-01-01T00:00:00Z"
MANIFEST_SCHEMA = "file string, shard long, part long, records long, bytes long, sha256 string"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, refers_to_id string, payload binary"


@dataclass(frozen=True)
class Layout:
    """shard_bytes: payload bytes aimed at in a shard; roll_bytes: compressed bytes of a file."""

    shard_bytes: int = 32 << 20
    roll_bytes: int = 32 << 20
    level: int = 6
    date: str = DATE


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _head(kind: str, fields: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8")


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _record_id(page_id: int | None, digest: str, copy: int) -> str:
    """Of the copy-th record with this row id and payload; all such rows are in one shard."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'factloom:page:{page_id}:{digest}:{copy}')}>"


def _clean(url: str | None) -> str:
    """A header value: control characters cannot end the header early."""
    return "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url or "")


def build_record(page_id: int | None, copy: int, url: str | None, payload: bytes, refers: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; headers, lengths and digests are generated from the payload."""
    sha = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Record-ID", _record_id(page_id, sha.hex(), copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", _b32(sha)),
        ("WARC-Block-Digest", _b32(hashlib.sha1(block).digest())),
        ("WARC-Row-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers, sha.hex(), 0)), ("WARC-Refers-To-Row-ID", "" if refers is None else str(refers))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _head("revisit" if revisit else "response", fields) + block + b"\r\n\r\n"


class _Roller:
    """Files of one shard, each closed when its compressed size reaches the limit."""

    def __init__(self, root: str, layout: Layout, shard: int):
        self.fs, self.path = _open(root)
        self.layout, self.shard, self.part, self.out = layout, shard, 0, None
        self.fs.create_dir(f"{self.path}/tmp", recursive=True)
        self.done: list[tuple] = []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.temp = f"{self.path}/tmp/{uuid.uuid4().hex}"
            self.out, self.sha, self.size, self.n = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0
        z = zlib.compressobj(self.layout.level, zlib.DEFLATED, 31)
        member = z.compress(record) + z.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.n += 1
        if self.size >= self.layout.roll_bytes:
            self.close()

    def _digest(self, name: str) -> str:
        sha = hashlib.sha256()
        with self.fs.open_input_stream(f"{self.path}/{name}", compression=None) as stream:
            while data := stream.read(1 << 20):
                sha.update(data)
        return sha.hexdigest()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        name = f"part-{self.shard:07d}-{self.part:05d}.warc.gz"
        there = self.fs.get_file_info(f"{self.path}/{name}")
        if there.is_file and there.size == self.size and self._digest(name) == self.sha.hexdigest():  # another attempt at this shard
            self.fs.delete_file(self.temp)
        else:
            self.fs.move(self.temp, f"{self.path}/{name}")
        self.done.append((name, self.shard, self.part, self.n, self.size, self.sha.hexdigest()))
        self.part, self.out = self.part + 1, None


def _writer(root: str, layout: Layout):
    schema = pa.schema([("file", pa.string()), ("shard", pa.int64()), ("part", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, page, refer, last, copies = None, object(), {}, None, 0
        for b in slices(batches):
            for shard, page_id, tag, url, html, digest, refers in zip(*(b.column(i).to_pylist() for i in range(7))):
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in roller.done], schema)
                    roller = _Roller(root, layout, shard)
                if page != page_id:
                    page, refer, last = page_id, {}, None
                if tag == 0:
                    refer[digest] = refers
                    continue
                payload = (html or "").encode("utf-8", "surrogatepass")
                own = hashlib.sha1(payload).hexdigest()
                copies = copies + 1 if own == last else 0  # equal payloads of a row id follow each other
                last = own
                again = own in refer and (refer[own] != page_id or copies > 0)
                roller.add(build_record(page_id, copies, url, payload, refer.get(own), again, layout.date))
        if roller is not None:
            roller.close()
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in roller.done], schema)

    return write


def write_warc(pages: DataFrame, root: str, layout: Layout = Layout(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row below ``root`` and return the committed manifest.

    The payload is the text in UTF-8, null read as empty. Of rows with equal payloads of at least
    1000 bytes, the one with the largest id is a response and the others are revisits of it; of
    rows that share that id the first written is the response. Rows without an id sort first, are
    never preferred as response to rows with one, and refer to each other only where no row of
    their payload has an id. Record ids are unique: each names its row's id, its payload and which
    copy of both it is. Ids are cast to long, payloads of any length are written whole, and further columns
    are not read, whatever their names. A null url gives an empty header value. An empty table gives an empty
    manifest and no files.
    """
    spark = pages.sparkSession
    stash = Stash(spark, "warc")
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("page_id", F.col("page_id").cast("long"))
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    digests = stash.put(rows.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes")))
    large = digests.where(F.col("payload_bytes") >= REVISIT_LEAST)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1").select("digest", "refers")
    notes = large.join(groups, "digest").select("page_id", "digest", "refers").distinct()
    deal, count = range_shards(stash, digests, "page_id", "payload_bytes", layout.shard_bytes)
    none = F.lit(None)
    # rows that share an id and a payload share a shard with their note
    noted = deal(notes, F.xxhash64("digest")).select("shard", "page_id", F.lit(0).alias("tag"), none.cast("string").alias("url"), none.cast("string").alias("html"), "digest", "refers")
    bodies = deal(rows, F.xxhash64(F.sha1(payload))).select("shard", "page_id", F.lit(1).alias("tag"), "url", F.col("html").cast("string").alias("html"), none.cast("string").alias("digest"), none.cast("long").alias("refers"))
    dealt = noted.unionByName(bodies).repartitionById(count, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "tag", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")), "url")
    files = f"{root}/data"
    dealt.mapInArrow(_writer(files, layout), MANIFEST_SCHEMA).write.parquet(f"{root}/manifest")
    drop_folder(spark, f"{files}/tmp")  # what failed attempts have left
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/manifest")


def parse_members(stream, block: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member, one in memory at a time."""
    z, parts = zlib.decompressobj(31), []
    data = stream.read(block)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            record = b"".join(parts)
            head, _, rest = record.partition(b"\r\n\r\n")
            lines = head.decode("utf-8").split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError("not a WARC record")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            n = int(fields["Content-Length"])
            if len(rest) != n + 4:
                raise ValueError("record length differs from its header")
            yield fields, rest[:n]
            data, z, parts = z.unused_data, zlib.decompressobj(31), []
            if data:
                continue
        data = stream.read(block)
    if parts:
        raise ValueError("file ends inside a record")


def _reader(root: str, bodies: bool):
    import re

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary())])

    def number(x: str | None) -> int | None:
        return int(x) if x else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(root)
        rows, held = [], 0
        for b in batches:
            for name in b.column("file").to_pylist():
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for fields, block in parse_members(stream):
                        if _b32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: block digest differs")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = fields["WARC-Type"] == "revisit"
                        sha = base64.b32decode(fields["WARC-Payload-Digest"][5:])
                        if not revisit and hashlib.sha1(payload).digest() != sha:
                            raise ValueError(f"{name}: payload digest differs")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        rows.append((number(fields["WARC-Row-ID"]), size, sha.hex(), fields["WARC-Type"], number(fields.get("WARC-Refers-To-Row-ID")), fields["WARC-Target-URI"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), payload if bodies and not revisit else None))
                        held += len(payload) if bodies else 200
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return read


def read_warc(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """The records of every file that the manifest lists, each checked against its digests."""
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/manifest")
    files = manifest.select("file").repartition(max(1, min(10_000, manifest.count())), F.xxhash64("file"))
    return files.mapInArrow(_reader(f"{root}/data", payloads), READ_SCHEMA)


def archive_faults(records: DataFrame) -> DataFrame:
    """(fault, record_id, n) of an archive's records: ids that are not unique, and revisits whose response
    is missing or has another payload. Empty for a sound archive."""
    ids = records.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("REPEATED_ID").alias("fault"), "record_id", "n")
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), "payload_digest", F.col("page_id").alias("refers_to")).distinct()
    revisits = records.where("record_type = 'revisit'")
    same = (revisits["refers_to_id"] == responses["refers_to_id"]) & (revisits["payload_digest"] == responses["payload_digest"]) & revisits["refers_to"].eqNullSafe(responses["refers_to"])
    lost = revisits.join(responses, same, "left_anti").select(F.lit("NO_RESPONSE").alias("fault"), "record_id", F.lit(1).cast("long").alias("n"))
    return ids.unionByName(lost)
