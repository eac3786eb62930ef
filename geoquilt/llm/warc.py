"""WARC archives: a deterministic sharded writer and its reader.

The writer deals records into shards by ranges of their id, sorts each shard,
and streams it into gzip members.  A file is rolled when its compressed size
passes a limit.  Headers, record ids and digests are regenerated from the
payload, nothing depends on time or host, so a task that runs again writes the
same bytes.  Files are written under temporary names and renamed, and only then
named by the manifest, a table that Spark commits; a reader opens what the
manifest names and checks it.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import posixpath
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from geoquilt.storage import discard, range_of, stored

HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A date that does not depend on the run, as no crawl time is known.
WARC_DATE = "2000-01-01T00:00:00Z"
ROLL_BYTES = 64 << 20
#: Payload bytes and rows of a shard, and cut points at most; beyond those, ranges are cut into steps.
SHARD_BYTES, ROWS_PER_SHARD, MAX_CUTS = 32 << 20, 20_000, 4096
COLUMNS = ("shard", "page_id", "kind", "digest", "leader", "home", "leader_url", "url", "payload")
MANIFEST = "file string, shard int, seq int, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def payload_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column: five hex digits make four base32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def digests(pages: DataFrame) -> DataFrame:
    """Stored (page_id, url, digest, bytes, salt) of every row of ``pages(page_id, url, payload)``.

    The only pass over the payloads before they are written.  ``salt`` deals the
    rows of one id.
    """
    return stored(
        pages.select(
            "page_id", "url", payload_sha1(F.col("payload")).alias("digest"), F.length("payload").cast("long").alias("bytes"), _salt()
        ),
        "warc-digests",
    )


def _salt() -> Column:
    return F.xxhash64("url", "payload").alias("salt")


@dataclass(frozen=True)
class Shards:
    """Ranges of page ids, each cut into equal steps; a frequent id and null have shards to deal their rows over."""

    nulls: int
    steps: int
    cuts: tuple[int, ...]  # ascending; a frequent id stands there several times
    least: int
    most: int

    @property
    def count(self) -> int:
        return self.nulls + self.steps * (len(self.cuts) + 1)

    def of(self, page_id: Column, salt: Column) -> Column:
        """Shard of a row; shards follow each other in the order of ids, null first."""
        ends = sorted(Counter(self.cuts).items())
        null = F.pmod(salt, F.lit(max(1, self.nulls)))
        if not ends:
            inner, low, high = F.lit(0), F.lit(self.least), F.lit(self.most)
            frequent, dealt = F.lit(False), F.lit(0)
        else:
            values, counts = [v for v, _ in ends], [c for _, c in ends]
            k = range_of(page_id, values)
            at = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), k + 1)
            inner, low, high = at([0, *itertools.accumulate(counts)]), at([self.least, *values]), at([*values, self.most])
            times = at([1, *counts])
            frequent = (times > 1) & (page_id == low)
            dealt = F.pmod(salt, (times - 1) * self.steps + 1)
        part = F.floor((page_id - low) / F.greatest(high - low, F.lit(1)) * self.steps)
        step = inner * self.steps + F.least(F.greatest(part, F.lit(0)), F.lit(self.steps - 1))
        # the ranges between the cuts at a frequent id are its own
        shard = F.when(frequent, inner * self.steps - dealt).otherwise(step)
        return F.when(page_id.isNull(), null).otherwise(shard + self.nulls).cast("int")


def shards_for(known: DataFrame, shard_bytes: int, rows_per_shard: int) -> Shards:
    """Shards of about ``shard_bytes`` of payload and ``rows_per_shard`` rows at most, by approximate quantiles of ids."""
    rows, held, ids, least, most = known.agg(F.count("*"), F.sum("bytes"), F.count("page_id"), F.min("page_id"), F.max("page_id")).first()
    n = max(1, math.ceil(max((held or 0) / shard_bytes, rows / rows_per_shard)))
    nulls = math.ceil(n * (rows - ids) / max(rows, 1))
    ranges, cuts = min(MAX_CUTS, max(1, n - nulls)), []
    if ids and ranges > 1:
        cuts = known.agg(F.percentile_approx("page_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    return Shards(nulls, max(1, math.ceil((n - nulls) / ranges)), tuple(sorted(cuts)), least or 0, most or 0)


def duplicates(known: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Distinct (page_id, shard, digest, leader, home, leader_url) of the rows whose payload others share.

    The leader of a payload is its largest page_id; the response is its first
    row in the ``home`` shard.  Only digests travel, and counts per digest are
    pre-aggregated, so a payload that a third of the pages share costs one row
    per task.
    """
    kept = known.where(F.col("bytes") >= min_revisit_bytes).select("page_id", "url", "digest", "shard")
    order = F.struct("page_id", (-F.col("shard")).alias("back"))
    shared = kept.groupBy(F.col("digest").alias("shared")).agg(F.max(order).alias("top"), F.count("*").alias("n"))
    shared = stored(shared.where("n > 1").select("shared", F.col("top.page_id").alias("leader"), (-F.col("top.back")).alias("home")), "warc-shared")
    rows = kept.join(shared, F.col("digest") == F.col("shared"))
    first = rows.where(F.col("page_id").eqNullSafe(F.col("leader")) & (F.col("shard") == F.col("home")))
    urls = first.groupBy(F.col("digest").alias("d")).agg(F.min(F.struct("url"))["url"].alias("leader_url"))
    pairs = rows.select("page_id", "shard", "digest", "leader", "home").distinct()
    return pairs.join(stored(urls, "warc-leaders"), F.col("digest") == F.col("d")).drop("d")


def _header(fields: list[tuple[str, object]], first: str) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode()


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _page_urn(page_id: int | None) -> str | None:
    return None if page_id is None else f"<urn:x-page:{page_id}>"


def _target(url: str | None) -> str | None:
    """A URL, percent-encoded where a header could not hold it."""
    return None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def response_id(digest: str) -> str:
    """Record id of the one response among records that share a payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response\n{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, record_id: str, leader: tuple[int | None, str | None] | None = None) -> bytes:
    """One WARC/1.1 record with regenerated headers; a ``leader`` (page_id, url) makes it a revisit.

    A revisit carries no payload but its digest and length, and names the record
    it refers to, its URL and its date.
    """
    digest = _sha1(payload)
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    block = http if leader else http + payload
    refers = [] if leader is None else [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", response_id(digest)),
        ("WARC-Refers-To-Target-URI", _target(leader[1])),
        ("WARC-Refers-To-Date", WARC_DATE),
        ("X-Refers-To-Page", _page_urn(leader[0])),
    ]
    fields = [
        ("WARC-Type", "revisit" if leader else "response"),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", WARC_DATE),
        ("WARC-Target-URI", _target(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{_sha1(block)}"),
        *refers,
        ("X-Page", _page_urn(page_id)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _header(fields, "WARC/1.1") + block + b"\r\n\r\n"


def info_bytes(name: str) -> bytes:
    """The warcinfo record in front of a file."""
    block = b"format: WARC File Format 1.1\r\n"
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'warcinfo' + chr(10) + name)}>"),
        ("WARC-Date", WARC_DATE),
        ("WARC-Filename", name),
        ("WARC-Block-Digest", f"sha1:{_sha1(block)}"),
        ("Content-Type", "application/warc-fields"),
        ("Content-Length", len(block)),
    ]
    return _header(fields, "WARC/1.1") + block + b"\r\n\r\n"


class _Roll:
    """The files of one shard: opened under a temporary name, renamed when full."""

    def __init__(self, folder: str, shard: int, attempt: str, roll_bytes: int) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.shard, self.attempt, self.roll_bytes = shard, attempt, roll_bytes
        self.seq, self.out = 0, None
        self.fs.create_dir(self.root, recursive=True)

    def write(self, record: bytes) -> Iterator[dict]:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temporary = posixpath.join(self.root, f"_tmp-{self.attempt}-{self.name}")
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.records, self.bytes, self.sha = 0, 0, hashlib.sha256()
            self._put(info_bytes(self.name))
        self._put(record)
        self.records += 1
        if self.bytes >= self.roll_bytes:
            yield from self.close()

    def _put(self, record: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # one gzip member a record, without a time stamp
        packed = packer.compress(record) + packer.flush()
        self.out.write(packed)
        self.sha.update(packed)
        self.bytes += len(packed)

    def close(self) -> Iterator[dict]:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        self.fs.move(self.temporary, posixpath.join(self.root, self.name))
        yield {"file": self.name, "shard": self.shard, "seq": self.seq, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest()}
        self.seq += 1


def _writer(folder: str, roll_bytes: int):
    schema = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = f"{TaskContext.get().taskAttemptId()}"
        roll, page, shared, seen, times = None, object(), {}, set(), Counter()
        done: list[dict] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
                shard, page_id, kind, digest, leader, home, leader_url, url, payload = row
                if roll is None or roll.shard != shard:
                    done += roll.close() if roll else []
                    roll, page = _Roll(folder, shard, attempt, roll_bytes), object()
                if page_id != page:
                    page, shared, seen, times = page_id, {}, set(), Counter()
                if kind == 0:  # what is known of this id's shared payloads comes before its records
                    shared[digest] = (leader, home, leader_url)
                    continue
                own = _sha1(payload)
                leads = shared.get(own)
                first = leads is not None and own not in seen and leads[0] == page_id and leads[1] == shard
                seen.add(own)
                times[own] += 1
                name = f"record\n{page_id}\n{own}\n{shard}\n{times[own]}"
                record_id = response_id(own) if first else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
                done += roll.write(record_bytes(page_id, url, payload, record_id, None if leads is None or first else (leads[0], leads[2])))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if roll:
            done += roll.close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return write


def write_archives(
    pages: DataFrame,
    folder: str,
    min_revisit_bytes: int = 0,
    roll_bytes: int = ROLL_BYTES,
    rows_per_shard: int = ROWS_PER_SHARD,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` below ``folder``; return the manifest.

    A null html is an empty payload, a null url leaves out the target header, a
    null page_id sorts first.  Of the rows with equal payloads of at least
    ``min_revisit_bytes`` bytes one with the largest page_id is a response and the
    others revisit it, by its record id; of several with that id it is the first
    by url in the first shard.  Rows with a null or very frequent page_id are dealt
    over several shards; only rows equal in id, url and html are streamed into one,
    which rolls.  Very long payloads are held one at a time.  Payloads cross the
    network once, in the range shuffle; other columns are not looked at.  An empty table
    has an empty manifest.  ``folder`` is a URI that all executors can write to; the
    manifest is committed last, and what failed attempts left is then removed.
    """
    records = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    known = digests(records)
    shards = shards_for(known, shard_bytes, rows_per_shard)
    shard = shards.of(F.col("page_id"), F.col("salt")).alias("shard")
    marks = duplicates(known.select("*", shard), min_revisit_bytes).withColumn("kind", F.lit(0))
    rows = records.select("*", _salt()).select("page_id", "url", "payload", shard, F.lit(1).alias("kind"))
    rows = rows.unionByName(marks, allowMissingColumns=True)
    sorted_rows = rows.repartitionByRange(shards.count, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "kind", "url", "digest")
    manifest = sorted_rows.select(*COLUMNS).mapInArrow(_writer(folder.rstrip("/") + "/records", roll_bytes), MANIFEST)
    manifest.write.parquet(folder.rstrip("/") + "/manifest")
    discard(known)
    store, root = pafs.FileSystem.from_uri(folder.rstrip("/") + "/records")
    for left in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if left.base_name.startswith("_tmp-"):
            store.delete_file(left.path)
    return pages.sparkSession.read.schema(MANIFEST).parquet(folder.rstrip("/") + "/manifest")


def _members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    rest = stream.read(size)
    while rest:
        parts.append(unpacker.decompress(rest))
        if unpacker.eof:
            yield b"".join(parts)
            rest, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []
            rest = rest or stream.read(size)
        else:
            rest = stream.read(size)
    if parts:
        raise ValueError("the last gzip member is cut off")


def parse_record(member: bytes) -> dict:
    """A record's fields; its block and payload digests must hold."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Type"] == "warcinfo":
        return {"record_type": "warcinfo"}
    if fields["WARC-Block-Digest"] != f"sha1:{_sha1(block)}":
        raise ValueError(f"the block of {fields['WARC-Record-ID']} does not have its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != length or _sha1(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not have its digest")
    number = lambda k: int(fields[k].rsplit(":", 1)[1].rstrip(">")) if k in fields else None
    return {"page_id": number("X-Page"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": digest, "refers_to": number("X-Refers-To-Page"), "payload": None if revisit else payload}


def _reader(folder: str, columns: list[str], rows_per_batch: int = 256):
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(c, kinds[c]) for c in columns])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, n, sha in zip(*(batch.column(c).to_pylist() for c in ("file", "records", "sha256")), strict=True):
                found, rows, check = 0, [], hashlib.sha256()
                with store.open_input_stream(posixpath.join(root, name), compression=None) as stream:

                    class Checked:
                        def read(self, size: int) -> bytes:
                            check.update(data := stream.read(size))
                            return data

                    for member in _members(Checked()):
                        record = parse_record(member)
                        if record["record_type"] == "warcinfo":
                            continue
                        rows.append({c: record[c] for c in columns})
                        found += 1
                        if len(rows) >= rows_per_batch:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if found != n or check.hexdigest() != sha:
                    raise ValueError(f"{name} is not what the manifest says")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_archives(manifest: DataFrame, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The records of the files that ``manifest`` names, checked against it."""
    full = T.StructType.fromDDL(RECORDS)
    columns = columns or full.names
    schema = T.StructType([full[c] for c in columns])
    files = manifest.select("file", "records", "sha256").repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(_reader(folder.rstrip("/") + "/records", columns), schema)
