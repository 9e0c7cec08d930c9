"""WARC archives with a two-level capture index.

warc/NNNNNN.warc.gz  records, each a gzip member of its own
index/NNNNNN.idx     captures in order of reversed-host URL keys, in compressed blocks
index/NNNNNN.dir     sparse directory of those blocks: first key, place, length
index/first.json     the first key of each index file
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pick, written
from .files import Ranges, opened, put

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = b"application/http; msgtype=response"


def url_key(url: str | None) -> str:
    """Host labels from last to first, then port, path and query: com,example)/a?b. Lower-case host, no fragment."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut_ = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut_].rpartition("@")[2].lower(), rest[cut_:] or "/"
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + path


def _clean(url: str | None) -> bytes:
    """A URL as one header value: white space and control characters percent-encoded."""
    return b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes([c]) for c in (url or "").encode())


def record_id(page_id: int | None, digest: str, again: str = "") -> bytes:
    """The URI of a record: of a page and what it holds; again tells repeated ones apart. A page without number is "-"."""
    return b"<urn:page:%s:%s%s>" % (b"-" if page_id is None else b"%d" % page_id, digest[:32].encode(), again.encode())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, again: str = "") -> bytes:
    """One WARC record: a response with its payload, or a revisit of another page's response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + record_id(page_id, digest, again),
        b"WARC-Date: " + date.encode(),
        b"WARC-Target-URI: " + _clean(url),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
    ]
    if revisit:
        lines += [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: " + record_id(refers_to, digest)]
    lines += [b"Content-Type: " + HTTP_TYPE, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """What a record holds. The payload's digest is held against the header's; a revisit has no payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError(f"not a record: {version!r}")
    fields = dict(line.split(b": ", 1) if b": " in line else (line.rstrip(b":"), b"") for line in lines)
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
    number = lambda name: None if (x := fields[name].split(b":")[2]) == b"-" else int(x)
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"page {number(b'WARC-Record-ID')}: the payload is not what its digest says")
    return {
        "page_id": number(b"WARC-Record-ID"),
        "url": fields[b"WARC-Target-URI"].decode(),
        "record_type": kind,
        "refers_to": number(b"WARC-Refers-To") if kind == "revisit" else None,
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": payload if kind == "response" else None,
    }


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z", block_lines: int = 512, level: int = 3, archive_bytes: int = 64 << 20) -> None:
    """Writes a record for each page, and the index of all captures.

    Of pages with equal payloads of least_bytes or more, the one with the smallest page_id is the
    response and the others revisit it (rows with that same page_id are responses too). The smallest
    ids come from an aggregate with partial results; the join with them is one that AQE splits at a
    payload that very many pages share. A task begins a new archive each archive_bytes. Captures are
    sorted by reversed-host key and page, so a host with very many pages spreads over index files.

    Null html: an empty payload. Null url: key "". Null page_id: a record without number, a revisit
    if its payload has a response elsewhere, never one that others refer to. No pages: no records.
    """
    spark = pages.sparkSession
    whole = pick(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    hashed = whole.withColumn("digest", F.sha2("payload", 256))
    firsts = hashed.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"))
    known = hashed.join(firsts, "digest", "left")
    typed = known.select("page_id", "url", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"), "payload")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, k, parts, at, last, same = TaskContext.get().partitionId(), 0, [], 0, None, 0
        name = f"{number:08d}-{k:06d}.warc.gz"
        for batch in batches:
            rows = []
            for page, url, digest, refers, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                same = same + 1 if last == (page, digest) else 0
                last = page, digest
                again = f":{number}-{same}" if same else ""
                parts.append(gzip.compress(record(page, url, payload, digest, refers, date, again), level, mtime=0))
                rows.append((url_key(url), page, name, at, len(parts[-1])))
                at += len(parts[-1])
                if at >= archive_bytes:
                    put(f"{folder}/warc", name, parts)
                    k, parts, at = k + 1, [], 0
                    name = f"{number:08d}-{k:06d}.warc.gz"
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "place", "size"])
        if parts:
            put(f"{folder}/warc", name, parts)

    # Sorted in full, so that a task that runs again writes the same file.
    captures = written(typed.sortWithinPartitions("digest", "page_id", "url").mapInArrow(archive, "key string, page_id long, file string, place long, size long"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, blocks, directory, lines, at = f"{TaskContext.get().partitionId():08d}", [], [], [], 0

        def flush() -> None:
            nonlocal at, lines
            blocks.append(zlib.compress(b"\n".join(json.dumps(x).encode() for x in lines), 6))
            directory.append([lines[0][0], at, len(blocks[-1])])
            at, lines = at + len(blocks[-1]), []

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                lines.append(row)
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if blocks:
            put(f"{folder}/index", f"{name}.idx", blocks)
            put(f"{folder}/index", f"{name}.dir", [json.dumps(directory).encode()])
            yield pa.RecordBatch.from_pydict({"file": [name], "key": [directory[0][0]]})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "place").mapInArrow(index, "file string, key string").collect()
    put(f"{folder}/index", "first.json", [json.dumps(sorted([x.key, x.file] for x in files)).encode()])


def _batch(rows: list, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def _loaded(folder: str, name: str):
    fs, base = opened(folder)
    with fs.open_input_file(f"{base}/{name}") as f:
        return json.loads(f.read())


def lookup(folder: str, url: str) -> list[dict]:
    """All captures of a URL's key: binary search over index files and blocks, then reads of ranges only."""
    key, out = url_key(url), []
    firsts = _loaded(f"{folder}/index", "first.json")
    blocks, records = Ranges(f"{folder}/index"), Ranges(f"{folder}/warc")
    # A key may go over several files and blocks: the last that begins before it, and all that begin with it.
    start = max(0, _before(firsts, key))
    for first, name in firsts[start:]:
        if first > key:
            break
        directory = _loaded(f"{folder}/index", f"{name}.dir")
        for first_, at, size in directory[max(0, _before(directory, key)) :]:
            if first_ > key:
                break
            for line in zlib.decompress(blocks.read(f"{name}.idx", at, size)).split(b"\n"):
                k, _, file, place, length = json.loads(line)
                if k == key:
                    out.append(parsed(gzip.decompress(records.read(file, place, length))))
    return out


def _before(entries: list, key: str) -> int:
    """The last entry whose key is smaller than key, or -1."""
    lo, hi = 0, len(entries)
    while lo < hi:
        mid = (lo + hi) // 2
        if entries[mid][0] < key:
            lo = mid + 1
        else:
            hi = mid
    return lo - 1


def lookups(spark: SparkSession, folder: str, urls: DataFrame, ahead: int = 4 << 20) -> DataFrame:
    """All captures of the URLs in urls(url): (page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload).

    Keys are dealt in order, and each is searched for: by halves in the first keys of index files, then
    in the sparse directory of a file. That gives blocks, and a key of very many captures is one row a
    block. Blocks are read as ranges, and the lines of a key found in them by halves; records are read
    as ranges as well, neighbours of an archive together. Repeated and unknown URLs do no harm.
    """
    n, most_rows = int(spark.conf.get("spark.sql.shuffle.partitions")), 20_000
    places_ = {"file": pa.string(), "place": pa.int64(), "size": pa.int64()}
    spots = {"key": pa.string(), **places_}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, held, directory = _loaded(f"{folder}/index", "first.json"), None, []
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                for first, name in firsts[max(0, _before(firsts, key)) :]:
                    if first > key:
                        break
                    if name != held:
                        held, directory = name, _loaded(f"{folder}/index", f"{name}.dir")
                    for first_, at, size in directory[max(0, _before(directory, key)) :]:
                        if first_ > key:
                            break
                        rows.append((key, name, at, size))
                        if len(rows) == most_rows:
                            yield _batch(rows, spots)
                            rows = []
            yield _batch(rows, spots)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Ranges(f"{folder}/index")
        for batch in batches:
            rows = []
            for name, at, size, keys in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                block = [json.loads(x) for x in zlib.decompress(reader.read(f"{name}.idx", at, size)).split(b"\n")]
                for key in keys:
                    i = _before(block, key) + 1
                    while i < len(block) and block[i][0] == key:
                        rows.append(block[i][2:])
                        i += 1
                if len(rows) >= most_rows:
                    yield _batch(rows, places_)
                    rows = []
            yield _batch(rows, places_)

    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, name, begin = Ranges(f"{folder}/warc"), b"", None, 0
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            rows, size_of = [], 0
            for j, (file, place, size) in enumerate(places):
                if file != name or place < begin or place + size > begin + len(held):
                    end = place + size
                    for f, p, z in places[j + 1 :]:  # on over small gaps
                        if f != file or p - end > 1 << 16 or p + z - place > ahead:
                            break
                        end = p + z
                    name, begin = file, place
                    held = reader.read(file, place, end - place)
                rows.append(parsed(gzip.decompress(held[place - begin : place - begin + size])))
                size_of += rows[-1]["payload_bytes"]
                if size_of > ahead:
                    yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})
                    rows, size_of = [], 0
            if rows:
                yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})

    keys = urls.select("url").mapInArrow(keyed, "key string").distinct()
    blocks = keys.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(search, "key string, file string, place long, size long")
    asked = blocks.groupBy("file", "place", "size").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    found = asked.repartition(n, "file", "place").sortWithinPartitions("file", "place").mapInArrow(lines, "file string, place long, size long")
    found = found.repartition(n, "file").sortWithinPartitions("file", "place")
    return found.mapInArrow(records, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def op3_warc(spark, sf_dir):
    """Contract query of operator 3 over all of pages: all captures of their URLs, by way of the index."""
    from ._common import shared_dir, table

    folder = shared_dir(spark)
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, folder)
    return lookups(spark, folder, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""
