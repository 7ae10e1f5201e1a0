"""WARC archives with a two-level capture index.

Pages are sorted by reversed-host URL key (com,example,news)/path) and page and cut into parts by range.  A part is three
files in the shared folder: the records (one gzip member each), the index lines in compressed blocks, and a sparse
directory with each block's first key and place.  A lookup finds the part in the manifest, a file of the same folder, and the
block in the directory by binary search, reads that range, finds the line by binary search, and reads that record's range.

Of records with equal payloads the one with the smallest page_id is the response, the others revisit it (payloads below
min_revisit_bytes are all responses); only the response holds the payload.  What a lookup says of a payload is measured on the
bytes it read: a response that does not match its digest, or a revisit whose response has another one, is an error.

Defined cases: null html is an empty payload; null or odd URLs get the key ")" with what there is; null page_ids come
first in a key's order and can be a response only if no page_id is known; all rows that repeat the smallest page_id of a
payload are responses; white space and control characters of a URL are percent-encoded in the header and kept beside it; an
empty table makes an archive without parts; extra columns are not read.  Files of failed attempts have other names and are in
no manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm._runtime import lookup_rows, salted_left, shared_dir, stored

#: Index lines of a block, payload bytes of a part, compression level of records.
BLOCK_LINES, PART_BYTES, LEVEL = 256, 16 << 20, 3
#: Most parts of an archive, so the manifest that tasks read stays at some MB; parts of a larger archive are larger.
MAX_PARTS = 100_000


def url_key(url: Column) -> Column:
    """Reversed host, a bracket, path and query: http://a.b.org/x?y#z is org,b,a)/x?y."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, scheme + r"([^/?#]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, scheme + r"[^/?#]*", ""), r"(?s)[#\s].*$", "")
    return F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), r"[\x00-\x20\x7f]", "_")


def capture_key(url: Column, page_id: Column) -> Column:
    """url_key and the page, in an order that holds for text: the page takes the place of the usual time stamp."""
    shifted = (page_id.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string")
    return F.concat(url_key(url), F.lit(" "), F.coalesce(F.lpad(shifted, 20, "0"), F.lit("-")))


@dataclass(frozen=True)
class Part:
    """A line of the manifest."""

    first_key: str
    records: str
    blocks: str
    directory: str


@dataclass(frozen=True)
class Archive:
    """Where an archive's manifest is, and how many parts it names."""

    manifest: str
    parts: int


def _name(key: str, ordinal: int) -> str:
    """A record's id: of its capture key and its number among the records of that key."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}#{ordinal}')}>"


def _header_url(url: str) -> list[str]:
    """The target URI, and the URL as it was where a header cannot hold it."""
    plain = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    return [f"WARC-Target-URI: {plain}"] + ([f"X-Original-URI: {json.dumps(url)}"] if plain != url else [])


def _record(key: str, ordinal: int, page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple[int, str, str | None] | None, date: str) -> bytes:
    """refers: page, capture key and URL of the response."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_name(key, ordinal)}", f"WARC-Date: {date}", *_header_url(url or ""), f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if refers:
        target = _header_url(refers[2] or "")[0].removeprefix("WARC-")
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers[1], 0)}", f"WARC-Refers-To-{target}", f"X-Refers-To-Page: {refers[0]}", f"X-Refers-To-Key: {refers[1]}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", LEVEL, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content of one record's gzip member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    return fields, rest[: int(fields["Content-Length"])]


def write_archive(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, date: str | None = None) -> Archive:
    """Write pages (page_id, url, html). date: of all records, in ISO form; by default when the archive is begun."""
    spark = pages.sparkSession
    folder, date = folder or shared_dir(spark, "warc"), date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(capture_key(F.col("url"), F.col("page_id")).alias("key"), F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    narrow = stored(rows.select("key", "page_id", "url", "sha1", F.octet_length("payload").alias("size")), "warc-digests")
    parts = min(MAX_PARTS, max(8, int(-(-(narrow.agg(F.sum("size")).first()[0] or 0) // PART_BYTES))))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "key", "url"))).alias("first")
    groups = stored(narrow.filter(F.col("size") >= min_revisit_bytes).groupBy("sha1").agg(first, F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n"), "warc-groups")
    refers = F.when((F.octet_length("payload") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first"))
    keyed = lookup_rows(rows, groups, "sha1").withColumn("refers", refers).select("key", "page_id", "url", "payload", "sha1", "refers")
    ranged = keyed.repartitionByRange(parts, "key").sortWithinPartitions("key", "page_id", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first_key, at, block_at, last, ordinal = None, None, 0, 0, None, 0
        lines: list[str] = []
        directory: list[str] = []
        for b in batches:
            if not b.num_rows:
                continue
            if names is None:
                store, path = fs.FileSystem.from_uri(folder)
                store.create_dir(path, recursive=True)
                stem = f"{path}/{uuid.uuid4().hex}"
                names = [f"{folder}/{stem.rpartition('/')[2]}.{x}" for x in ("warc.gz", "cdx.gz", "dir")]
                records, blocks = store.open_output_stream(f"{stem}.warc.gz", compression=None), store.open_output_stream(f"{stem}.cdx.gz", compression=None)
            for key, page, url, payload, sha1, refers in zip(*(c.to_pylist() for c in b.columns)):
                first_key = key if first_key is None else first_key
                last, ordinal = key, ordinal + 1 if key == last else 0
                member = _record(key, ordinal, page, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), tuple(refers.values()) if refers else None, date)
                records.write(member)
                lines.append(f"{key}\t{at}\t{len(member)}")
                at += len(member)
                if len(lines) == BLOCK_LINES:
                    block_at = _close_block(lines, directory, blocks, block_at)
        if names:
            if lines:
                _close_block(lines, directory, blocks, block_at)
            records.close()
            blocks.close()
            with store.open_output_stream(f"{stem}.dir", compression=None) as out:
                out.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_pydict({"first_key": [first_key], "records": [names[0]], "blocks": [names[1]], "directory": [names[2]]})

    found = ranged.mapInArrow(write, "first_key string, records string, blocks string, directory string").collect()  # a line for each part
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/manifest", compression=None) as out:
        out.write("\n".join("\t".join(astuple(p)) for p in sorted((Part(*r) for r in found), key=lambda p: p.first_key)).encode())
    return Archive(f"{folder}/manifest", len(found))


_manifests: dict[str, list[Part]] = {}


def read_manifest(path: str) -> list[Part]:
    """The parts in the order of their keys; a worker reads a manifest once."""
    if path not in _manifests:
        store, p = fs.FileSystem.from_uri(path)
        with store.open_input_stream(p, compression=None) as f:
            _manifests.clear()
            _manifests[path] = [Part(*line.split("\t")) for line in f.read().decode().split("\n") if line]
    return _manifests[path]


def _close_block(lines: list[str], directory: list[str], blocks, at: int) -> int:
    member = zlib.compress("\n".join(lines).encode(), 6)
    blocks.write(member)
    directory.append(f"{lines[0].split(chr(9))[0]}\t{at}\t{len(member)}")
    lines.clear()
    return at + len(member)


class PartReader:
    """Lookups in one part; holds its directory and the last blocks."""

    def __init__(self, part: Part, blocks: int = 4):
        store, path = fs.FileSystem.from_uri(part.directory)
        with store.open_input_stream(path, compression=None) as f:
            rows = [x.split("\t") for x in f.read().decode().split("\n")]
        self.first, self.place = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        self.index = store.open_input_file(fs.FileSystem.from_uri(part.blocks)[1])
        self.data = store.open_input_file(fs.FileSystem.from_uri(part.records)[1])
        self.held: OrderedDict[int, tuple[list[str], list[list[str]]]] = OrderedDict()
        self.keep = blocks

    def _block(self, i: int) -> tuple[list[str], list[list[str]]]:
        if i not in self.held:
            at, n = self.place[i]
            rows = [x.split("\t") for x in zlib.decompress(self.index.read_at(n, at)).decode().split("\n")]
            self.held[i] = [r[0] for r in rows], rows
            if len(self.held) > self.keep:
                self.held.popitem(last=False)
        return self.held[i]

    def find(self, key: str) -> Iterator[tuple[dict[str, str], bytes]]:
        """Every record of a capture key, in order."""
        i = bisect_right(self.first, key) - 1
        found: list[list[str]] = []
        while i >= 0:
            keys, rows = self._block(i)
            j = bisect_right(keys, key)
            while j and keys[j - 1] == key:
                j -= 1
                found.append(rows[j])
            if j or keys[0] != key:  # an equal key may end the block before
                break
            i -= 1
        if i >= 0 and not found:
            return
        for _, at, n in reversed(found):
            yield parse_record(self.data.read_at(int(n), int(at)))

    def close(self) -> None:
        self.index.close()
        self.data.close()


_FOUND = "key string, ordinal int, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_key string, payload binary"


def _read(keys: DataFrame, archive: Archive, payload: bool) -> DataFrame:
    """The records of distinct capture keys; bytes and digest are measured, of a revisit the digest is what it claims."""
    manifest = archive.manifest

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = [p.first_key for p in read_manifest(manifest)]
        for b in batches:
            # Equal keys may begin in the part before the one whose first key they are.
            spans = [(max(0, bisect_right(starts, k) - 1), k) for k in b.column(0).to_pylist()]
            rows = [(p, k) for last, k in spans for p in range(_first_part(starts, last, k), last + 1)]
            yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in rows], pa.int32()), "key": pa.array([k for _, k in rows], pa.string())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        for b in batches:
            out: list[tuple] = []
            size = 0
            for part, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if part != now:
                    if reader:
                        reader.close()
                    now, reader = part, PartReader(read_manifest(manifest)[part])
                for ordinal, (h, content) in enumerate(reader.find(key)):
                    page, digest, kind = h["X-Page-Id"], h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    url = json.loads(h["X-Original-URI"]) if "X-Original-URI" in h else h["WARC-Target-URI"]
                    response = kind == "response"
                    if response and digest != base64.b32encode(hashlib.sha1(content).digest()).decode():
                        raise ValueError(f"the payload of {h['WARC-Record-ID']} does not have its digest")
                    out.append((key, ordinal, int(page) if page else None, url, len(content) if response else None, digest, kind, None if response else int(h["X-Refers-To-Page"]), h.get("X-Refers-To-Key"), content if response and payload else None))
                    size += len(content) if payload else 0
                if size > 1 << 22:
                    yield batch(out)
                    out, size = [], 0
            yield batch(out)
        if reader:
            reader.close()

    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], [f.split()[0] for f in _FOUND.split(", ")])

    routed = keys.select("key").distinct().mapInArrow(route, "part int, key string")
    return routed.repartitionByRange(archive.parts, "part", "key").sortWithinPartitions("part", "key").mapInArrow(read, _FOUND)


def lookup(keys: DataFrame, archive: Archive, payload: bool = True) -> DataFrame:
    """The records of the distinct capture keys in column key: key, page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload (null for a revisit, and where it is not wanted). A revisit's bytes are those of its response, which is
    read, too."""
    columns = ("key", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    if not archive.parts:
        return keys.sparkSession.createDataFrame([], _FOUND).select(*columns)
    found = stored(_read(keys, archive, payload), "warc-found")
    asked = found.filter("refers_key is not null").select(F.col("refers_key").alias("key")).distinct()
    answers = _read(asked, archive, False).filter("ordinal = 0").select(F.col("key").alias("refers_key"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
    wrong = F.raise_error(F.concat(F.lit("a revisit of "), "key", F.lit(" and its response differ")))
    revisits = salted_left(found.filter("refers_key is not null"), answers, "refers_key")
    revisits = revisits.withColumns({"payload_bytes": F.col("bytes"), "payload_digest": F.when(F.col("digest") == F.col("payload_digest"), F.col("digest")).otherwise(wrong)})
    return found.filter("refers_key is null").select(*columns).unionByName(revisits.select(*columns))


def _first_part(starts: list[str], last: int, key: str) -> int:
    while last and starts[last] == key:
        last -= 1
    return last
