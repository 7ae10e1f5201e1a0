"""BAM: blocked gzip of binary alignments, read in splits and written by partition (inventory 2.1, 2.2). CRAM is not read."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import interval as iv

#: Fixed values of the format.
_MAGIC, _EOF = b"BAM\x01", bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
#: Bytes of a block before it is compressed; records that must follow one another where a split begins.
BLOCK_BYTES, CHAIN = 60_000, 4
_SCHEMA = "read_id string, flag int, chr string, start long, mapq int, cigar string, seq string, qual string, tags map<string,string>"


def _block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return struct.pack("<4BI2BH2B2H", 0x1F, 0x8B, 8, 4, 0, 0, 0xFF, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(data), len(data))


def _bin(start: int, end: int) -> int:
    """The index bin of a half-open range."""
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


def _cigar(text: str | None) -> list[tuple[int, int]]:
    out, n = [], 0
    for c in text or "":
        if c.isdigit():
            n = n * 10 + int(c)
        else:
            out.append((n, _OPS.index(c)))
            n = 0
    return out


def _record(ids: dict[str, int], read: str, flag: int, chrom: str | None, start: int | None, mapq: int, cigar: str | None, seq: str | None, qual: str | None, tags) -> bytes:
    ops, name, s = _cigar(cigar), read.encode() + b"\0", seq or ""
    codes = [_BASES.index(c) if c in _BASES else 15 for c in s.upper()] + [0] * (len(s) % 2)
    at = -1 if start is None else start
    end = at + max(1, sum(n for n, op in ops if op in (0, 2, 3, 7, 8)))
    body = struct.pack("<2i2B3H4i", ids.get(chrom, -1), at, len(name), mapq, _bin(at, end) if at >= 0 else 4680, len(ops), flag, len(s), -1, -1, 0)
    body += name + struct.pack(f"<{len(ops)}I", *(n << 4 | op for n, op in ops)) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    body += bytes(ord(c) - 33 for c in qual) if qual is not None and len(qual) == len(s) else b"\xff" * len(s)
    for k, v in sorted(dict(tags or {}).items()):
        body += k.encode() + b"Z" + str(v).encode() + b"\0"
    return struct.pack("<i", len(body)) + body


def write_bam(alignments: DataFrame, folder: str, references: list[tuple[str, int]]) -> int:
    """A file for each partition, in its order; the number of files. Files of failed attempts are left out."""
    columns = [f.split()[0] for f in _SCHEMA.split(", ")]
    head = "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in references).encode()
    names = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in references)
    header = _MAGIC + struct.pack("<i", len(head)) + head + struct.pack("<i", len(references)) + names
    ids = {n: i for i, (n, _) in enumerate(references)}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size, name = None, [], 0, f"{uuid.uuid4().hex}.bam"
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                store, path = fs.FileSystem.from_uri(folder)
                store.create_dir(f"{path}/_attempts", recursive=True)
                out = store.open_output_stream(f"{path}/_attempts/{name}", compression=None)
                for i in range(0, len(header), BLOCK_BYTES):
                    out.write(_block(header[i : i + BLOCK_BYTES]))
            for row in zip(*(c.to_pylist() for c in b.columns)):
                r = _record(ids, *row)
                if held and size + len(r) > BLOCK_BYTES:
                    out.write(_block(b"".join(held)))
                    held, size = [], 0
                for i in range(0, len(r) if len(r) > BLOCK_BYTES else 0, BLOCK_BYTES):
                    out.write(_block(r[i : i + BLOCK_BYTES]))
                if len(r) <= BLOCK_BYTES:
                    held.append(r)
                    size += len(r)
        if out:
            if held:
                out.write(_block(b"".join(held)))
            out.write(_EOF)
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    done = [r["name"] for r in alignments.select(*columns).mapInArrow(write, "name string").collect()]  # a line for each file
    store, path = fs.FileSystem.from_uri(folder)
    for name in done:
        store.move(f"{path}/_attempts/{name}", f"{path}/{name}")
    if done:
        store.delete_dir(f"{path}/_attempts")
    return len(done)


class _Blocks:
    """Blocks of a file from an offset on, as (offset, data)."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size

    def at(self, offset: int) -> tuple[bytes, int] | None:
        """The block at an offset and its length there; None if there is none."""
        head = self.f.read_at(min(18, self.size - offset), offset) if offset < self.size else b""
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\x00":
            return None
        n = struct.unpack_from("<H", head, 16)[0] + 1
        raw = self.f.read_at(n, offset)
        try:
            data = zlib.decompress(raw[18:-8], -15)
        except zlib.error:
            return None
        return (data, n) if len(raw) == n and struct.unpack_from("<2I", raw, n - 8) == (zlib.crc32(data), len(data)) else None

    def first(self, start: int, end: int) -> int | None:
        """The first block that begins in [start, end)."""
        step = 1 << 16
        for low in range(start, end, step):
            piece = self.f.read_at(min(step + 3, self.size - low), low)
            i = piece.find(b"\x1f\x8b\x08\x04")
            while i >= 0 and low + i < end:
                if self.at(low + i):
                    return low + i
                i = piece.find(b"\x1f\x8b\x08\x04", i + 1)
        return None


class _Stream:
    """Bytes from a block on, grown as they are asked for; knows at which block each begins."""

    def __init__(self, blocks: _Blocks, offset: int):
        self.blocks, self.next = blocks, offset
        self.buf, self.places = bytearray(), []

    def need(self, n: int) -> bool:
        while len(self.buf) < n:
            got = self.blocks.at(self.next)
            if got is None:
                if self.next < self.blocks.size:
                    raise ValueError(f"no block at {self.next}")
                return False
            if got[0]:
                self.places.append((len(self.buf), self.next))
                self.buf += got[0]
            self.next += got[1]
        return True

    def block_of(self, p: int) -> int:
        while len(self.places) > 1 and self.places[1][0] <= p:
            self.places.pop(0)
        return self.places[0][1]

    def trim(self, p: int) -> int:
        if p < 1 << 20:
            return p
        self.block_of(p)
        del self.buf[:p]
        self.places = [(max(0, a - p), b) for a, b in self.places]
        return 0


def _header(blocks: _Blocks) -> tuple[list[tuple[str, int]], int, int]:
    """References, and block and place of the first record."""
    s = _Stream(blocks, 0)
    if not s.need(8) or s.buf[:4] != _MAGIC:
        raise ValueError("not a BAM file")
    p = 8 + struct.unpack_from("<i", s.buf, 4)[0]
    s.need(p + 4)
    n, p, refs = struct.unpack_from("<i", s.buf, p)[0], p + 4, []
    for _ in range(n):
        s.need(p + 4)
        size = struct.unpack_from("<i", s.buf, p)[0]
        s.need(p + 8 + size)
        refs.append((bytes(s.buf[p + 4 : p + 3 + size]).decode(), struct.unpack_from("<i", s.buf, p + 4 + size)[0]))
        p += 8 + size
    if not s.need(p + 1):
        return refs, s.next, 0
    block = s.block_of(p)
    return refs, block, p - s.places[0][0]


def _follows(buf: bytearray, p: int, refs: list[tuple[str, int]]) -> int:
    """Where the record at p ends if it can be one, else -1."""
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos, _ = struct.unpack_from("<3i2B3H4i", buf, p)
    fixed = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not (-1 <= ref < len(refs) and -1 <= mate < len(refs) and l_name > 0 and 0 <= l_seq <= size and fixed <= size):
        return -1
    if pos < -1 or mate_pos < -1 or (ref >= 0 and pos > refs[ref][1]) or (mate >= 0 and mate_pos > refs[mate][1]):
        return -1
    name = buf[p + 36 : p + 36 + l_name]
    if len(name) == l_name and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return -1
    ops = buf[p + 36 + l_name : p + 36 + l_name + 4 * n_cigar : 4]
    return -1 if any(c & 15 > 8 for c in ops) else p + 4 + size


def _guess(s: _Stream, refs: list[tuple[str, int]]) -> int | None:
    """The first place of the first block at which records begin: CHAIN of them in a row, or up to the end."""
    first = len(s.buf)
    whole = s.need(first + 4 * BLOCK_BYTES)
    for p in range(first):
        q, n = p, 0
        while q >= 0 and n < CHAIN and q + 36 <= len(s.buf):
            q, n = _follows(s.buf, q, refs), n + 1
        if q >= 0 and n and (n == CHAIN or q >= len(s.buf) - 36) and (whole or q <= len(s.buf)):
            return p
    return None


def _tag_map(buf: bytes) -> list[tuple[str, str]]:
    out, p = {}, 0
    while p + 3 <= len(buf):
        key, kind = buf[p : p + 2].decode("latin-1"), chr(buf[p + 2])
        p += 3
        if kind in "ZH":
            end = buf.index(0, p)
            out[key], p = buf[p:end].decode("utf-8", "replace"), end + 1
        elif kind == "A":
            out[key], p = chr(buf[p]), p + 1
        elif kind == "B":
            f, n = _NUMBERS[chr(buf[p])], struct.unpack_from("<i", buf, p + 1)[0]
            out[key] = chr(buf[p]) + "".join(f",{x:g}" if f == "f" else f",{x}" for x in struct.unpack_from(f"<{n}{f}", buf, p + 5))
            p += 5 + n * struct.calcsize(f)
        else:
            f = _NUMBERS[kind]
            (x,) = struct.unpack_from("<" + f, buf, p)
            out[key], p = (f"{x:g}" if f == "f" else str(x)), p + struct.calcsize(f)
    return list(out.items())


_PAIRS = [a + b for a in _BASES for b in _BASES]


def _parse(buf: bytes, refs: list[tuple[str, int]]) -> tuple:
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<2i2B3Hi", buf, 0)
    p = 32 + l_name
    cigar = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", buf, p))
    p += 4 * n_cigar
    seq = "".join([_PAIRS[x] for x in buf[p : p + (l_seq + 1) // 2]])[:l_seq]
    p += (l_seq + 1) // 2
    qual = buf[p : p + l_seq]
    text = None if not l_seq or qual[0] == 0xFF else bytes(q + 33 for q in qual).decode("latin-1")
    return buf[32 : 31 + l_name].decode("latin-1"), flag, refs[ref][0] if ref >= 0 else None, pos if pos >= 0 else None, mapq, cigar or None, seq or None, text, _tag_map(buf[p + l_seq :])


def _records(path: str, start: int, end: int) -> Iterator[tuple]:
    """Records that begin in blocks that begin in [start, end) of a file."""
    store, p = fs.FileSystem.from_uri(path)
    with store.open_input_file(p) as f:
        blocks = _Blocks(f, f.size())
        refs, head_block, head_place = _header(blocks)
        at = 0 if start == 0 else blocks.first(start, end)
        if at is None or (at <= head_block and head_block >= end):
            return
        if at <= head_block:
            s, place = _Stream(blocks, head_block), head_place
        else:
            s, place = _Stream(blocks, at), None
            while place is None:  # a record longer than a block may hold the first ones
                if s.next >= end or not s.need(1):
                    return
                place = _guess(s, refs)
                if place is None:
                    after = blocks.at(at)[1] + at
                    if after >= end:
                        return
                    at, s = after, _Stream(blocks, after)
        while s.need(place + 4):
            if s.block_of(place) >= end:
                return
            size = struct.unpack_from("<i", s.buf, place)[0]
            if not s.need(place + 4 + size):
                raise ValueError(f"{path} ends within a record")
            yield _parse(bytes(s.buf[place + 4 : place + 4 + size]), refs)
            place = s.trim(place + 4 + size)


def read_bam(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Alignments of a BAM file or of a folder of them, as read_sam() has them; files are read in splits, each
    beginning at the first record of its first block."""
    store, p = fs.FileSystem.from_uri(path)
    info = store.get_file_info(p)
    files = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(p)) if x.is_file and x.path.endswith(".bam")]
    base = path[: len(path) - len(p)] if path.endswith(p) else ""
    ranges = [(base + x.path, a, min(x.size, a + split_bytes)) for x in files for a in range(0, x.size, split_bytes)]
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start, end in zip(*(c.to_pylist() for c in b.columns)):
                rows: list[tuple] = []
                for r in _records(file, start, end):
                    rows.append(r)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], t) for j, t in enumerate(types)], names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], t) for j, t in enumerate(types)], names)

    splits = spark.createDataFrame(ranges, "file string, start long, end long").repartition(max(1, min(len(ranges), 100_000)))
    return splits.mapInArrow(read, _SCHEMA).withColumn("blocks", iv.cigar_blocks(F.col("start"), F.col("cigar")))
