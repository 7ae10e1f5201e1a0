"""Exact n-gram Jaccard join: documents link when their sets of word shingles have a similarity of at least 0.8.

Sets that are equal become one node first.  Two sets that link must share a shingle among the first ones of each in any
common order (the prefix rule), so only those prefixes are exchanged, the rarest shingles first: the order comes from a
fixed-size table of hashed counts.  A shingle's list is cut into tiles by size band, since linked sets differ in size by a
quarter at most.  A first round pairs each tile's members with the tile's leaders; a second pairs, in lists that still
span several components, the members of different components whose hashed signatures of 256 bits allow a link.  Every pair
is then bounded from above by its parity bitmaps (the bits that differ are shingles that differ) before the sorted arrays are
intersected exactly.  Skipped are only pairs that a verified chain of links joins already, so no component is lost, and
near copies cost a star, not all pairs.

A set is named by 64 bits of its shingles' hashes; where two sets share a name, 64 more tell them apart.

Defined cases: null, empty or blank text has an empty set and links with nothing; a text of fewer words than a shingle is
one shingle; equal sets always link; repeated rows and ids are nodes' members one by one; an empty table gives an empty
result; extra columns are not read by jaccard_components() and pass through one_per_component(), which keeps the row with the
smallest doc_id (no id comes last, equal ids go by a hash of the text) of each component, one of rows that repeat it, and
every row without words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import _tokens as tk
from strandlake.llm._runtime import dropped, lookup_rows, row_key, rows_of_ids, semi_rows, split_by_ids, stored

PERCENT = 80
WORDS = 5
#: Cells of the table of hashed counts, and its slices.
SKETCH_BITS, SKETCH_SLICES = 22, 16
#: Entries for a task, and members of a list that a tile takes; longer lists are cut into pairs of blocks.
ENTRIES_PER_BUCKET, LIST_BLOCK = 400_000, 30_000
#: Entries for a task of the second round.
REST_PER_BUCKET = 100_000
LEADERS = 3
#: Sets that a task remembers, so that repeated ones are counted and sent once.
MAX_SEEN = 200_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice."""
    w = tk.words(data, offsets, tk.SPACES, tk.fold_az())
    whole = tk.grams(w.hashes, k)
    out = []
    for a, b in zip(w.bounds, w.bounds[1:]):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        else:
            out.append(tk.grams(w.hashes[a:b], b - a) if b > a else whole[:0])
    return out


def _names(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set (0: empty), from the sum and xor of its mixed hashes and its size."""
    if not len(s):
        return 0, 0
    m = tk.mix(s + np.uint64(0x632BE59BD9B4E019))
    total = m.sum(dtype=np.uint64, keepdims=True) * np.uint64(len(s) * 2 + 1)
    xor = np.bitwise_xor.reduce(m * np.uint64(0x2545F4914F6CDD1D), keepdims=True)
    h = tk.mix(np.concatenate([total ^ xor, total * np.uint64(0xD6E8FEB86659FD93) + xor])).view(np.int64)
    return int(h[0]) or 1, int(h[1])


def _node(s: np.ndarray, renamed: dict[tuple[int, int], int]) -> int:
    """The set's name: the first one, unless that stands for another set."""
    names = _names(s)
    return renamed.get(names, names[0]) if renamed else names[0]


def prefix_length(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return size - -(-percent * size // 100) + 1


def needed(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least intersection of linked sets of these sizes: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap, as many bits as the size band's upper end (a power of two, 64 at least)."""
    width = max(64, 1 << int(len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, size_a: int, size_b: int) -> int:
    """No intersection is larger: each bit in which the (folded) bitmaps differ is a shingle of one side only."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (size_a + size_b - int(np.bitwise_count(x ^ y).sum())) // 2


def signature(s: np.ndarray) -> np.ndarray:
    """Parity bitmap of 256 bits, as four numbers."""
    odd = np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


_DESCRIBED = "kind int, doc_id long, k1 long, k2 long, n long, node long, other long, s0 long, s1 long, s2 long, s3 long, blob binary"


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: both names, size and signature of each row's set; kind 1: slices of the counts of hashed shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def count() -> None:
            nonlocal size
            if held:
                np.add(cells, np.bincount(np.concatenate(held), minlength=len(cells)), out=cells, casting="unsafe")
            held.clear()
            size = 0

        for b in batches:
            for first, end, data, offsets in tk.slices(b.column(1)):
                sets = shingle_sets(data, offsets, k)
                names = np.array([_names(s) for s in sets], dtype=np.int64).reshape(-1, 2)
                new = [s for s, x in zip(sets, names[:, 0].tolist()) if x not in seen and not seen.add(x)]
                if len(seen) > MAX_SEEN:
                    seen.clear()
                if new:
                    held.append((np.concatenate(new) >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                    size += len(held[-1])
                    if size > 2_000_000:
                        count()
                n = end - first
                part = b.slice(first, n)
                signs = np.array([signature(s) for s in sets], dtype=np.int64).reshape(-1, 4)
                out = {"kind": pa.array(np.zeros(n, dtype=np.int32)), "doc_id": part.column(0).cast(pa.int64()), "k1": part.column(2), "k2": part.column(3), "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(names[:, 0]), "other": pa.array(names[:, 1])}
                yield pa.RecordBatch.from_pydict(out | {f"s{j}": pa.array(signs[:, j]) for j in range(4)} | {"blob": pa.nulls(n, pa.binary())})
        count()
        if cells.any():
            parts = cells.reshape(SKETCH_SLICES, -1)
            zero = pa.array(np.zeros(SKETCH_SLICES, dtype=np.int64))
            out = {f: zero for f in ("k1", "k2", "n", "node", "other", "s0", "s1", "s2", "s3")}
            out |= {"kind": pa.array(np.ones(SKETCH_SLICES, dtype=np.int32)), "doc_id": pa.array(range(SKETCH_SLICES), pa.int64()), "blob": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())}
            yield pa.RecordBatch.from_pydict({f.split()[0]: out[f.split()[0]] for f in _DESCRIBED.split(", ")})

    return docs.select("doc_id", "text", *(c.alias(f"k{i}") for i, c in enumerate(row_key("doc_id", "text"), 1))).mapInArrow(run, _DESCRIBED)


def levels(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, halvings) of a slice of the table, a byte each.

    order is logarithmic in the distance from the median cell, so frequent shingles stand out however full the table is;
    halvings says into how many blocks (a power of two) a list must be cut, from what is beyond the cells' own noise.
    """
    median = float(np.median(total))
    z = total - median
    order = np.clip(128 + np.sign(z) * np.round(6 * np.log2(1 + np.abs(z))), 0, 255).astype(np.uint8)
    beyond = np.maximum(1.0, (z - 4 * np.sqrt(median)) / LIST_BLOCK)
    return order, np.ceil(np.log2(beyond)).astype(np.uint8)


def _sketch(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The summed table's levels: 8 MB, whatever the input."""

    def fold(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_SLICES, dtype=np.int64)
        for b in batches:
            for blob in b.column("blob"):
                total += np.frombuffer(zlib.decompress(blob.as_py()), dtype=np.uint32)
        order, halvings = levels(total)
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int64()), "order": pa.array([order.tobytes()], pa.binary()), "halvings": pa.array([halvings.tobytes()], pa.binary())})

    got = described.filter("kind = 1").select(F.col("doc_id").alias("part"), "blob").groupBy("part").applyInArrow(fold, "part long, order binary, halvings binary").collect()
    tables = np.zeros((2, SKETCH_SLICES, (1 << SKETCH_BITS) // SKETCH_SLICES), dtype=np.uint8)
    for r in got:
        tables[0, r.part] = np.frombuffer(r.order, dtype=np.uint8)
        tables[1, r.part] = np.frombuffer(r.halvings, dtype=np.uint8)
    return tables[0].reshape(-1), tables[1].reshape(-1)


_ENTRY = np.dtype([("h", "<u8"), ("node", "<i8"), ("size", "<i4"), ("pos", "<i4")])


def _entries(docs: DataFrame, sketch: tuple[np.ndarray, np.ndarray], buckets: int, k: int, percent: int, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """(bucket, blob): prefix entries of each distinct set, dealt by shingle."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_of, halvings_of = sent.value
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            e = np.concatenate(held)
            held.clear()
            bucket = (e["h"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            at = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(e))
            for a in range(0, len(at) - 1, 64):
                cuts = at[a : a + 65]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cuts[:-1]]), "blob": pa.array([e[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())})

        for b in batches:
            for _, _, data, offsets in tk.slices(b.column(0)):
                for s in shingle_sets(data, offsets, k):
                    if not len(s) or (node := _node(s, renamed)) in seen:
                        continue
                    if len(seen) > MAX_SEEN:
                        seen.clear()
                    seen.add(node)
                    cell = (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                    rank = order_of[cell]
                    length = int(prefix_length(np.int64(len(s)), percent))
                    mixed = tk.mix(s)
                    first = np.lexsort((mixed, rank))[:length]
                    e = np.empty(length, dtype=_ENTRY)
                    e["h"], e["node"], e["size"], e["pos"] = mixed[first], node, len(s), np.arange(length)
                    # A list longer than a block goes to all pairs of its block with the others.
                    blocks = 1 << halvings_of[cell[first]].astype(np.int64)
                    if (blocks > 1).any():
                        own = (node & 0x7FFFFFFF) % blocks
                        again = np.repeat(np.arange(length), blocks)
                        other = np.concatenate([np.arange(n) for n in blocks])
                        e, mine = e[again], own[again]
                        cut = blocks[again] > 1
                        e["h"][cut] = tk.mix(e["h"][cut] ^ (np.minimum(mine, other)[cut].astype(np.uint64) << np.uint64(32)) ^ np.maximum(mine, other)[cut].astype(np.uint64))
                    held.append(e)
                    size += len(e)
                if size > 600_000:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("text").mapInArrow(run, "bucket long, blob binary")


def _near(e: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and places in the prefixes still allow a link, this being the first shingle in common."""
    a, b = e["size"][i].astype(np.int64), e["size"][j].astype(np.int64)
    rest = np.minimum(a - e["pos"][i], b - e["pos"][j])
    return (rest >= needed(a, b, percent)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (e["node"][i] != e["node"][j])


def _pairs(e: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distinct pairs (a, b, size_a, size_b), a < b."""
    swap = e["node"][i] > e["node"][j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    out = np.column_stack([e["node"][i], e["node"][j], e["size"][i], e["size"][j]])
    return np.unique(out, axis=0) if len(out) else out


def _band(size: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(np.log(size.astype(float)) / np.log(100 / percent) + 1e-9).astype(np.int64)


def _star(e: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of each tile's leaders, the members with the fewest rare shingles, with its members and the next band's."""
    order = np.lexsort((e["node"], e["pos"], _band(e["size"], percent), e["h"]))
    e = e[order]
    band = _band(e["size"], percent)
    fresh = np.ones(len(e), dtype=bool)
    fresh[1:] = (e["h"][1:] != e["h"][:-1]) | (band[1:] != band[:-1])
    starts = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    ends = np.append(starts[1:], len(e))
    after = np.zeros(len(starts), dtype=bool)  # the group before is the band below of the same list
    after[1:] = (e["h"][starts[1:]] == e["h"][starts[:-1]]) & (band[starts[1:]] == band[starts[:-1]] + 1)
    all_of = np.arange(len(e))
    found = []
    for lead in range(LEADERS):
        for back, ok in ((0, np.ones(len(starts), dtype=bool)), (1, after)):
            g = group - back
            leader = starts[g] + lead
            good = ok[group] & (leader < ends[g]) & (leader != all_of)
            i, j = leader[good], all_of[good]
            near = _near(e, i, j, percent)
            found.append(_pairs(e, i[near], j[near]))
    return np.unique(np.concatenate(found), axis=0)


def _first_round(entries: DataFrame, percent: int) -> DataFrame:
    """kind 0: a star's pairs; kind 1: entries of the lists of three and more, for the second round."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = np.concatenate([np.frombuffer(x.as_py(), dtype=_ENTRY) for b in batches for x in b.column("blob")])
        e = e[np.lexsort((e["node"], e["h"]))]
        twice = np.zeros(len(e), dtype=bool)
        twice[1:] = (e["h"][1:] == e["h"][:-1]) & (e["node"][1:] == e["node"][:-1])
        e = e[~twice]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], e["h"][1:] != e["h"][:-1]])), len(e))
        members = np.repeat(np.diff(cuts), np.diff(cuts))
        e, members = e[members >= 2], members[members >= 2]
        if not len(e):
            return
        p = _star(e, percent)
        if len(p):
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(len(p), dtype=np.int32)), "h": pa.array(np.zeros(len(p), dtype=np.int64)), **{c: pa.array(p[:, j].astype(np.int64)) for j, c in enumerate(("a", "b", "size_a", "size_b"))}})
        e = e[members >= 3]
        if len(e):
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(len(e), dtype=np.int32)), "h": pa.array(e["h"].view(np.int64)), "a": pa.array(e["node"].astype(np.int64)), "b": pa.array(np.zeros(len(e), dtype=np.int64)), "size_a": pa.array(e["size"].astype(np.int64)), "size_b": pa.array(e["pos"].astype(np.int64))})

    return entries.groupBy("bucket").applyInArrow(run, "kind int, h long, a long, b long, size_a long, size_b long")


def _second_round(rest: DataFrame, nodes: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Pairs of members of different components, in lists (h, node, size, pos) that span several, whose signatures allow a
    link. nodes: node, label and signature."""
    rows = rest.join(nodes, "node").withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, marks, signs = [], [], []
        for b in batches:
            e = np.empty(b.num_rows, dtype=_ENTRY)
            e["h"] = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            for c in ("node", "size", "pos"):
                e[c] = b.column(c).to_numpy(zero_copy_only=False)
            parts.append(e)
            marks.append(b.column("label").to_numpy(zero_copy_only=False))
            signs.append(np.column_stack([b.column(f"s{j}").to_numpy(zero_copy_only=False) for j in range(4)]).view(np.uint64))
        e, label, sign = np.concatenate(parts), np.concatenate(marks), np.concatenate(signs)
        order = np.lexsort((e["size"], e["h"]))
        e, label, sign = e[order], label[order], sign[order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], e["h"][1:] != e["h"][:-1]])), len(e))
        found, waiting = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if found:
                p = np.unique(np.concatenate(found), axis=0)
                found.clear()
                for x in range(0, len(p), 100_000):
                    yield pa.RecordBatch.from_pydict({c: pa.array(p[x : x + 100_000, j].astype(np.int64)) for j, c in enumerate(("a", "b", "size_a", "size_b"))})

        for a, z in zip(cuts, cuts[1:]):
            if (label[a:z] == label[a]).all():
                continue
            for x in range(a, z, 256):  # by blocks: neither a list's matrix of pairs nor its pairs are ever whole
                for y in range(x, z, 4096):
                    i, j = np.arange(x, min(x + 256, z))[:, None], np.arange(y, min(y + 4096, z))[None, :]
                    if 100 * int(e["size"][x : x + 256][: z - x].max()) < percent * int(e["size"][y]):
                        break
                    at = np.nonzero((i < j) & (label[i] != label[j]))
                    i, j = i[at[0], 0], j[0, at[1]]
                    near = _near(e, i, j, percent)
                    i, j = i[near], j[near]
                    sizes = e["size"][i].astype(np.int64), e["size"][j].astype(np.int64)
                    apart = np.bitwise_count(sign[i] ^ sign[j]).sum(1, dtype=np.int64)
                    allowed = (sizes[0] + sizes[1] - apart) // 2 >= needed(*sizes, percent)
                    found.append(_pairs(e, i[allowed], j[allowed]))
                    waiting += len(found[-1])
                    if waiting > 1_000_000:
                        yield from flush()
                        waiting = 0
        yield from flush()

    return rows.groupBy("bucket").applyInArrow(run, "a long, b long, size_a long, size_b long").dropDuplicates(["a", "b"])


def _verify(pairs: DataFrame, known: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that link: bitmaps first, then the sorted arrays."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size_a, size_b = (b.column(c).to_numpy() for c in ("size_a", "size_b"))
            need = needed(size_a, size_b, percent)
            ok = [overlap_bound(x.as_py(), y.as_py(), int(p), int(q)) >= n for x, y, p, q, n in zip(b.column("map_a"), b.column("map_b"), size_a, size_b, need)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [[s for _, _, data, offsets in tk.slices(b.column(c)) for s in shingle_sets(data, offsets, k)] for c in ("text_a", "text_b")]
            ok = []
            for x, y in zip(*sets):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    maps = known.select("node", "map")
    some = pairs.join(maps.withColumnsRenamed({"node": "a", "map": "map_a"}), "a").join(maps.withColumnsRenamed({"node": "b", "map": "map_b"}), "b")
    some = stored(some.select("a", "b", "size_a", "size_b", "map_a", "map_b").mapInArrow(bounded, "a long, b long"), "jaccard-bounded")
    # Only the texts that are still asked for are shuffled.
    texts = [semi_rows(known.select("node", "text"), some.select(F.col(c).alias("node")), "node") for c in "ab"]
    full = some.join(texts[0].withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(texts[1].withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(exact, "a long, b long")


def _forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges as (child, root) of its own components: the same components with fewer edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        def emit() -> pa.RecordBatch:
            kids = [x for x in parent if find(x) != x]
            return pa.RecordBatch.from_pydict({"u": pa.array(kids, pa.int64()), "v": pa.array([find(x) for x in kids], pa.int64())})

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > 500_000:
                yield emit()
                parent = {}
        yield emit()

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (two bigint columns): label is the smallest node reachable.

    Alternating large and small stars, each a grouped minimum and a join; edges are written to the shared folder after
    each, and only their number and checksum reach the driver.
    """
    edges = stored(_forest(edges).distinct(), "components")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges, old = stored(small, "components"), edges
        dropped(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _renamed(members: DataFrame, nodes: DataFrame) -> dict[tuple[int, int], int]:
    """Of sets that share their first name with another set, all but one go by their second; next to none, at any size (of
    10^10 different sets about three)."""
    shared = nodes.filter("low != high").select("node")
    if not shared.limit(1).count():
        return {}
    found = members.join(F.broadcast(shared), "node").select("node", "other").distinct().collect()
    least: dict[int, int] = {}
    for r in found:
        least[r.node] = min(least.get(r.node, r.other), r.other)
    return {(r.node, r.other): r.other for r in found if r.other != least[r.node]}


def _nodes(members: DataFrame) -> DataFrame:
    """Distinct sets: node, smallest doc_id, signature, and the extremes of the second name."""
    return stored(members.filter("node != 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("other").alias("low"), F.max("other").alias("high"), *[F.max(f"s{j}").alias(f"s{j}") for j in range(4)]), "jaccard-nodes")


def _labelled(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """doc_id, k1, k2, n_shingles, node, label (of the component), component_id of every row; the last three null without words."""
    docs = docs.select("doc_id", "text")
    described = stored(_describe(docs, k), "jaccard-sets")
    members = described.filter("kind = 0").drop("kind", "blob")
    nodes = _nodes(members)
    if renamed := _renamed(members, nodes):
        names = docs.sparkSession.createDataFrame([(*names, new) for names, new in renamed.items()], "node long, other long, new long")
        members = members.join(F.broadcast(names), ["node", "other"], "left").withColumn("node", F.coalesce("new", "node")).drop("new")
        nodes = _nodes(members)
    total = members.agg(F.sum(F.floor(F.col("n") * (100 - percent) / 100) + 1)).first()[0] or 0
    buckets = max(12, int(-(-total // ENTRIES_PER_BUCKET)))
    first = stored(_first_round(_entries(docs, _sketch(described), buckets, k, percent, renamed), percent), "jaccard-lists")
    pairs = first.filter("kind = 0").select("a", "b", "size_a", "size_b").dropDuplicates(["a", "b"])
    rest = first.filter("kind = 1").select("h", F.col("a").alias("node"), F.col("size_a").cast("int").alias("size"), F.col("size_b").cast("int").alias("pos"))
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(rest.select("node")).distinct()
    wanted = stored(nodes.select("node", "doc_id").join(involved, "node", "left_semi"), "jaccard-involved")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in tk.slices(b.column(0)):
                sets = shingle_sets(data, offsets, k)
                nodes = pa.array([_node(s, renamed) for s in sets], pa.int64())
                out = pa.RecordBatch.from_pydict({"node": nodes, "map": pa.array([bitmap(s) for s in sets], pa.binary()), "text": b.column(0).slice(first, end - first)})
                yield out.filter(pc.equal(nodes, b.column(1).slice(first, end - first))) if b.num_columns > 1 else out

    schema = "node long, map binary, text string"
    # One exchange of the texts that are asked for, by id; repeated rows of an id are merged in the same partitions.
    asked = rows_of_ids(docs, wanted.withColumnRenamed("node", "asked"), "doc_id")
    once = asked.dropDuplicates(["doc_id", "asked", "text"])
    known = once.select("text", "asked").mapInArrow(describe, schema)
    # Sets that only rows without an id have are found by their names.
    nameless = docs.filter("doc_id is null").select("text").mapInArrow(describe, schema).join(wanted.filter("doc_id is null"), "node", "left_semi").dropDuplicates(["node"])
    known = stored(known.unionByName(nameless), "jaccard-texts")
    links = stored(_verify(pairs, known, k, percent), "jaccard-links")
    labels = components(links)
    n_rest = rest.count()
    if n_rest:
        placed = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("node", "label", *(f"s{j}" for j in range(4)))
        more = stored(_second_round(rest, placed, max(1, n_rest // REST_PER_BUCKET), percent), "jaccard-pairs")
        dropped(first)
        extra = stored(_verify(more, known, k, percent), "jaccard-links")
        if extra.limit(1).count():
            labels = components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).filter("u != v").unionByName(extra.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    dropped(known)
    joined = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = joined.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = joined.join(smallest, "label").select("node", "label", "component_id")
    return members.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.when(F.col("node") != 0, F.col("node")).alias("node")).join(of_node, "node", "left")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, node (the set's name, null if empty) and component_id (smallest doc_id linked, itself included)."""
    alone = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return _labelled(docs, percent, k).select("doc_id", "n_shingles", "node", alone.alias("component_id"))


def one_per_component(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """docs with one row of each component, see above for which; rows are dropped, not ids."""
    rows = stored(_labelled(docs, percent, k).filter("node is not null").select("doc_id", "k1", "k2", "label"), "jaccard-rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "k1", "k2")).alias("best")
    kept = rows.groupBy("label").agg(best, F.count("*").alias("n")).filter("n > 1").select("label", F.col("best.k1").alias("b1"), F.col("best.k2").alias("b2"))
    judged = lookup_rows(rows.select("k1", "k2", "label"), kept, "label").filter("b1 is not null")
    judged = judged.groupBy("k1", "k2").agg(F.bool_or((F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2"))).alias("stays"), F.count("*").alias("n"))
    marks = stored(judged.filter("not stays or n > 1").select("k1", "k2", "stays"), "jaccard-marks")
    key = row_key("doc_id", "text")
    named = docs.withColumns({"__sl_k1": key[0], "__sl_k2": key[1]})
    marks = marks.withColumnsRenamed({"k1": "__sl_k1", "k2": "__sl_k2", "stays": "__sl_stays"})
    maybe, clean = split_by_ids(named, marks, "__sl_k1", "__sl_k2")
    seen = lookup_rows(maybe, marks, "__sl_k1", "__sl_k2")
    whole = F.struct(*docs.columns)
    one = seen.filter("__sl_stays").groupBy("__sl_k1", "__sl_k2").agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("r")).select("r.*")  # rows that repeat the one that stays
    return clean.select(*docs.columns).unionByName(seen.filter("__sl_stays is null").select(*docs.columns)).unionByName(one)
