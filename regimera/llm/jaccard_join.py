"""N-gram Jaccard join: size bands, hashed bitmap signatures, exact sorted-array intersection.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Two documents link when their sets overlap in
80 % of the union or more. Linked documents form components; no link between different texts is lost.

1. Every set gets a digest (its node): exact copies are one node from here on. Two sketches count shingles and words by
   hashed slot over all documents, a slot for each row of the table within limits; tasks' sketches are summed FAN at a time. Shingle slots far above the mean mark the passages that many documents
   share; the word counts tell how often a shingle is to be expected by chance.
2. Sets that link share one of the first n - ceil(0.8 n) + 1 shingles of each, in any one order of all shingles; the
   order is by expected frequency (common ones last), then hash. Those prefixes go, packed, to the partition of each shingle.
3. A shingle's list of nodes is cut into size bands (factor 1.25; only the same or neighbouring bands can link). Each
   member is paired with its band's leader, leaders of neighbouring bands with each other: pairs grow in proportion to
   the list, never with its square. Lists of three and more are kept under their least node, where the list is whole: lists
   with the same least node are one group, a node in it once, so a family of near copies is a few groups, not one for each shingle.
4. In a group blocks of nodes meet in tiles. Bitmaps, as wide as the size band asks, bound the overlap from above by
   (|x| + |y| - popcount(x xor y)) / 2. A tile yields each node's few best partners, not its pairs. These and the pairs of
   step 3 that the bitmaps leave are checked by exact intersection of sorted arrays; links give first components.
5. Two more rounds look only at groups that hold several components, at partners in other components, and with bitmaps
   eight times as wide: first again the best few, then all that are left, which are the pairs close to the threshold.
   Then every pair that could link lies in one component or has been checked exactly.

Scale: texts are never shuffled. Prefixes are about a fifth of all shingles at 8 bytes each; sets (8 bytes a shingle)
move only for nodes in some pair that the bitmaps left, chosen by a Bloom filter of 16 bits a node, or by a join where that
would be over 2**BLOOM_MOST bits. A shingle whose sketch count exceeds
`salt_at` has its list split by node over several partitions; the leaders of the parts are then paired with the least
of them. Groups of more than BLOCK_ROWS nodes are dealt as pairs of blocks to several tasks. The driver receives the
sketch and the filter, both of bounded size.

Cases: null and blank texts have an empty set, no links, and are components of their own; repeated rows (same id) keep a
row each; a null id takes part and is never the smallest unless alone; with fewer than five words the whole sequence is
the one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialise, ship
from .components import components
from .textkernel import Words, chunks, give_back, lean, mix64, shingle_sets

SIZE = 5
#: Links need NUMERATOR / DENOMINATOR of the union.
NUMERATOR, DENOMINATOR = 4, 5
#: Slots of a sketch as a power of two: one for each row of the table, between these.
SKETCH_BITS, SKETCH_MOST = 18, 22
#: Sketches summed in one task.
FAN = 64
#: Bits of the Bloom filter as a power of two, at least and at most (32 MB).
BLOOM_BITS, BLOOM_MOST = 20, 28
LEAST_BITS = 512
#: Bits of the bitmaps for each shingle: in the first round, and in the later ones.
NARROW, WIDE = 1, 8
TILE = 512
#: Bytes of bitmaps gathered at once, and widest bitmap (in bits) of a tile's first look: memory does not grow with the texts' lengths.
GATHER_BYTES, LOOK_BITS = 1 << 22, 1 << 16
#: Partners held in a task before only the best of each node are kept.
HELD_PAIRS = 1 << 20
#: Most rows in a block of a group; a smaller group is cut into blocks of BLOCK_ROWS, up to BLOCKS of them, to spread its work: two
#: blocks are some two million comparisons, and every row goes once to each block of its group.
GROUP_ROWS, BLOCK_ROWS, BLOCKS = 4096, 1024, 16
#: Most ids that are broadcast to drop their documents.
BROADCAST_IDS = 1 << 20
#: Rows in an Arrow batch: texts and sets are wide.
BATCH_ROWS = 1000
#: Best partners of a node in each group: in the first and in the second round.
FEW, MORE = 2, 8
SALT_AT = 1 << 16


def nodes_of(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set as a signed integer; 0 for an empty one."""
    size = np.diff(offsets)
    out = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        starts = offsets[:-1][some]
        total = np.add.reduceat(sets, starts)
        mixed = np.bitwise_xor.reduceat(mix64(sets ^ np.uint64(0xA0761D6478BD642F)), starts)
        out[some] = mix64(total * np.uint64(0xE7037ED1A0B428DB) ^ mixed ^ size[some].astype(np.uint64))
    return out.view(np.int64)


def widths(size: np.ndarray, factor: int = NARROW) -> np.ndarray:
    """Bits of a set's bitmap: the power of two at or above factor times its size, LEAST_BITS at least."""
    return np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(factor * size, 1))).astype(np.int64))


def signatures(sets: np.ndarray, offsets: np.ndarray, factor: int = NARROW) -> list[bytes]:
    """A bitmap for each set: every shingle flips its slot's bit, so differing bits never exceed differing shingles.

    The slot is the hash modulo the width, so a bitmap folds to half its width by exclusive-or of its halves.
    """
    size = np.diff(offsets)
    bits = widths(size, factor)
    base = np.concatenate([[0], np.cumsum(bits)])
    slot = (mix64(sets + np.uint64(0x9E37)) >> np.uint64(24)).astype(np.int64) & (np.repeat(bits, size) - 1)
    odd = (np.bincount(np.repeat(base[:-1], size) + slot, minlength=base[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little")
    return [packed[a:b].tobytes() for a, b in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist())]


def folded(sigs: list[bytes], bits: int) -> np.ndarray:
    """Bitmaps of at least `bits` bits folded to that width, a row of 64-bit words each."""
    out = np.empty((len(sigs), bits // 64), np.uint64)
    for i, s in enumerate(sigs):
        x = np.frombuffer(s, "<u8")
        out[i] = x if len(x) == bits // 64 else np.bitwise_xor.reduce(x.reshape(-1, bits // 64), axis=0)
    return out


def slack(size_a: np.ndarray, size_b: np.ndarray, sig_a: list[bytes], sig_b: list[bytes], factor: int = NARROW) -> np.ndarray:
    """By how much the bitmap bound (|a| + |b| - differing bits) / 2 exceeds the least overlap; negative where no link is possible."""
    out = np.full(len(size_a), -1, np.int64)
    near = DENOMINATOR * np.minimum(size_a, size_b) >= NUMERATOR * np.maximum(size_a, size_b)
    width = np.minimum(widths(size_a, factor), widths(size_b, factor))
    for w in np.unique(width[near]).tolist():
        of_width = np.flatnonzero(near & (width == w))
        step = max(1, 8 * GATHER_BYTES // w)
        for k in range(0, len(of_width), step):
            rows = of_width[k : k + step]
            x, y = folded([sig_a[i] for i in rows.tolist()], w), folded([sig_b[i] for i in rows.tolist()], w)
            differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            out[rows] = (size_a[rows] + size_b[rows] - differ) // 2 - needed_overlap(size_a[rows], size_b[rows])
    return out


def needed_overlap(size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Least intersection for a link: i >= t (a + b) / (1 + t)."""
    top, whole = NUMERATOR, NUMERATOR + DENOMINATOR
    return -(-top * (size_a + size_b) // whole)


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in chunks(column):
        sets, offs = shingle_sets(Words(data, offsets), SIZE)
        yield a, b, sets, offs


_PROFILE = "doc_id bigint, n_shingles bigint, node bigint, signature binary, slice int, part int, counts binary"


def sketch_bits(docs: DataFrame) -> int:
    return min(SKETCH_MOST, max(SKETCH_BITS, docs.count().bit_length()))


def profile(docs: DataFrame, width_bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, node, signature) of each document, and slices of each task's sketch (slice, part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half_size, part = 1 << width_bits, TaskContext.get().partitionId()  # shingles, then words
        sketch = np.zeros(2 * half_size, np.int64)
        names, types = ["doc_id", "n_shingles", "node", "signature", "slice", "part", "counts"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets)
                sets, offs = shingle_sets(words, SIZE)
                for half, hashes in ((0, sets), (half_size, words.hash)):
                    slots, n = np.unique((hashes >> np.uint64(64 - width_bits)).astype(np.int64), return_counts=True)
                    sketch[half + slots] += n
                arrays = [batch.column(0)[a:b], pa.array(np.diff(offs), pa.int64()), pa.array(nodes_of(sets, offs), pa.int64()), pa.array(signatures(sets, offs), pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(b - a, t) for t in types[4:])], names)
        if sketch.any():
            parts = [x.astype("<u8" if x.max() >> 32 else "<u4").tobytes() for x in np.split(sketch, 16)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(16, t) for t in types[:4]), pa.array(range(16), types[4]), pa.array([part] * 16, types[5]), pa.array(parts, types[6])], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lean(run), _PROFILE)


def read_sketch(profiled: DataFrame, width_bits: int = SKETCH_BITS, fan: int = FAN) -> np.ndarray:
    """The sketches (shingles, words) summed over all tasks, `fan` tasks' slices at a time; twice 2**width_bits counts reach the driver."""
    width = (2 << width_bits) // 16

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for x in table.column("counts"):
            raw = x.as_buffer()
            total += np.frombuffer(raw, "<u8" if raw.size == 8 * width else "<u4").astype(np.int64)
        give_back()
        return pa.table({"slice": table.column("slice")[:1], "part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    parts = profiled.where("slice is not null").select("slice", "part", "counts")
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // fan)
        parts = parts.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("slice", "part").applyInArrow(add, "slice int, part int, counts binary")
    out = np.zeros(2 << width_bits, np.int64)
    for r in parts.collect():
        raw = bytes(r["counts"])
        out[r["slice"] * width : (r["slice"] + 1) * width] += np.frombuffer(raw, "<u8" if len(raw) == 8 * width else "<u4").astype(np.int64)
    return out.reshape(2, -1)


def slots(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The slot of each hash in an array of counts, a power of two of them."""
    return (hashes >> np.uint64(65 - len(counts).bit_length())).astype(np.int64)


def classes_of(sketch: np.ndarray, salt_at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(frequency class of each shingle slot, bits of salt, cost of each word slot in quarter bits, words in quarter bits).

    A class counts half powers of two of the expected number of documents; 0 is for slots up to four times the mean. A word's
    cost is minus the logarithm of its share of all words.
    """
    shingle, word = sketch
    mean = max(1.0, shingle.mean())
    much = shingle > 4 * mean
    rank = np.where(much, np.floor(2 * np.log2(np.maximum(shingle, 1))), 0).astype(np.uint8)
    salt = np.where(much, np.ceil(np.log2(np.maximum(shingle, 1) / salt_at)), 0)
    total = max(1, int(word.sum()))
    cost = np.clip(np.round(4 * np.log2(total / np.maximum(word, 1))), 0, 255).astype(np.uint8)
    return rank, np.clip(salt, 0, 12).astype(np.uint8), cost, 4 * float(np.log2(total))


def bucket_bits(df: DataFrame) -> int:
    return max(4, (2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def prefixes(docs: DataFrame, shared, bits: int) -> DataFrame:
    """Packed prefix lists by bucket of the shingle: (bucket, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, salting, cost, whole = shared.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> pa.RecordBatch:
            token, node, size = (np.concatenate(x) for x in zip(*held))
            held.clear()
            slot = slots(token, salting)
            salt = (mix64(node.view(np.uint64)).astype(np.int64)) & ((1 << salting[slot].astype(np.int64)) - 1)
            bucket = (mix64(token) >> np.uint64(64 - bits)).astype(np.int64) | salt << bits
            order = np.argsort(bucket, kind="stable")
            token, node, size, bucket = token[order], node[order], size[order], bucket[order]
            used, first = np.unique(bucket, return_index=True)
            blobs = []
            for a, b in zip(first, np.append(first[1:], len(bucket))):
                head = np.flatnonzero(np.concatenate([[True], node[a + 1 : b] != node[a : b - 1]]))
                runs = np.diff(np.append(head, b - a))
                blobs.append(np.array([len(head)], "<u8").tobytes() + node[a:b][head].tobytes() + size[a:b][head].astype("<u4").tobytes() + runs.astype("<u4").tobytes() + token[a:b].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        total = 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                words = Words(data, offsets)
                sets, offs, paid = shingle_sets(words, SIZE, cost[slots(words.hash, cost)])
                size, node = np.diff(offs), nodes_of(sets, offs)
                fresh = np.array([s > 0 and not (x in seen or seen.add(x)) for x, s in zip(node.tolist(), size.tolist())], bool)
                doc = np.repeat(np.arange(len(size)), size)
                # Half powers of two of the count to be expected by chance, from a sixteenth on.
                chance = np.clip(np.floor((whole - paid) / 2) + 8, 0, 255).astype(np.int64)
                key = doc * 256 + np.maximum(chance, rank[slots(sets, rank)])
                order = np.argsort(key, kind="stable")  # within a class the hashes are sorted already
                place = np.arange(len(sets)) - np.repeat(offs[:-1], size)
                length = size + 1 - -(-NUMERATOR * size // DENOMINATOR)
                take = (place < length[doc]) & fresh[doc]
                held.append((sets[order][take], node[doc[take]], size[doc[take]]))
                total += int(take.sum())
                if total > 1 << 20:
                    yield send()
                    total = 0
                if len(seen) > 1 << 20:
                    seen.clear()
        if held:
            yield send()

    return docs.select("text").mapInArrow(lean(run), "bucket bigint, blob binary")


def _unpack(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    token, node, size = [], [], []
    for cell in blobs:
        raw = cell.as_buffer()
        n = int(np.frombuffer(raw, "<u8", 1)[0])
        runs = np.frombuffer(raw, "<u4", n, 8 + 12 * n)
        node.append(np.repeat(np.frombuffer(raw, "<i8", n, 8), runs))
        size.append(np.repeat(np.frombuffer(raw, "<u4", n, 8 + 8 * n), runs).astype(np.int64))
        token.append(np.frombuffer(raw, "<u8", -1, 8 + 16 * n))
    return np.concatenate(token), np.concatenate(node), np.concatenate(size)


#: kind 0: a pair (a, b) and the lists it shares; 1: a member b of a list with least node a; 2: the leader b of band `band` in a part of list a;
#: 3: a member b of a part of list a.
_LISTS = "kind int, a bigint, b bigint, band int, times bigint"


def _band(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(size) / np.log(DENOMINATOR / NUMERATOR) + 1e-9).astype(np.int64)


def lists(packed: DataFrame, salted_slots: np.ndarray) -> DataFrame:
    """What each bucket's lists give: leader pairs, members of lists of three and more, leaders of split lists."""

    chosen = np.flatnonzero(salted_slots)

    def run(table: pa.Table) -> pa.Table:
        token, node, size = _unpack(table.column("blob"))
        order = np.lexsort((node, token))
        token, node, size = token[order], node[order], size[order]
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        token, node, size = token[fresh], node[fresh], size[fresh]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(start, len(token)))
        split = np.repeat(np.isin(slots(token[start], salted_slots), chosen), count)
        many = np.repeat(count, count)
        keep = (many > 1) | split
        token, node, size, many, split = token[keep], node[keep], size[keep], many[keep], split[keep]
        if not len(token):
            return _table([])
        # Lists with the same members are worth one: their first stands for all, counted.
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(start, len(token)))
        print_ = np.add.reduceat(mix64(node.view(np.uint64)), start) ^ count.astype(np.uint64)
        print_ = np.where(split[start], token[start], print_)
        _, one, times = np.unique(print_, return_index=True, return_counts=True)
        weight = np.zeros(len(start), np.int64)
        weight[one] = times
        weight = np.repeat(weight, count)
        keep = weight > 0
        token, node, size, many, split, weight = token[keep], node[keep], size[keep], many[keep], split[keep], weight[keep]
        band = _band(size)
        order = np.lexsort((node, band, token))
        token, node, many, split, weight, band = token[order], node[order], many[order], split[order], weight[order], band[order]
        new_list = np.concatenate([[True], token[1:] != token[:-1]])
        new_band = new_list | np.concatenate([[True], band[1:] != band[:-1]])
        first = np.flatnonzero(new_band)
        leader = np.repeat(node[first], np.diff(np.append(first, len(node))))
        member = ~new_band
        a, b, w = [leader[member]], [node[member]], [weight[member]]
        near = np.flatnonzero(~new_list[first][1:] & (band[first][1:] == band[first][:-1] + 1)) if len(first) > 1 else np.zeros(0, int)
        lead = node[first]
        a.append(lead[near])
        b.append(lead[near + 1])
        w.append(weight[first][near])
        a, b, w = np.concatenate(a), np.concatenate(b), np.concatenate(w)
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((high, low))
        low, high, w = low[order], high[order], w[order]
        rows = []
        if len(low):
            at = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            rows.append((0, low[at], high[at], np.zeros(len(at), int), np.add.reduceat(w, at)))
        three = (many > 2) & ~split
        at = np.flatnonzero(new_list)
        least = np.repeat(np.minimum.reduceat(node, at), np.diff(np.append(at, len(node))))
        group = np.unique(np.stack([least[three], node[three]]), axis=1)
        rows.append((1, group[0], group[1], np.zeros(group.shape[1], int), np.zeros(group.shape[1], int)))
        rows.append((3, token[split].view(np.int64), node[split], np.zeros(split.sum(), int), np.zeros(split.sum(), int)))
        top = new_band & split
        rows.append((2, token[top].view(np.int64), node[top], band[top], np.zeros(top.sum(), int)))
        return _table(rows)

    return packed.groupBy("bucket").applyInArrow(run, _LISTS)


def _table(rows: list) -> pa.Table:
    names = ["kind", "a", "b", "band", "times"]
    if not rows:
        return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))})
    kind = np.concatenate([np.full(len(a), k) for k, a, *_ in rows])
    a, b, band, times = (np.concatenate([r[i] for r in rows]) for i in range(1, 5))
    return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "band": pa.array(band, pa.int32()), "times": pa.array(times, pa.int64())})


def bloom(nodes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of 2**bits bits over column node, two bits a node; built by bit_or, at most 2**(bits - 6) rows reach the driver."""
    mask = (1 << bits) - 1
    bit = F.explode(F.array(F.col("node").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("node", 32).bitwiseAND(F.lit(mask))))
    rows = nodes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


def _in_bloom(words: np.ndarray, node: np.ndarray) -> np.ndarray:
    mask = 64 * len(words) - 1
    ok = np.ones(len(node), bool)
    for bit in (node & mask, (node.view(np.uint64) >> np.uint64(32)).astype(np.int64) & mask):
        ok &= (words[bit >> 6] >> (bit & 63)) & 1 == 1
    return ok


def set_table(docs: DataFrame, pairs: DataFrame, most: int = BLOOM_MOST) -> DataFrame:
    """(node, size, signature, members) once for each node of the pairs; the bitmaps are the wide ones."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    bits = max(BLOOM_BITS, (32 * pairs.count()).bit_length())
    words_of = docs.sparkSession.sparkContext.broadcast(bloom(asked, bits) if bits <= most else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, sets, offs in _sets(batch.column(0)):
                node, size = nodes_of(sets, offs), np.diff(offs)
                may = size > 0 if words is None else (size > 0) & _in_bloom(words, node)
                pick = [i for i in np.flatnonzero(may).tolist() if not (int(node[i]) in seen or seen.add(int(node[i])))]
                if len(seen) > 1 << 20:
                    seen.clear()
                members = [sets[offs[i] : offs[i + 1]] for i in pick]
                cut = np.concatenate([[0], np.cumsum(size[pick])]).astype(np.int64)
                sigs = signatures(np.concatenate(members) if members else np.zeros(0, np.uint64), cut, WIDE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[pick], pa.int64()), pa.array(size[pick], pa.int64()), pa.array(sigs, pa.binary()), pa.array([m.tobytes() for m in members], pa.binary())],
                    ["node", "size", "signature", "members"],
                )

    found = docs.select("text").mapInArrow(lean(run), "node bigint, size bigint, signature binary, members binary").dropDuplicates(["node"])
    return found if bits <= most else found.join(asked.distinct(), "node", "left_semi")


def prune(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps do not rule out."""
    x = nodes.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("signature").alias("ga"))
    y = nodes.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("signature").alias("gb"))
    near = DENOMINATOR * F.least("sa", "sb") >= NUMERATOR * F.greatest("sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [batch.column(i).to_numpy() for i in (2, 3)]
            keep = pa.array(slack(*size, batch.column(4).to_pylist(), batch.column(5).to_pylist()) >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(2)], ["a", "b"])

    joined = pairs.join(x, "a").join(y, "b").where(near).select("a", "b", "sa", "sb", "ga", "gb")
    return joined.mapInArrow(lean(run), "a bigint, b bigint")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection of their sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                ok[i] = np.count_nonzero(q[at] == p) >= needed_overlap(len(p), len(q))
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left, right = sets.select(F.col("node").alias("a"), F.col("members").alias("x")), sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a bigint, b bigint")


_GROUP = "a bigint, b bigint"


def tiles(members: DataFrame, facts: DataFrame, factor: int, best: int | None) -> DataFrame:
    """members: (list, node, comp, lists), facts: (node, size, signature) of every member. Pairs (a, b) across components that may link: each node's `best` partners, or all.

    A pair is looked at in the least list that both nodes are in. Lists of many nodes are cut into blocks by hashed node and
    dealt as pairs of blocks; bitmaps join the rows when these have been dealt, so they move once.
    """

    def run(table: pa.Table) -> pa.Table:
        node, comp, size, block = (table.column(c).to_numpy() for c in ("node", "comp", "size", "block"))
        sig, lists_of = table.column("signature").to_pylist(), table.column("lists").to_pylist()
        own, (one, two) = table.column("list")[0].as_py(), (table.column(c)[0].as_py() for c in ("one", "two"))
        order = np.lexsort((node, size))
        node, comp, size, block = node[order], comp[order], size[order], block[order]
        sig, lists_of = [sig[i] for i in order], [frozenset(lists_of[i]) for i in order]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def kept() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(end, other, slack) of what was found: each end's best partners, ties to the lower node, or every pair once."""
            if not found:
                return (np.zeros(0, np.int64),) * 3
            end, other, value = (np.concatenate([f[i] for f in found]) for i in range(3))
            if best is None:
                return end, other, value
            order = np.lexsort((node[other], -value, end))
            end, other, value = end[order], other[order], value[order]
            start = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
            first = np.arange(len(end)) - np.repeat(start, np.diff(np.append(start, len(end)))) < best
            return end[first], other[first], value[first]

        for i in range(0, len(node), TILE):
            width = min(LOOK_BITS, int(widths(size[i : i + 1], factor)[0]))  # the tile's least: every bitmap of the tile folds to it
            step = 8 * GATHER_BYTES // width
            left = folded(sig[i : i + TILE], width)
            for j in range(i, len(node), TILE):
                if DENOMINATOR * size[min(i + TILE, len(node)) - 1] < NUMERATOR * size[j]:
                    break  # the smallest of this block is too large already
                a, b = size[i : i + TILE, None], size[None, j : j + TILE]
                may = (comp[i : i + TILE, None] != comp[None, j : j + TILE]) & (DENOMINATOR * a >= NUMERATOR * b)
                if one != two:
                    may &= block[i : i + TILE, None] != block[None, j : j + TILE]
                if i == j:
                    may &= np.triu(np.ones(may.shape, bool), 1)
                p, q = np.nonzero(may)
                if not len(p):
                    continue
                right = folded(sig[j : j + TILE], width)
                differ = np.concatenate([np.bitwise_count(left[p[k : k + step]] ^ right[q[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(p), step)])
                p, q = p + i, q + j
                rest = (size[p] + size[q] - differ) // 2 - needed_overlap(size[p], size[q])
                p, q = p[rest >= 0], q[rest >= 0]
                for k in range(0, len(p), 4096):  # then at full width
                    x, y = p[k : k + 4096], q[k : k + 4096]
                    rest = slack(size[x], size[y], [sig[r] for r in x.tolist()], [sig[r] for r in y.tolist()], factor)
                    ok = rest >= 0
                    ok[ok] = [min(lists_of[u] & lists_of[v]) == own for u, v in zip(x[ok].tolist(), y[ok].tolist())]
                    x, y, rest = x[ok], y[ok], rest[ok]
                    found.append((x, y, rest) if best is None else (np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([rest, rest])))
                    held += len(found[-1][0])
                    if best is not None and held > HELD_PAIRS + best * len(node):
                        found[:] = [kept()]
                        held = len(found[0][0])
        x, y, _ = kept()
        low, high = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
        pairs = np.unique(np.stack([low, high]), axis=1) if len(low) else np.zeros((2, 0), np.int64)
        if len(node) > TILE:
            give_back()
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    n = F.count(F.lit(1))
    blocks = F.greatest(F.ceil(n / GROUP_ROWS), F.least(F.ceil(n / BLOCK_ROWS), F.lit(BLOCKS)))
    sizes = members.groupBy("list").agg(blocks.cast("int").alias("blocks"))
    placed = members.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("one", F.least("block", "with")).withColumn("two", F.greatest("block", "with"))
    # Dealt by all three: a table that is spread by list alone would do for the grouping, with all blocks of a list in one task.
    dealt = dealt.join(facts.select("node", "size", "signature"), "node")
    return dealt.repartition("list", "one", "two").groupBy("list", "one", "two").applyInArrow(run, _GROUP)


def _contested(groups: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Rows of groups with several components, as tiles() takes them; without comps every node is a component."""
    if comps is None:
        placed = groups.withColumn("comp", F.col("node"))
    else:
        placed = groups.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = placed.groupBy("list").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("list")
        placed = placed.join(several, "list", "left_semi")
    return placed.select("list", "node", "comp", "lists")


def join(docs: DataFrame, salt_at: int = SALT_AT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    with arrow_rows(spark, BATCH_ROWS):
        return _join(docs, salt_at)


def _join(docs: DataFrame, salt_at: int) -> DataFrame:
    """All steps with Python in them end in a written table; what is returned are joins of such tables."""
    spark = docs.sparkSession
    context, bits = spark.sparkContext, bucket_bits(docs)
    width = sketch_bits(docs)
    profiled = materialise(profile(docs, width), "join-profile")
    rank, salting, cost, whole = classes_of(read_sketch(profiled, width), salt_at)
    packed = prefixes(docs, context.broadcast((rank, salting, cost, whole)), bits)
    listed = materialise(lists(packed, salting > 0), "join-lists")
    pairs = listed.where("kind = 0").select("a", "b", "times")
    if (salting > 0).any():
        lead = listed.where("kind = 2").select(F.col("a").alias("list"), "band", F.col("b").alias("node"))
        least = lead.groupBy("list", "band").agg(F.min("node").alias("least"))
        across = lead.join(least, ["list", "band"]).select(F.least("node", "least").alias("a"), F.greatest("node", "least").alias("b"))
        below = least.alias("l").join(least.alias("h"), F.expr("l.list = h.list and h.band = l.band + 1"))
        across = across.unionByName(below.select(F.least("l.least", "h.least").alias("a"), F.greatest("l.least", "h.least").alias("b")))
        pairs = pairs.unionByName(across.where("a <> b").withColumn("times", F.lit(1).cast("long")))
    light = profiled.where("n_shingles > 0").groupBy("node").agg(F.max("n_shingles").alias("size"), F.min("signature").alias("signature"))
    nodes = materialise(light, "join-nodes")
    # Lists with the same least node are one group; each node knows the groups it is in.
    grouped = listed.where("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("node"))
    if (salting > 0).any():  # a row for each list that is split: written, so that the engine knows how few
        members = listed.where("kind = 3").select(F.col("a").alias("token"), F.col("b").alias("node"))
        heads = materialise(members.groupBy("token").agg(F.min("node").alias("list")), "join-heads")
        grouped = grouped.unionByName(members.join(heads, "token").select("list", "node"))
    grouped = grouped.distinct()
    lists_of = grouped.groupBy("node").agg(F.collect_list("list").alias("lists"))
    groups = materialise(grouped.join(lists_of, "node"), "join-groups")
    # First round: every node is a component of its own.
    asked = materialise(prune(pairs.select("a", "b").distinct(), nodes).unionByName(tiles(_contested(groups, None), nodes, NARROW, FEW)).distinct(), "join-asked")
    sets = materialise(set_table(docs, asked), "join-sets")
    links = materialise(verify(asked, sets), "join-links")
    comps = components(links)
    groups = groups.join(sets.select("node"), "node", "left_semi")
    for best in (MORE, None):
        found = tiles(_contested(groups, comps), sets, WIDE, best)
        more = materialise(found.join(asked, ["a", "b"], "left_anti"), "join-asked")
        if more.isEmpty():
            continue
        added = materialise(verify(more, sets), "join-links")
        asked = asked.unionByName(more)
        if not added.isEmpty():
            links = links.unionByName(added)
            comps = components(links)
    rows = profiled.where("slice is null").select("doc_id", "n_shingles", "node")
    first = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("head"))
    joined = first.join(comps, "node", "left").select("node", "head", F.coalesce("comp", "node").alias("comp"))
    least = joined.groupBy("comp").agg(F.min("head").alias("component_id"))
    ids = joined.join(least, "comp").select("node", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("n_shingles > 0").join(ids, "node").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def one_of_each(docs: DataFrame, salt_at: int = SALT_AT, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs with only the smallest id of each component; of rows that repeat an id one stays. Rows without an id all stay.

    The ids to drop are counted first: up to broadcast_ids of them (8 bytes each) are broadcast, more are joined by a shuffle.
    """
    found = materialise(join(docs, salt_at), "join-components")
    away = materialise(found.where("doc_id <> component_id").select("doc_id").distinct(), "join-away")
    if away.count() <= broadcast_ids:
        away = F.broadcast(away)
    left = docs.join(away, "doc_id", "left_anti").select(docs.columns)
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return left
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(left.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
