"""Exact substring deduplication by a distributed merge sort of suffixes that never compares known common prefixes again."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Bytes of a repeated string, and of the part of it by which an anchor is chosen.
LENGTH, GRAM = 200, 50
#: A run is sorted and sent when its suffixes have so many bytes; a block of a run has so many suffixes.
RUN_BYTES, BLOCK = 24_000_000, 512
#: A group of suffixes with a common GRAM is judged in memory up to so many distinct contexts; windows of a larger one are cut and counted by Spark.
GROUP = 2_000
#: Buckets of suffixes for each shuffle partition; only suffixes with the same first GRAM bytes meet, so buckets go by their hash.
BUCKETS = 4

_RANDOM = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a text: packed places and hashes of their grams.

    The anchor of a string of `length` bytes is the place of its gram of the smallest hash, the leftmost at a tie. It depends on the string alone, so equal
    strings have it at the same offset. A place is packed as position << 16 | greatest offset << 8 | least offset: the strings with this anchor start that many
    bytes before it. About 2 of (length - gram + 2) positions are anchors.
    """
    n = len(data) - gram + 1
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    powers, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[np.frombuffer(data, np.uint8)] * powers[: len(data)], out=total[1:])
    h = (total[gram:] - total[:n]) * inverse[:n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    w = length - gram + 1
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - w + 1
    place = (np.minimum(back[:starts], ahead[w - 1 : w - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    last = np.concatenate((first[1:] - 1, [starts - 1]))
    at = place[first]
    return (at << 16) | ((at - first) << 8) | (at - last), h[at].view(np.int64)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (differ.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (common prefix with the run's suffix before, suffix, payload). Each run's head knows its common prefix with the last output: of two
    heads the longer one is smaller, and only where they are equal are bytes compared, from there on."""

    def __init__(self, runs: list[Iterable[tuple[int, bytes, object]]]):
        self.runs = [iter(r) for r in runs]
        self.size = 1 << max(len(runs) - 1, 0).bit_length()
        self.heads: list[tuple[int, bytes, object] | None] = [next(r, None) for r in self.runs] + [None] * (self.size - len(runs))
        self.known = [0] * self.size
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y, known = self.heads[a], self.heads[b], self.known
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        p, q, h = x[1], y[1], known[a]
        m = common_prefix(p, q, h)
        if p[m : m + 1] <= q[m : m + 1]:
            known[b] = m
            return a, b
        known[a] = m
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        """(common prefix with the suffix before, suffix, payload) in order."""
        while (head := self.heads[w := self.winner]) is not None:
            yield self.known[w], head[1], head[2]
            following = self.heads[w] = next(self.runs[w], None)
            self.known[w] = following[0] if following is not None else 0
            node = (w + self.size) >> 1
            while node:
                w, self.losers[node] = self._play(w, self.losers[node])
                node >>= 1
            self.winner = w


def front_coded(suffixes: list[tuple[bytes, bytes, int]]) -> Iterator[tuple[list, list, list, list]]:
    """Blocks (common prefixes with the suffix before, tails, left contexts, counts) of sorted (suffix, left, count); a block's first suffix is whole."""
    for i in range(0, len(suffixes), BLOCK):
        part, before, coded = suffixes[i : i + BLOCK], b"", ([], [], [], [])
        for suffix, left, count in part:
            known = common_prefix(before, suffix, 0)
            for column, value in zip(coded, (known, suffix[known:], left, count)):
                column.append(value)
            before = suffix
        yield coded


def decoded(blocks: list[tuple[list, list, list, list]]) -> Iterator[tuple[int, bytes, tuple[bytes, int]]]:
    before = b""
    for prefixes, tails, lefts, counts in blocks:
        start = True
        for known, tail, left, count in zip(prefixes, tails, lefts, counts):
            suffix = before[:known] + tail
            yield common_prefix(before, suffix, 0) if start else known, suffix, (left, count)
            before, start = suffix, False


def context_id(left: bytes, right: bytes) -> bytes:
    return xxhash.xxh3_128_digest(bytes([len(left)]) + left + right)


def _window_ranges(starts: list[int]) -> list[int]:
    """Sorted numbers as a flat list of first and last of each run."""
    out: list[int] = []
    for s in starts:
        if out and out[-1] == s - 1:
            out[-1] = s
        else:
            out += [s, s]
    return out


Group = list[tuple[bytes, int, dict[bytes, int]]]


def judge_group(group: Group, length: int) -> Iterator[tuple[bytes, list[int], None]]:
    """Of sorted suffixes with one gram (suffix, common prefix with the one before, counts by left context): context ids and the ranges of offsets in left + suffix
    at which repeated strings start. A context that occurs twice repeats wholly; for another, a string that reaches beyond the longest common prefix with a
    neighbour is alone, and the others are counted."""
    windows: Counter = Counter()
    spans = []
    for j, (suffix, known, lefts) in enumerate(group):
        shared = len(suffix) if len(lefts) > 1 else max(known, group[j + 1][1] if j + 1 < len(group) else 0)
        for left, count in lefts.items():
            text = left + suffix
            last = len(text) - length if count > 1 else min(len(text), len(left) + shared) - length
            for k in range(last + 1):
                windows[text[k : k + length]] += 1
            spans.append((left, suffix, text, last, count))
    for left, suffix, text, last, count in spans:
        if count > 1:
            yield context_id(left, suffix), [0, last], None
        elif found := [k for k in range(last + 1) if windows[text[k : k + length]] > 1]:
            yield context_id(left, suffix), _window_ranges(found), None


def _unjudged(group: Group, length: int) -> Iterator[tuple[bytes, list[int] | None, bytes]]:
    """The same contexts with their bytes, and the ranges only of one that is known to occur twice."""
    for suffix, _, lefts in group:
        for left, count in lefts.items():
            text = left + suffix
            yield context_id(left, suffix), [0, len(text) - length] if count > 1 else None, text


def _merge_bucket(runs: list[list], length: int, gram: int, most: int | None = None) -> Iterator[tuple[bytes, list[int] | None, bytes | None]]:
    """(context id, ranges, None), or in groups of `most` (GROUP) distinct contexts and more what _unjudged gives; a context may come in two rows then."""
    most = GROUP if most is None else most
    group: Group = []
    n, before, judge = 0, b"", judge_group
    for known, suffix, (left, count) in LoserTree([decoded(r) for r in runs]):
        if known < gram:
            yield from judge(group, length)
            group, n, judge = [(suffix, 0, {left: count})], 1, judge_group
        elif group and known == len(suffix) == len(before):
            lefts = group[-1][2]
            n += left not in lefts
            lefts[left] = lefts.get(left, 0) + count
        else:
            group.append((suffix, known, {left: count}))
            n += 1
        before = suffix
        if n >= most:
            judge = _unjudged
            yield from judge(group, length)
            group, n = [], 0
    yield from judge(group, length)


_BLOCK_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("places", T.ArrayType(T.LongType())), T.StructField("contexts", T.ArrayType(T.BinaryType())),
        T.StructField("bucket", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("prefixes", T.ArrayType(T.IntegerType())),
        T.StructField("tails", T.ArrayType(T.BinaryType())), T.StructField("lefts", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.LongType())),
    ]
)
_BLOCK_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64())]


def _run_builder(length: int, gram: int, buckets: int):
    """From (doc_id, key, text, places): rows of kind 0 with the context of each place, and rows of kind 1 with the blocks of sorted runs. Equal contexts of a run
    are sent once, with their count."""

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(_BLOCK_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BLOCK_TYPES)], names=_BLOCK_SCHEMA.names)

    def flush(contexts: dict[tuple[bytes, bytes], int], run: int) -> Iterator[tuple]:
        by_bucket: dict[int, list] = {}
        for (suffix, left), count in contexts.items():
            by_bucket.setdefault(xxhash.xxh3_64_intdigest(suffix[:gram]) % buckets, []).append((suffix, left, count))
        for bucket, items in by_bucket.items():
            items.sort()
            for block, coded in enumerate(front_coded(items)):
                yield (1, None, None, None, None, bucket, run, block, *coded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: dict[tuple[bytes, bytes], int] = {}
        size, number = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            out = []
            for doc, key, text, places in zip(*(batch.column(i) for i in range(4))):
                data, places = (text.as_py() or "").encode("utf-8", "surrogatepass"), places.as_py()
                ids = []
                for p in places:
                    at, most, least = p >> 16, p >> 8 & 255, p & 255
                    left, right = data[at - most : at], data[at : at - least + length]
                    ids.append(context_id(left, right))
                    if (right, left) in contexts:
                        contexts[right, left] += 1
                    else:
                        contexts[right, left] = 1
                        size += len(left) + len(right)
                out.append((0, doc.as_py(), key.as_py(), places, ids, *[None] * 7))
                if size > RUN_BYTES:
                    out += flush(contexts, number)
                    contexts, size, number = {}, 0, number + 1
            yield rows_of(out)
        yield rows_of(list(flush(contexts, number)))

    return run


def _merger(length: int, gram: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.list_(pa.int32()), pa.binary()))], names=["context", "ranges", "string"])

        def merged(runs: dict) -> Iterator[pa.RecordBatch]:
            rows = []
            for row in _merge_bucket(list(runs.values()), length, gram, group):
                rows.append(row)
                if len(rows) >= 4096:
                    yield out(rows)
                    rows = []
            yield out(rows)

        bucket, runs = None, {}
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for i, (b, r) in enumerate(keys):
                if b != bucket:
                    if runs:
                        yield from merged(runs)
                    bucket, runs = b, {}
                runs.setdefault(r, []).append(tuple(batch.column(k)[i].as_py() for k in range(3, 7)))
        if runs:
            yield from merged(runs)

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, key, ranges) of the (doc_id, key, text) rows with repeated strings; ranges are flat lists of first and last byte start of such strings.

    group says from how many contexts on a group's strings are counted by Spark, over all tasks; the rows are the same.
    """
    if not gram < length <= 255 + gram:
        raise ValueError("gram < length <= gram + 255")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors((x.as_py() or "").encode("utf-8", "surrogatepass"), length, gram) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([h for _, h in found], pa.list_(pa.int64()))], names=["doc_id", "key", "places", "grams"])

    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scanned = written(docs.mapInArrow(scan, "doc_id long, key long, places array<long>, grams array<long>"), "anchors")
    often = scanned.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    each = scanned.select("doc_id", "key", F.explode(F.arrays_zip("places", "grams")).alias("x")).select("doc_id", "key", F.col("x.places").alias("place"), F.col("x.grams").alias("gram"))
    places = each.join(often, "gram", "left_semi").groupBy("doc_id", "key").agg(F.collect_set("place").alias("places"))
    texts = docs.join(places, ["doc_id", "key"]).select("doc_id", "key", "text", "places")
    runs = written(texts.mapInArrow(_run_builder(length, gram, buckets), _BLOCK_SCHEMA), "runs", ("kind",))
    blocks = runs.where("kind = 1").select("bucket", "run", "block", "prefixes", "tails", "lefts", "counts")
    judged = blocks.repartition("bucket").sortWithinPartitions("bucket", "run", "block").mapInArrow(_merger(length, gram, group), "context binary, ranges array<int>, string binary")
    judged = written(judged, "judged")
    small = judged.where("string is null").select("context", "ranges")
    large = judged.where("string is not null").select("context", F.when(F.col("ranges").isNull(), 1).otherwise(2).alias("weight"), "string").repartition("context")
    windows = large.select("context", "weight", "string", F.explode(F.sequence(F.lit(0), F.length("string") - length)).alias("k"))
    windows = windows.select("context", "weight", "k", F.unhex(F.md5(F.substring("string", F.col("k") + 1, F.lit(length)))).alias("window"))
    twice = windows.groupBy("window").agg(F.sum("weight").alias("n")).where("n > 1").select("window")
    ranges = F.flatten(F.transform(F.array_sort(F.collect_set("k")), lambda k: F.array(k, k)))
    large = windows.join(twice, "window", "left_semi").groupBy("context").agg(ranges.alias("ranges"))
    contexts = runs.where("kind = 0").select("doc_id", "key", F.explode(F.arrays_zip("places", "contexts")).alias("x")).select("doc_id", "key", F.col("x.places").alias("place"), F.col("x.contexts").alias("context"))
    start = F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(F.lit(255))
    hit = contexts.join(small.unionByName(large), "context").select("doc_id", "key", start.alias("start"), "ranges")
    moved = F.transform("ranges", lambda x: x + F.col("start"))
    return hit.groupBy("doc_id", "key").agg(F.flatten(F.collect_list(moved)).alias("ranges"))


def cut(data: bytes, ranges: list[int], length: int = LENGTH) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal removed runs [start, end) and the bytes that remain."""
    spans: list[tuple[int, int]] = []
    for first, last in sorted(zip(ranges[::2], ranges[1::2])):
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], last + length))
        else:
            spans.append((first, last + length))
    at, rest = 0, []
    for a, b in spans:
        rest.append(data[at:a])
        at = b
    return spans, b"".join([*rest, data[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans) of every row.

    Texts are UTF-8 bytes, null is empty. Every byte goes that is covered by a string of `length` bytes which also starts anywhere else, in another row or in the
    same; so both copies go, and strings are judged on the input. kept is what remains (a cut may split a character, so it is binary), spans are the removed
    runs as start and end. Rows of the same id and text are each other's copies; rows shorter than `length` stay whole; null ids are treated as an id.

    Only anchors are sorted, one for each string: first the grams of all anchors are counted, then the suffixes at anchors whose gram repeats go into sorted,
    front-coded runs, which are exchanged by gram and merged by loser trees; common prefixes of neighbours tell which strings repeat.
    """
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)), F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    found = repeated_ranges(keyed.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))), length, gram, group)
    ranges = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "ranges")
    rows = keyed.join(ranges, (F.coalesce("doc_id", F.lit(-1)) == F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("doc_id", "text", "ranges")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>"
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans, kept = cut(data, ranges.as_py() or [], length)
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in spans]))
            columns = list(zip(*out)) or [()] * 6
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    return rows.mapInArrow(run, schema)
