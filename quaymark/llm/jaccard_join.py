"""Exact Jaccard join of shingle sets: the universe is cut into segments by size band, sets that agree on a segment but for the allotted differences are candidates."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, merged_components, written
from .minhash import _rest_links, _star_links, one_text_each, set_number, shingle_set, with_components

#: About so many tokens of a set lie in the segments that are also indexed with one token less.
DELETIONS = 12
#: Segments beyond the needed ones, one in so many: what frequent segments can be left out for.
SPARE = 16
_P, _Q, _R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (x ^ salt) * _Q
    x = (x ^ (x >> np.uint64(29))) * _R
    return x ^ (x >> np.uint64(32))


class Bands:
    """Bands of set sizes, each with its own segments, for sets that link at percent / 100."""

    def __init__(self, percent: int):
        self.percent, self.edges = percent, [1, 2]

    def of(self, n: int) -> int:
        while self.edges[-1] <= n:
            low = self.edges[-1]
            self.edges.append(max(low + 1, low * 10_000 // self.percent**2))
        return bisect_right(self.edges, n) - 1

    def difference(self, n: int, other: int) -> int:
        """Linked sets of n and `other` tokens differ in so many at most, counted on both sides."""
        return (100 - self.percent) * (n + other) // (100 + self.percent)

    def largest(self, band: int) -> int:
        self.of(self.edges[-1])
        return self.edges[band + 1] - 1

    def segments(self, band: int) -> tuple[int, int]:
        """The band's segments, and how many of them are also indexed with one token less."""
        top = self.largest(band)
        most = self.difference(top * 100 // self.percent, top)
        m = max(2, most + 1 + most // SPARE)
        return m, min(m, -(-DELETIONS * m // top))

    def probes(self, n: int) -> list[tuple[int, int, int, int]]:
        """(bands back, segments, segments with deletions, differences that must be allotted) for each band with sets that a set of n tokens, as the larger one, may be
        linked to. Its own band comes first, and is also the one that it is indexed in; without a difference to allot, only equal sets link."""
        own, least = self.of(n), -(-self.percent * n // 100)
        return [(back, *self.segments(own - back), self.difference(n, min(n, self.largest(own - back))) + 1) for back in range(own - self.of(max(least, 1)) + 1)]


def signatures(sets: list[np.ndarray], bands: Bands) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, tuple, tuple]]:
    """For each number of bands back: (back, places in sets, short, loose, whole, less) of the sets that probe so far back.

    short: what is to be allotted beyond one for each segment and one more for each of the first `loose` segments (negative or 0). whole: (ends, hashes) of what each set has
    in each segment, in order of segments. less: (ends, hashes, segments) of the same with one token left out, of the loose segments' tokens.
    """
    plans = [bands.probes(len(s)) if len(s) else [] for s in sets]
    for back in range(max(map(len, plans), default=0)):
        chosen = [i for i, p in enumerate(plans) if len(p) > back]
        m = np.array([plans[i][back][1] for i in chosen], np.int64)
        spared = np.array([plans[i][back][2] for i in chosen], np.int64)
        short = np.array([plans[i][back][3] for i in chosen], np.int64) - m - spared
        band = np.array([bands.of(len(sets[i])) - back for i in chosen], np.uint64)
        size = np.array([len(sets[i]) for i in chosen], np.int64)
        values = np.concatenate([sets[i] for i in chosen]).view(np.uint64)
        owner = np.repeat(np.arange(len(chosen)), size)
        with np.errstate(over="ignore"):
            seg = ((_mixed(values, _P) >> np.uint64(20)) % m[owner].astype(np.uint64)).astype(np.int64)
            own = _mixed(values, _R)
            ends = np.cumsum(m)
            cell = (ends - m)[owner] + seg
            order = np.argsort(cell, kind="stable")
            total = np.append(np.uint64(0), np.cumsum(own[order]))
            upto = np.cumsum(np.bincount(cell, minlength=int(ends[-1])))
            sums = total[upto] - total[np.append(0, upto[:-1])]
            cells = np.repeat(np.arange(len(chosen)), m)
            number = np.arange(len(cells)) - (ends - m)[cells]
            place = _mixed((number.astype(np.uint64) << np.uint64(12)) | band[cells], _Q)
            loose = np.flatnonzero(seg < spared[owner])
            whole = (_mixed(sums, _P) + place).view(np.int64)
            less = (_mixed(sums[cell[loose]] - own[loose], _P) + place[cell[loose]]).view(np.int64)
        yield back, np.array(chosen), short, spared, (ends, whole), (np.cumsum(np.bincount(owner[loose], minlength=len(chosen))), less, seg[loose])


_SETS = "doc_id long, text_hash long, n_shingles long, node long, back int, short int, loose int, whole array<long>, less array<long>, less_seg array<int>"


def _sets_of(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of each (doc_id, text_hash, text): its shingles' number, its node (equal sets are one, sets without shingles none) and its signatures(), a row for each number of
    bands back. Sets that only equal ones can be linked to have no signatures, and one row with back 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        names = [c.split()[0] for c in _SETS.split(", ")]

        def listed(ends: np.ndarray, values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values))

        def rows(ids: list, hashes: list, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            ids, hashes = pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())
            n = np.array([len(s) for s in sets], np.int64)
            nodes = pa.array([set_number(s) if len(s) else None for s in sets], pa.int64())

            def out(at: np.ndarray, back: int, short, loose, whole, less, less_seg) -> pa.RecordBatch:
                at = pa.array(at, pa.int64())
                fixed = [ids.take(at), hashes.take(at), pa.array(n).take(at), nodes.take(at), pa.array(np.full(len(at), back, np.int32))]
                return pa.RecordBatch.from_arrays([*fixed, pa.array(short.astype(np.int32)), pa.array(loose.astype(np.int32)), whole, less, less_seg], names=names)

            # without a difference that a larger linked set could have, only equal sets link
            probing = np.array([bool(k) and bands.difference(int(k) * 100 // percent, int(k)) > 0 for k in n], bool)
            alone, others = np.flatnonzero(~probing), np.flatnonzero(probing)
            none, zero = np.zeros(len(alone), np.int64), np.empty(0, np.int64)
            yield out(alone, 0, none, none, listed(none, zero), listed(none, zero), listed(none, zero.astype(np.int32)))
            for back, at, short, loose, (ends, whole), (less_ends, less, seg) in signatures([sets[i] for i in others], bands):
                yield out(others[at], back, short, loose, listed(ends, whole), listed(less_ends, less), listed(less_ends, seg.astype(np.int32)))

        for batch in batches:
            held, start, sets = 0, 0, []
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, text in enumerate(batch.column(2), 1):
                sets.append(shingle_set(text.as_py(), size))
                held += len(sets[-1])
                if held > 200_000 or k == len(batch):
                    yield from rows(ids[start:k], hashes[start:k], sets)
                    held, start, sets = 0, k, []

    return docs.mapInArrow(run, _SETS)


def _signature_rows(sets: DataFrame) -> DataFrame:
    """(sig, node, n, back, seg, gone, loose, short): a row for each signature; gone: whether a token is left out, loose: whether the segment has such rows."""
    kept = ["node", F.col("n_shingles").cast("int").alias("n"), "back", "short"]
    whole = sets.select(*kept, F.col("loose").alias("spared"), F.posexplode("whole").alias("seg", "sig"))
    less = sets.select(*kept, F.explode(F.arrays_zip("less", "less_seg")).alias("x"))
    columns = ["sig", "node", "n", "back", "seg", "gone", "loose", "short"]
    whole = whole.withColumns({"gone": F.lit(False), "loose": F.col("seg") < F.col("spared")}).select(*columns)
    return whole.unionByName(less.select(*kept[:1], "n", "back", "short", F.col("x.less").alias("sig"), F.col("x.less_seg").alias("seg"), F.lit(True).alias("gone"), F.lit(True).alias("loose")).select(*columns))


def candidate_lists(rows: DataFrame) -> DataFrame:
    """(value, node, n): lists of sets, such that any two linked sets stand in one together; rows as of _signature_rows().

    A linked pair's larger set, probing the smaller one's band, must find it. Differences over all segments are fewer than what is allotted to the segments in
    all, so in some segment there are fewer than allotted there: none where one is allotted (equal signatures), one at most where two are (the
    whole of one set is the other's with or without one token less), and a segment with nothing allotted isn't looked up. Each set allots by cost: what it meets in the
    index under a segment's signatures, counted over all sets; segments that it meets nothing in are free. So segments which are empty or common everywhere are left out.
    """
    own = Window.partitionBy("sig")
    whole = ~F.col("gone")
    shared = rows.withColumns({"least": F.min("node").over(own), "most": F.max("node").over(own), "any_index": F.min("back").over(own), "any_whole": F.max(whole).over(own)})
    shared = written(shared.where("least <> most and any_index = 0 and any_whole").drop("least", "most", "any_index", "any_whole").distinct(), "shared")
    indexed = F.col("back") == 0
    met = shared.groupBy("sig").agg(F.count_if(indexed & whole).alias("n_whole"), F.count_if(indexed & F.col("gone")).alias("n_less"))
    priced = shared.join(met, "sig").withColumns({
        "one": F.when(whole, F.col("n_whole") - indexed.cast("int")).otherwise(0),
        "two": F.when(whole, F.col("n_less")).otherwise(F.col("n_whole")),
    })
    cells = priced.groupBy("node", "back", "seg", "loose", "short").agg(F.sum("one").alias("one"), F.sum("two").alias("two"))
    steps = F.filter(
        F.array(F.struct(F.col("one").alias("cost"), "seg", F.lit(1).alias("level")), F.struct(F.when(F.col("loose"), F.greatest("one", "two")).otherwise(0).alias("cost"), "seg", F.lit(2).alias("level"))),
        lambda x: x["cost"] > 0,
    )
    allotted = cells.groupBy("node", "back", "short").agg(F.array_sort(F.flatten(F.collect_list(steps))).alias("steps"))
    taken = allotted.select("node", "back", F.explode(F.slice("steps", 1, F.greatest(F.col("short") + F.size("steps"), F.lit(0)))).alias("step"))
    taken = taken.groupBy("node", "back", F.col("step.seg").alias("seg")).agg(F.max("step.level").alias("level"))
    asking = written(shared.join(taken, ["node", "back", "seg"]).where(whole | (F.col("level") == 2)), "asking")
    asked = asking.groupBy(F.col("sig").alias("value")).agg(F.max(whole & (F.col("level") == 2)).alias("less_too"))
    answers = shared.where(indexed).withColumnRenamed("sig", "value").join(asked, "value").where(whole | F.col("less_too"))
    return asking.select(F.col("sig").alias("value"), "node", "n").unionByName(answers.select("value", "node", "n")).distinct()


def linked_components(docs: DataFrame, shingle_words: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set of shingles, and the smallest id that is reachable by links.

    Two rows are linked if 100 * |a and b| >= percent * |a or b|. Words are runs of characters other than space and \\x09-\\x0D, with A-Z in lower case; a text of
    fewer words than a shingle is one shingle. Null texts and texts without words have no shingles and are linked with nothing. Equal sets are one node, whatever
    their ids, so rows of one id with different texts are told apart; a component's id is the smallest id that isn't null, null if there is none. Empty tables give no rows.

    In a list of candidates all nodes are compared with the list's hub on full sets; where several components are left, the nodes outside the
    largest are compared with all in blocks. So no link between components is lost, and a group of copies never gives all its pairs. Shingles and sets
    are 64-bit hashes. A text is held by one task, whatever its length.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    signed = written(_sets_of(texts, shingle_words, percent), "sets")
    sets = signed.where("back = 0").select("doc_id", "text_hash", "n_shingles", "node")
    lists = written(candidate_lists(_signature_rows(signed)), "candidates")
    lengths = lists.groupBy("value").agg(F.count("*").alias("length")).where("length > 1")
    lists = lists.join(lengths, "value")
    lists = written(lists.join(lists.groupBy("node").agg(F.sum("length").alias("weight")), "node"), "weighed")
    hubs = lists.groupBy("value").agg(F.max_by(F.struct("node", "n"), F.struct("weight", -F.col("node"))).alias("hub"))
    fits = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    pairs = lists.join(hubs, "value").where((F.col("node") != F.col("hub.node")) & fits).select("node", F.col("hub.node").alias("hub")).distinct()
    one_text = written(one_text_each(texts, sets, lists.select("node").distinct()), "texts")
    star = written(_star_links(written(pairs, "pairs"), one_text, shingle_words, percent), "star")
    members = connected_components(star, "stars")
    rest = written(_rest_links(lists.select("value", "node"), members, one_text, shingle_words, percent), "rest-links")
    if not rest.isEmpty():
        members = merged_components(members, rest, "all")
    return with_components(sets, members).select("doc_id", "n_shingles", "component_id")
