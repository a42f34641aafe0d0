"""Near-duplicate documents: bottom-k sketches of one hash function, inverted lists of retained values, estimation on union sketches, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, connected_components, written

#: Values that a sketch retains; its LISTED smallest are in inverted lists.
SKETCH, LISTED = 64, 32
#: Texts of similarity 0.8 share at least so many of their LISTED values, but for one pair in 10^9 (26 are expected).
SHARED = 10
#: A pair is verified if its estimate is at least so much: six standard errors under 0.8.
LEAST_ESTIMATE = 0.5
#: Rows that are compared with one hub, or stand on one side of a block, together.
STAR, BLOCK = 64, 256
#: Values of a block that are multiplied at once.
COLUMNS = 4096
_FOLD = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_P, _Q, _R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_WORDS: dict[bytes, int] = {}


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles: `size` words each, or the whole sequence if there are fewer; none without words.

    One 64-bit hash function stands for all; words are runs of bytes other than space and \\x09-\\x0D, with A-Z in lower case.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return np.empty(0, np.int64)
    if len(_WORDS) > 400_000:
        _WORDS.clear()
    get, numbers = _WORDS.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        numbers.append(h)
    values = np.array(numbers, np.uint64)
    size = min(size, len(values))
    n = len(values) - size + 1
    h = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h ^ values[k : k + n]) * _P
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(30))) * _Q
        h = (h ^ (h >> np.uint64(27))) * _R
        h ^= h >> np.uint64(31)
    return np.unique(h.view(np.int64))


def estimate(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> float:
    """Jaccard similarity as the share of the k smallest values of both sets together that both have."""
    a, b = a[:k], b[:k]
    union = np.union1d(a, b)[:k]
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / max(len(union), 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, on the full sets."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, True))
    return 100 * common >= percent * (small + large - common)


def set_number(values: np.ndarray) -> int:
    """A 64-bit hash that stands for all equal sets, whatever the ids of their rows."""
    return int.from_bytes(xxhash.xxh3_64_digest(values.tobytes()), "big", signed=True)


def one_text_each(texts: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, text): a text of each wanted node; texts and sets have doc_id and text_hash, by which one row of a node's is found."""
    first = sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    first = first.select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    found = texts.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_hash")))
    return found.select(F.col("node").alias("doc"), "text").dropDuplicates(["doc"])


def with_components(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows (doc_id, node) with component_id: the smallest id of the component that their node is in; rows without a node are alone."""
    placed = rows.join(members, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = F.col("component").isNull()
    return placed.join(least, "component", "left").withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))).drop("component")


def _sketcher(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), size) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_number(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64())),
                    batch.column(2),
                ],
                names=["doc_id", "n_shingles", "node", "sketch", "text_hash"],
            )

    return run


def _inverted_lists(classes: DataFrame) -> DataFrame:
    """(value, node, weight): in which lists a node stands, by prefix filtering. Lists are ordered by their length over the whole corpus, and each node stands
    in its rarest ones, so many that two nodes that share SHARED values meet in one; lists of one node are left out.
    weight is the number of nodes that a node's lists have in all: the centre of a group of near copies has the largest."""
    listed = F.least(F.size("sketch"), F.lit(LISTED))
    postings = classes.select(F.col("node"), listed.alias("size"), F.explode(F.slice("sketch", 1, LISTED)).alias("value"))
    lengths = postings.groupBy("value").agg(F.count("*").alias("length")).where("length > 1")
    own = Window.partitionBy("node")
    ranked = postings.join(lengths, "value").withColumns(
        {"rank": F.row_number().over(own.orderBy("length", "value")), "n": F.count("*").over(own), "weight": F.sum("length").over(own)}
    )
    prefix = F.col("size") - F.ceil(F.col("size") * SHARED / LISTED) + 1
    return ranked.where(F.col("rank") + F.col("size") - F.col("n") <= prefix).select("value", "node", "weight")


def _estimated(pairs: DataFrame, classes: DataFrame, k: int = SKETCH) -> DataFrame:
    """Of (node, hub) pairs those whose union sketch gives LEAST_ESTIMATE or more."""
    of = lambda name: classes.select(F.col("node").alias(name), F.col("sketch").alias(f"{name}_sketch"))
    both = pairs.join(of("node"), "node").join(of("hub"), "hub")
    union = F.slice(F.array_sort(F.array_union("node_sketch", "hub_sketch")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("node_sketch", "hub_sketch")))
    return both.where(common >= LEAST_ESTIMATE * F.size(union)).select("node", "hub")


def _star_links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) of the (node, hub) pairs that the full sets confirm. A hub's text goes with each STAR of its nodes, so no task gets more of them at once."""
    salted = pairs.join(pairs.groupBy("hub").agg(F.count("*").alias("n")), "hub").withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / STAR)))
    asked = salted.select("hub", "salt", F.lit(1).alias("side"), F.col("node").alias("doc")).unionByName(salted.select("hub", "salt", F.lit(0).alias("side"), F.col("hub").alias("doc")).distinct())
    rows = asked.join(texts, "doc").select("hub", "salt", "side", "doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub = None, None
        for batch in batches:
            a, b = [], []
            hubs, salts, sides, docs = (batch.column(i).to_pylist() for i in range(4))
            for i, text in enumerate(batch.column(4)):
                values = shingle_set(text.as_py(), size)
                if not sides[i]:
                    key, hub = (hubs[i], salts[i]), values
                elif key == (hubs[i], salts[i]) and linked(values, hub, percent):
                    a.append(docs[i])
                    b.append(hubs[i])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "side").mapInArrow(run, "a long, b long")


def _block_links(left: list, right: list, percent: int) -> list[tuple[int, int]]:
    """Links between the rows (node, component, set) of left and right, only such that join components which none before has joined.

    Matrix products give all intersections: values that one row alone has can't be common and have no column.
    """
    sizes = [[len(s) for _, _, s in side] for side in (left, right)]
    flat = np.concatenate([s for side in (left, right) for _, _, s in side])
    rows = np.repeat(np.arange(len(left) + len(right)), sizes[0] + sizes[1])
    values, columns, counts = np.unique(flat, return_inverse=True, return_counts=True)
    used = counts > 1
    place = np.cumsum(used) - 1
    keep = used[columns]
    rows, columns = rows[keep], place[columns[keep]]
    common = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(used.sum()), COLUMNS):
        part = (columns >= first) & (columns < first + COLUMNS)
        matrix = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        matrix[rows[part], columns[part] - first] = 1
        common += matrix[: len(left)] @ matrix[len(left) :].T
    total = np.add.outer(np.array(sizes[0]), np.array(sizes[1]))
    parents: dict[int, int] = {}

    def root(x: int) -> int:
        while parents.get(x, x) != x:
            x = parents[x]
        return x

    out = []
    for i, j in np.argwhere(100 * common >= percent * (total - common)):
        (a, p, _), (b, q, _) = left[i], right[j]
        if common[i, j] and (p := root(p)) != (q := root(q)):
            parents[p] = q
            out.append((a, b))
    return out


def _shared_sizes(texts: DataFrame, size: int) -> DataFrame:
    """(node, n, shared) of the texts: how large their sets are, and how many of their shingles another of the texts has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = shingle_set(text.as_py(), size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), node, np.int64)), pa.array(values)], names=["node", "shingle"])

    each = written(texts.select("doc", "text").mapInArrow(run, "node long, shingle long"), "shingles")
    often = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle", F.lit(1).alias("other"))
    return each.join(often, "shingle", "left").groupBy("node").agg(F.count("*").alias("n"), F.count("other").alias("shared"))


def _rest_links(lists: DataFrame, members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) that the hubs have missed: within each list, every node outside the list's largest component against every node, in blocks of BLOCK x BLOCK.

    Two sets of n and m shingles are linked only if percent / (100 + percent) * (n + m) are common. A node that shares fewer than that with all others
    together, for the smallest m of its list, has no link there, and is left out. A node of the largest component only has to reach nodes outside it, so its m
    is the smallest of those; a node outside may be linked to any node. Only links that join different components are emitted, so a group of n near
    copies gives n - 1 links at most in a block, not n^2.
    """
    known = lists.join(members, "node", "left").select("value", "node", F.coalesce("component", "node").alias("component"))
    parts = known.groupBy("value", "component").agg(F.count("*").alias("n"))
    largest = parts.groupBy("value").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("n_all"), F.count("*").alias("parts")).where("parts > 1 and n_all > 2")
    rows = written(known.join(largest.select("value", "major"), "value"), "rest")
    of_rows = written(texts.join(rows.select(F.col("node").alias("doc")).distinct(), "doc", "left_semi"), "rest-texts")
    rows = rows.join(_shared_sizes(of_rows, size), "node").withColumn("minor", F.col("component") != F.col("major"))
    enough = F.expr(f"{100 + percent} * shared >= {percent} * (n + least_n)")
    rows = rows.join(rows.groupBy("value").agg(F.min("n").alias("least_n")), "value").where(enough).drop("least_n")
    of_list = rows.groupBy("value").agg(F.min("n").alias("least"), F.min(F.when(F.col("minor"), F.col("n"))).alias("least_minor"))
    least_n = F.when(F.col("minor"), F.col("least")).otherwise(F.col("least_minor"))
    rows = written(rows.join(of_list, "value").withColumn("least_n", least_n).where(enough).drop("least", "least_minor"), "rest-rows")
    counts = rows.groupBy("value").agg(F.count("*").alias("n_all"), F.count_if("minor").alias("n_minor"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"))
    counts = counts.groupBy("mark", "n_all", "n_minor").agg(F.min("value").alias("value"))  # lists of the same nodes
    rows = rows.join(counts, "value")
    lefts, rights = F.ceil(F.col("n_minor") / BLOCK).cast("int"), F.ceil(F.col("n_all") / BLOCK).cast("int")
    seed = F.xxhash64("node")
    left = rows.where("minor").select("value", F.pmod(seed, lefts).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), rights - 1)).alias("j"), F.lit(0).alias("side"), "node", "component")
    right = rows.select("value", F.explode(F.sequence(F.lit(0), lefts - 1)).alias("i"), F.pmod(seed, rights).cast("int").alias("j"), F.lit(1).alias("side"), "node", "component")
    asked = left.unionByName(right).withColumnRenamed("node", "doc")
    rows = asked.join(of_rows, "doc").select("value", "i", "j", "side", "doc", "component", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, out = None, ([], []), []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            which, docs, components = (batch.column(i).to_pylist() for i in range(3, 6))
            for n, text in enumerate(batch.column(6)):
                if keys[n] != key:
                    out += _block_links(*sides, percent) if sides[0] and sides[1] else []
                    key, sides = keys[n], ([], [])
                sides[which[n]].append((docs[n], components[n], shingle_set(text.as_py(), size)))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
            out = []
        out = _block_links(*sides, percent) if sides[0] and sides[1] else []
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return rows.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j", "side").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) of every row; text_hash is xxhash64 of the text, which tells rows of one id apart; kept marks the row that has the smallest id of its component.

    Documents are linked if their shingle sets have a Jaccard similarity of percent / 100 or more. Equal sets are one node, whatever their ids.
    In each inverted list all nodes are compared with the hub (the node of the largest weight): estimated on union sketches, then verified on the full sets. Where
    a list still holds several components, the nodes outside its largest are verified against all its nodes in blocks, so no link between
    components is lost, and the pairs of a large group are never emitted. Links are joined to components by rounds of joins.
    Texts without words and null texts have no shingles and stand alone. Rows of one id with different texts are linked by their own texts; rows of the same id and text are
    each other's copies, and kept or not together. A null id is a component's id only where all its rows have null ids. Texts are held whole by one task. Empty tables give no rows.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    schema = "doc_id long, n_shingles long, node long, sketch array<long>, text_hash long"
    sketched = written(texts.mapInArrow(_sketcher(shingle_words), schema), "sketches")
    classes = sketched.where("node is not null").select("node", "n_shingles", "sketch").dropDuplicates(["node"])
    lists = written(_inverted_lists(classes), "lists")
    hubs = lists.groupBy("value").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))
    pairs = lists.join(hubs, "value").where("node <> hub").select("node", "hub").distinct()
    one_text = written(one_text_each(texts, sketched.select("doc_id", "text_hash", "node"), lists.select("node").distinct()), "texts")
    star = written(_star_links(written(_estimated(pairs, classes), "pairs"), one_text, shingle_words, percent), "star")
    members = connected_components(star, "stars")
    rest = written(_rest_links(lists, members, one_text, shingle_words, percent), "rest-links")
    if not rest.isEmpty():
        members = connected_components(star.unionByName(rest), "all")
    rows = with_components(sketched.select("doc_id", "n_shingles", "node", "text_hash"), members)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")
