"""Phrase collocations: suffix pointers routed by leading words and counted by a multikey three-way quicksort."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, written

#: Words of the longest phrase.
LONGEST = 5
#: Word pairs, and then triples of pairs that pass, are counted in slots first, each up to 255: what is in a rarer slot is rare itself. There is a slot for SLOT_CHARS
#: characters of text, so that as many stay rare in a larger corpus, from SLOTS to MOST_SLOTS. The slots that pass are one bit each, 8 MB at most.
SLOTS, MOST_SLOTS, SLOT_CHARS, SLOT_BLOCK = 1 << 22, 1 << 26, 128, 1 << 12
#: So many of the most frequent words have a number of their own in blocks (8 bytes each are broadcast); a block lists the ids of its other words.
KNOWN = 1 << 19
#: A task's dictionary and its rows are sent on at this size.
DICTIONARY, BUFFER = 500_000, 1_000_000
#: Buckets of leading words for each shuffle partition, or more: one for 3 * LANE_ROWS characters. A bucket of more rows than LANE_ROWS is dealt anew by one word more.
BUCKETS, LANE_ROWS = 4, 500_000

_SPLIT = bytes.maketrans(UPPER.encode() + b",;:!?\x0a\x0b\x0c\x0d", LOWER.encode() + b"." * 9)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_COUNTED = "kind int, lang string, id long, word string, n long, slots binary"


class Known:
    """Ids of the most frequent words, whose codes are their places from 1; whole: whether all other words are rare. Codes beyond are places in a block's own list."""

    def __init__(self, ids: np.ndarray, whole: bool):
        self.whole, self._ids = whole, np.append(np.zeros(1, np.uint64), ids)
        self._order = np.argsort(self._ids)
        self._sorted = self._ids[self._order]

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """The codes of ids; -1 for words that have none."""
        at = np.minimum(np.searchsorted(self._sorted, ids), len(self._sorted) - 1)
        return np.where(self._sorted[at] == ids, self._order[at], -1).astype(np.int32)

    def coded(self, words: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The codes of rows of words, -1 filled in, and for each block (rows up to its end) the ids of words without a code."""
        more, other = [], codes < 0
        some = other.any()
        for start, end in zip([0, *ends[:-1]], ends):
            at = other[start:end] if some else other[:0]
            listed, place = np.unique(words[start:end][at] if some else words[:0], return_inverse=True)
            if some:
                codes[start:end][at] = len(self._ids) + place
            more.append(listed)
        return codes.astype(np.uint32), more

    def ids(self, codes: np.ndarray, more: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The ids of rows of codes; offsets: where in `more` each row's block begins."""
        other = codes >= len(self._ids)
        out = self._ids[np.where(other, 0, codes)]
        if other.any():
            out[other] = more[(codes.astype(np.int64) - len(self._ids) + offsets[:, None])[other]]
        return out


class Dictionary(dict):
    """Words (bytes) to numbers from 1; number 0 is the end of a piece. With a whole Known, rare words have the id 0 and end a piece as well."""

    def __init__(self, known: Known | None = None):
        super().__init__({b".": 0})
        self._known, self._codes = known, np.zeros(1024, np.int32)
        self._new: list[int] = []
        self._ids, self._filled = np.zeros(1024, np.uint64), 1

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        # 0 stands for no word
        self._new.append(xxhash.xxh3_64_intdigest(word) or 1)
        return n

    def hashes(self) -> np.ndarray:
        """Each number's 64-bit id."""
        end = self._filled + len(self._new)
        if end > len(self._ids):
            self._ids = np.concatenate((self._ids, np.zeros(2 * end, np.uint64)))
            self._codes = np.concatenate((self._codes, np.zeros(2 * end, np.int32)))
        new = np.array(self._new, np.uint64)
        if self._known is not None:
            codes = self._known.codes(new)
            if self._known.whole:
                new[codes < 0] = 0
            self._codes[self._filled : end] = codes
        self._ids[self._filled : end] = new
        self._new, self._filled = [], end
        return self._ids[:end]

    def codes(self) -> np.ndarray:
        """Each number's code, after hashes()."""
        return self._codes[: self._filled]

    def numbers(self, text: str | None) -> np.ndarray:
        """The words' numbers in order, with 0 at each end of a piece and at the text's end."""
        tokens = (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).replace(b".", b" . ").split()
        return np.fromiter(map(self.__getitem__, [*tokens, b"."]), np.int64, len(tokens) + 1)


def _numbers_by_lang(batch: pa.RecordBatch, dictionary: Dictionary) -> Iterator[tuple[str, np.ndarray]]:
    """The numbers of several texts of a language at once; a text's end ends a piece."""
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        numbers = dictionary.numbers(text.as_py())
        held.setdefault(lang, []).append(numbers)
        sizes[lang] = sizes.get(lang, 0) + len(numbers)
        if sizes[lang] > BUFFER:
            yield lang, np.concatenate(held.pop(lang))
            sizes[lang] = 0
    for lang, parts in held.items():
        yield lang, np.concatenate(parts)


def pair_slots(ids: np.ndarray, lang: int, slots: int = SLOTS) -> np.ndarray:
    """The slot of each word with the next one; `slots` where a piece ends between or before them."""
    a, b = ids[:-1], ids[1:]
    with np.errstate(over="ignore"):
        h = (a ^ np.uint64(lang)) * _P
        h = ((h ^ (h >> np.uint64(29))) + b) * _Q
        h ^= h >> np.uint64(31)
    return np.where((a > 0) & (b > 0), (h & np.uint64(slots - 1)).astype(np.int64), slots)


def triple_slots(ids: np.ndarray, lang: int, pairs: "Bits") -> np.ndarray:
    """The slot of each word with the next two, of as many slots as pairs have; their number unless both pairs pass."""
    goes = pairs[pair_slots(ids, lang, pairs.slots)]
    with np.errstate(over="ignore"):
        h = (ids[:-2] ^ np.uint64(lang)) * _Q
        h = ((h ^ (h >> np.uint64(30))) + ids[1:-1]) * _P
        h = ((h ^ (h >> np.uint64(28))) + ids[2:]) * _Q
        h ^= h >> np.uint64(31)
    return np.where(goes[:-1] & goes[1:], (h & np.uint64(pairs.slots - 1)).astype(np.int64), pairs.slots)


def _lang_id(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang)


def _counted(slots: np.ndarray, place: np.ndarray) -> None:
    """Adds the places to slots, the last of which is for what has none; a slot counts up to 255."""
    place, n = np.unique(place, return_counts=True)
    slots[place] = np.minimum(slots[place] + n, 255)


def _counter(n_slots: int = SLOTS):
    """From (lang, text): rows of kind 0 with a word's count, of kind 1 with a lang's words, of kind 2 with a block of slot counts; sums are taken in Spark."""

    def words_of(counts: dict, dictionary: Dictionary) -> pa.RecordBatch:
        names, langs, places, totals = list(dictionary), [], [], []
        for lang, n in counts.items():
            used = np.flatnonzero(n)
            used = used[used > 0]
            langs += [lang] * len(used)
            places.append(used)
            totals.append(n[used])
        places = np.concatenate([*places, np.empty(0, np.int64)])
        words = pa.array([names[i] for i in places], pa.binary()).cast(pa.string())
        return _rows(0, langs, np.zeros(len(places), np.int64), words, np.concatenate([*totals, np.empty(0, np.int64)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, counts, totals = Dictionary(), {}, {}
        slots = np.zeros(n_slots + 1, np.uint8)
        for batch in batches:
            for lang, numbers in _numbers_by_lang(batch, dictionary):
                totals[lang] = totals.get(lang, 0) + int(np.count_nonzero(numbers))
                seen = np.bincount(numbers)
                held = counts.get(lang, np.empty(0, np.int64))
                if len(held) < len(seen):
                    held = counts[lang] = np.concatenate((held, np.zeros(2 * len(seen) - len(held), np.int64)))
                held[: len(seen)] += seen
                _counted(slots, pair_slots(dictionary.hashes()[numbers], _lang_id(lang), n_slots))
            if len(dictionary) > DICTIONARY:
                yield words_of(counts, dictionary)
                dictionary, counts = Dictionary(), {}
        yield words_of(counts, dictionary)
        yield _rows(1, list(totals), np.zeros(len(totals), np.int64), pa.nulls(len(totals), pa.string()), np.array(list(totals.values()), np.int64))
        yield _blocks(slots)

    return run


def _blocks(slots: np.ndarray) -> pa.RecordBatch:
    blocks = slots[:-1].reshape(-1, SLOT_BLOCK)
    used = np.flatnonzero(blocks.any(axis=1))
    return _rows(2, [None] * len(used), used, pa.nulls(len(used), pa.string()), np.zeros(len(used), np.int64), [blocks[i].tobytes() for i in used])


class Bits:
    """What passes, by slot, of one bit for each; the slot after the last never does."""

    def __init__(self, passing: np.ndarray):
        self.slots, self._bytes = 8 * len(passing), np.append(passing, np.uint8(0))

    def __getitem__(self, slot: np.ndarray) -> np.ndarray:
        return (self._bytes[slot >> 3] << (slot & 7).astype(np.uint8) & 128) > 0


def _triples(texts: DataFrame, pairs, known=None) -> DataFrame:
    """Rows of kind 2: blocks of the slot counts of triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = known and known.value, Bits(pairs.value)
        dictionary, slots = Dictionary(words), np.zeros(bits.slots + 1, np.uint8)
        for batch in batches:
            for lang, numbers in _numbers_by_lang(batch, dictionary):
                _counted(slots, triple_slots(dictionary.hashes()[numbers], _lang_id(lang), bits))
            if len(dictionary) > DICTIONARY:
                dictionary = Dictionary(words)
        yield _blocks(slots)

    return texts.mapInArrow(run, _COUNTED)


def _rows(kind: int, langs: list, ids: np.ndarray, words: pa.Array, n: np.ndarray, slots: list | None = None) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(langs), kind, np.int32)), pa.array(langs, pa.string()), pa.array(ids.astype(np.int64)), words, pa.array(n.astype(np.int64)), pa.array(slots, pa.binary()) if slots is not None else pa.nulls(len(langs), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "lang", "id", "word", "n", "slots"])


def _passing(slots: DataFrame, least: int, n_slots: int) -> np.ndarray:
    """One bit a slot: whether it was counted `least` times (255 if that is more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                total = sums.setdefault(block, np.zeros(SLOT_BLOCK, np.uint32))
                np.minimum(total + np.frombuffer(n.as_py(), np.uint8), 255, out=total)
        bits = [np.packbits(n >= min(least, 255)).tobytes() for n in sums.values()]
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int64()), "bits": pa.array(bits, pa.binary())})

    out = np.zeros((n_slots // SLOT_BLOCK, SLOT_BLOCK // 8), np.uint8)
    for row in slots.select("id", "slots").repartition("id").mapInArrow(run, "block long, bits binary").collect():
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def _with_ids(words: DataFrame) -> DataFrame:
    """(lang, id, word, n) of (lang, word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) or 1 for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(np.array(ids, np.uint64).view(np.int64)), batch.column("word"), batch.column("n")], names=["lang", "id", "word", "n"])

    return words.mapInArrow(run, "lang string, id long, word string, n long")


def _known(words: DataFrame) -> Known:
    """The KNOWN most frequent of the frequent words, which go to the driver by their ids."""
    ranked = words.groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(KNOWN + 1).select("id").toArrow()
    ids = ranked.column("id").to_numpy().view(np.uint64)
    return Known(ids[:KNOWN], len(ids) <= KNOWN)


#: n rows of a language in a bucket: LONGEST columns of codes (see Known) and one of weights, each of which has its lowest bytes first, then the next ones; more has
#: the ids of words without a code of their own. Rows are in order, so leading columns and high bytes take next to nothing once compressed.
_BLOCK = "bucket long, lang string, n long, rows binary, more array<long>"


def _hashed(lang: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the language's number and the first `depth` words of each row."""
    with np.errstate(over="ignore"):
        h = lang.astype(np.uint64) * _Q
        for k in range(depth):
            h = (h ^ words[:, k]) * _P
            h ^= h >> np.uint64(29)
    return h


def _blocks_of(lang: np.ndarray, words: np.ndarray, weight: np.ndarray, names: list[str], depth: int, buckets: int, known: Known, codes: np.ndarray) -> pa.RecordBatch:
    """The rows in blocks, one for each language and bucket; buckets go by the first `depth` words, so equal leading words meet in one, whatever task they come from."""
    ids = np.array([_lang_id(x) for x in names], np.uint64)
    bucket = (_hashed(ids[lang], words, depth) >> np.uint64(24)) % np.uint64(buckets)
    places = bucket * np.uint64(len(names)) + lang.astype(np.uint64)
    order = np.lexsort((*words.T[2::-1], places))
    lang, words, weight, places, codes = lang[order], words[order], weight[order], places[order], codes[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(lang), 1), bool), places[1:] != places[:-1])))
    ends = np.append(first[1:], len(lang))[: len(first)]
    codes, more = known.coded(words, codes, ends)
    table = np.column_stack([codes, weight.astype(np.uint32)])
    rows = [np.ascontiguousarray(table[start:end].T).view(np.uint8).reshape(LONGEST + 1, -1, 4).transpose(0, 2, 1).tobytes() for start, end in zip(first, ends)]
    listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, more)]), pa.int32()), pa.array(np.concatenate([*more, np.empty(0, np.uint64)]).view(np.int64)))
    bucket = (places[first] // np.uint64(max(len(names), 1))).astype(np.int64)
    columns = [pa.array(bucket), pa.array([names[i] for i in lang[first]], pa.string()), pa.array((ends - first).astype(np.int64)), pa.array(rows, pa.binary()), listed]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "lang", "n", "rows", "more"])


def _unblocked(batch: pa.RecordBatch, langs: dict[str, int], known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows (language's number, words, weight) of blocks; langs gets the numbers."""
    code = np.array([langs.setdefault(x, len(langs)) for x in batch.column("lang").to_pylist()], np.int64)
    n = batch.column("n").to_numpy()
    parts = [np.frombuffer(x.as_buffer(), np.uint8).reshape(LONGEST + 1, 4, -1).transpose(2, 0, 1) for x in batch.column("rows")]
    table = np.ascontiguousarray(np.concatenate([*parts, np.empty((0, LONGEST + 1, 4), np.uint8)])).view(np.uint32)[:, :, 0]
    more = batch.column("more")
    sizes = more.value_lengths().to_numpy()
    words = known.ids(table[:, :LONGEST], more.flatten().to_numpy().view(np.uint64), np.repeat(np.cumsum(sizes) - sizes, n))
    return np.repeat(code, n), words, table[:, LONGEST].astype(np.int64)


def _suffixes(texts: DataFrame, pairs, triples, buckets: int, known=None) -> DataFrame:
    """Blocks of suffixes (w1..w5, 0 for no word) with their number: those that start with two words of a passing slot, cut to LONGEST words, to their piece and to
    where triples pass. A task sums equal ones, and sends what goes to a bucket as one block. known: a broadcast Known, or none has a code."""

    def combined(parts: list) -> pa.RecordBatch:
        names = sorted({lang for lang, *_ in parts})
        lang = np.concatenate([np.full(len(w), names.index(x), np.int64) for x, w, _ in parts])
        words, codes = (np.concatenate(x) for x in list(zip(*parts))[1:])
        order = np.argsort(_hashed(lang, words, LONGEST), kind="stable")
        lang, words, codes = lang[order], words[order], codes[order]
        # rows that differ in spite of equal hashes only stay apart
        first = np.flatnonzero(np.concatenate(([True], (lang[1:] != lang[:-1]) | (words[1:] != words[:-1]).any(axis=1))))
        return _blocks_of(lang[first], words[first], np.diff(np.append(first, len(lang))), names, 2, buckets, _codes_of(known), codes[first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = known and known.value
        dictionary, parts, size = Dictionary(words_of), [], 0
        of_pairs, of_triples = Bits(pairs.value), Bits(triples.value)
        for batch in batches:
            for lang, numbers in _numbers_by_lang(batch, dictionary):
                ids = dictionary.hashes()[numbers]
                codes_of = dictionary.codes()[numbers] if known is not None else np.where(ids > 0, -1, 0).astype(np.int32)
                goes = np.append(of_triples[triple_slots(ids, _lang_id(lang), of_pairs)], np.zeros(LONGEST, bool))
                at = np.flatnonzero(of_pairs[pair_slots(ids, _lang_id(lang), of_pairs.slots)])
                if len(at):
                    words = np.zeros((len(at), LONGEST), np.uint64)
                    codes = np.zeros((len(at), LONGEST), np.int32)
                    for k in range(2):
                        words[:, k], codes[:, k] = ids[at + k], codes_of[at + k]
                    on = np.ones(len(at), bool)
                    for k in range(2, LONGEST):
                        on &= goes[at + k - 2]
                        words[on, k], codes[on, k] = ids[at[on] + k], codes_of[at[on] + k]
                    parts.append((lang, words, codes))
                    size += len(at)
                if size > BUFFER:
                    yield combined(parts)
                    parts, size = [], 0
            if len(dictionary) > DICTIONARY:
                dictionary = Dictionary(words_of)
        if parts:
            yield combined(parts)

    return texts.mapInArrow(run, _BLOCK)


def counted_prefixes(words: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of pointers to the rows of `words` (0 ends a row): (row, depth, count) of every prefix of `depth` columns whose rows weigh
    `least` or more. Each step splits pointers at one column into smaller, equal and larger; the equal part's weight is that prefix's count, and it goes on
    at the next column. Parts that weigh less than `least` are abandoned, so the steps are about as many as the prefixes found."""
    columns = [np.ascontiguousarray(words[:, k]) for k in range(words.shape[1])]
    stack = [(np.arange(len(words)), 0)]
    while stack:
        rows, depth = stack.pop()
        keys = columns[depth][rows]
        some = np.sort(keys[:: max(1, len(keys) // 31)])
        pivot = some[len(some) // 2]
        equal = keys == pivot
        same = rows[equal]
        if pivot != 0 and (n := int(weight[same].sum())) >= least:
            yield int(same[0]), depth + 1, n
            if depth + 1 < len(columns):
                stack.append((same, depth + 1))
        if len(same) < len(rows):
            less = keys < pivot
            for part in (rows[less], rows[~(less | equal)]):
                if len(part) and int(weight[part].sum()) >= least:
                    stack.append((part, depth))


_PHRASE = "lang string, words array<long>, n long"


def _phrases_of(found: list[tuple[str, list[int], int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.array([x[0] for x in found], pa.string()), "words": pa.array([x[1] for x in found], pa.list_(pa.int64())), "n": pa.array([x[2] for x in found], pa.int64())})


def _codes_of(known) -> Known:
    """Of a broadcast Known or none."""
    return known.value if known is not None else Known(np.empty(0, np.uint64), False)


def _sharded(blocks: DataFrame, depth: int, least: int, known=None) -> DataFrame:
    """(lang, words, n) of the phrases of `depth` words or more; blocks are those of all tasks, so a bucket has all suffixes with its leading words. A task sorts bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, codes = {}, _codes_of(known)

        def counted(parts: list[tuple]) -> pa.RecordBatch:
            code, words, weight = (np.concatenate(x) for x in zip(*parts))
            names = list(langs)
            table = np.column_stack([code.astype(np.uint64) + np.uint64(1), words])
            return _phrases_of([(names[code[row]], words[row, : size - 1].view(np.int64).tolist(), n) for row, size, n in counted_prefixes(table, weight, least) if size > depth])

        parts, last = [], None
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            borders = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            for start, end in zip([0, *borders], [*borders, len(bucket)]):
                if start == end:
                    continue
                if parts and bucket[start] != last:
                    yield counted(parts)
                    parts = []
                last = bucket[start]
                parts.append(_unblocked(batch.slice(start, end - start), langs, codes))
        if parts:
            yield counted(parts)

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _PHRASE)


def _heads(blocks: DataFrame, depth: int, least: int, known=None) -> DataFrame:
    """(lang, words, n) of the phrases of just `depth` words: tasks sum their own, Spark the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, codes = {}, _codes_of(known)
        for batch in batches:
            code, words, weight = _unblocked(batch, langs, codes)
            if len(code):
                names = list(langs)
                table = np.column_stack([code.astype(np.uint64) + np.uint64(1), words[:, :depth]])
                yield _phrases_of([(names[code[row]], words[row, :depth].view(np.int64).tolist(), n) for row, size, n in counted_prefixes(table, weight, 1) if size == depth + 1])

    return blocks.mapInArrow(run, _PHRASE).groupBy("lang", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _routed_on(blocks: DataFrame, depth: int, buckets: int, known=None) -> DataFrame:
    """The blocks dealt anew by `depth` leading words; shorter suffixes have no further phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, codes = {}, _codes_of(known)
        for batch in batches:
            code, words, weight = _unblocked(batch, langs, codes)
            long = words[:, depth - 1] != 0
            yield _blocks_of(code[long], words[long], weight[long], list(langs), depth, buckets, codes, codes.codes(words[long]))

    return blocks.mapInArrow(run, _BLOCK)


def frequent_phrases(blocks: DataFrame, least: int, buckets: int, lane_rows: int | None = None, known=None) -> DataFrame:
    """(lang, words, n) of all phrases of 2 to LONGEST words that occur `least` times; words are ids.

    A bucket has the suffixes of its leading pairs from all tasks, which the shards sort. Where a bucket has more than lane_rows (LANE_ROWS) rows, its phrases of two words are
    summed by Spark, its suffixes are dealt to other buckets by three leading words, and so on; so no task gets much more than lane_rows rows, whatever a pair's share.
    """
    lane_rows = LANE_ROWS if lane_rows is None else lane_rows
    found = []
    for depth in range(2, LONGEST + 1):
        if depth == LONGEST:
            # all that is left is of one phrase
            found.append(_heads(blocks, depth, least, known))
            break
        sizes = written(blocks.groupBy("bucket").agg(F.sum("n").alias("n_rows")).where(F.col("n_rows") > lane_rows).select("bucket"), "hot-buckets")
        if sizes.isEmpty():
            found.append(_sharded(blocks, depth, least, known))
            break
        # 8 bytes for each hot bucket are broadcast, so blocks are read where they are, not written anew
        found.append(_sharded(blocks.join(F.broadcast(sizes), "bucket", "left_anti").select(*blocks.columns), depth, least, known))
        hot = blocks.join(F.broadcast(sizes), "bucket", "left_semi").select(*blocks.columns)
        found.append(_heads(hot, depth, least, known))
        blocks = written(_routed_on(hot, depth + 1, buckets, known), "routed-suffixes")
    return reduce(DataFrame.unionByName, found)


def collocations(docs: DataFrame, least: int = 100, percent: int = 100, most: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language (null: und) its `most` phrases of the highest score.

    Texts are lower-cased (A-Z), cut into pieces at [.,;:!?\\x0A-\\x0D] and into words at spaces and tabs; null texts are empty. Phrases are 2 to 5 words of one piece
    that occur `least` times, overlaps included. Cut after k words, a phrase of count a with parts of counts l and r scores floor(1000 a n / (l r)), n being all
    words of the language; the cut of the lowest score counts, the smallest k at ties. A phrase goes if a longer one that has it occurs in percent of its
    occurrences or more. Order: score and a descending, then the phrase's bytes. Repeated rows count each time; a text is held by one task, whatever its length.

    Words are 64-bit hashes until the end; sums are exact (decimals of 38 digits). A language of empty texts, and an empty table, give no rows.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    chars = int(texts.agg(F.sum(F.length("text"))).first()[0] or 0)
    slots = min(MOST_SLOTS, max(SLOTS, 1 << int(chars // SLOT_CHARS).bit_length()))
    counted = written(texts.mapInArrow(_counter(slots), _COUNTED), "words", ("kind",))
    words = counted.where("kind = 0").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = written(_with_ids(words), "frequent-words")
    totals = counted.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    sent = docs.sparkSession.sparkContext.broadcast
    known = sent(_known(words))
    pairs = sent(_passing(counted.where("kind = 2"), least, slots))
    triples = sent(_passing(_triples(texts, pairs, known), least, slots))
    buckets = max(BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // (3 * LANE_ROWS))
    suffixes = written(_suffixes(texts, pairs, triples, buckets, known), "suffixes")
    phrases = written(frequent_phrases(suffixes, least, buckets, known=known), "phrases")

    parts = phrases.unionByName(words.select("lang", F.array("id").alias("words"), "n"))
    size = F.size("words")
    cuts = phrases.withColumnRenamed("n", "a").withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"head": F.slice("words", 1, F.col("k")), "tail": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(parts.select("lang", F.col("words").alias(side), F.col("n").alias(name)), ["lang", side])
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.join(totals, "lang").withColumns({"over": (exact("a") * 1000).cast("decimal(20,0)") * exact("total"), "under": exact("l") * exact("r")})
    best = cuts.groupBy("lang", "words").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("best"), F.first("a").alias("a"), F.first("total").alias("n"))
    longer = phrases.where(size > 2).select("lang", F.explode(F.array(F.slice("words", 1, size - 1), F.slice("words", 2, size - 1))).alias("words"), F.col("n").alias("longer"))
    longer = longer.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    kept = best.join(longer, ["lang", "words"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * percent, F.lit(True)))
    spelled = kept.select("lang", "words", F.posexplode("words").alias("k", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    spelled = spelled.groupBy("lang", "words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    scored = kept.join(spelled, ["lang", "words"]).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
