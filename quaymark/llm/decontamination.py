"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, and one scan of every text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Consecutive words of an item that make a window.
WINDOW_WORDS = 10
#: An automaton of so many windows at most is broadcast; a larger benchmark is scanned by several automata, one after the other.
MAX_WINDOWS = 2_000_000
#: Bytes that end a word become spaces, A-Z become a-z; every byte keeps its place.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
HIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("item", T.StringType())])
RESULT = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(HIT))]
)


def words(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters of the text with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """All windows of the items, over word numbers: a word that no item has is 0, so a text is scanned by one dictionary look-up and one step a word."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW_WORDS):
        self.ids: dict[bytes, int] = {}
        self.items: list[str] = []
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            numbers = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words(text))
            if numbers:
                self.items.append(item)
                for i in range(max(len(numbers) - window, 0) + 1):
                    owners.setdefault(numbers[i : i + window], set()).add(len(self.items) - 1)
        for key, who in owners.items():
            self.tree.add_word(key, (len(key), tuple(sorted(who))))
        if owners:
            self.tree.make_automaton()
        self.empty = not owners

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int]]]:
        """The number of words and the hits (first word, word after the last, number of the item), in order of their end."""
        found = words(text)
        if self.empty or not found:
            return len(found), []
        get = self.ids.get
        numbers = tuple([get(w, 0) for w in found])
        if not any(numbers):
            return len(found), []
        return len(found), [(end + 1 - size, end + 1, i) for end, (size, who) in self.tree.iter(numbers) for i in who]


def covered(ranges: list[tuple[int, int]]) -> int:
    total = last = 0
    for start, end in sorted(ranges):
        if end > last:
            total += end - max(start, last)
            last = end
    return total


def spans(text: str, hits: list[tuple[int, int, int]], items: list[str]) -> list[dict]:
    """Character offsets in the text itself of each item's hits; hits of one item that touch or overlap are one span."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(data.translate(_FOLD))]
    merged: dict[int, list[list[int]]] = {}
    for start, end, item in sorted(hits):
        runs = merged.setdefault(item, [])
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    chars = [0, *np.cumsum(begins).tolist()]  # of each byte offset
    return [{"start": chars[places[a][0]], "end": chars[places[b - 1][1]], "item": items[i]} for i, runs in merged.items() for a, b in runs]


def _automata(items: DataFrame, item: str, text: str, window: int, most: int) -> Iterator[tuple[Automaton, bool]]:
    """One automaton after the other, and whether it is the last. The items are read in bounded parts: each part has about so many words, hence windows."""
    rows = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    size = F.size(F.split(F.col("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = rows.agg(F.sum(F.coalesce(size, F.lit(0)).cast("long"))).first()[0] or 0
    parts = int(-(-total // most)) or 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    for k in range(parts):
        yield Automaton([tuple(r) for r in rows.where(part == k).collect()], window), k == parts - 1


def find_contamination(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The columns keep of every row and n_words, n_hit, items, spans.

    A window is `window` consecutive words of an item, or the whole of a shorter item that has any. n_hit counts the words of the text that lie inside an
    occurrence of any window, items are the ids of the items with such windows, sorted as strings, and spans their places as character offsets in the text as
    it is. Null and empty texts have no words. Null or wordless items have no window, items of the same text are each named, an empty benchmark hits nothing.
    Columns among keep that have a result's name are replaced; repeated rows are rows. A benchmark of more than max_windows words is scanned by one automaton
    after the other, and only one is in memory at a time: what they find is written in between.
    """
    keep = [c for c in keep if c not in RESULT.names]
    held = F.struct(*keep) if keep else F.struct(F.lit(1).alias("none"))
    out = docs.select(held.alias("_row"), F.col(text).alias("_text"))
    ranges = T.StructField("_ranges", T.ArrayType(T.ArrayType(T.LongType())))
    first = True
    for automaton, last in _automata(items, item_id, item_text, window, max_windows):
        fields = [out.schema["_row"], *RESULT] if last else [out.schema["_row"], out.schema["_text"], *RESULT, ranges]
        shared = docs.sparkSession.sparkContext.broadcast(automaton)
        out = out.mapInArrow(_scanner(shared, first, last), T.StructType(fields))
        if not last:
            out, first = written(out, "scanned"), False
            shared.unpersist()
    return out.select(*([F.col("_row")[c].alias(c) for c in keep]), *[f.name for f in RESULT])


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item", pa.string())])
_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(_SPAN), pa.list_(pa.list_(pa.int64()))]


def _scanner(shared, first: bool, last: bool):
    """One automaton's scan of _row, _text and, after the first, what the automata before have found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                n, hits = automaton.scan(text)
                ids = {automaton.items[k] for _, _, k in hits}
                ranges = [(a, b) for a, b, _ in hits]
                places = spans(text, hits, automaton.items) if hits else []
                if not first:
                    ids |= set(batch.column(4)[i].as_py())
                    places = batch.column(5)[i].as_py() + places
                    ranges += map(tuple, batch.column(6)[i].as_py())
                places.sort(key=lambda p: (p["start"], p["end"], p["item"]))
                out.append((n, covered(ranges), sorted(ids), places, ranges))
            columns = list(zip(*out)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns[: 4 if last else 5], _TYPES)]
            names = [f.name for f in RESULT]
            if last:
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["_row", *names])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["_row", "_text", *names, "_ranges"])

    return scan


def items_digest(items):
    """sha256 in lower-case hex of the ids, comma-joined."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
