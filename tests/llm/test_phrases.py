import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa

from quaymark.llm import phrases

SCHEMA = "doc_id long, text string, lang string, rank int, n string"


def plain(rows, least, percent=100, most=2000):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        found = [(p, a) for p, a in f.items() if a >= least and len(p) > 1]
        scored = []
        for p, a in found:
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found):
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), p, k))
        for rank, (s, a, _, p, k) in enumerate(sorted(scored)[:most], 1):
            out.add((lang, rank, " ".join(p), -a, f[p[:k]], f[p[k:]], total[lang], -s))
    return out


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["of", "The", "été", "a", "b", "c", "x\x00y", "日本", "New", "York", "w" * 70]
    joins = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "! "]
    rows = [(i, "".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"]), 7, "x") for i in range(n)]
    return rows + [(None, None, "en", None, None), (1, "", None, 1, ""), (1, " \t.,", "fr", 1, "")] + rows[:20]


def collected(df):
    return {tuple(r) for r in df.collect()}


def test_equals_plain_counts(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, SCHEMA)
    for least, percent, most in ((20, 100, 2000), (8, 100, 30), (12, 80, 2000)):
        expected = plain(rows, least, percent, most)
        assert expected and collected(phrases.collocations(df, least, percent, most)) == expected


def test_a_passage_in_a_third_of_all_rows_and_a_very_long_text(spark):
    rng = random.Random(2)
    passage = "in the name of the law we ask you all"
    rows = [(i, passage + ". " + " ".join(rng.choices("abcdefgh", k=12)), "en", 0, "") for i in range(150)]
    rows += [(1000, " ".join(rng.choices("abcdefgh", k=30_000)), "en", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert collected(phrases.collocations(df)) == plain(rows, 100)


def test_hot_leading_words_are_routed_by_more_words(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(r[2] or "und", r[1]) for r in rows], "lang string, text string")
    bits = spark.sparkContext.broadcast(np.full(phrases.SLOTS // 8, 255, np.uint8))
    blocks = phrases._suffixes(df, bits, bits, 7).cache()
    rows_of = lambda x: sorted((r.lang, tuple(r.words), r.n) for r in x.collect())
    expected = rows_of(phrases.frequent_phrases(blocks, 10, 7))
    assert len(expected) > 100 and len({x[:2] for x in expected}) == len(expected)
    for lane in (0, 30, 400):
        assert rows_of(phrases.frequent_phrases(blocks, 10, 7, lane)) == expected
    blocks.unpersist()


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 4, (3000, 4)).astype(np.uint64)
    words[:, 0] += 1
    for k in range(1, 4):
        words[words[:, k - 1] == 0, k] = 0
    weight = rng.integers(1, 4, 3000)
    expected = Counter()
    for row, n in zip(words.tolist(), weight.tolist()):
        for k in range(1, 5):
            if row[k - 1]:
                expected[tuple(row[:k])] += n
    for least in (1, 30, 10**6):
        found = [(tuple(words[row, :k].tolist()), n) for row, k, n in phrases.counted_prefixes(words, weight, least)]
        assert sorted(found) == sorted((p, n) for p, n in expected.items() if n >= least)


def test_dictionaries_are_sent_on(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en"], "text": ["a b c a b", "a b", None]})

    def words():
        sums = Counter()
        for out in phrases._counter()(iter([batch, batch])):
            for row in out.to_pylist():
                sums[row["kind"], row["lang"], row["id"], row["word"]] += row["n"]
        return sums

    expected = words()
    assert sorted(n for (kind, *_), n in expected.items() if kind == 0) == [2, 2, 2, 4, 4]
    monkeypatch.setattr(phrases, "DICTIONARY", 1)
    assert words() == expected
    monkeypatch.setattr(phrases, "BUFFER", 1)
    assert words() == expected


def test_empty_tables(spark):
    assert not phrases.collocations(spark.createDataFrame([], SCHEMA)).collect()
    assert not phrases.collocations(spark.createDataFrame([(1, None, None, 1, "")], SCHEMA)).collect()


def test_suffixes_take_few_bytes_where_nearly_all_pass(spark, monkeypatch):
    """In a large corpus nearly all pairs and triples pass, so what is sent of a suffix must be less than the text it is of, and is not written again for hot buckets."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(3000)]
    chosen = np.minimum(rng.zipf(1.2, (300, 400)) - 1, 2999)
    rows = [(i, " ".join(words[k] for k in row), "en", 0, "") for i, row in enumerate(chosen.tolist())]
    sizes, write = {}, phrases.written

    def measured(df, name, *more):
        out = write(df, name, *more)
        path = spark._quaymark_written[-1].removeprefix("file://")
        sizes[name] = (sum(p.stat().st_size for p in Path(path).rglob("*.parquet")), out.agg({"n": "sum"}).first()[0] if "n" in out.columns else 0)
        return out

    monkeypatch.setattr(phrases, "written", measured)
    monkeypatch.setattr(phrases, "LANE_ROWS", 500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(1)
    assert phrases.collocations(df, 2).count() == 2000
    n_bytes, n_suffixes = sizes["suffixes"]
    assert n_suffixes > 30_000 and n_bytes < 12 * n_suffixes
    assert "routed-suffixes" in sizes and "hot-suffixes" not in sizes


def test_words_without_codes_and_slots_by_the_text(spark, monkeypatch):
    """Words beyond the numbered ones go by their ids; with more slots for the text the same phrases are found."""
    rows = corpus(5)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    expected = plain(rows, 12)
    counted, counter = [], phrases._counter
    monkeypatch.setattr(phrases, "_counter", lambda n: counted.append(n) or counter(n))
    monkeypatch.setattr(phrases, "MOST_SLOTS", 2 * phrases.SLOTS)
    for known, chars in ((0, 128), (3, 128), (1 << 19, 0.001)):
        monkeypatch.setattr(phrases, "KNOWN", known)
        monkeypatch.setattr(phrases, "SLOT_CHARS", chars)
        assert collected(phrases.collocations(df, 12)) == expected
    assert counted[0] == counted[1] == phrases.SLOTS < counted[2] == phrases.MOST_SLOTS
