import hashlib
import random
from collections import defaultdict

import pytest

from quaymark.llm import queries, suffix_dedup
from quaymark.llm.common import table


def plain(texts, length):
    """Every window in one dictionary."""
    starts = defaultdict(int)
    datas = [(t or "").encode() for t in texts]
    for d in datas:
        for i in range(len(d) - length + 1):
            starts[d[i : i + length]] += 1
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if starts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, x in zip(d, gone) if not x)
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string, ranges string")
    return {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(df, **options).collect()}


def test_equals_all_windows(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    passage = [" ".join(rng.choices(words, k=60)) for _ in range(6)]
    texts = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passage)
            if rng.random() < 0.5:
                a = rng.randint(0, len(p) // 2)
                p = p[a : a + rng.randint(10, len(p))]
            parts += [p, " ".join(rng.choices(words, k=rng.randint(0, 60)))]
        texts.append(rng.choice(["", " "]).join(parts))
    texts += [texts[3]] * 3 + [None, "", "ab" * 400, "x" * 199, "y" * 200, "y" * 201, "é" * 100, passage[0], passage[0] * 3]
    rows = [(i, t, "e", "r") for i, t in enumerate(texts)]
    for options in ({}, {"length": 60, "gram": 20}):
        assert run(spark, rows, **options) == dict(enumerate(plain(texts, options.get("length", 200))))


def test_large_groups_are_counted_by_spark(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    rng = random.Random(6)
    middle = "".join(rng.choices("abcdefgh", k=150))
    texts = ["".join(rng.choices("pq", k=rng.randint(20, 80))) + "0123456789" * 4 + middle + "".join(rng.choices("rs", k=60)) for _ in range(40)]
    texts += [t[10:] for t in texts[:10]] + [texts[0]] * 5
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    # workers import the module anew, so the limit goes with the function that is sent
    found = list(suffix_dedup._merge_bucket([[c for c in suffix_dedup.front_coded(sorted((middle.encode() + t.encode()[-60:], t.encode()[:50], 1) for t in texts[:20]))]], 200, 50))
    assert any(h for _, _, h in found)
    assert run(spark, rows) == dict(enumerate(plain(texts, 200)))


def around(rng, passage, n, side):
    """n texts with the passage in unlike surroundings, and some whose surroundings are equal for a while before clean bytes follow."""
    some = lambda k: "".join(rng.choices("abcdefghijklmnop", k=k))
    texts = [some(side) + passage + some(side) for _ in range(n)]
    texts += [x + some(250) for x in texts[:3]]
    texts += [texts[4][-side - len(passage) :] + some(200), some(90) + texts[5][: side + len(passage)]]
    return texts


def test_groups_beyond_the_limit(spark):
    """A passage in more documents than GROUP: a context that occurs twice must not mark strings behind it."""
    rng = random.Random(8)
    texts = around(rng, "".join(rng.choices("ABCDEFGHIJ", k=150)), suffix_dedup.GROUP + 100, 90)
    assert run(spark, [(i, t, None, None) for i, t in enumerate(texts)]) == dict(enumerate(plain(texts, 200)))


def test_small_and_large_groups_give_the_same(spark):
    rng = random.Random(9)
    passages = ["".join(rng.choices("ABCDEFGHIJ", k=k)) for k in (120, 200, 330)]
    texts = [t for p in passages for t in around(rng, p, 25, 110)] + [passages[2]] * 2 + [passages[2] * 2]
    expected = dict(enumerate(plain(texts, 200)))
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    for group in (3, 20, 1 << 40):
        assert run(spark, rows, group=group) == expected


def test_a_context_in_many_runs_is_one():
    text = ("".join(random.Random(10).choices("ab", k=200)).encode(), b"left", 1)
    runs = [list(suffix_dedup.front_coded([text])) for _ in range(8)]
    assert [(r, h) for _, r, h in suffix_dedup._merge_bucket(runs, 200, 50, 5)] == [([0, 4], None)]


def test_loser_tree_keeps_order_and_prefixes():
    rng = random.Random(7)
    words = ["".join(rng.choices("ab", k=rng.randint(0, 12))).encode() for _ in range(500)]
    runs = []
    for k in range(7):
        part = sorted((w, b"", 1) for w in words[k::7])
        runs.append(suffix_dedup.decoded(list(suffix_dedup.front_coded(part))))
    out = list(suffix_dedup.LoserTree(runs))
    assert [s for _, s, _ in out] == sorted(words)
    for (_, a, _), (known, b, _) in zip(out, out[1:]):
        assert known == suffix_dedup.common_prefix(a, b, 0)


def test_empty_and_repeated_rows(spark):
    assert run(spark, []) == {}
    text = "z%s" % ("qwertyuiop" * 30)
    df = spark.createDataFrame([(1, text), (1, text), (None, "abc"), (2, None)], "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(df).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in rows) == [(-1, 3, 0), (1, 301, 301), (1, 301, 301), (2, 0, 0)]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_registered_query(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = {r.doc_id: tuple(r)[1:] for r in queries.op8_suffix_dedup(spark, sf_dir).collect()}
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert rows == dict(zip([d.doc_id for d in docs], plain([d.text for d in docs], 200)))
