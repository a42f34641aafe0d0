import random
from itertools import combinations

import numpy as np
from test_minhash import shingles, varied

from quaymark.llm import jaccard_join as jj

SCHEMA = "doc_id long, text string, node int, n_shingles string"


def plain(docs, k=4, percent=85):
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(docs)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            parent[root(b)] = root(a)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(docs)), key=str)


def ours(spark, docs, k=4, percent=85):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], SCHEMA)
    return sorted((tuple(r) for r in jj.linked_components(df, k, percent).collect()), key=str)


def grown(rng, words, base):
    """Edits by replacing, cutting and adding, so that sizes differ."""
    out = varied(rng, words, base, rng.randint(0, 3))
    cut = rng.randint(0, max(1, len(out) // 10))
    return out[cut:] + rng.choices(words, k=rng.randint(0, max(1, len(out) // 10)))


def test_equals_all_pairs(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 5))) for _ in range(400)]
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=int(10 ** rng.uniform(0.7, 2.3)))
        texts += [" ".join(grown(rng, words, base)) for _ in range(rng.randint(1, 5))]
    texts += ["", None, " \n", "One", "one", "a b", "A  B", "a b c", "x\x0by z w", "x y z w", "x y z w", " ".join(words) * 30, " ".join(words) * 30 + " end"]
    rng.shuffle(texts)
    docs = list(enumerate(texts, 3)) + [(None, texts[4]), (None, "nothing like it"), (None, None), (5, "another text of the same id as an earlier one"), (5, "another text of the same id as an earlier one here")]
    for k, percent in ((4, 85), (2, 60), (1, 85)):
        expected = plain(docs, k, percent)
        assert ours(spark, docs, k, percent) == expected


def test_ids_that_clash_keep_the_links_of_each_text(spark):
    rng = random.Random(2)
    a, b = (rng.choices([f"w{i}" for i in range(900)], k=60) for _ in range(2))
    docs = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:-1])), (3, " ".join(b[1:])), (4, "alone in here")]
    assert ours(spark, docs) == plain(docs) == sorted([(1, 57, 1), (1, 57, 1), (2, 56, 1), (3, 56, 1), (4, 1, 4)], key=str)


def test_short_texts_with_common_parts_and_a_hot_group(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    lines = [rng.choices(words, k=9) for _ in range(4)]
    texts = [" ".join(rng.choice(lines) + rng.choice(lines) + rng.choices(words, k=rng.randint(0, 6))) for _ in range(250)]
    base = rng.choices(words, k=80)
    texts += [" ".join(varied(rng, words, base, rng.randint(0, 2))) for _ in range(200)] + ["w1 w2 w3 w4 w5"] * 100
    docs = list(enumerate(texts))
    assert ours(spark, docs) == plain(docs)


def test_every_linked_pair_is_found_by_what_is_allotted():
    """Two sets within the bound agree on a segment but for what it is allotted, however the differences fall."""
    rng = np.random.default_rng(4)
    for percent in (60, 85, 95):
        bands = jj.Bands(percent)
        for n in [*range(6, 60), 150, 700]:
            for back, m, loose, needed in bands.probes(n):
                assert needed <= m + loose and 0 < loose <= m
            s = np.sort(rng.integers(-(2**62), 2**62, n))
            smaller = max(-(-percent * n // 100), 1)
            other = np.sort(rng.permutation(s)[:smaller])
            found = list(jj.signatures([s, other], bands))
            back = bands.of(n) - bands.of(smaller)

            def rows(i, b, found=found):
                for at_back, owners, _, _, (ends, whole), (less_ends, less, _) in found:
                    if at_back == b and i in owners:
                        k = int(np.flatnonzero(owners == i)[0])
                        cut = lambda e, v: v[e[k - 1] if k else 0 : e[k]]  # noqa: E731, B023
                        return {(x, False) for x in cut(ends, whole)} | {(x, True) for x in cut(less_ends, less)}

            mine, theirs = rows(0, back), rows(1, 0)
            assert any((x, False) in theirs or (not g and (x, True) in theirs) for x, g in mine)


def test_empty_tables(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(1, None)]) == [(1, 0, 1)]
