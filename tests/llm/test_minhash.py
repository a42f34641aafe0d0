import random
from itertools import combinations

from quaymark.llm import minhash, queries
from quaymark.llm.common import connected_components, table


def shingles(text, k):
    words = (text or "").encode().lower().split()
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def plain(docs, k, percent=80):
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def run(spark, docs, k=4):
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, component_id int")
    return {r.doc_id: tuple(r)[1:4] for r in minhash.near_duplicates(df, k).collect()}


def varied(rng, words, text, n):
    out = list(text)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(words)
    return out


def corpus(seed, groups, each, length, most):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 5))) for _ in range(500)]
    texts = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(1, length))
        texts += [" ".join(varied(rng, words, base, rng.randint(0, most))) for _ in range(rng.randint(1, each))]
    rng.shuffle(texts)
    return texts


def test_equals_all_pairs(spark):
    texts = corpus(1, 25, 5, 150, 4) + ["", None, " \n", "One", "one", "a b", "A  B", "a b c", "x\x0by z w", "x y z w"]
    docs = list(enumerate(texts, 3))
    for k in (4, 5):
        assert run(spark, docs, k) == plain(docs, k)


def test_chains_and_stars_of_near_copies(spark):
    """A group in which few pairs are linked: the hubs miss links, which the blocks find."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    text = rng.choices(words, k=120)
    texts = []
    for i in range(80):
        text = varied(rng, words, text, 2) if i % 4 else rng.choices(words, k=40) + text[40:]
        texts.append(" ".join(text))
    base = rng.choices(words, k=100)
    texts += [" ".join(varied(rng, words, base, rng.randint(0, 9))) for _ in range(120)]
    docs = list(enumerate(texts))
    assert run(spark, docs) == plain(docs, 4)


def test_groups_of_extended_and_cut_members(spark):
    """A member with unique text of its own may be linked only to a smaller one, which the group's hub isn't."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(60, 140))
        most = len(base) // 4
        texts += [" ".join(varied(rng, words, base, rng.randint(0, 1))) for _ in range(6)]
        for _ in range(4):
            texts.append(" ".join(base + rng.choices(words, k=rng.randint(0, most))))
            texts.append(" ".join(base[: len(base) - rng.randint(0, most)]))
    docs = list(enumerate(texts))
    assert run(spark, docs) == plain(docs, 4)


def test_one_large_member_outside(spark):
    """x has 20 shingles besides the 80 of y, and of the hub's component only y is linked to it."""
    words = [f"w{i}" for i in range(83)]
    near = [" ".join(words[:-2] + [f"v{i}", "end"]) for i in range(6)]
    near += [" ".join(words[:40] + ["u"] + words[41:-2] + [f"v{i}", "end"]) for i in range(6)]
    docs = list(enumerate([*near, " ".join(words), " ".join(words + [f"x{i}" for i in range(20)])]))
    assert run(spark, docs) == plain(docs, 4)


def test_blocks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    monkeypatch.setattr(minhash, "STAR", 3)
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    base = rng.choices(words, k=60)
    docs = [(i, " ".join(varied(rng, words, base, rng.randint(0, 4)))) for i in range(70)]
    assert run(spark, docs) == plain(docs, 4)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (9, text + " more"), (None, "alone here"), (7, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id or -1), r.component_id or -1, r.kept) for r in minhash.near_duplicates(df, 5).collect())
    assert rows == [(-1, -1, True), (-1, 5, False), (5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False)]
    assert run(spark, []) == {}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(900, 999)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{k: 900 for k in range(901, 999)}, 1000: 900}


def test_registered_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, d, "documents").select("doc_id", "text").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in queries.op4_minhash_dedup(spark, d).collect()} == plain(docs, 4)


def test_ids_that_clash_keep_the_links_of_each_text(spark):
    rng = random.Random(8)
    a, b = (rng.choices([f"w{i}" for i in range(900)], k=60) for _ in range(2))
    docs = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:-1])), (3, " ".join(b[1:])), (None, " ".join(b)), (None, "alone in here")]
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in rows), key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, None, True)], key=str)


def test_a_very_long_text(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    long = rng.choices(words, k=120_000)
    docs = [(4, " ".join(long)), (2, " ".join(varied(rng, words, long, 900))), (1, " ".join(rng.choices(words, k=50_000))), (3, " ".join(long[:110_000]))]
    assert run(spark, docs) == plain(docs, 4)
