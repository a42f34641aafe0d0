import hashlib
import random
import zlib
from collections import defaultdict

from quaymark.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, pos int, words string"


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    members = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = turns.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        seq = tuple(base[:h] + own[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append((c, len(seq) == d))
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [out[q] for q in children[p]]
        saved = (len(members[p]) - 1) * len((p[-1][1]).encode().split()) if p else 0
        ends = ",".join(str(c) for c in sorted(c for c, end in members[p] if end))
        parent = min(c for c, _ in members[p[:-1]]) if p else None
        row = (min(c for c, _ in members[p]), len(p), parent, len(members[p]), len(below), sum(b[5] for b in below) or 1, saved + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
        out[p] = row
    return sorted(out.values(), key=str)


def ours(spark, rows, most=ct.CONTAINER):
    turns = ct.turns_in_order(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in ct.prefix_trie(ct.sequences(ct.rebuilt(turns)), most).collect()), key=str)


def corpus(seed, n, texts, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(texts), 1, "x"))
    rng.shuffle(rows)
    return rows


def test_equals_a_plain_trie_at_every_container_size(spark):
    rows = corpus(1, 120, ["a b", "c", "", "d  e\tf", "été 日本", "x\x0by"], 6)
    rows += [(5000, None, None, None, 1, ""), (5000, None, "user", "hello", 1, ""), (5000, 1, "user", "hello", 1, ""), (5000, 1, "user", "hello", 1, ""), (None, 1, "user", "x", 1, "")]
    rows += [(-7, 0, "user", "a b", 1, ""), (-20, 1, "user", "c", 1, ""), (10**16 + 3, 0, "user", "a b", 1, "")]
    # alone without its group's first conversation, and with fewer turns than it would take from it: turnless
    alone = next(c for c in range(100_001, 100_019) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows += [(alone, 0, "user", "a b", 1, ""), (alone, 1, "user", "c", 1, "")]
    expected = plain(rows)
    for most in (1000, 1, 4, 20):
        assert ours(spark, rows, most) == expected


def test_hot_first_turn_copies_and_a_very_long_conversation(spark):
    rows = [(20 * c, t, "user", f"same {t}", 1, "") for c in range(60) for t in range(30)]
    rows += [(20 * c, t, "user", f"same {t}" if t < 9 else f"{c} {t}", 1, "") for c in range(60, 120) for t in range(12)]
    rows += [(20 * c, 0, "user", f"other {c}", 1, "") for c in range(120, 180)]
    rows += [(99_980, t, "user", f"turn {t % 7}", 1, "") for t in range(3000)]
    expected = plain(rows)
    for most in (1000, 25):
        assert ours(spark, rows, most) == expected


def test_digests_of_many_chunks(spark, monkeypatch):
    rows = [(20 * c, 0, "user", "hello there", 1, "") for c in range(3000)]
    assert ours(spark, rows, 10) == plain(rows)


def test_role_and_text_are_told_apart(spark):
    rows = [(0, 0, "a", "bc", 1, ""), (20, 0, "ab", "c", 1, ""), (40, 0, "", "abc", 1, ""), (60, 0, None, "abc", 1, "")]
    got = ours(spark, rows)
    assert got == plain(rows) and len(got) == 4


def test_empty_tables(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(None, 0, "user", "x", 1, "")]) == []
