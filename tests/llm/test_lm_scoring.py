import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.llm import lm_scoring as lm
from quaymark.llm import queries
from quaymark.llm.common import table


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lm._FOLD)) + [b""]


def plain_base(docs):
    """Counts and the unigram score by definition. docs: (id, text)."""
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    c = Counter(w for d, t in docs if not held[d] for w in words(t))
    n, v = sum(c.values()), len(c)
    out = {}
    for d, t in docs:
        ws = words(t)
        out[d] = (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in ws))
    return out


@pytest.fixture(scope="module")
def small():
    """A vocabulary and a model of it, as the driver makes them, and coded texts."""
    rng = random.Random(1)
    known = {w: 3000 - i for i, w in enumerate([b"", *(f"w{k}".encode() for k in range(2200))])}
    n = lm.CLASSES * lm.MEMBERS
    counts = np.array(list(known.values()), float)[:n]
    targets = np.array([i // lm.MEMBERS if i < n else lm.CLASSES + lm.shape(w) for i, w in enumerate(known)], np.int32)
    vocabulary = lm.Vocabulary({w: i for i, w in enumerate(known)}, np.array(list(known.values()), float), targets, np.concatenate((counts.reshape(lm.CLASSES, -1).sum(1), np.full(lm.SHAPES, 50.0))), counts, np.full(lm.SHAPES, 3.0), sum(known.values()), len(known))
    texts = [lm.encode([*(f"w{rng.randrange(2300)}".encode() for _ in range(rng.randint(0, 90))), b""], vocabulary) for _ in range(30)]
    return vocabulary, lm.Model.initial(vocabulary), texts


def test_gradients_are_right(small):
    """Every kind of weight against finite differences, over a window with texts that begin inside it."""
    _, model, texts = small
    model = model.replaced(model.flat() + np.random.default_rng(2).standard_normal(len(model.flat())).astype(np.float32) * 0.05)
    inputs, classes, members, which, starts = lm._in_lanes(texts[:6], 3)
    part = slice(0, 20)
    args = (inputs[part], classes[part], members[part], which[part] >= 0, starts[part], np.zeros((inputs.shape[1], lm.HIDDEN), np.float32))
    grads, _, n = lm._window(model, *args)

    def loss(m):
        table = m.embed @ m.wx + m.b
        h, total = args[5], 0.0
        for t in range(20):
            h = m.step(table[args[0][t]], np.where(args[4][t][:, None], 0, h).astype(np.float32))[0]
            real = args[3][t]
            total -= m.outputs(h[real], args[1][t][real], args[2][t][real])[0].sum()
        return total

    rng = np.random.default_rng(3)
    for name in lm.Model.NAMES:
        g = grads[name].ravel()
        direction = g / np.linalg.norm(g)
        step = 3e-2
        up, down = (lm.Model({k: getattr(model, k) for k in lm.Model.NAMES} | {name: getattr(model, name) + (s * direction).reshape(getattr(model, name).shape).astype(np.float32)}) for s in (step, -step))
        assert (loss(up) - loss(down)) / (2 * step) == pytest.approx(np.linalg.norm(g), rel=0.03), name
    assert n == int(args[3].sum()) and rng is not None


def test_lanes_and_windows_do_not_change_the_score(small):
    """The state is carried to the end of a text and never into another."""
    _, model, texts = small
    together = lm.log_likelihoods(model, texts, 4)
    alone = np.array([lm.log_likelihoods(model, [t])[0] for t in texts])
    assert np.allclose(together, alone, rtol=1e-4)
    assert len(lm.log_likelihoods(model, [])) == 0


def test_probabilities_add_up_to_one(small):
    """Over all classes and words of a class, after any history."""
    _, model, _ = small
    h = np.random.default_rng(4).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    classes = np.array([c for c in range(lm.CLASSES) for _ in range(lm.MEMBERS)] + [lm.CLASSES + k for k in range(lm.SHAPES)])
    members = np.array([m for _ in range(lm.CLASSES) for m in range(lm.MEMBERS)] + [0] * lm.SHAPES)
    found, _ = model.outputs(np.repeat(h, len(classes), 0), classes, members)
    assert np.exp(found).sum() == pytest.approx(1, rel=1e-4)


def test_training_learns_an_order(small):
    vocabulary, model, _ = small
    texts = [lm.encode([f"w{k % 7}".encode() for k in range(i, i + 60)] + [b""], vocabulary) for i in range(40)]
    before = lm.log_likelihoods(model, texts).sum()
    trainer = lm.Trainer(model, 0.01, 8)
    for _ in range(60):
        trainer.learn(texts)
    assert trainer.steps > 60 and lm.log_likelihoods(trainer.model, texts).sum() > 0.3 * before


def test_base_and_edge_rows(spark):
    rng = random.Random(5)
    docs = [(d, " ".join(rng.choices(["The", "cat", "sat", "É.", "on,", "mats-and-more", "x\x0by", "z"], k=rng.randint(0, 40)))) for d in range(60)] + [(60, None), (61, ""), (62, "new" + "w" * 90)]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = lm.score_documents(df, held).collect()
    want = plain_base(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4]) and r.score < 0
    twice = lm.score_documents(df.limit(1).union(df.limit(1)).union(spark.createDataFrame([(None, "a", 0.0)], df.schema)), held)
    assert twice.count() == 3
    assert lm.score_documents(df.limit(0), held).collect() == []
    only_held = lm.score_documents(df, F.lit(True)).first()
    assert only_held.train_tokens == 0 and only_held.n_known == 0


def test_query_beats_the_unigrams_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, d, "documents").select("doc_id", "text").collect()]
    want = plain_base(docs)
    rows = queries.op2_lm_scoring(spark, d).collect()
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.98
    assert sum(r.score > r.base_score for r in held) > 0.8 * len(held)


def test_long_texts_are_scored_beside_others(small, monkeypatch):
    """Texts of a batch of 600,000 tokens run side by side in one call, so a long text's steps aren't taken for itself; scores are those of each text alone."""
    vocabulary, model, _ = small
    texts = ["w1 w2 w3 " * 3000, *["w4 w5 w6 w7 w8 w9 " * 100] * 1000]
    calls, score = [], lm.log_likelihoods
    monkeypatch.setattr(lm, "log_likelihoods", lambda m, held, *more: calls.append(len(held)) or score(m, held, *more))
    shared = type("Shared", (), {"value": (model, vocabulary)})
    batch = lm.pa.RecordBatch.from_arrays([lm.pa.array(range(len(texts))), lm.pa.array(texts)], names=["row", "text"])
    out = [x for b in lm._scorer(shared)(iter([batch])) for x in b.column(3).to_pylist()]
    assert calls == [len(texts)] and len(out) == len(texts)
    alone = [x for t in texts[:2] for b in lm._scorer(shared)(iter([batch.slice(texts.index(t), 1)])) for x in b.column(3).to_pylist()]
    assert np.allclose(out[:2], alone, rtol=1e-4)


def test_windows_share_their_memory(small):
    """Training asks for its large arrays once; what a window gives is the same with memory of other windows in it, and isn't overwritten by the next."""
    _, model, texts = small
    inputs, classes, members, which, starts = lm._in_lanes(texts, 8)
    args = [(inputs[at], classes[at], members[at], which[at] >= 0, starts[at]) for at in (slice(0, 32), slice(32, 50))]
    h, room = np.zeros((8, lm.HIDDEN), np.float32), {}
    alone = [lm._window(model, *x, h) for x in args]
    shared = [lm._window(model, *x, h, room) for x in args]
    kept = {k: id(v) for k, v in room.items()}
    again = lm._window(model, *args[0], h, room)
    assert kept == {k: id(v) for k, v in room.items()} and len(kept) > 5
    for (g, after, n), (g2, after2, n2) in zip([*alone, alone[0]], [*shared, again]):
        assert n == n2 and np.array_equal(after, after2) and all(np.array_equal(g[k], g2[k]) for k in lm.Model.NAMES)
    trainer = lm.Trainer(model)
    trainer.learn(texts)
    assert trainer.room


def test_outputs_of_large_weights_and_of_several_blocks(small, monkeypatch):
    """Where weights are too large for a float's exponent the rows' maxima are taken off, and blocks of rows give what all rows give."""
    _, model, _ = small
    rng = np.random.default_rng(6)
    h = np.tanh(rng.standard_normal((700, lm.HIDDEN))).astype(np.float32)
    classes = rng.integers(0, lm.CLASSES + lm.SHAPES, 700)
    members = np.where(classes < lm.CLASSES, rng.integers(0, lm.MEMBERS, 700), 0)
    for scale in (1, 100):
        large = lm.Model({k: getattr(model, k) * np.float32(scale if k in ("wc", "ww") else 1) for k in lm.Model.NAMES})
        logits = h.astype(float) @ large.wc + large.bc
        top = logits.max(1)
        want = logits[np.arange(700), classes] - top - np.log(np.exp(logits - top[:, None]).sum(1))
        for i in np.flatnonzero(classes < lm.CLASSES):
            l = h[i].astype(float) @ large.ww[classes[i]] + large.bw[classes[i]]
            want[i] += l[members[i]] - l.max() - math.log(np.exp(l - l.max()).sum())
        for block in (64, 1024):
            monkeypatch.setattr(lm, "BLOCK", block)
            assert np.allclose(large.outputs(h, classes, members)[0], want, rtol=1e-4, atol=1e-3)
