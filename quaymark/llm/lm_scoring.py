"""Log-likelihood of whole documents under a gated recurrent language model that is trained here, in numpy, by truncated backpropagation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, written

#: The most frequent words are outputs of their own: CLASSES classes of MEMBERS words. All other words are in one of SHAPES classes by their form, and
#: within such a class go by their count in the corpus, so the vocabulary is open and grows with the input.
CLASSES, MEMBERS, SHAPES = 64, 32, 16
#: Counts of so many words go to every task; those of the rest are joined.
LOOKUP_WORDS, LOOKUP_BYTES = 200_000, 48
#: Units of the recurrent layer and of the embedding; tokens of a window of backpropagation; texts that run side by side in training and in scoring.
HIDDEN, WINDOW, TRAIN_LANES, LANES = 32, 32, 256, 256
#: Every training text trains once, in spans of SPAN tokens, over which the state is carried: rows are dealt to ROUNDS rounds by a hash, and after each round the
#: tasks' models are averaged. The pace of Adam's steps halves each time that the steps grow fourfold beyond SLOWER.
SPAN, ROUNDS, RATE, SLOWER = 2048, 2, 0.004, 200
#: Rows of which classes are told at once.
BLOCK = 1024
#: Models are averaged in so many groups before the driver averages these.
GROUPS = 32
FLUSH_WORDS = 300_000
END = b""
_FOLD = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def tokens(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D with A-Z in lower case, and the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(), END]


def shape(word: bytes) -> int:
    """Class of a word that isn't an output of its own: by length and last character."""
    last = word[-1:]
    kind = 0 if last == b"." else 1 if last == b"," else 2 if word.isascii() else 3
    return 4 * kind + min(len(word) // 4, 3)


class Vocabulary(NamedTuple):
    """numbers: number of each of the LOOKUP_WORDS, most frequent first; the first CLASSES * MEMBERS are outputs of their own. counts: their counts, by number.
    targets: their classes. shape_logs: log10 of the sum of count + 1 over each shape's words, and 1."""

    numbers: dict[bytes, int]
    counts: np.ndarray
    targets: np.ndarray
    class_counts: np.ndarray
    head_counts: np.ndarray
    shape_logs: np.ndarray
    total: int
    distinct: int


class Model:
    """A gated recurrent unit with an embedding, a softmax over classes and one over the words of each of the first CLASSES classes."""

    NAMES = ("embed", "wx", "wh", "b", "wc", "bc", "ww", "bw")
    INPUTS = CLASSES * MEMBERS + SHAPES + 1  # the last is the start

    def __init__(self, parts: dict[str, np.ndarray]):
        self.__dict__.update(parts)

    @classmethod
    def initial(cls, vocabulary: Vocabulary, seed: int = 11) -> Model:
        """Small random weights; the biases give the words' shares in the corpus."""
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        words = np.log(vocabulary.head_counts.reshape(CLASSES, MEMBERS) + 1e-3)
        return cls(
            {"embed": r(cls.INPUTS, HIDDEN), "wx": r(HIDDEN, 3 * HIDDEN), "wh": r(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32), "wc": r(HIDDEN, CLASSES + SHAPES),
             "bc": np.log(vocabulary.class_counts + 0.5).astype(np.float32), "ww": r(CLASSES, HIDDEN, MEMBERS) * 0.1, "bw": words.astype(np.float32)}
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def replaced(self, flat: np.ndarray) -> Model:
        parts, at = {}, 0
        for n in self.NAMES:
            old = getattr(self, n)
            parts[n] = flat[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return Model(parts)

    def step(self, gates: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """gates: the inputs' part. Returns the new state and what backpropagation needs."""
        g = h @ self.wh
        zr = gates[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
        np.negative(zr, out=zr)
        np.exp(np.minimum(zr, np.float32(30), out=zr), out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, own = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
        new = r * own
        new += gates[:, 2 * HIDDEN :]
        np.tanh(new, out=new)
        out = h - new
        out *= z
        out += new
        return out, z, r, own, new

    def outputs(self, h: np.ndarray, classes: np.ndarray, members: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-likelihood of each row's class and, in the first CLASSES classes, word; with grads also the gradient of its negative sum by h."""
        # states are between -1 and 1: where no logit can get near the largest exponent of a float, the row's maximum needn't be taken off
        small = max(float((np.abs(self.wc).sum(0) + np.abs(self.bc)).max()), float((np.abs(self.ww).sum(1) + np.abs(self.bw)).max())) < 60
        ones = np.ones(max(CLASSES + SHAPES, MEMBERS), np.float32)
        n, rows = len(h), np.arange(len(h))
        order = np.argsort(classes.astype(np.int16), kind="stable")  # rows of a class are next to each other
        h, classes, members = h[order], classes[order], members[order]
        cuts = np.searchsorted(classes, np.arange(CLASSES + 1)).tolist()

        def softened(logits: np.ndarray, chosen: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not small:
                logits -= logits.max(1, keepdims=True)
            picked = logits[own, chosen]
            np.exp(logits, out=logits)
            sums = logits @ ones[: logits.shape[1]]
            return picked - np.log(sums), sums

        found, dh = np.empty(n, np.float32), None if grads is None else np.empty_like(h)
        for first in range(0, n, BLOCK):  # logits of so many rows stay in the processor's cache
            at = slice(first, min(first + BLOCK, n))
            own = rows[: at.stop - first]
            logits = h[at] @ self.wc
            logits += self.bc
            found[at], sums = softened(logits, classes[at], own)
            if grads is not None:
                logits /= sums[:, None]
                logits[own, classes[at]] -= 1
                grads["wc"] += h[at].T @ logits
                grads["bc"] += logits.sum(0)
                dh[at] = logits @ self.wc.T
        for c in range(CLASSES):
            at = slice(cuts[c], cuts[c + 1])
            if at.start == at.stop:
                continue
            x, m, own = h[at], members[at], rows[: at.stop - at.start]
            l = x @ self.ww[c]
            l += self.bw[c]
            logs, sums = softened(l, m, own)
            found[at] += logs
            if grads is not None:
                l /= sums[:, None]
                l[own, m] -= 1
                grads["ww"][c] += x.T @ l
                grads["bw"][c] += l.sum(0)
                dh[at] += l @ self.ww[c].T
        out = np.empty(n, found.dtype)
        out[order] = found
        if dh is not None:
            sorted_dh, dh = dh, np.empty_like(dh)
            dh[order] = sorted_dh
        return out, dh


class Encoded(NamedTuple):
    inputs: np.ndarray
    classes: np.ndarray
    members: np.ndarray


def numbered(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, Encoded]:
    """Of a text's tokens: their numbers (-1: not in the lookup), the places of those that have none, and the targets and, one later, inputs."""
    first = CLASSES * MEMBERS
    numbers = np.fromiter(map(vocabulary.numbers.get, words, repeat(-1)), np.int32, len(words))
    missing = np.flatnonzero(numbers < 0)
    classes = vocabulary.targets[numbers] if len(vocabulary.targets) else np.zeros(len(words), np.int32)
    if len(missing):
        classes[missing] = [CLASSES + shape(words[i]) for i in missing.tolist()]
    own = classes < CLASSES
    outputs = np.where(own, numbers, classes + (first - CLASSES))
    inputs = np.empty_like(outputs)
    inputs[0], inputs[1:] = Model.INPUTS - 1, outputs[:-1]
    return numbers, missing, Encoded(inputs, classes, np.where(own, numbers % MEMBERS, 0))


def encode(words: list[bytes], vocabulary: Vocabulary) -> Encoded:
    """Numbers of a text's tokens as targets and, one later, as inputs."""
    return numbered(words, vocabulary)[2]


def _in_lanes(texts: list[Encoded], lanes: int) -> tuple[np.ndarray, ...]:
    """Texts one after the other in lanes, longest lane first: arrays (step, lane) of inputs, classes, members, text numbers (-1: none) and starts."""
    loads = [0] * min(lanes, max(len(texts), 1))
    own: list[list[int]] = [[] for _ in loads]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i].inputs)):
        k = min(range(len(loads)), key=loads.__getitem__) if len(texts) > len(loads) else i
        own[k].append(i)
        loads[k] += len(texts[i].inputs)
    order = sorted(range(len(loads)), key=lambda k: -loads[k])
    shape_ = (max(loads, default=0), len(loads))
    out = [np.zeros(shape_, np.int32) for _ in range(3)] + [np.full(shape_, -1, np.int32), np.zeros(shape_, bool)]
    for lane, k in enumerate(order):
        at = 0
        for i in own[k]:
            n = len(texts[i].inputs)
            for target, source in zip(out, texts[i]):
                target[at : at + n, lane] = source
            out[3][at : at + n, lane] = i
            out[4][at, lane] = True
            at += n
    return tuple(out)


def log_likelihoods(model: Model, texts: list[Encoded], lanes: int = LANES) -> np.ndarray:
    """The natural log-likelihood of each whole text (of its classes and own words). The state is carried from window to window up to the text's end."""
    if not texts:
        return np.zeros(0)
    inputs, classes, members, which, starts = _in_lanes(texts, lanes)
    table = model.embed @ model.wx + model.b
    total = np.zeros(len(texts))
    active, begins = (which >= 0).sum(1).tolist(), starts.any(1).tolist()
    h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
    for first in range(0, len(inputs), WINDOW):
        states, places = [], slice(first, min(first + WINDOW, len(inputs)))
        for t in range(places.start, places.stop):
            a = active[t]
            h = np.where(starts[t, :a, None], np.float32(0), h[:a]) if begins[t] else h[:a]  # the state before is still to be scored
            h = model.step(table[inputs[t, :a]], h)[0]
            states.append(h)
        real = which[places] >= 0
        found, _ = model.outputs(np.concatenate(states), classes[places][real], members[places][real])
        total += np.bincount(which[places][real], found, len(texts))
    return total


class Trainer:
    """Adam on windows of truncated backpropagation: the state goes on from window to window, gradients don't. Moments and pace go on from one call to the next."""

    def __init__(self, model: Model, rate: float = RATE, lanes: int = TRAIN_LANES):
        self.model, self.flat, self.rate, self.lanes, self.steps = model, model.flat(), rate, lanes, 0
        self.first_moment, self.second_moment = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.room: dict[str, np.ndarray] = {}

    def learn(self, texts: list[Encoded]) -> None:
        inputs, classes, members, which, starts = _in_lanes(texts, self.lanes)
        h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        for first in range(0, len(inputs), WINDOW):
            n = int((which[first] >= 0).sum())  # lanes are sorted by length: the others have ended
            at = slice(first, min(first + WINDOW, len(inputs))), slice(0, n)
            grads, h, tokens_ = _window(self.model, inputs[at], classes[at], members[at], which[at] >= 0, starts[at], h[:n], self.room)
            self._step(np.concatenate([grads[k].ravel() for k in Model.NAMES]) / max(tokens_, 1))

    def _step(self, gradient: np.ndarray) -> None:
        norm = float(np.sqrt(gradient @ gradient))
        if norm > 1:
            gradient /= norm
        self.steps += 1
        self.first_moment += 0.1 * (gradient - self.first_moment)
        self.second_moment += 0.01 * (gradient * gradient - self.second_moment)
        pace = self.rate / math.sqrt(1 + self.steps / SLOWER)
        move = np.sqrt(self.second_moment / (1 - 0.99**self.steps)) + 1e-6
        self.flat = self.flat - pace / (1 - 0.9**self.steps) * self.first_moment / move
        self.model = self.model.replaced(self.flat)


def _in_room(room: dict[str, np.ndarray], name: str, *shape_: int) -> np.ndarray:
    """An array of this shape whose memory is kept in room: memory that is asked for and given back in every window costs the system a third of training."""
    size = math.prod(shape_)
    if name not in room or room[name].size < size:
        room[name] = np.empty(size, np.float32)
    return room[name][:size].reshape(shape_)


def _window(model: Model, inputs, classes, members, real, starts, h, room: dict | None = None) -> tuple[dict, np.ndarray, int]:
    """Gradients of one window's summed negative log-likelihood, the state after it, and its tokens. Nothing that is returned lies in room."""
    room = {} if room is None else room
    grads = {k: np.zeros_like(getattr(model, k)) for k in Model.NAMES}
    table = model.embed @ model.wx + model.b
    steps, begins = range(len(inputs)), starts.any(1).tolist()
    gates = np.take(table, inputs, axis=0, out=_in_room(room, "gates", *inputs.shape, 3 * HIDDEN), mode="clip")
    names = ("before", "hidden", "z", "r", "own", "new", "d_new", "d_hidden", "to_new", "to_z", "to_r")
    before, hidden, z, r, own, new, d_new, d_hidden, to_new, to_z, to_r = (_in_room(room, name, *inputs.shape, HIDDEN) for name in names)
    for t in steps:
        if begins[t]:
            h = np.where(starts[t][:, None], np.float32(0), h)
        before[t] = h
        h, z[t], r[t], own[t], new[t] = model.step(gates[t], h)
        hidden[t] = h
    _, dh_out = model.outputs(hidden[real], classes[real], members[real], grads)
    d_hidden[~real] = 0
    d_hidden[real] = dh_out
    # what the gradient of a state is multiplied with is known for the whole window; only the gradient itself goes step by step
    np.subtract(1, z, out=d_new)
    np.multiply(np.subtract(before, new, out=to_z), z, out=to_z)
    to_z *= d_new
    np.subtract(1, np.multiply(new, new, out=to_new), out=to_new)
    to_new *= d_new
    np.multiply(np.subtract(1, r, out=to_r), r, out=to_r)
    to_r *= own
    d_gates = _in_room(room, "d_gates", *inputs.shape, 3 * HIDDEN)  # of the state's part, and in the end of the inputs' part
    back = np.ascontiguousarray(model.wh.T)
    dh = np.zeros_like(h)
    for t in reversed(steps):
        dh += d_hidden[t]
        d_g = d_gates[t]
        np.multiply(dh, to_new[t], out=d_new[t])
        np.multiply(dh, to_z[t], out=d_g[:, :HIDDEN])
        np.multiply(d_new[t], to_r[t], out=d_g[:, HIDDEN : 2 * HIDDEN])
        np.multiply(d_new[t], r[t], out=d_g[:, 2 * HIDDEN :])
        dh *= z[t]
        dh += d_g @ back
        if begins[t]:
            dh[starts[t]] = 0
    grads["wh"] += before.reshape(-1, HIDDEN).T @ d_gates.reshape(-1, 3 * HIDDEN)
    d_gates[:, :, 2 * HIDDEN :] = d_new
    d_flat, flat_inputs = d_gates.reshape(-1, 3 * HIDDEN), inputs.astype(np.int16).ravel()
    d_table = np.zeros((Model.INPUTS, 3 * HIDDEN), np.float32)
    order = np.argsort(flat_inputs, kind="stable")
    cuts = np.flatnonzero(np.diff(flat_inputs[order], prepend=-1))
    by_input = np.take(d_flat, order, axis=0, out=gates.reshape(d_flat.shape), mode="clip")
    d_table[flat_inputs[order][cuts]] = np.add.reduceat(by_input, cuts, axis=0)
    grads["b"] += d_flat.sum(0)
    grads["wx"] += model.embed.T @ d_table
    grads["embed"] += d_table @ model.wx.T
    return grads, h, int(real.sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, shape, n) of texts: the counts of the task's words, let go whenever there are FLUSH_WORDS of them."""

    def counts(found: Counter) -> pa.RecordBatch:
        columns = [pa.array(list(found), pa.binary()), pa.array([shape(w) for w in found], pa.int32()), pa.array(list(found.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "shape", "n"])

    found: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            found.update(tokens(text.as_py()))
        if len(found) > FLUSH_WORDS:
            yield counts(found)
            found = Counter()
    yield counts(found)


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """From (word, shape, c) of all training tokens. The driver gets LOOKUP_WORDS words of LOOKUP_BYTES bytes at most, and SHAPES sums."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    short = counts.where(F.length("word") <= LOOKUP_BYTES)
    upto = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    sizes = short.groupBy("c").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(upto))  # a row for each different count
    least = sizes.where(F.col("upto") <= LOOKUP_WORDS).agg(F.min("c")).first()[0]
    rows = short.where(F.col("c") >= least).select("word", "c").collect() if least is not None else []
    known = {bytes(w): c for w, c in sorted(rows, key=lambda r: (-r.c, bytes(r.word)))}
    heads = list(known)[: CLASSES * MEMBERS]
    head_counts = np.zeros(CLASSES * MEMBERS)
    head_counts[: len(heads)] = [known[w] for w in heads]
    targets = np.array([i // MEMBERS if i < CLASSES * MEMBERS else CLASSES + shape(w) for i, w in enumerate(known)], np.int32)
    sums, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    for k, c, n in counts.groupBy("shape").agg(F.sum("c"), F.count("*")).collect():
        sums[k], kinds[k] = c, n
    for w in heads:
        sums[shape(w)] -= known[w]
        kinds[shape(w)] -= 1
    class_counts = np.concatenate((head_counts.reshape(CLASSES, MEMBERS).sum(1), sums))
    return Vocabulary({w: i for i, w in enumerate(known)}, np.array(list(known.values()), np.float64), targets, class_counts, head_counts, np.log10(sums + kinds + 1), total, distinct)


def fit(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """From (round, text): in each round, each task trains on its texts from the shared model, and the models are averaged by their steps, in GROUPS groups by
    Spark first."""
    spark = texts.sparkSession
    model = Model.initial(vocabulary)
    known = spark.sparkContext.broadcast(vocabulary)
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def local(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mine, held, size = Trainer(shared.value), [], 0
            for batch in batches:
                for text in batch.column(0):
                    words = tokens(text.as_py())
                    for at in range(0, len(words), SPAN):
                        held.append(encode(words[at : at + SPAN], known.value))
                    size += len(words)
                    if size >= 1_000_000:
                        mine.learn(held)
                        held, size = [], 0
            if held:
                mine.learn(held)
            if mine.steps:
                row = {"part": pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), "steps": pa.array([float(mine.steps)]), "model": pa.array([mine.flat.astype(np.float32).tobytes()], pa.binary())}
                yield pa.RecordBatch.from_pydict(row)

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, steps = None, 0.0
            for batch in batches:
                for n, flat in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    part = n * np.frombuffer(flat, np.float32).astype(np.float64)
                    total, steps = part if total is None else total + part, steps + n
            if steps:
                yield pa.RecordBatch.from_pydict({"steps": pa.array([steps]), "model": pa.array([(total / steps).astype(np.float32).tobytes()], pa.binary())})

        models = texts.where(F.col("round") == number).select("text").mapInArrow(local, "part int, steps double, model binary")
        rows = models.repartition(GROUPS, "part").mapInArrow(average, "steps double, model binary").collect()
        if rows:
            steps = sum(r.steps for r in rows)
            model = model.replaced(sum(r.steps / steps * np.frombuffer(r.model, np.float32) for r in rows))
    return model


_SCORED = T.StructType(
    [T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("logs", T.DoubleType()), ("score", T.DoubleType()), ("words", T.ArrayType(T.BinaryType())), ("times", T.ArrayType(T.IntegerType())))]
)


def _scorer(shared, most: int = 2_000_000):
    """Of (row, text): n_tokens; n_known and logs (sum of log10(c + 1)) of the words in the lookup; score without the counts of the words that aren't; these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocabulary = shared.value
        logs = np.log10(vocabulary.counts + 1)
        inside = np.where(vocabulary.targets >= CLASSES, logs, 0.0)  # of words within a class of a shape
        whole = np.concatenate((np.zeros(CLASSES), vocabulary.shape_logs))

        def scored(held: list[tuple]) -> list[tuple]:
            found = log_likelihoods(model, [e for e, _ in held]) / math.log(10)
            return [(*rest[:3], float(x) + rest[3], *rest[4:]) for x, (_, rest) in zip(found, held)]

        for batch in batches:
            out, held, size = [], [], 0
            for text in batch.column(1):
                words = tokens(text.as_py())
                numbers, missing, e = numbered(words, vocabulary)
                other = Counter(words[i] for i in missing.tolist())
                known = numbers[numbers >= 0]
                rest = float(inside[known].sum() - whole[e.classes].sum())
                held.append((e, (len(words), len(known), float(logs[known].sum()), rest, list(other), list(other.values()))))
                size += len(words)
                if size >= most:
                    out += scored(held)
                    held, size = [], 0
            out += scored(held)
            columns = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["row", *_SCORED.names])

    return run


def score_documents(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The rows where the column held_out isn't true are learned from: their words are counted, and all of them train the model. score is the log10 probability of
    the whole text with its end: of each token the class given all before it, times the word in the class: given all before it for the most frequent words,
    else (count + 1) / (sum of count + 1 over the class's words, and 1), with unknown words as one word. base_score is the unigram one. Null texts are empty
    and have the end alone; rows with a null id are learned from; without training rows all words are unknown; empty tables give no rows.
    """
    rows = docs.select(F.struct(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out")).alias("row"), F.col(text).alias("text"))
    learned = rows.where("not row.held_out").select("text", F.pmod(F.xxhash64("row.doc_id", "text"), F.lit(ROUNDS)).alias("round"))
    found = learned.select("text").mapInArrow(_count, "word binary, shape int, n long")
    counts = written(found.groupBy("word", "shape").agg(F.sum("n").alias("c")), "counts")
    vocabulary = vocabulary_of(counts)
    model = fit(learned, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((model, vocabulary))
    scored = rows.mapInArrow(_scorer(shared), T.StructType([rows.schema["row"], *_SCORED.fields]))
    scored = written(scored.withColumn("id", F.monotonically_increasing_id()), "scored")
    rest = scored.select("id", F.explode(F.arrays_zip("words", "times")).alias("x")).select("id", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rest = rest.join(counts.select("word", "c"), "word", "left").groupBy("id").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("logs_"))
    whole = scored.drop("words", "times").join(rest, "id", "left")
    more = F.coalesce("logs_", F.lit(0.0))
    norm = math.log10(vocabulary.total + vocabulary.distinct + 1)
    return whole.select(
        "row.doc_id", "row.held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * norm).alias("base_score"), (F.col("score") + more).alias("score"),
    )
