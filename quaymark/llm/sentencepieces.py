"""SentencePiece encoding and decoding by the tokenizers library, from the model file alone."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The model is a parameter; this is where public tokenizers are found by default.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A model is sent to the executors with the task; it may have so many bytes.
MAX_MODEL_BYTES = 64_000_000
#: Threads of one task's batch are spark.task.cpus, and so many at least: one runs on while another waits for a long text.
THREADS = 2
#: A Python worker keeps the ids and the decoded form of so many words, each of so many characters at most; all others are encoded in every slice anew.
KEPT_WORDS, KEPT_CHARS = 200_000, 40
MARK = "▁"
#: Where texts may be cut if no merge crosses from a word into the mark that follows.
WORDS = f"{MARK}+[^{MARK}]*|[^{MARK}]+"
_WORDS = re.compile(WORDS)
_KINDS = {1: "normal", 2: "unknown", 3: "control", 4: "user", 5: "unused", 6: "byte"}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message: varints as int, the rest as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """What a SentencePiece model file says: pieces with scores and kinds, the algorithm, the normaliser and byte fallback."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, str]] = []
        self.algorithm, self.byte_fallback, self.unk_id, self.unk_surface = 1, False, 0, " ⁇ "
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for field, value in _fields(data):
            if field == 1:
                piece, score, kind = "", 0.0, 1
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif k == 3:
                        kind = v
                self.pieces.append((piece, score, _KINDS[kind]))
            elif field == 2:
                for k, v in _fields(value):
                    if k == 3:
                        self.algorithm = v
                    elif k == 35:
                        self.byte_fallback = bool(v)
                    elif k == 40:
                        self.unk_id = v
                    elif k == 44:
                        self.unk_surface = v.decode()
            elif field == 3:
                for k, v in _fields(value):
                    if k == 2:
                        self.charsmap = v
                    elif k == 3:
                        self.dummy_prefix = bool(v)
                    elif k == 4:
                        self.squeeze = bool(v)
                    elif k == 5:
                        self.escape = bool(v)
        self.unk_id = next((i for i, p in enumerate(self.pieces) if p[2] == "unknown"), self.unk_id)

    def merges(self) -> list[tuple[str, str]]:
        """BPE merges from the scores: every split of a piece into two pieces, best piece first; of one piece, in the order of the parts' ids."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in ("normal", "user", "unused")}
        out = []
        for piece, i in ids.items():
            parts = [(ids[piece[:k]], ids[piece[k:]], piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
            out += [(-self.pieces[i][1], i, *part) for part in sorted(parts)]
        out.sort(key=lambda m: (m[0], m[1]))
        return [(m[4], m[5]) for m in out]

    def splits_at_marks(self) -> bool:
        """Whether no piece has a mark after another character: then no merge crosses from a word into the mark that follows, and texts may be cut there."""
        return all(MARK not in p.lstrip(MARK) for p, _, kind in self.pieces if kind in ("normal", "user", "unused"))

    def plain(self) -> bool:
        """Whether the normaliser only puts a mark in front and for every space, which prepared() does at once."""
        return not self.charsmap and not self.squeeze and self.dummy_prefix and self.escape

    def tokenizer(self, normalise: bool = True):
        """The same model for the tokenizers library; without normalise for texts that are prepared()."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.algorithm == 1:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unk_id, byte_fallback=self.byte_fallback)
        elif self.algorithm == 2:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unk_id][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"unigram and BPE models are supported, not algorithm {self.algorithm}")
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        if steps and normalise:
            out.normalizer = normalizers.Sequence(steps)
        if self.escape and self.splits_at_marks():
            out.pre_tokenizer = pre_tokenizers.Split(Regex(WORDS), "isolated")
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence(steps + [decoders.Strip(" ", 1, 0)] * self.dummy_prefix)
        return out


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"the model has over {MAX_MODEL_BYTES} bytes")
    return data


def prepared(text: str) -> str:
    return MARK + text.replace(" ", MARK)


_CACHE: dict = {}


def _tokenizer(data: bytes):
    """The tokenizer, whether its texts have to be prepared(), the ids and, apart, texts of words kept so far (none where texts can't be cut into words), and
    which pieces begin with a mark; one in each Python worker, and workers outlive their tasks."""
    key = hash(data)
    if key not in _CACHE:
        _CACHE.clear()
        model = PieceModel(data)
        by_words = model.plain() and model.splits_at_marks() and any(p == MARK and kind == "normal" for p, _, kind in model.pieces)
        starts = np.array([p.startswith(MARK) for p, _, _ in model.pieces], bool)
        _CACHE[key] = model.tokenizer(not model.plain()), model.plain(), ({}, {}) if by_words else None, starts
    return _CACHE[key]


def _words_coded(words: list[str], data: bytes) -> tuple[dict[str, bytes], dict[str, str]]:
    """Each word's ids, as the bytes of 32-bit numbers, and the text that they decode to. A word has one mark, at its front, so in the ids of many words at once
    each piece that begins with a mark begins a word, and in their text each space; words of several marks are encoded one by one."""
    from tokenizers import pre_tokenizers

    tokenizer, _, _, starts = _tokenizer(data)
    single = [w for w in words if w.startswith(MARK) and not w.startswith(MARK, 1)]
    several = [w for w in words if not w.startswith(MARK) or w.startswith(MARK, 1)]
    found = [x.ids for x in tokenizer.encode_batch_fast(several, add_special_tokens=False)]
    texts = tokenizer.decode_batch(found, skip_special_tokens=False)
    codes = [array("i", ids).tobytes() for ids in found]
    if single:
        general = tokenizer.pre_tokenizer
        tokenizer.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")  # cuts words of one mark as the general one does, without an expression
        try:
            flat = tokenizer.encode_batch_fast(["".join(single)], add_special_tokens=False)[0].ids
        finally:
            tokenizer.pre_tokenizer = general
        ids = np.array(flat, np.int32)
        cuts = [*(4 * np.flatnonzero(starts[ids])).tolist(), 4 * len(flat)]
        decoded = tokenizer.decode(flat, skip_special_tokens=False).split(" ")
        if len(cuts) != len(single) + 1 or len(decoded) != len(single):
            raise ValueError("a word has another number of marks than one")
        whole = ids.tobytes()
        codes += [whole[a:b] for a, b in zip(cuts, cuts[1:])]
        texts += decoded
    named = several + single
    return dict(zip(named, codes)), dict(zip(named, texts))


def coded_batch(texts: list[str], data: bytes) -> tuple[list[bytes], list[str]]:
    """Of each text the ids, as the bytes of 32-bit numbers, and the text that they decode to. The tokenizer cuts prepared() texts at marks and encodes each word by
    itself, so a word that comes again has the same ids. A word's pieces begin with a mark, so they decode by themselves, and the first loses its space alone."""
    tokenizer, plain, kept, _ = _tokenizer(data)
    if kept is None:
        found = tokenizer.encode_batch_fast(list(map(prepared, texts)) if plain else texts, add_special_tokens=False)
        ids = [x.ids if text else [] for x, text in zip(found, texts)]
        return [array("i", x).tobytes() for x in ids], decode_batch(ids, data)
    words = [_WORDS.findall(prepared(text)) if text else [] for text in texts]
    ids_of, text_of = kept
    new = list(set(chain.from_iterable(words)).difference(ids_of))
    passing = [w for w in new if len(w) > KEPT_CHARS] if len(ids_of) < KEPT_WORDS else new
    for held, found in zip(kept, _words_coded(new, data)):
        held.update(found)
    codes = [b"".join(map(ids_of.__getitem__, of_text)) for of_text in words]
    decoded = [" ".join(map(text_of.__getitem__, of_text)) for of_text in words]
    for w in passing:
        del ids_of[w], text_of[w]
    return codes, decoded


def encode_batch(texts: list[str], data: bytes) -> list[list[int]]:
    """The ids of each text."""
    return [np.frombuffer(x, np.int32).tolist() for x in coded_batch(texts, data)[0]]


def _library(data: bytes):
    """The sentencepiece library's processor, one in each Python worker."""
    import sentencepiece

    key = "library", hash(data)
    if key not in _CACHE:
        _tokenizer(data)
        _CACHE[key] = sentencepiece.SentencePieceProcessor(model_proto=data)
    return _CACHE[key]


def decode_batch(ids: list[list[int]], data: bytes) -> list[str]:
    return _tokenizer(data)[0].decode_batch(ids, skip_special_tokens=False)


def _in_slices(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Texts in order, cut so that a slice has about `most` characters: encodings of long texts never pile up."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_texts(docs: DataFrame, keep: list[str], text: str = "text", model: bytes | None = None, threads: int | None = None, decode: bool = True, check: Column | None = None) -> DataFrame:
    """The columns keep of every row, pieces (ids, without begin and end marks), n_pieces and, with decode, decoded (the text from its ids again); with check
    also parity: where check is true, whether the sentencepiece library gives the same ids and text, else null.

    Null and empty texts have no pieces and decode to ''. Texts are encoded whole, in batches. Columns among keep that have a result's name are replaced;
    repeated rows are rows.
    """
    data = model or read_model()
    keep = [c for c in keep if c not in ("pieces", "n_pieces", "decoded", "parity")]
    threads = threads or max(THREADS, int(docs.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1")))
    held = F.struct(*keep) if keep else F.struct(F.lit(1).alias("none"))
    rows = docs.select(held.alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.lit(False) if check is None else check, F.lit(False)).alias("_check"))
    fields = [rows.schema["_row"], T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType())]
    fields += [T.StructField("decoded", T.StringType())] * decode
    checked = check is not None
    fields += [T.StructField("parity", T.BooleanType())] * checked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = ("true" if threads > 1 else "false"), str(threads)
        for batch in batches:
            at = 0
            for part in _in_slices(batch.column(1).to_pylist()):
                codes, decoded = coded_batch(part, data)
                sizes = np.array([len(x) // 4 for x in codes], np.int64)
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)  # of a slice; a text has fewer than 2^31 bytes
                arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(codes), np.int32))), pa.array(sizes)]
                if decode:
                    arrays.append(pa.array(decoded, pa.string()))
                if checked:
                    chosen = [i for i in range(len(part)) if batch.column(2)[at + i].as_py()]
                    wrong = {chosen[i] for i in _differing([part[i] for i in chosen], data, [codes[i] for i in chosen], [decoded[i] for i in chosen])}
                    same = dict.fromkeys(chosen, True) | dict.fromkeys(wrong, False)
                    arrays.append(pa.array([same.get(i) for i in range(len(part))], pa.bool_()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *arrays], names=[f.name for f in fields])
                at += len(part)

    out = rows.mapInArrow(run, T.StructType(fields))
    return out.select(*([F.col("_row")[c].alias(c) for c in keep]), *[f.name for f in fields[1:]])


def _differing(texts: list[str], data: bytes, codes: list[bytes], decoded: list[str]) -> list[int]:
    theirs = _library(data)
    expected = theirs.encode(texts, num_threads=1)
    return [i for i, (a, b, text) in enumerate(zip(codes, expected, decoded)) if array("i", b).tobytes() != a or text != theirs.decode(b)]


def parity(texts: list[str], data: bytes) -> list[int]:
    """The numbers of the texts whose ids or decoded form differ from the sentencepiece library's."""
    return _differing(texts, data, *coded_batch(texts, data))


def verify_parity(docs: DataFrame, text: str = "text", model: bytes | None = None) -> DataFrame:
    """(n_texts, n_differing) for each partition: every whole text is encoded by both libraries."""
    data = model or read_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = wrong = 0
        for batch in batches:
            for part in _in_slices([x or "" for x in batch.column(0).to_pylist()]):
                n, wrong = n + len(part), wrong + len(parity(part, data))
        yield pa.RecordBatch.from_pydict({"n_texts": pa.array([n], pa.int64()), "n_differing": pa.array([wrong], pa.int64())})

    return docs.select(text).mapInArrow(run, "n_texts long, n_differing long")
