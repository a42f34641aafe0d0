"""Quality rules: fixed base rules, then thresholds taken from mergeable quantile sketches of each language and source."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, written

#: Base rules.
MIN_WORDS, WINDOW_WORDS, MAX_REPEAT_PERCENT = 10, 5, 20
#: What the adaptive rules look at, each times SCALE as an integer: (name, SQL over the counts, least width of the fence above the upper quartile). Words and capitals
#: spread in every group, so their widths come from its sketch; of what most texts have none of, the quartiles are 0 and the least width stands. The
#: widths leave every fence inside its metric's range (shares end at SCALE, repeats at the base rule's), so each rule can reject.
SCALE = 1000
METRICS = (
    ("symbols_per_word", f"n_symbols * {SCALE} div n_words", 17),
    ("dup_lines_per_line", f"n_dup_lines * {SCALE} div greatest(n_lines, 1)", 34),
    ("repeat_per_word", f"n_repeat_words * {SCALE} div n_words", 15),
    ("chars_per_word", f"word_chars * {SCALE} div n_words", 150),
    ("upper_per_char", f"n_upper * {SCALE} div greatest(word_chars, 1)", 10),
)
#: Fences stand FENCE widths (upper quartile less median, or the least width) above the upper quartile. A group of fewer documents than MIN_GROUP takes its
#: language's sketch, and that of fewer the sketch of all documents.
FENCE, MIN_GROUP = 12, 30
#: Buckets of the sketch grow by GAMMA: a quantile is right within 1 %.
GAMMA = 1.02
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
_SPACES, _SYMBOLS, _UPPER = b" \t\n\x0b\x0c\r", b"#*$%&|<>", UPPER.encode()
#: Beyond so many groups their fences aren't broadcast but joined by a shuffle.
MAX_BROADCAST_GROUPS = 50_000


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text. Words are runs of bytes other than space and \\x09-\\x0D."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at ASCII white space only
    n, size = len(words), len(data)
    word_chars = len(text) - (size - len(data.translate(None, _SPACES)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if n > WINDOW_WORDS:
        windows = list(zip(*(words[i:] for i in range(WINDOW_WORDS))))
        if len(set(windows)) < len(windows):
            often = {k for k, v in Counter(windows).items() if v > 1}
            end = 0
            for i, window in enumerate(windows):
                if window in often:
                    repeated += i + WINDOW_WORDS - max(i, end)
                    end = i + WINDOW_WORDS
    symbols, upper = size - len(data.translate(None, _SYMBOLS)), size - len(data.translate(None, _UPPER))
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_counts(x.as_py()) for x in batch.column(batch.num_columns - 1)]
        arrays = [pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64()) for _ in COUNTS]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *COUNTS])


def with_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep and COUNTS of every row."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS])
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(_count_batches, schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def sketch(counted: DataFrame, by: list[str]) -> DataFrame:
    """A mergeable quantile sketch of each group and metric, as rows (by..., metric, bucket, n).

    Bucket k > 0 holds the values from above GAMMA^(k-1) up to GAMMA^k, bucket 0 the value 0. Sketches merge by adding n, so the result doesn't depend on
    the partitioning or on retries, and its size is bounded by the span of the metrics, not by the rows.
    """
    each = F.array(*[F.struct(F.lit(name).alias("metric"), F.expr(sql).alias("value")) for name, sql, _ in METRICS])
    bucket = F.when(F.col("m.value") <= 0, 0).otherwise(F.ceil(F.log(F.col("m.value").cast("double")) / F.log(F.lit(GAMMA)))).cast("int")
    return (
        counted.select(*by, F.explode(each).alias("m"))
        .select(*by, F.col("m.metric").alias("metric"), bucket.alias("bucket"))
        .groupBy(*by, "metric", "bucket")
        .agg(F.count("*").alias("n"))
    )


def thresholds(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by..., metric, n, fence) from sketches: the fence is upper quartile + FENCE * max(upper quartile - median, least width)."""
    upto = Window.partitionBy(*by, "metric").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by, "metric")
    ranked = sketches.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(whole)})
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), value))
    width = F.create_map(*[F.lit(x) for name, _, least in METRICS for x in (name, float(least))])
    return (
        ranked.groupBy(*by, "metric")
        .agg(F.max("total").alias("n"), at(0.5).alias("median"), at(0.75).alias("upper"))
        .withColumn("fence", F.col("upper") + FENCE * F.greatest(F.col("upper") - F.col("median"), width[F.col("metric")]))
        .select(*by, "metric", "n", "fence")
    )


def group_fences(counted: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row for each group: the columns by and a fence for each metric. Groups too small for a threshold take the merged sketch of the wider group.

    The rows are as many as there are groups; sketches are pre-aggregated in each partition.
    """
    own = written(sketch(counted, list(by)), "sketches")
    out = thresholds(own, list(by))
    for k in range(len(by) - 1, -1, -1):
        wider = thresholds(own.groupBy(*by[:k], "metric", "bucket").agg(F.sum("n").alias("n")), list(by[:k]))
        wider = wider.select(*[F.col(c).alias(f"_{c}") for c in by[:k]], F.col("metric").alias("_metric"), F.col("n").alias("_n"), F.col("fence").alias("_fence"))
        on = F.col("metric") == F.col("_metric")
        for c in by[:k]:
            on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        small = F.col("n") < MIN_GROUP
        out = out.join(wider, on, "left").select(*by, "metric", F.when(small, F.col("_n")).otherwise(F.col("n")).alias("n"), F.when(small, F.col("_fence")).otherwise(F.col("fence")).alias("fence"))
    return out.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == name, F.col("fence"))).alias(f"max_{name}") for name, _, _ in METRICS])


def judge(docs: DataFrame, keep: list[str], by: tuple[str, ...] = ("lang", "source"), text: str = "text", store: bool = True) -> DataFrame:
    """The columns keep, COUNTS, base_failed and kept of every row.

    A row is kept if it passes the base rules and no metric exceeds the fence of its language and source; thresholds are learned from the rows that pass the
    base rules. Null and empty texts have no words and fail; null groups are groups of their own; repeated rows are judged alike, values on the fence are
    kept, columns among keep that have a result's name are replaced; empty tables give no rows.
    store: whether to write the counts once (for a narrow keep) or to count again for the verdicts.
    """
    keep = [c for c in keep if c not in (*COUNTS, "base_failed", "kept")]
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    counted = with_counts(docs.select(*keep, *[F.col(c).alias(n) for c, n in names.items()], text), [*keep, *names.values()], text)
    counted = counted.withColumn("base_failed", base_failed())
    if store:
        counted = written(counted, "counts")
    fences = group_fences(counted.where("not base_failed"), tuple(names.values()))
    fences = written(fences.select(*[F.col(n).alias(f"{n}_") for n in names.values()], *[f"max_{name}" for name, _, _ in METRICS]), "fences")
    if fences.count() <= MAX_BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    on = F.lit(True)
    for n in names.values():
        on &= F.col(n).eqNullSafe(F.col(f"{n}_"))
    fits = F.lit(True)
    for name, sql, _ in METRICS:
        fits &= F.coalesce(F.expr(sql) <= F.col(f"max_{name}"), F.lit(True))
    safe = F.when(F.col("base_failed"), False).otherwise(fits)
    return counted.join(fences, on, "left").withColumn("kept", safe).select(*keep, *COUNTS, "base_failed", "kept")
