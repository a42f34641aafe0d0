"""The pipeline's stages, one after the other, against plain versions of what each decides."""

from test_line_dedup import plain as plain_lines
from test_minhash import plain as plain_near
from test_small_operators import plain_contamination

import corpus_pipeline
from quaymark.llm import queries, sentencepieces
from quaymark.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_every_stage(spark):
    docs = table(spark, SF, "documents")
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "minhash near-dedup", "benchmark decontamination", "sentencepiece"]
    before = {r.doc_id: r for r in docs.collect()}

    quality = written(steps["quality rules"](spark, docs, SF), "t")
    kept = {r.doc_id for r in queries.op5_quality_rules(spark, SF).where("kept").collect()}
    rows = {r.doc_id: r for r in quality.collect()}
    assert quality.columns == columns and rows == {d: before[d] for d in kept}

    lines = written(steps["line dedup"](spark, quality, SF), "t")
    want = plain_lines(spark, [(d, r.text) for d, r in rows.items()])
    rows = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == columns
    assert {d: r.text for d, r in rows.items()} == {d: t for d, (_, n, t) in want.items() if not n or any(c.isalnum() for c in t)}
    assert all(r.n_chars == len(r.text) for r in rows.values())

    near = written(steps["minhash near-dedup"](spark, lines, SF), "t")
    want = {d for d, (_, _, keep) in plain_near([(d, r.text) for d, r in rows.items()], 5).items() if keep}
    rows = {d: rows[d] for d in want}
    assert near.columns == columns and {r.doc_id: r for r in near.collect()} == rows

    clean = written(steps["benchmark decontamination"](spark, near, SF), "t")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hits = plain_contamination([(d, r.text) for d, r in rows.items()], items)
    rows = {d: r for d, r in rows.items() if not hits[d][1]}
    assert clean.columns == columns and {r.doc_id: r for r in clean.collect()} == rows

    model = sentencepieces.read_model()
    out = {r.doc_id: r for r in steps["sentencepiece"](spark, clean, SF).collect()}
    assert set(out) == set(rows) == {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert all(r.round_trip and r.pieces == sentencepieces.encode_batch([r.text], model)[0] for r in out.values())


def test_empty_table_and_extra_columns(spark):
    docs = table(spark, SF, "documents").selectExpr("*", "1 as kept", "'x' as pieces_", "2 as n_words", "3 as n_removed", "4 as n_hit")
    for rows in (docs.limit(0), docs.where("doc_id < 20")):
        for name, stage in corpus_pipeline.STAGES:
            rows = written(stage(spark, rows, SF), "t")
            assert set(docs.columns) <= set(rows.columns), name
        assert rows.where("n_words <> 2 or n_hit <> 4 or kept <> 1").count() == 0


def test_near_stage_with_odd_ids(spark):
    """A near copy goes and another text of its id stays, repeated rows stay, a copy without an id goes, and another text without an id stays."""
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long), (2, long + " more"), (2, "quite another text of the same id " * 3), (None, long), (None, "alone without an id at all here"), (3, "twice the same row of five words"), (3, "twice the same row of five words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = dict(corpus_pipeline.STAGES)["minhash near-dedup"](spark, docs, SF).collect()
    assert sorted(map(str, left)) == sorted(map(str, [r for i, r in enumerate(docs.collect()) if i not in (1, 3)]))
