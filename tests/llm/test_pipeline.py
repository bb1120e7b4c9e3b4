import glob

import corpus_pipeline
from pointloom.llm import line_dedup, poisson_mix, quality, simhash, wfst_pieces
from pointloom.llm.queries import oracle_sql, queries
from tests.llm.cases import edge, empty


def test_stages_and_run(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mix", "pieces"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, step = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in step.collect()}
        step = spark.createDataFrame(stage(spark, step, sf_dir).collect(), docs.schema)
        assert step.columns == columns and {r["doc_id"] for r in step.collect()} <= before, name
    want = sorted((r["doc_id"], r["text"]) for r in step.collect())
    out = corpus_pipeline.run(spark, sf_dir)
    texts = wfst_pieces.decode_ids(out, wfst_pieces.model_bytes())
    assert sorted((r["doc_id"], r["text"]) for r in texts.collect()) == want and want


def texts_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_each_stage_over_odd_rows(spark, sf_dir):
    """Nulls, empty and long texts, repeats: what each stage keeps, and that empty tables stay empty."""
    rows, none = edge(spark, extra=False), empty(spark)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).collect() == [], name
    good = stages["quality"](spark, rows, sf_dir)
    assert set(texts_of(good)) <= set(texts_of(rows)) and not [r for r in good.collect() if not (r["text"] or "").strip()]
    line = "a shared line of text."
    lost = {r["doc_id"]: r["text"] for r in stages["line_dedup"](spark, rows, sf_dir).collect()}
    assert [i for i, t in lost.items() if line in (t or "").lower()] == [1] and lost[3] is None and lost[None] == ""
    assert lost[2] == "something else entirely\n\n" and len(lost[5]) > 0 and lost[6] == ""
    left = [r["doc_id"] for r in stages["near_duplicates"](spark, rows, sf_dir).collect()]
    assert sorted(left, key=str) == [1, 2, 3, 5, 8, 8, None]
    mixed = stages["mix"](spark, rows, sf_dir)
    assert mixed.columns == rows.columns and set(texts_of(mixed)) <= set(texts_of(rows))
    pieces = stages["pieces"](spark, rows, sf_dir)
    assert pieces.count() == rows.count() and all(r["decodes"] for r in pieces.collect()) and all((r["n_pieces"] == 0) == (r["doc_id"] in (3, 4)) for r in pieces.collect())


def test_stages_leave_no_rows_behind(spark, sf_dir):
    folder = spark.sparkContext.getCheckpointDir()
    before = set(glob.glob(f"{folder.removeprefix('file:')}/pipeline-*/*"))
    corpus_pipeline.run(spark, sf_dir).count()
    assert [f.rsplit("/", 1)[1] for f in set(glob.glob(f"{folder.removeprefix('file:')}/pipeline-*/*")) - before] == ["3-mix"]


def test_registry():
    names = queries()
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])) and "pipeline" in names
    assert set(oracle_sql()) <= set(names)
    assert all(m.__doc__ for m in (line_dedup, poisson_mix, quality, simhash, wfst_pieces))
