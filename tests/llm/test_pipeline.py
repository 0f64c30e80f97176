from __future__ import annotations

import pytest

import corpus_pipeline
from mnemoflow.llm import mixing, personal_data, quality, scratch
from mnemoflow.llm.catalog import fold
from tests.llm.test_operators import KIND, LOWER, ROWS, WORD, plain_components, prose, windows_of


UPPER = {v: k for k, v in ((k, ord(c)) for k, c in LOWER.items())}


@pytest.fixture(scope="module")
def rows(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages_take_effect(spark, sf, rows):
    """run() against a plain version of each stage."""
    docs = [tuple(r) for r in rows.collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(fold("doc_id", 5) != 0)
    good = {r.doc_id for r in quality.score(rows, quality.fit(rows, labels), ["doc_id"]).collect() if r.score >= 0.3}
    docs = [d for d in docs if d[0] in good]
    first = {d for d, _, c, _ in plain_components(docs, 5, 80) if d == c}
    docs = [d for d in docs if d[0] in first]
    windows = {w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in windows_of(WORD.findall(r.text.translate(LOWER)), 10)}
    docs = [d for d in docs if not windows & set(windows_of(WORD.findall(d[1].translate(LOWER)), 10))]
    model = personal_data.fit(spark.createDataFrame(docs, rows.schema))
    sizes = {d[0]: len(personal_data.mask(d[1], personal_data.all_spans(d[1], {}, model)[1]).split()) for d in docs}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert {k: r["size"] for k, r in got.items()} == sizes
    assert sum(r.taken for r in got.values()) == pytest.approx(sum(sizes.values()), abs=len(got))


def test_stages_keep_columns_and_survive_awkward_rows(spark, sf):
    docs = spark.createDataFrame([*ROWS, (None, "no id at all", "en", "a", 12, "clash", 1, 1), (None, "no id at all", "en", "a", 12, "clash", 1, 1)], KIND)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.where("doc_id IS NULL").count() == (1 if name == "near copies" else 2), name
        empty = stage(spark, docs.where("false"), sf)
        assert empty.columns == docs.columns and empty.count() == 0, name
    near = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert [r.doc_id for r in near.where("doc_id IN (0, 1)").collect()] == [0]
    assert corpus_pipeline.mix_sources(spark, docs, sf).count() == docs.count()


def test_rows_are_judged_by_their_own_text(spark, sf):
    """Unrelated texts under one id, or none, stay; copies among them go; wordless texts stay."""
    own = [prose(40, 900 + k) for k in range(5)]
    rows = [(5, own[0]), (5, own[1]), (6, own[2]), (None, own[3]), (None, own[4]), (None, own[2]), (7, own[4] + " end"), (5, own[1]), (5, own[1].translate(UPPER)), (8, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0, "", 0, 0) for i, t in rows], KIND).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()), key=str)
    assert [x for x in got if x[1] and x[0] != 5] == [(6, own[2]), (7, own[4] + " end"), (None, own[3])]
    assert [x for x in got if not x[1]] == [(8, ""), (8, ""), (8, None)]
    fives = [t for i, t in got if i == 5]
    assert len(fives) == 2 and own[0] in fives and {t.translate(LOWER) for t in fives} == {t.translate(LOWER) for t in own[:2]}


def test_contaminated_rows_go_and_their_namesakes_stay(spark, tmp_path):
    item, clean = prose(30, 950), prose(30, 951)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, item), (1, clean), (None, "so " + item), (None, clean)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0, "", 0, 0) for i, t in rows], KIND)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()), key=str)
    assert got == [(1, clean), (None, clean)]


def test_stages_can_be_chained_before_any_is_written(spark, sf, rows):
    lazily = rows
    for _, stage in corpus_pipeline.STAGES:
        lazily = stage(spark, lazily, sf)
    columns = ["doc_id", "size", "source_size", "target", "taken", "text"]
    once = corpus_pipeline.run(spark, sf)
    again = corpus_pipeline.run(spark, sf)
    want = sorted(map(str, once.select(columns).collect()))
    assert sorted(map(str, lazily.select(columns).collect())) == sorted(map(str, again.select(columns).collect())) == want


def test_run_leaves_nothing_but_its_result(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda _: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, sf)
    assert len(list((tmp_path / "mnemoflow").iterdir())) == 1
    assert out.count() > 0


def test_the_result_holds_the_mixed_texts(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    for r in rows:
        assert sum(p["last"] - p["first"] for p in r.pieces) == r.taken
    words = sum(len(r.text.split()) for r in mixing.stream(out).collect())
    assert words == sum(r.taken for r in rows)
    slots = [r.slot for r in mixing.stream(out).select("slot").collect()]
    assert slots == sorted(slots)
