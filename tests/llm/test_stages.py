"""Each pipeline stage on odd tables of its own: nulls in every column, repeated rows, clashing extra columns, nothing."""

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

LONG = "A plain sentence of a calm and quiet day in the small town by the river. "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, token string, n long, label int, score double, component_id long, spans string, item_id string"
EXTRAS = (7, "t", 3, 1, 0.5, 9, "email:0:3", "i")


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), *EXTRAS)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = [row(k, f"{LONG}{k} " * 4) for k in range(40)] + [row(100 + k, "!!! ||| ### $$$ " * 30) for k in range(20)]
    rows += [row(3, f"{LONG}3 " * 4)] * 2 + [row(None, f"{LONG}3 " * 4), row(None, None), row(200, None, None, None), row(201, ""), row(202, " \n\t "), row(203, "one"), row(204, "word " * 60_000), row(205, "x" * 300_000)]
    rows += [(None,) * 13] * 2
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, 0, "x") for k in range(40)] + [(100 + k, 0, 0, "x") for k in range(20)] + [(None, 1, 1, None), (1, None, None, None), (999, 0, 1, "x")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    items = [(1, "eight words that none of these texts hold"), (1, "eight words that none of these texts hold"), (2, None), (None, "one two three"), (3, ""), (4, "of these texts")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, odd, name, stage):
    folder, rows = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    got = out.collect()
    if name == "pieces":
        assert len(got) == len(rows) and out.columns[0] == "doc_id"
        # nothing but the begin and end ids where there is no text
        assert all(r.n_tokens >= 2 for r in got) and sum(r.n_tokens == 2 for r in got) >= sum(not r[1] for r in rows)
        return
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    # good rows stay as they are, repeated and without a doc_id too
    plain = f"{LONG}3 " * 4
    assert sum(r.doc_id == 3 and r.text == plain for r in got) == (3 if name != "near_duplicates" else sum(r.doc_id == 3 for r in got)) > 0
    assert sum(r.doc_id is None and r.text == plain for r in got) == 1
    assert all(tuple(r)[5:] in (EXTRAS, (None,) * 8) for r in got)
    if name in ("decontamination", "personal_data"):
        assert len(got) == len(rows)
        assert sorted(map(str, got)) == sorted(map(str, docs.collect()))
    if name == "near_duplicates":
        assert {200, 201, 202, 203, 204, 205} <= {r.doc_id for r in got} and sum(r.doc_id is None for r in got) == 4
        assert sum(r.doc_id is not None and 100 <= r.doc_id < 120 for r in got) == 1
    if name == "quality":
        assert not [r for r in got if r.doc_id is not None and 100 <= r.doc_id < 120]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_nothing(spark, odd, tmp_path, name, stage):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet").limit(0)
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{odd[0]}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.count() == 0 and (name == "pieces" or out.columns == docs.columns)


def test_filters_without_labels_or_items_keep_all(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{odd[0]}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        if name in ("quality", "decontamination"):
            assert stage(spark, docs, str(tmp_path)).count() == len(odd[1])
