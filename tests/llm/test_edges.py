"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchlens.llm import (
    decontamination,
    html,
    lines,
    packing,
    quality,
    records,
    sharding,
    simhash,
    substrings,
    syncmers,
)
from matchlens.llm.store import fresh_path

LONG = " ".join(f"word{i}" for i in range(4000))
LINE = "one two three four five six seven eight nine ten"
ROWS = [
    (None, None), (None, "no id here"), (None, "no id here"), (1, None), (2, ""), (3, " \n\t "),
    (4, LINE), (4, LINE), (4, "same id, other text\n" + LINE), (5, LONG), (6, LONG), (7, "x"),
    (8, LINE.upper() + "\n" + LINE), (9, "Σίσυφος 中文 é👍 " * 30), (10, "a" * 5000), (11, "\x00\x1c"),
]
CLASHING = ("removed", "keep_id", "bad_id", "bucket", "mark", "component_id", "k_id", "line", "good")


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    return frame.select("*", *[F.lit(name).alias(name) for name in CLASHING]).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (4, 1, 0), (5, 0, 0), (7, 1, 1), (7, 1, 0), (None, 1, 1), (9, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, LINE), (2, None), (3, ""), (None, "word7 word8")],
                                 "item_id long, text string")


def _filtering(docs, labels, benchmark):
    return {
        "quality": lambda d: quality.good_documents(d, labels),
        "near": simhash.one_of_each,
        "clean": lambda d: decontamination.clean(d, benchmark),
        "lines": lines.dedup_lines,
    }


@pytest.mark.parametrize("name", ["quality", "near", "clean", "lines"])
def test_filters_keep_columns_and_take_empty_tables(docs, none, labels, benchmark, name):
    run = _filtering(docs, labels, benchmark)[name]
    kept = run(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert 0 < len(rows) <= len(ROWS)
    assert all(row["good"] == "good" and row["line"] == "line" for row in rows)
    assert run(none).count() == 0


def test_line_dedup(docs):
    left = [(r.doc_id, r.text) for r in lines.dedup_lines(docs).collect()]
    assert len(left) == len(ROWS)
    assert left.count((4, LINE)) + left.count((4, "same id, other text\n" + LINE)) in (1, 2)
    assert (8, "") in left and (6, "") in left and (5, LONG) in left  # case does not matter
    assert left.count((None, None)) == 1 and left.count((None, "no id here")) == 2


def test_near_duplicates(docs):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(ROWS)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert {by_id[i].fingerprint for i in (1, 2, 3)} == {"0" * 16}
    assert {by_id[i].component_id for i in (1, 2, 3)} == {1}
    assert by_id[6].component_id == 5
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()]
    assert (1, None) not in kept or kept.count((1, None)) == 1
    assert (6, LONG) not in kept and (5, LONG) in kept


def test_contamination(docs, none, benchmark):
    found = decontamination.contamination(docs, benchmark).collect()
    assert len(found) == len(ROWS)
    hit = {r.doc_id for r in found if r.n_hit}
    assert hit == {4, 5, 6, 8}
    assert {tuple(r["items"]) for r in found if r.doc_id in (5, 6)} == {()}  # no item_id to list
    assert not any(r.contaminated for r in found if r.doc_id in (5, 6))
    assert all(r.n_words == 0 for r in found if r.doc_id in (1, 2, 3))
    assert decontamination.contamination(none, benchmark).count() == 0
    nothing = decontamination.contamination(docs, benchmark.where("false"))
    assert nothing.where("n_hit > 0").count() == 0


def test_packing(docs, none):
    found = packing.pack_documents(docs, 64).toPandas()
    assert packing.pack_documents(none).count() == 0
    assert (found.length == 64).sum() > 100
    for _, inside in found.sort_values("offset").groupby("sequence_id"):
        assert (inside.offset == inside.length.cumsum() - inside.length).all()
        assert inside.length.sum() <= 64
    assert (found[found.doc_id.isin([1, 2, 3])].length == 1).all()


def test_sharding(docs, none):
    found = sharding.shard_documents(docs, 4).toPandas()
    assert len(found) == len(ROWS) and sharding.shard_documents(none).count() == 0
    for _, inside in found.groupby("shard"):
        assert sorted(inside.slot) == list(range(len(inside)))
    assert found[found.doc_id.isin([5, 6])]["shard"].nunique() == 1
    assert found[found.doc_id.isin([1, 2])]["size"].tolist() == [1, 1]


def test_records(spark, docs, none):
    folder = fresh_path(spark, "records")
    index = records.write_records(docs, folder)
    found = records.read_records(spark, folder).orderBy("start").toPandas()
    assert len(found) == len(ROWS)
    assert (found.start == found.n_tokens.cumsum() - found.n_tokens).all()
    known = [i for i in found.doc_id if i == i]
    assert known == sorted(known) and found.doc_id[:3].isna().all()
    wanted = spark.createDataFrame([(5,), (9,)], "doc_id long")
    again = {r.doc_id: len(r.ids) for r in records.read_selected(index, folder, wanted).collect()}
    assert again == found.set_index("doc_id").n_tokens.loc[[5.0, 9.0]].to_dict()
    empty = fresh_path(spark, "records")
    assert records.write_records(none, empty).count() == 0
    assert records.read_records(spark, empty).count() == 0


def test_substrings(docs, none):
    found = substrings.dedup_substrings(docs).collect()
    assert len(found) == len(ROWS) and substrings.dedup_substrings(none).count() == 0
    by_id = {r.doc_id: r for r in found}
    assert by_id[6].n_removed == by_id[6].n_bytes == len(LONG) and by_id[5].n_removed == 0
    assert (by_id[10].n_removed, by_id[10].n_spans) == (4999, 1)
    assert by_id[1].n_bytes == 0 and by_id[1].sha == hashlib.sha256(b"").hexdigest()


def test_syncmers(docs, none):
    found = syncmers.fingerprint_pairs(docs).collect()
    assert len(found) == len(ROWS) and syncmers.fingerprint_pairs(none).count() == 0
    by_id = {r.doc_id: r for r in found}
    assert by_id[5].fingerprint == by_id[6].fingerprint
    assert by_id[6].near_next == 1.0 and by_id[6].near_edited < 1.0
    assert {by_id[i].fingerprint for i in (1, 2, 3)} == {""}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_quality_without_labels_keeps_all(docs, none, labels):
    assert quality.select(docs, labels.where("false")).count() == len(ROWS)
    assert quality.select(none, labels).count() == 0


def test_pages(spark):
    rows = [(1, None), (2, ""), (3, "a < b"), (None, "<p>x"), (5, "<div>" * 9000 + "deep"), (5, "<b>y")]
    frame = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1))
    found = [(r.page_id, r.text) for r in html.extract_text(frame).collect()]
    assert found == [(1, ""), (2, ""), (3, "a < b"), (None, "x"), (5, "deep"), (5, "y")]
    assert html.extract_text(frame.where("false")).count() == 0


def test_stages_keep_the_columns_of_documents(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    given = docs.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, given, str(tmp_path)).columns == given.columns
        assert stage(spark, given.where("false"), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, given.where("false"), str(tmp_path)).count() == 0
