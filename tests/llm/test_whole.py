"""Whole jobs: what a bound or a first pass used to leave out."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchlens.llm import graph, lines, simhash, store, syncmers, wordsets
from matchlens.sources import scratch


def _runs(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


@pytest.mark.parametrize("paired", [simhash.PAIRED, 1])
def test_near_copies_leave_the_pipeline(spark, monkeypatch, paired):
    monkeypatch.setattr(wordsets, "PAIRED", paired)
    rng = random.Random(8)
    texts = []
    for group in range(8):
        base = [f"g{group}w{rng.randrange(900)}" for _ in range(rng.randrange(6, 160))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 2, 3))):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(9)}"
            texts.append(" ".join(copy))
    texts += ["one two three", "one two four", "", "one"]
    sets, root = [_runs(t) for t in texts], list(range(len(texts)))
    marks = [simhash.fingerprint(t.encode()) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            like = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if (like >= 0.8 or (marks[i] ^ marks[j]).bit_count() <= 2) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(root)
    assert len(kept) < simhash.one_of_each(docs).count()


def _template_texts(n, places=13, words=100):
    """Distinct texts of one template, in which some places take one of two words each."""
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(words)]
    at = range(3, words, words // places)
    texts = set()
    while len(texts) < n:
        copy = list(plain)
        for i in at:
            copy[i] = rng.choice("xy")
        texts.add(" ".join(copy))
    return sorted(texts)


def _rows_written(spark, monkeypatch, folder, texts):
    monkeypatch.setattr(scratch, "shared_folder", lambda _: f"file://{folder}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    tables = Counter()
    for file in folder.rglob("*.parquet"):
        tables[file.parent.name.split("-")[0]] += pq.ParquetFile(file).metadata.num_rows
    return kept, tables


def _roots(texts):
    sets, marks = [_runs(t) for t in texts], [simhash.fingerprint(t.encode()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            like = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if (like >= 0.8 or (marks[i] ^ marks[j]).bit_count() <= 2) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return set(root)


def test_groups_of_partly_alike_texts_write_no_pairs(spark, monkeypatch, tmp_path):
    found = {}
    for n in (200, 400):
        (tmp_path / str(n)).mkdir()
        texts = _template_texts(n)
        kept, found[n] = _rows_written(spark, monkeypatch, tmp_path / str(n), texts)
        assert kept == _roots(texts)
    assert found[400]["packs"] >= 1
    # twice the texts: about twice the rows, never four times
    for kind in ("entries", "crowded", "open", "pairs", "members", "packs"):
        assert found[400][kind] <= 2.9 * max(found[200][kind], 60), kind
    assert found[400].total() <= 2.9 * found[200].total()


def _mixed_texts(n, words=60):
    """Texts of one length of five words only, so most have a run of five in common with some others
    by chance. Every tenth has a near copy."""
    rng = random.Random(6)
    texts = []
    for i in range(n):
        text = [rng.choice("abcde") for _ in range(words)]
        texts.append(" ".join(text))
        if i % 10 == 0:
            texts.append(" ".join([*text[:-2], f"x{i}", "y"]))
    return texts


def test_runs_shared_by_chance_need_no_whole_sets(spark, monkeypatch, tmp_path):
    rows, write = Counter(), store.written

    def counting(df, kind="table"):
        table = write(df, kind)
        rows[kind] += table.count()
        return table

    for module in (wordsets, simhash, graph):
        monkeypatch.setattr(module, "written", counting)
    texts = _mixed_texts(400)
    kept, _ = _rows_written(spark, monkeypatch, tmp_path, texts)
    assert kept == _roots(texts) and len(kept) < len(texts)
    assert rows["pairs"] > 200 and rows["whole"] <= 100, rows  # 40 near copies


def test_near_pairs_left_apart_are_compared_in_groups(spark, monkeypatch, tmp_path):
    texts, rng = [], random.Random(12)
    for g in range(12):  # too few for a crowded run; a chain of changes, so some are alike and some not
        text = [f"g{g}w{i}" for i in range(70)]
        for i in range(12):
            text = list(text)
            text[rng.randrange(70)] = f"g{g}new{i}"
            texts.append(" ".join(text))
    kept, tables = _rows_written(spark, monkeypatch, tmp_path, texts)
    assert kept == _roots(texts) and tables["rest"] > 0


def test_what_only_one_set_has_is_never_overstated():
    rng = random.Random(10)
    for n in (0, 1, 5, 40, 63, 64, 65, 300, 5000):
        for m in (0, 1, n // 2, n, 2 * n + 3):
            one = {rng.getrandbits(64) - 2**63 for _ in range(n)}
            other = {*rng.sample(sorted(one), min(m, n) * 9 // 10), *(rng.getrandbits(64) - 2**63 for _ in range(m // 10))}
            marks = [wordsets.sketch(np.array(sorted(s), dtype=np.int64)) for s in (one, other)]
            assert wordsets.unlike(*marks) == wordsets.unlike(*marks[::-1]) <= len(one ^ other)
            assert wordsets.unlike(marks[0], marks[0]) == 0
            here = [[(len(s), m)] for s, m in zip((one, other), marks, strict=True)]
            if len(one & other) * 9 >= (len(one) + len(other)) * 4:
                assert [x.tolist() for x in wordsets.maybe_alike(*here)] == [[0], [0]]
            elif max(map(len, marks)) <= 2 * min(map(len, marks)):
                few = wordsets.unlike(*marks) * 9 <= len(one) + len(other)
                assert len(wordsets.maybe_alike(*here)[0]) == few
    far = [wordsets.sketch(np.array([rng.getrandbits(63) for _ in range(400)])) for _ in range(2)]
    assert wordsets.unlike(*far) > 800 // 9


def test_writing_leaves_no_shuffle_files_and_passing_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda _: f"file://{tmp_path}")
    before = spark.conf.get(store.CLEANUP)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    earlier = set(blocks.getAllFiles().mkString(" ").split())
    with store.passing() as kept:
        store.written(spark.range(10), "spent")
        with store.passing() as inner:
            store.written(spark.range(10), "spent")
            table = inner(store.written(spark.range(9).groupBy((F.col("id") % 3).alias("k")).count(), "kept"))
        kept(table)
    for _ in range(50):  # they are removed in the background
        new = set(blocks.getAllFiles().mkString(" ").split()) - earlier
        left = [name for name in new if name.rpartition("/")[2].startswith("shuffle_")]
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert table.count() == 3 and spark.conf.get(store.CLEANUP) == before
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["kept"]


def test_packs_are_compared_exactly():
    rng = random.Random(9)
    base = rng.sample(range(10**9), 90)
    packs = [
        [np.array(sorted({*rng.sample(base, rng.randrange(70, 91)), *rng.sample(range(99), 5)}), dtype=np.int64) for _ in range(n)]
        for n in (40, 25)
    ]
    at, there = wordsets.alike(*packs)
    wanted = [(i, j) for i, a in enumerate(packs[0]) for j, b in enumerate(packs[1])
              if len({*a} & {*b}) * 5 >= len({*a} | {*b}) * 4]
    assert list(zip(at.tolist(), there.tolist(), strict=True)) == wanted and wanted


def test_short_lines_are_compared_for_equality(spark):
    said = [
        "les.\nand ornd.\n\n  \nabcdefgh\nthe cat sat on a mat", "LES.\nother\n\n \nand  ornd.",
        "the cat sat on a hat\na b c d e f g h", "the cat sat on mat\nthe dog sat on a mat",
        "我们今天去公园散步吧", "我们今天去公园跑步吧\n我们明天去公园跑步吧", "👍👍👍👍👍👍👍👍", "💥💥💥💥💥💥💥💥",
        "other x\nles\nab\nabd", "Total: 100 EUR\n2019-01-01\nChapter 10", "Total: 200 EUR\n2019-01-02\nChapter 11",
        "if a > b:", "if a < b:", "Chapter 10\nCHAPTER 11",
        "in the year 2019 all of it was new here\nwe saw the old house by the sea again",
        "in the year 2020 all of it was new here\nwe saw the red house by the sea again",
    ]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    left = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert left == dict(enumerate(said)) | {
        1: "other\n\n ", 13: "", 15: "in the year 2020 all of it was new here",
    }


def _plain_words(rng, n, tag):
    return [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]


def test_fingerprints_of_long_texts_are_whole(spark):
    rng = random.Random(3)
    rows = []
    for key in range(30):
        words, more = _plain_words(rng, 3000, "a"), _plain_words(rng, 3000, "b")
        at, there = rng.randrange(2900), rng.randrange(2900)
        edited = [*words[:at], *more[:60], *words[at + 60 :]]
        quoting = [*more[:there], *words[at : at + 60], *more[there:]]
        rows.append((key, at, there, " ".join(words), " ".join(edited), " ".join(quoting)))
    frame = spark.createDataFrame(rows, "key long, x long, y long, text string, edited string, other string")
    marked = frame
    for text in ("text", "edited", "other"):
        marked = syncmers.with_fingerprint(marked, text, f"m_{text}")
    near = syncmers.likeness(F.col("m_text"), F.col("m_edited"))
    quote = syncmers.likeness(F.col("m_text"), F.col("m_other"))
    for r in marked.select(near.alias("near"), quote.alias("quote")).collect():
        assert 0.9 < r.near < 1.0 and 0.0 < r.quote < 0.05
    found = {r.key: r for r in syncmers.passages(frame, "key", "text", "other").collect()}
    for key, at, there, *_ in rows:
        r = found[key]
        assert r.other_at - r.at == there - at
        assert at <= r.at <= at + 3 and at + 56 < r.at + r.n_words <= at + 60 and r.n_marks >= 15


def test_passages_take_any_name_of_the_key(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, f"x y {words}"), (None, words, words), (3, None, words), (4, "", "")]
    for name in ("at", "mark", "pair", "offset", "n_words"):
        frame = spark.createDataFrame(rows, f"{name} long, text string, other string")
        found = [tuple(r) for r in syncmers.passages(frame, name, "text", "other").collect()]
        assert [(r[0], r[2] - r[1]) for r in found] == [(1, 2)]
    assert syncmers.passages(frame.where("false"), "n_words", "text", "other").count() == 0


def _plain_syncmers(spark, text):
    """Hashes of runs of K words whose least inner run of S words is the first or last of them."""
    words = [w for w in (text or "").lower().split() if w]
    k, s = syncmers.K, syncmers.S
    frame = spark.createDataFrame([(words,)], "w array<string>").select(F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    hashes = frame.first().h
    pairs = [tuple(hashes[i : i + s]) for i in range(len(hashes) - s + 1)]
    inner = [r.v for r in spark.createDataFrame(pairs or [(0, 0)], "a long, b long").select(F.xxhash64("a", "b").alias("v")).collect()]
    chosen = []
    for i in range(len(hashes) - k + 1):
        within = inner[i : i + k - s + 1]
        if min(within) in (within[0], within[-1]):
            chosen.append(i)
    return chosen


def test_syncmers_are_those_of_a_plain_count(spark):
    rng = random.Random(4)
    for n in (5, 6, 40, 300):
        text = " ".join(f"w{rng.randrange(30)}" for _ in range(n))
        frame = spark.createDataFrame([(text,)], "text string")
        found = syncmers.with_syncmers(frame, "text", "out").first().out
        assert [m["at"] for m in found] == _plain_syncmers(spark, text)
        runs = [tuple(text.split()[m["at"] : m["at"] + syncmers.K]) for m in found]
        marks = [m["mark"] for m in found]
        assert len(set(runs)) == len(set(marks)) == len(set(zip(runs, marks, strict=True)))
