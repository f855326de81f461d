"""Near matches of benchmark windows against a plain search at every start."""

import random

import pytest
from pyspark.sql import functions as F

from matchlens.llm.decontamination import words_of
from matchlens.llm.proximity import proximity_matches

SIZE, SLACK, MISSING = 5, 2, 2


def _plain(docs, items, size, slack, missing):
    found = {}
    for doc_id, text in docs:
        said = words_of((text or "").encode())
        for item_id, passage in items:
            words = words_of((passage or "").encode())
            n = min(len(words), size)
            for window in {tuple(words[i : i + n]) for i in range(len(words) - n + 1) if n}:
                best = None
                for start in range(-n - slack, len(said) + slack + 1):
                    off = [
                        min((abs(p - start - k) for p, w in enumerate(said) if w == term), default=None)
                        for k, term in enumerate(window)
                    ]
                    near = [d for d in off if d is not None and d <= slack]
                    if len(near) >= n - missing * n // size:
                        best = max(best or (0, 0, 0), (len(near), near.count(0), -start))
                        if best == (len(near), near.count(0), -start):
                            place = start
                if best:
                    found[doc_id, text, item_id, b" ".join(window)] = (place, n, best[0], best[1])
    return found


def _found(spark, docs, items, *rule):
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("window", F.lit(1))
    right = spark.createDataFrame(items, "item_id long, text string")
    rows = proximity_matches(left, right, *rule).collect()
    return sorted(
        (r.doc_id or -1, r.item_id or -1, r.start, r.n_terms, r.n_matched, r.n_in_place) for r in rows
    )


@pytest.mark.parametrize("rule", [(SIZE, SLACK, MISSING), (SIZE, 0, 0), (SIZE, 0, 1)])
def test_near_matches(spark, rule):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 6
    items = [(i, " ".join(rng.choices([*vocabulary, "unheard"], k=rng.randint(1, 9)))) for i in range(12)]
    docs = []
    for i in range(40):
        said = rng.choices(vocabulary, k=rng.randint(0, 25))
        passage = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(passage) + 1)
            passage[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
        at = rng.randint(0, len(said))
        docs.append((i, " ".join(said[:at] + passage + said[at:]).title()))
    items += [(20, None), (21, " .. "), (None, items[0][1])]
    docs += [(50, None), (51, ""), (None, items[1][1]), (None, items[2][1]), (0, docs[0][1])]
    wanted = _plain(docs, items, *rule)
    wanted = sorted((k[0] or -1, k[2] or -1, *v) for k, v in wanted.items())
    found = _found(spark, docs, items, *rule)
    assert found == wanted
    assert any(near < n for *_, n, near, _ in found) == (rule[2] > 0)


def test_long_texts_and_words_away_from_their_place(spark):
    said = "one two three four five six seven eight nine ten eleven twelve thirteen"
    moved = said.replace("six seven", "seven six").replace("two", "2").replace("ten", "so ten")
    docs = [(1, "x " * 200_000 + said), (2, "y " * 7 + moved), (3, " ".join(reversed(said.split())))]
    found = _found(spark, docs, [(9, said)])
    assert found == [(1, 9, 200_000, 13, 13, 13), (2, 9, 7, 13, 12, 6)]


def test_nothing_to_match(spark):
    assert _found(spark, [], [(1, "a b")]) == []
    assert _found(spark, [(1, "a b")], []) == []
    with pytest.raises(ValueError):
        _found(spark, [(1, "a")], [(1, "a")], 5, -1, 0)
