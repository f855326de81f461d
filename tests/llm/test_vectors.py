"""Operators 11 to 13 against plain versions of their rules."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlens.llm import divergence, quantize, topk

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def _vectors(seed, n, width, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        centre = rng.choice(centres)
        rows.append((i, [scale * round(c + rng.gauss(0, 0.2), 2) for c in centre], rng.choice([None, 1, 2])))
    return rows


ODD = [(0, None, 1), (50, [NAN] * 8, 1), (51, [INF] + [0.0] * 7, 1), (52, [None] + [0.0] * 7, 2),
       (100, [], None), (100, [0.5], 7), (None, [0.25] * 8, None), (None, [0.25] * 8, None),
       (3, [1.0] * 8, 1), (3, [1.0] * 8, 1), (50, [1.0] * 8, 1), (50, [1.0] * 8, 1)]


def _whole(vector, width):
    return [math.floor(256 * x) for x in vector] + [0] * (width - len(vector))


def _kept(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def _clip(n):
    return min(max(n, -(1 << 63)), (1 << 63) - 1)


def _nearest(rows, k, every):
    kept = _kept(rows)
    width = max((len(r[1]) for r in kept), default=0)
    whole = [_whole(r[1], width) for r in kept]
    found = Counter()
    for i, (q, _, _) in enumerate(kept):
        if q is None or q % every:
            continue
        ranked = sorted(
            (-_clip(sum(a * b for a, b in zip(whole[i], w, strict=True))), c[0] is None, c[0] or 0)
            for j, (w, c) in enumerate(zip(whole, kept, strict=True)) if j != i
        )
        for rank, (score, none, vec_id) in enumerate(ranked[:k], 1):
            found[q, rank, None if none else vec_id, -score] += 1
    return found


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("rows, every", [
    (_vectors(1, 400, 24), 10), (_vectors(2, 300, 7) + ODD, 25), (ODD, 50), (_vectors(3, 120, 8, 1e12), 6),
    (_vectors(4, 60, 4, 1e300), 6), (_vectors(5, 3, 2), 1),
])
def test_nearest(spark, monkeypatch, rows, every):
    width = max(len(r[1]) for r in rows if r[1])
    monkeypatch.setattr(topk, "BLOCK_CELLS", 16 * width)  # several blocks of queries
    got = topk.nearest(_frame(spark, rows), F.col("vec_id") % every == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == _nearest(rows, 5, every)


def test_nearest_of_nothing(spark):
    nothing = _frame(spark, ODD[:4])
    assert topk.nearest(nothing, F.col("vec_id") % 2 == 0).count() == 0
    assert topk.nearest(nothing.where("false"), F.lit(True)).count() == 0


def test_bounds_drop_candidates_and_lose_none():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 300, (20, 64))
    rows = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(0, 20, (1000, 64)))
    queries, candidates = topk.Side(rows[::100]), topk.Side(rows)
    real = topk.scores(queries.rows, candidates.rows)
    least = np.sort(real, axis=1)[:, -5]
    alive = topk.survivors(queries, slice(0, 10), candidates, least)
    assert (alive | (real < least[:, None])).all()
    assert alive.mean() < 0.2


def _codes(rows, parts, entries, rounds):
    kept = _kept(rows)
    longest = max((len(r[1]) for r in kept), default=1)
    width = -(-max(longest, 1) // parts) * parts
    length = width // parts
    whole = [_whole(r[1], width) for r in kept]
    cut = [[w[p * length : (p + 1) * length] for p in range(parts)] for w in whole]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    books = [[list(cut[i][p]) for i in order[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        members = defaultdict(list)
        for c in cut:
            for p in range(parts):
                members[p, nearest(p, c[p])[1]].append(c[p])
        for (p, k), xs in members.items():
            books[p][k] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    found, labels = [], Counter()
    for r, c in zip(kept, cut, strict=True):
        best = [nearest(p, c[p]) for p in range(parts)]
        error = sum(b[0] for b in best)
        labels[r[2]] += error
        found.append((r[0], "".join(f"{b[1]:02x}" for b in best), _clip(error), r[2]))
    return Counter((*f[:3], _clip(labels[f[3]]), digest) for f in found)


@pytest.mark.parametrize("rows, parts, entries", [
    (_vectors(1, 300, 24), 4, 16), (_vectors(2, 200, 7) + ODD, 3, 64), (ODD, 16, 64),
    (_vectors(3, 80, 8, 1e12), 2, 8), (_vectors(6, 150, 15), 5, 1),
])
def test_codes(spark, rows, parts, entries):
    got = quantize.compress(_frame(spark, rows), parts=parts, entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == _codes(rows, parts, entries, 2)


def test_codes_of_nothing(spark):
    assert quantize.compress(_frame(spark, ODD[:4])).count() == 0


def test_transform_scales_distances():
    for size in (1, 2, 4, 16):
        matrix = quantize.sequency_order(size)
        assert (matrix @ matrix.T == size * np.eye(size)).all()
        assert [(np.diff(r) != 0).sum() for r in matrix] == list(range(size))


def _documents(seed, n, sources):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Ünï", "中文", "ELSE"]
    rows = []
    for i in range(n):
        chosen = [words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(rng.randrange(40))]
        text = rng.choice([" ", ", ", "1\x00"]).join(chosen)
        rows.append((i, text, rng.choice(["en", "de", None]), f"s{rng.randrange(sources)}", "x"))
    return rows


EXTRA = [(1, None, "fr", None, "x"), (1, "", "fr", "a", "x"), (2, "a " * 5000, None, None, "x"),
         (2, "a " * 5000, None, None, "x"), (3, "only", "it", "one", "x"), (4, "1 2 3", "", "", "x")]


def _audit(rows, least, top):
    tokens = []
    for _, text, lang, source, _ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        tokens.append((lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)))
    found = []
    for lang in {t[0] for t in tokens}:
        docs = Counter(w for t in tokens if t[0] == lang for w in set(t[2]))
        kept = sorted(w for w, n in docs.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, words in (t for t in tokens if t[0] == lang):
            counts[source].update(w for w in words if w in kept)
        whole = sum(counts.values(), Counter())

        def share(c, kept=kept):
            n = sum(c.values()) + 5 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 5) // n for w in kept}

        q, p = share(whole), {s: share(c) for s, c in counts.items()}
        for s in p:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in p if o != s]
            terms = [(q[w] - p[s][w], w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, _, item) in enumerate(sorted(items)[:most], 1):
                    found.append((lang, s, part, item, -value, rank))
    return sorted(found)


@pytest.mark.parametrize("rows, least, options", [
    (_documents(1, 300, 5) + EXTRA, 5, {}), (_documents(2, 300, 9) + EXTRA, 3, {"block": 4, "together": 2}),
    (_documents(3, 40, 3) + EXTRA, 30, {"top": 3}), (EXTRA, 1, {"block": 1}), (EXTRA, 99, {}),
])
def test_audit(spark, rows, least, options):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, value string")
    got = divergence.audit(frame.repartition(3), least, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == _audit(rows, least, options.get("top", 50))
    assert divergence.audit(frame.where("false")).count() == 0


def test_shared_trees_hold_few_nodes():
    counts = np.zeros((30, 4096), dtype=np.int64)
    counts[:, :16] = np.random.default_rng(0).integers(1, 3, (30, 16))
    forest = divergence.Forest(counts)
    assert sum(c.shape[1] for c in forest.children) < 500
    mine, theirs, times = forest.pairs_of_leaves(0, 1)
    assert times.sum() == 4096 and len(mine) <= 5
    large = np.array([10**13])
    assert divergence.prices(large, 10**14, 7)[0] == 1 + 10**9 * (10**13 + 5) // (10**14 + 35)
