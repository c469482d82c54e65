"""The n-gram Jaccard join, vector codes and runs of words, each against brute force."""

import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import heavy_light as H
from lamina.llm import queries, tandem
from lamina.llm import vector_codes as VC
from lamina.llm.common import table

# 11 n-gram Jaccard join


def gram_set(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute_components(rows, percent=90):
    sets = [gram_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def joined(spark, rows, **options):
    got = H.joined(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(tuple(r) for r in got.collect())


def variants(rng, n_bases, copies, least=1, most=90):
    rows = []
    for b in range(n_bases):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(least, most))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(copies)):
            words = list(base)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(2))]
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("most", [None, 0, 20, 30])
def test_join_is_that_of_all_pairs(spark, monkeypatch, most):
    rows = variants(random.Random(5), 40, 12)
    if most is not None:
        monkeypatch.setattr(H, "boundary", lambda *a: most)
    assert joined(spark, rows) == brute_components(rows)


def test_join_of_long_lists_and_large_components_in_tiles(spark, monkeypatch):
    for name, value in (("LIST_TILE", 16), ("TILE_SETS", 16), ("TILE_ELEMENTS", 2000)):
        monkeypatch.setattr(H, name, value)
    rng = random.Random(3)
    rows = variants(rng, 6, 3, 60, 90)
    base = [f"b{i}" for i in range(200)]
    for _ in range(120):  # copies that are near their base, but not all near each other
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randint(1, 5)):
            words[at] = f"n{rng.randrange(10**6)}"
        rows.append((10_000 + len(rows), " ".join(words)))
    rows += [(20_000 + i, " ".join(["licence"] * 3 + [f"line{k}" for k in range(60)] + [f"own{i}"] * (i % 2))) for i in range(80)]
    assert joined(spark, rows) == brute_components(rows)


def test_join_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "a b c"), (8, "A  b\x0bc"), (9, "a b c d"), (9, "x y z"), (9, "x y z"), (0, "x\x1cy z"), (10, "É b c"), (11, "é b c")]
    assert joined(spark, rows) == brute_components(rows)
    got = {tuple(r) for r in H.joined(spark.createDataFrame([(None, "a b c"), (3, "a b c"), (2, "a b c")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "key", "sid", "component_id")})).collect()}
    assert got == {(None, 1, None), (3, 1, 2), (2, 1, 2)}
    assert joined(spark, []) == []
    long = " ".join(f"w{i}" for i in range(120_000))
    assert joined(spark, [(1, long), (2, long + " end"), (3, "other")]) == [(1, 119_998, 1), (2, 119_999, 1), (3, 1, 3)]


def test_subset_sizes_cover_all_partners():
    for n, t in itertools.product(range(1, 60), repeat=2):
        if n <= t and 100 * n >= 90 * t:
            m = H.shared(90, n, t)
            assert m in H.subset_sizes(90, n) and m in H.subset_sizes(90, t) and 190 * m >= 90 * (n + t) > 190 * (m - 1)


# 12 vector codes


def brute_codes(rows, dim):
    kept = [(i, np.array([int(np.floor(1024 * np.float64(x))) for x in v], object), lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = dim // 4
    parts = [[v[p * d : (p + 1) * d] for _, v, _ in kept] for p in range(4)]
    order = sorted(range(len(kept)), key=lambda i: kept[i][0])[:256]
    books = [[parts[p][i] for i in order] for p in range(4)]
    near = lambda x, book: min((int(((x - e) ** 2).sum()), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            at = [near(x, books[p])[1] for x in parts[p]]
            for k in set(at):
                own = [x for x, a in zip(parts[p], at, strict=True) if a == k]
                books[p][k] = np.array([int(sum(c)) // len(own) for c in zip(*own, strict=True)], object)
    text = ",".join(str(c) for book in books for e in book for c in e)
    found = [[near(x, books[p]) for x in parts[p]] for p in range(4)]
    errors = [sum(found[p][i][0] for p in range(4)) for i in range(len(kept))]
    by_label = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    sha = hashlib.sha256(text.encode()).hexdigest()
    return sorted(((kept[i][0], "".join(f"{found[p][i][1]:02x}" for p in range(4)), errors[i], by_label[kept[i][2]], sha) for i in range(len(kept))), key=str)


def codes(spark, rows):
    return sorted((tuple(r) for r in VC.coded(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")).collect()), key=str)


def test_codes_are_those_of_all_distances(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8) / (1 + i % 5)], int(i % 3) if i % 7 else None) for i in rng.permutation(600)]
    rows[5] = (rows[5][0], None, 1)
    rows[6] = (rows[6][0], [None] + rows[6][1][1:], 1)
    rows[7] = (rows[7][0], [float("nan")] + rows[7][1][1:], 1)
    rows[8] = (rows[8][0], [float("inf")] + rows[8][1][1:], 1)
    rows[9:40] = [(i, [0.5] * 8, 0) for i, *_ in rows[9:40]]  # ties
    rows[40] = (rows[40][0], [0.0] * 8, None)
    assert codes(spark, [(*r, "x") for r in rows]) == brute_codes(rows, 8)
    few = rows[100:130]
    assert codes(spark, [(*r, "x") for r in few]) == brute_codes(few, 8)


def test_codes_of_odd_rows(spark):
    assert codes(spark, []) == [] and codes(spark, [(1, None, 1, ""), (2, [float("nan")] * 4, 1, "")]) == []
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 1, ""), (2, [1.0, 2.0], 1, ""), (3, [], 2, ""), (4, [1e30] * 4, None, ""), (1, [1.0, 2.0, 3.0, 4.0], 1, ""), (None, [1.0, 2.0, 3.0, 5.0], None, "")]
    got = {(r[0], r[1], r[2], r[3]) for r in codes(spark, rows)}
    assert got == {(1, "00000000", 0, 0), (2, None, None, 0), (3, None, None, None), (4, None, None, 0), (None, "00000002", 0, 0)}


def test_the_annulus_leaves_entries_out_and_loses_none():
    rng = np.random.default_rng(7)
    entries = rng.integers(-1000, 1000, (256, 16)) * rng.integers(1, 30, (256, 1))
    x = np.concatenate([entries[rng.integers(0, 256, 500)] + rng.integers(-40, 40, (500, 16)), entries[:20]])
    index, best, measured = VC.Codebook(entries).nearest(x)
    d = ((x[:, None].astype(object) - entries[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
    assert measured < len(x) * 256 / 4


# 13 runs


def brute_runs(words, length=24, exponent=3):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and not any(q % b == 0 and a <= i and a + m >= j + q for a, m, b in found):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted((r for r in found if r[1] >= max(length, exponent * r[2])), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("length", "exponent"), [(24, 3), (6, 2), (1, 2), (9, 3), (8, 4)])
def test_runs_are_those_of_all_periods(length, exponent):
    rng = random.Random(length * exponent)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            s = [rng.randrange(rng.choice([2, 3, 60])) for _ in range(rng.randint(0, 40))]
            for _ in range(rng.randrange(3)):
                p = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
                at = rng.randint(0, len(s))
                s[at:at] = (p * 9)[: rng.randint(5, 60)]
            texts.append(s)
        ids, of, want, start = np.array(sum(texts, []), np.int64), np.repeat(np.arange(len(texts)), [len(s) for s in texts]), [], 0
        for s in texts:
            want += [(a + start, b, c) for a, b, c in brute_runs(s, length, exponent)]
            start += len(s)
        assert [tuple(r) for r in tandem.runs_of(ids, of, length, exponent).tolist()] == want


def test_every_square_is_in_the_vocabulary():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randint(1, 25))]
        t = np.array([*s, 2])
        ext = tandem.Extensions(t)
        tree = tandem.SuffixTree(t, ext)
        got = {tuple(s[tree.first[v] : tree.first[v] + n]) for v, n in tandem.vocabulary(tree, *tandem.leftmost_cover(ext, tandem.lempel_ziv(ext)))}
        assert got == {tuple(s[i : i + 2 * k]) for k in range(1, len(s)) for i in range(len(s) - 2 * k + 1) if s[i : i + k] == s[i + k : i + 2 * k]}


def brute_digest(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = brute_runs([known[w] for w in words])
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_run_query_on_whole_table(spark, tmp_path):
    """All documents of the smallest tables but the longest, and odd ones."""
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect() if len(r.text or "") < 6000]
    line = " ".join(f"l{i}" for i in range(11))
    docs += [(1001, None), (1002, ""), (1003, "ha " * 5000), (1004, f"x {' '.join([line] * 9)} y {' '.join([line] * 4)}"), (1005, " ".join(["a b"] * 12)), (1006, " ".join(["a b"] * 11) + " a"), (1004, "é " * 30)]
    spark.createDataFrame(docs, "doc_id long, text string").withColumns({"runs": F.lit(1), "collapsed": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_tandem_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((brute_digest(*d) for d in docs), key=str)
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_of_odd_frames(spark):
    odd = spark.createDataFrame([(None, "b " * 40, 1, 2)], "doc_id long, text string, `a.b` int, c0 int")
    row = tandem.find_runs(odd).first()
    assert row["runs"] == [(0, 40, 1)] and row["collapsed"] == "b" and row["a.b"] == 1
    assert tandem.find_runs(odd.limit(0)).count() == 0
    assert tandem.digest(tandem.find_runs(odd.withColumn("text", tandem.with_planted_runs(F.col("doc_id"), F.col("text"))))).first().n_runs == 1


def test_vectors_are_read_from_arrow_slices():
    column = pa.array([[1.0, 2.0, 3.0, 4.0], None, [5.0, None, 1.0, 1.0], [0.5] * 4, []], pa.list_(pa.float32()))
    kept, coded, x = VC.integer_vectors(column.slice(1), 4)
    assert kept.tolist() == [False, False, True, True] and coded.tolist() == [False, False, True, False] and x.tolist() == [[512] * 4]
