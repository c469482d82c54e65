"""Brute force, round trips and edge cases of the operators over documents."""

import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lamina.llm import decontam, mixing, quality, simhash, suffix, toxicity
from lamina.llm.common import pieces
from lamina.llm.components import components

DOCS = "doc_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def word_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# 1 SimHash


def brute_print(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, bits=4):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((root(ids[a]), root(ids[b])))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_simhash_against_brute_force(spark):
    rng = random.Random(1)
    base = [word_text(rng, rng.randrange(1, 600)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " tail") for i, t in enumerate(base)] + [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "oNE"), (0, base[0])]
    got = simhash.near_duplicates(docs(spark, rows).withColumn("fp", F.lit(1)), simhash.EXACT_64).select("doc_id", simhash.hex_digits().alias("h"), "component_id").collect()
    assert len(got) == len(rows)
    text = dict(rows)
    ids = sorted(text)
    want = brute_components(ids, [brute_print(text[i]) for i in ids])
    for r in got:
        assert int(r.h, 16) == brute_print(text[r.doc_id]) and r.component_id == want[r.doc_id]
    assert simhash.near_duplicates(docs(spark, []), simhash.EXACT_64).count() == 0


def test_forest_finds_every_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 60)
    monkeypatch.setattr(simhash, "TILE_ROWS", 100)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    near = base[:400].copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    prints = np.unique(np.concatenate([base, near]))
    nodes = spark.createDataFrame([(i, [int(x)]) for i, x in enumerate(prints.view(np.int64))], "id long, fp array<long>")
    got = {r.node: r.component for r in components(simhash.link(nodes, simhash.EXACT_64)).collect()}
    a, b = simhash.shard_links(np.arange(len(prints)), prints[:, None], 4)
    want = dict(zip(a.tolist(), b.tolist())) | {int(x): int(x) for x in b}
    assert got == want


def word_sets(text, k=5):
    words = text.split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def test_equal_prints_are_not_equal_sets(spark):
    rng = random.Random(5)
    line = "the same nine words stand on every line here "
    rows = [(i, line * 60 + word_text(rng, 60, 10**6)) for i in range(8)]  # prints over repeats are all the line's
    own = word_text(rng, 300, 10**6)
    rows += [(20, f"{line * 2}{own}"), (21, f"{line * 60}{own}")]  # equal sets, other counts
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()}
    assert word_sets(rows[8][1]) == word_sets(rows[9][1])
    assert kept == {*range(8), 20}


@pytest.mark.parametrize("n, tile", [(400, 1024), (300, 64)])
def test_near_dedup_of_many_variants_against_brute_force(spark, monkeypatch, n, tile):
    monkeypatch.setattr(simhash, "VERIFY_ROWS", tile)
    rng = random.Random(n)
    base = [f"b{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):  # about 0.85 from the base, 0.73 from each other
        words = base.copy()
        for at in rng.sample(range(300), 5 if i % 3 else 8):  # those with 8 changes are near no one
            words[at] = f"c{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    sets = [word_sets(t) for _, t in rows]
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            if (common := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - common) and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    want = {i for i in range(n) if label[i] == i}
    assert 1 < len(want) < n / 2
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()} == want


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    changed = words.copy()
    changed[200] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, word_text(rng, 300, 5000)), (4, " ".join(words)), (4, " ".join(words)), (3, word_text(rng, 300, 5000)), (None, "x y")]
    kept = simhash.drop_near_duplicates(docs(spark, rows).withColumn("lang", F.lit("en")))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3 quality


def test_ordinal_thresholds_and_grades():
    rng = np.random.default_rng(0)
    texts = ["plain words in a line " * 5, "SHOUT!! SHOUT!! " * 5 + "plain words in a line " * 3, "### $$$ ### $$$ " * 6]
    y = rng.integers(0, 3, 240)
    rows = [quality.text_features(texts[2 - g] + " " + " ".join(f"k{v}" for v in rng.integers(0, 99, 5))) for g in y]
    m = quality.fit_ordinal(rows, y)
    assert m.thresholds[0] < m.thresholds[1]
    tails = m.tails(np.array([float(m.weights[a].astype(float) @ v) for a, v in rows]))
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert (np.abs(m.expected(tails) - y) < 0.6).mean() > 0.95


def test_quality_edge_cases(spark):
    rows = [(i, "good calm prose here " * 8) for i in range(40)] + [(100 + i, "BAD!! $$$ ### " * 8) for i in range(40)] + [(200, None), (201, ""), (0, "good calm prose here " * 8)]
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(30)] + [(None, 1), (5, None)], "doc_id long, quality int")
    d = docs(spark, rows).withColumn("tail_prob", F.lit(9.0))
    scored = quality.score(d, quality.fit(d, labels))
    assert scored.count() == len(rows) and scored.where("tail_prob < 0 OR tail_prob > 1").count() == 0
    kept = {r.doc_id for r in quality.select_quality(d, labels).collect()}
    assert set(range(40)) <= kept and not kept & set(range(100, 140))
    one = quality.fit(d, labels.where("quality = 1"))
    assert quality.score(d, one).where("tail_prob < 0.5").count() == 0
    assert quality.score(d.limit(0), one).count() == 0
    assert quality.score(d, quality.fit(d, labels.limit(0))).count() == len(rows)


def test_quality_on_unseen_rows(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = quality.fit(d, labels.where("doc_id % 2 = 0"))
    got = quality.score(d, m).join(labels.where("doc_id % 2 = 1"), "doc_id").selectExpr("avg(int((tail_prob >= 0.5) = (quality = 1))) AS a").first().a
    assert got > 0.95


# 4 mixing


def test_mixing_rates_and_determinism(spark):
    d = spark.range(20000).selectExpr("id AS doc_id", "string(id) AS text", "if(id % 3 = 0, 'hot', 's' || id % 7) AS source", "bigint(10) AS n_chars")
    weights = {"hot": 0.1} | {f"s{i}": 0.9 / 7 for i in range(7)}
    got = mixing.mix(d, weights)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["hot"] / 2000 - 1) < 0.1 and abs(sum(n.values()) / 20000 - 1) < 0.05
    again = mixing.mix(d.repartition(7), weights)
    assert got.select("doc_id", "replica", "mix_key").exceptAll(again.select("doc_id", "replica", "mix_key")).count() == 0
    keys = [r.mix_key for r in got.where("spark_partition_id() = 0").collect()]
    assert keys == sorted(keys)
    assert mixing.mix(d, {"hot": 1.0}).where("source != 'hot'").count() == 0
    large = mixing.mix(d.where("doc_id < 30"), volume=300.0).groupBy("doc_id").count().selectExpr("avg(count) a").first().a
    assert abs(large / 300 - 1) < 0.6


def test_mixing_edge_cases(spark):
    schema = "doc_id long, text string, source string, n_chars long, replica int"
    d = spark.createDataFrame([(1, "a", None, 1, 0), (1, "a", None, 1, 0), (None, None, "s", None, 0), (2, "", "s", 0, 5)], schema)
    got = mixing.mix(d, volume=3.0)
    assert got.columns == ["doc_id", "text", "source", "n_chars", "replica", "mix_key"]
    by = collections.Counter((r.doc_id, r.replica) for r in got.collect())
    assert all(n == 2 for (i, _), n in by.items() if i == 1)
    assert mixing.mix(d.limit(0)).count() == 0


# 6 suffixes


def brute_cut(rows, n=400):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for (i, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("small", "n"), [(False, 400), (True, 400), (True, 256)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, small, n):
    if small:  # pieces, runs and ranges so small that all the ways of splitting are taken
        monkeypatch.setattr(suffix, "PIECE", 1000)
        monkeypatch.setattr(suffix, "RUN", 50)
        monkeypatch.setattr(suffix, "RANGE_ROWS", 5)
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    parts = [some(n) for n in (250, 257, 395, 399, 400, 401, 655, 900)]
    rows = [(i, some(rng.randrange(600)) + rng.choice(parts) + some(rng.randrange(500)) + rng.choice(parts)[rng.randrange(60) :]) for i in range(50)]
    rows += [(500, None), (501, ""), (502, "a" * 1500), (503, "ab" * 500), (504, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (505, "é" * 300)]
    d = docs(spark, rows).repartition(3).withColumn("spans", F.lit(1)).withColumn("kept", F.lit("x"))
    got = suffix.remove_repeats(d, n).select(F.col("doc_id").cast("string"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute_cut(rows, n)


@pytest.mark.parametrize("n", [400, 450])
def test_hot_passages_between_different_texts_make_no_large_group(spark, monkeypatch, n):
    monkeypatch.setattr(suffix, "RANGE_ROWS", 60)
    dealt, made = suffix.dealt_cells, []
    monkeypatch.setattr(suffix, "dealt_cells", lambda *a: made.append(dealt(*a)) or made[-1])
    rng = random.Random(6)
    some = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    hot = some(n)
    rows = [(i, some(150) + hot + some(150)) for i in range(400)]
    d = docs(spark, rows).repartition(8)
    got = suffix.remove_repeats(d).select(F.col("doc_id").cast("string"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect())) == brute_cut(rows)
    sizes = made[0].groupBy("deal").agg(F.countDistinct("context").alias("n"), F.count(F.lit(1)).alias("rows")).agg(F.max("n"), F.max("rows")).first()
    assert sizes[0] <= 60 < 400 <= sizes[1]


def test_suffix_dedup_of_nothing(spark):
    assert suffix.remove_repeats(docs(spark, [])).count() == 0
    text = suffix.remove_repeats(docs(spark, [(1, "é" * 250 + "x"), (2, "é" * 250 + "y")]), as_text=True)
    assert {r.doc_id: r.kept for r in text.collect()} == {1: "x", 2: "y"}


def test_loser_tree_and_front_coding():
    rng = random.Random(5)
    strings = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(60))) for _ in range(300))
    runs = [[] for _ in range(5)]
    for x in strings:
        rng.choice(runs).append(x)
    merged = list(suffix.merge_runs([suffix.front_decode(*suffix.front_code(r)) for r in runs]))
    out = [runs[r][i] for r, i, _ in merged]
    assert out == strings
    assert [n for _, _, n in merged[1:]] == [suffix.common(a, b, 0) for a, b in zip(out, out[1:])]


# 9 toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    calm = [f"{a}{b}" for a in "table river garden window music letter winter".split() for b in ("", "s", "ing", "ed", "ly")]
    bad = ["vilescum", "wretch", "hatemonger"]

    def text(toxic):
        words = [rng.choice(calm) for _ in range(rng.randrange(20, 80))]
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        return " ".join(words)

    y = [int(rng.random() < 0.3) for _ in range(400)]
    d = docs(spark, [(i, text(t)) for i, t in enumerate(y)] + [(900, None), (901, ""), (0, "table")]).withColumn("toxic_score", F.lit("x"))
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(y)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    scored = toxicity.score(d, toxicity.fit(d, labels)).withColumn("held", toxicity.held_out("doc_id"))
    rows = [r for r in scored.collect() if r.doc_id < 900 and r.text != "table"]
    held = [r for r in rows if r.held]
    assert scored.count() == 403 and 40 < len(held) < 120
    assert np.mean([(r.toxic_score >= 0.5) == bool(y[r.doc_id]) for r in held]) > 0.75
    bad_, good = ([r.toxic_score for r in held if y[r.doc_id] == v] for v in (1, 0))
    assert np.mean([a > b for a in bad_ for b in good]) > 0.85
    only = toxicity.fit(d, labels.where("toxic = 0"))
    assert toxicity.score(d, only).where("toxic_score > 0.5").count() == 0
    assert toxicity.score(d.limit(0), only).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    d = spark.range(200).selectExpr("id AS doc_id", "'some text' AS text")
    assert toxicity.training_rows(d, labels).where(toxicity.held_out("doc_id")).count() == 0


def test_windows_cover_every_byte_and_start_at_words():
    rng = random.Random(14)
    texts = [toxicity.folded("".join(rng.choice("abcdefg  .é") for _ in range(rng.randrange(200)))) for _ in range(60)] + [toxicity.folded(None), toxicity.folded("x" * 5000)]
    data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
    first = ends - [len(t) for t in texts]
    starts = toxicity.window_starts(data, first)
    covered = np.zeros(len(data), bool)
    for s in starts:
        e = ends[np.searchsorted(first, s, side="right") - 1]
        covered[s : min(s + toxicity.WINDOW, e)] = True
    assert covered.all() and (np.diff(starts) > 0).all()
    words = [m.start() - 1 for m in re.finditer(rb"(?<![a-z\x80-\xff])[a-z\x80-\xff]{%d}" % toxicity.LETTERS, data)]
    assert set(words) <= set(starts.tolist())
    model = toxicity.CompressionModel(toxicity.WindowLengths(b"abc def"), toxicity.WindowLengths(b"gfe dcb"), np.zeros(7))
    together, alone = model.distances(texts), [model.distances([t])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(together, alone, strict=True))


def test_pieces_of_long_rows():
    data = bytes(range(256)) * 100
    assert pieces(data, 1 << 20) == data and len(pieces(data, 4096)) == 4096 and pieces(data, 4096).endswith(data[-512:])


# 10 decontamination


def brute_hits(text, items):
    words = decontam.words_of(text)
    hit, found = set(), set()
    for owner, t in items:
        w = decontam.words_of(t)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for p in range(len(words) - m + 1):
                if words[p : p + m] == w[i : i + m]:
                    hit |= set(range(p, p + m))
                    found.add(owner)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_against_brute_force(spark, block_bytes):
    rng = random.Random(7)
    items = [(i, word_text(rng, n, 6)) for i, n in enumerate((10, 12, 25, 3, 1, 11))] + [(7, None), (8, "  "), (9, "W1 w2, w3"), (9, word_text(rng, 14, 30))]
    rows = [(i, word_text(rng, rng.randrange(0, 80), 7) + " " + (rng.choice(items)[1] or "") + " é w9") for i in range(40)] + [(50, None), (51, ""), (3, "w1 w1 w1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(docs(spark, rows).withColumn("items", F.lit(0)), bench, block_bytes=block_bytes)
    want = sorted((str(i), t or "", *brute_hits(t, [(str(a), b) for a, b in items])) for i, t in rows)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    assert sorted((str(r.doc_id), r.text or "", r.n_words, r.n, r["items"]) for r in got.withColumn("n", n_hit).collect()) == want
    assert decontam.decontaminate(docs(spark, rows), bench.limit(0)).where("size(items) > 0").count() == 0
    r = decontam.digest(got.where("doc_id = 50")).first()
    assert (r.n_words, r.n_hit, r.contaminated, r.items_sha256) == (0, 0, False, hashlib.sha256(b"").hexdigest())


def test_tables_of_a_large_benchmark_are_bounded():
    rng = random.Random(8)
    items = [(str(i), " ".join(f"v{rng.randrange(50_000)}" for _ in range(6000))) for i in range(24)]  # 1 MB
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    tables = decontam.build_tables(items)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used < 60 * size
    words = decontam.words_of(items[3][1])
    assert decontam.find(words, tables) == ([[0, len(words)]], {"3"})


def test_clean_documents_with_frequent_blocks(spark):
    """Many items that end alike, and a benchmark of many blocks."""
    items = spark.range(300).selectExpr("id AS item_id", "concat('q', id, ' a b c d e f of the end of the end') AS text")
    d = spark.range(400).selectExpr("id AS doc_id", "concat('x ', repeat('of the end ', 40), if(id % 4 = 0, concat('q', id % 300, ' a b c d e f of the end z'), '')) AS text")
    one, many = (decontam.digest(decontam.decontaminate(d, items, block_bytes=b)) for b in (1 << 20, 2000))
    assert one.exceptAll(many).count() == 0 and many.count() == 400 and one.where("contaminated").count() == 100
