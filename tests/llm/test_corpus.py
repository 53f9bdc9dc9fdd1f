"""Operators over the whole corpus."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from mediaqc.llm import ann, components, exact_dedup, lm_score, mixing, near_dedup, sharding, substring_dedup
from tests.llm import brute


def test_exact(messy, rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    got = exact_dedup.exact_dedup(messy, counters=10).collect()
    assert len(got) == len(rows)
    kept = Counter()
    for (i, t), r in zip(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")), sorted(got, key=lambda r: (r.id is None, r.id or 0)), strict=True):
        if i is not None:
            best = min(groups[norm(t)], key=lambda x: (x[0], x[1], x[2] or 0))
            assert (r.id, r.keep_id, r.group_size) == (i, best[2], len(groups[norm(t)]))
    for r in got:
        kept[bytes(r.digest)] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    out = exact_dedup.keep_exact(messy)
    assert out.columns == messy.columns and out.count() == len(groups)
    assert exact_dedup.exact_dedup(messy.limit(0)).collect() == [] and exact_dedup.keep_exact(messy.limit(0)).collect() == []


def test_heavy_hitters_are_found_and_bounded(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    slim = exact_dedup.digests(df)
    assert [r.group_size for r in exact_dedup.frequent(slim, 10).collect()] == [1000]
    got = exact_dedup.exact_dedup(df, counters=10)
    assert got.where("kept").count() == 2001 and got.where("group_size = 1000 AND keep_id = 0").count() == 1000


def near_rows(seed=3):
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randint(0, 4000)}" for _ in range(n)]
    rows, passage = [], fresh(60)
    for _ in range(25):
        base = fresh(rnd.randint(6, 160))
        rows.append(base)
        for _ in range(rnd.randint(0, 5)):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = "edit"
            rows.append(copy)
    rows += [passage + fresh(rnd.randint(5, 60)) for _ in range(40)]
    chain = fresh(100)
    for k in range(12):  # each like the next, the first unlike the last
        rows.append(chain[3 * k :] + [f"c{j}" for j in range(3 * k)])
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize("centres", [0, 2])
def test_near_equals_brute_force(spark, monkeypatch, centres):
    """Also without any centre, when all buckets go the exact way."""
    monkeypatch.setattr(near_dedup, "CENTRES", centres)
    data = near_rows()
    got = {r.id: (r.n_shingles, r.component) for r in near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute.near_components(data)


def test_near_cases(messy, rows):
    got = near_dedup.near_duplicates(messy).collect()
    named = [(i, t) for i, t in rows if i is not None]
    want = brute.near_components(named)
    assert len(got) == len(rows) and all((r.n_shingles, r.component) == want[r.id] for r in got if r.id is not None)
    out = near_dedup.keep_near(messy)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == messy.columns and sorted(i for i in ids if i is not None) == sorted({c for _, c in want.values()}) and ids.count(None) == 2
    assert near_dedup.near_duplicates(messy.limit(0)).collect() == [] and near_dedup.keep_near(messy.limit(0)).collect() == []


def test_recall_of_the_tables():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(300):
        common, own = rng.integers(0, 1 << 62, 300, np.uint64), rng.integers(0, 1 << 62, 100, np.uint64)
        a, b = np.concatenate([common, own[:50]]), np.concatenate([common, own[50:]])
        ka, kb = (near_dedup.part_keys(near_dedup.minhashes(x)) for x in (a, b))
        same = ka == kb
        missed += not (same[: near_dedup.PARTS].any() and same[near_dedup.PARTS :].any())
    assert missed <= 2


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 90: 90, 95: 90, 100: 90}


def test_ann_recall_and_cases(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24))
    x[300:600] = x[0] + rng.normal(size=(300, 24)) * 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, lambda i: i % 50 == 0, 10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    hits = 0
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        best = set(np.argsort(-s)[:10])
        hits += len(best & {i for i, _ in found.values()})
        assert sorted(found) == list(range(1, 11)) and all(abs(s[i] - v) < 1e-12 for i, v in found.values())
    assert len(got) == 30 and hits / 300 >= 0.95
    odd = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [0.5, 0.5]), (6, [0.5, 0.5]), (20, [1.0, 2.0, 3.0]), (40, [2.0, 0.0]), (40, [2.0, 0.0]), (None, [1.0, 1.0]), (7, [])]
    odd = spark.createDataFrame(odd, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("score", F.lit(2.0))
    got = [tuple(r) for r in ann.nearest(odd, lambda i: i % 20 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 40, 2.0), (0, 2, 5, 0.5), (0, 3, 6, 0.5), (40, 1, 0, 2.0), (40, 2, 5, 1.0), (40, 3, 6, 1.0)]
    assert ann.nearest(odd.limit(0), lambda i: i % 20 == 0, 3).collect() == []


def test_ann_third_of_equal_vectors(spark):
    """A group of copies larger than the beam: recall by id, and the smallest ids of a tie."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1800, 24))
    x[rng.permutation(1800)[:600]] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, lambda i: i % 30 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    hits = 0
    for q in range(0, 1800, 30):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1800), -s))[:20].tolist()) & {i for _, i in got[q]})
        assert len(got[q]) == 20
    assert hits / (20 * 60) >= 0.97


def test_ann_recall_on_the_embeddings(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows])
    got = {}
    for r in ann.query(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits += len(best & {i for i, _ in found.values()})
        assert sorted(found) == list(range(1, 21)) and all(abs(s[ids == i][0] - v) < 1e-12 for i, v in found.values())
    assert set(got) == set(ids[ids % 20 == 0].tolist()) and hits / (20 * len(got)) >= 0.9


def test_ann_recall_in_tight_groups(spark):
    """Rows far from the origin that differ by less than a step of 8 bits over whole components: the nearest are not found by chance."""
    rng = np.random.default_rng(6)
    n = 2000
    x = rng.normal(size=(8, 24))[rng.integers(0, 8, n)] + 0.003 * rng.normal(size=(n, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, lambda i: i % 40 == 0, 20).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    hits = 0
    for q in range(0, n, 40):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & got[q])
    assert hits / (20 * 50) >= 0.9


def test_ann_widens_until_enough_is_found(spark, monkeypatch):
    """With beams that are too narrow for the rows the search goes on until a sample of the queries has its nearest."""
    monkeypatch.setattr(ann, "BEAM", 10)
    monkeypatch.setattr(ann, "GOOD", 1.0)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, lambda i: i % 30 == 0, 5).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    for q in range(0, 600, 30):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        assert got[q] == set(np.argsort(-s)[:5].tolist())


def test_lm(messy, spark):
    named = messy.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    data = [(r.doc_id, r.text) for r in named.select("doc_id", "text").collect()]
    want = brute.base_scores(data)
    few, all_ = (lm_score.score_texts(named, lm_score.vocabulary(), head=h).collect() for h in (3, 10**6))
    scores = {r.id: r.score for r in all_}
    for r in few:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.id][:4]
        assert abs(r.base_score - want[r.id][4]) < 1e-6 * max(1, abs(r.base_score)) and abs(r.score - scores[r.id]) < 1e-6 * max(1, abs(r.score))
        assert np.isfinite(r.score) and r.score <= 0
    assert len(lm_score.score_texts(messy, lm_score.vocabulary()).collect()) == messy.count()
    assert lm_score.score_texts(messy.limit(0), lm_score.vocabulary()).collect() == []
    alone = lm_score.score_texts(spark.createDataFrame([(4, "held out")], "doc_id long, text string"), lm_score.vocabulary()).first()
    assert alone.train_tokens in (0, 3) and np.isfinite(alone.score)


def test_lattice_is_a_distribution_and_sums_all_segmentations():
    names = ["▁", "a", "b", "ab", "▁a", "▁ab"] + [f"<{k}>" for k in range(256)]
    p = lm_score.Pieces(names[:6] + [""] * 256, [-6.0, -1.0, -2.0, -3.0, -4.0, -5.0] + [0.0] * 256, {k: 6 + k for k in range(256)})

    def every(word):
        def go(rest, first):
            if not rest:
                return 1.0
            total = sum(p.p[names.index(rest[:k])] * go(rest[k:], False) for k in range(1, len(rest) + 1) if rest[:k] in names[:6])
            if rest[0] not in names[:6]:
                total += float(np.prod([p.p[6 + b] for b in rest[0].encode()])) * go(rest[1:], False)
            return total

        return go("▁" + word, True)

    words = ["a", "ab", "abab", "bé", "zab"]
    assert np.allclose(np.exp(p.lattices(words)), [every(w) for w in words])
    expected = p.lattices(["ab"], np.array([2.0]))
    assert abs(expected @ np.array([len(n.encode()) if n[:1] != "▁" else len(n) - 1 for n in names] + [0]) - 4.0) < 1e-9


def vocabulary_parts():
    sp = sentencepiece.SentencePieceProcessor(model_file=lm_score.vocabulary())
    n = sp.get_piece_size()
    names = ["" if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else sp.id_to_piece(i) for i in range(n)]
    return names, [sp.get_score(i) for i in range(n)], {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}


@pytest.mark.parametrize("head", [2, 1000])
def test_lm_document_scores_equal_brute_force(spark, head):
    """Every segmentation of every word written out, with the production vocabulary; words seen, rare, unknown and spelled in bytes."""
    rnd = random.Random(4)
    words = ["the", "cat", "sat", "onto", "mat", "zqx", "né", "日x", "▁a", "a▁", "🎉"]
    rows = [(k, " ".join(rnd.choice(words[: 3 + k]) for _ in range(rnd.randint(0, 12)))) for k in range(12)] + [(50, None), (51, "unseen Words 🎊")]
    want = brute.lattice_scores(rows, *vocabulary_parts(), lm_score.PRIOR)
    got = lm_score.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), lm_score.vocabulary(), head=head).collect()
    assert len(got) == len(rows) and all(abs(r.score - want[r.id]) < 1e-8 * max(1, abs(want[r.id])) for r in got)


def test_long_words_one_by_one_equal_the_batch(spark, monkeypatch):
    pieces = lm_score.read_pieces(lm_score.vocabulary())
    words = ["international" * 7, "日本x" * 30, "z" * 200]
    both = [(pieces.lattices(words), pieces.lattices(words, np.array([1.0, 2.0, 3.0])))]
    monkeypatch.setattr(lm_score, "LONG", 10)
    both.append((pieces.lattices(words), pieces.lattices(words, np.array([1.0, 2.0, 3.0]))))
    assert np.allclose(both[0][0], both[1][0]) and np.allclose(both[0][1], both[1][1])
    long = "abcdefghij" * 100_000
    got = {r.id: r for r in lm_score.score_texts(spark.createDataFrame([(7, long), (2, "abc " + long[:500]), (4, None)], "doc_id long, text string"), lm_score.vocabulary()).collect()}
    # held out, so the word has no entry of its own, but pieces alone
    assert got[7].held_out and got[7].n_tokens == 2 and np.isfinite(got[7].score) and got[7].score < -1e4
    assert not got[2].held_out and got[2].n_known == 3 and -20 < got[2].score < 0


def test_mix(messy, spark):
    got = mixing.mix(messy).collect()
    assert len(got) == messy.count() and all(r.copies <= 3 and (r.size or r.copies == 0) for r in got)
    again = mixing.mix(messy.repartition(5)).collect()
    key = lambda rs: Counter((r.id, r.source, r.size, r.copies, r.target) for r in rs)
    assert key(got) == key(again)
    out = mixing.mixed(messy)
    assert out.columns == messy.columns and Counter(r.doc_id for r in out.collect()) == Counter({i: c for i, c in Counter(x for r in got for x in [r.id] * r.copies).items()})
    assert mixing.mix(messy.limit(0)).collect() == [] and mixing.mixed(messy.limit(0)).collect() == []
    blank = messy.withColumn("text", F.lit(" "))
    assert {(r.copies, r.target) for r in mixing.mix(blank).collect()} == {(0, 0.0)} and mixing.mixed(blank).collect() == []


def test_mix_meets_targets(spark):
    rnd = random.Random(8)
    sizes = {"a": 4000, "b": 300, "c": 100, None: 600}
    rows = [(k, " ".join("w" for _ in range(rnd.randint(1, 30))), s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in got:
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.size
        s[1] += r.size * r.copies
    total = sum(s[0] for s in by.values())
    assert abs(sum(s[2] for s in by.values()) - total) < 1e-6 * total and abs(sum(s[1] for s in by.values()) - total) <= 30
    weights, left, w = {"a": 1, "b": 2, "c": 3, None: 1}, float(total), {}
    open_ = set(weights)
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] >= 3 * by[s][0]}
        if not full:
            break
        for s in full:
            w[s] = 3.0 * by[s][0]
            left -= w[s]
        open_ -= full
    w |= {s: level * weights[s] for s in open_}
    for s, (size, taken, target, source_size) in by.items():
        assert size == source_size and abs(target - w[s]) < 1e-6 * total and abs(taken - target) <= 60


def unsigned_order(spark, rows, seed=7):
    found = spark.createDataFrame(rows, "doc_id long, source string").select("doc_id", "source", F.xxhash64(F.lit(seed), "doc_id", "source").alias("h")).collect()
    return {(r.doc_id, r.source): r.h & ((1 << 64) - 1) for r in found}


def test_mix_equals_brute_force(spark):
    """Sources of all sizes, a row repeated hundreds of times, empty texts; each source ends within half of its largest document."""
    rnd = random.Random(9)
    rows = [(k, " ".join("w" for _ in range(rnd.choice([0, 1, 5, 30, 200]))), rnd.choice(["a", "b", "b", "b", "c", "é", None])) for k in range(900)]
    rows += [(5000, "x y z", "b")] * 2500 + [(5001, "t " * 40, "tiny")] + [(None, "n n", "a")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    plain = [(i, s, len(t.split())) for i, t, s in rows]
    order = unsigned_order(spark, [(i, s) for i, s, _ in plain])
    want = brute.mixed(plain, lambda i, s: order[i, s])
    got: dict = {}
    by: dict = {}
    for r in mixing.mix(df).collect():
        got.setdefault((r.id, r.source, r.size), []).append(r.copies)
        x = by.setdefault(r.source, [0, 0, r.target])
        x[0], x[1] = x[0] + r.size * r.copies, max(x[1], r.size)
    assert {k: sorted(v) for k, v in got.items()} == want
    assert all(abs(taken - target) <= largest / 2 + 1e-6 for taken, largest, target in by.values())
    out = Counter((r.doc_id, r.source) for r in mixing.mixed(df).collect())
    assert out == Counter({(i, s): sum(v) for (i, s, _), v in want.items() if sum(v)})


def test_running_sums_by_ranges(spark):
    df = mixing.cut(spark.range(500).select((F.col("id") * 37 % 500).alias("x"), F.lit(2).alias("y")), "t")
    assert all(r.n == r.x and r.s == 2 * r.x for r in mixing.running(df, [F.col("x")], {"n": F.lit(1), "s": F.col("y")}).collect())


def whole_shards(rows, n):
    """Shard of each text by plain scheduling of all groups one by one, and whether no group has to be cut."""
    sizes = Counter()
    for _, t in rows:
        sizes[hashlib.md5((t or "").encode()).digest()] += len((t or "").encode()) + 1
    return brute.longest_first(sizes, n), max(sizes.values()) * n <= sum(sizes.values())


def test_shards_equal_plain_longest_processing_time(spark):
    """Groups one by one, with ties in size, hot sizes, copies, and more groups than any number that the driver would take one by one."""
    rnd = random.Random(8)
    texts = [f"{k} " + "x" * rnd.choice([3, 3, 3, 40, 41, rnd.randint(0, 900)]) for k in range(24_000)]
    rows = [(k, t) for k, t in enumerate(texts + rnd.choices(texts, k=3000) + ["", ""])] + [(99_999, None)]
    want, whole = whole_shards(rows, 7)
    got = {r.id: r.shard for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()}
    assert whole and len(want) > 24_000
    assert got == {i: want[hashlib.md5((t or "").encode()).digest()] for i, t in rows}


def test_shards_cut_what_exceeds_a_share(messy, rows):
    got = sharding.shard(messy, 5).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(len((t or "").encode()) + 1 for _, t in rows)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(messy.limit(0), 5).collect() == []


def test_runs_equal_a_heap():
    rnd = random.Random(4)
    for _ in range(300):
        loads = [rnd.randint(0, 60) for _ in range(rnd.randint(1, 6))]
        size, n = rnd.randint(1, 25), rnd.randint(1, 40)
        want, slow = [], list(loads)
        for _ in range(n):
            b = min(range(len(slow)), key=lambda b: (slow[b], b))
            want.append(b)
            slow[b] += size
        stretches = sharding.run(loads, size, n)
        of = lambda j: [(j - at, bins) for at, bins in stretches if at <= j][-1]
        assert [bins[k % len(bins)] for k, bins in map(of, range(n))] == want and loads == slow


def test_shards_and_hot_empty_texts(spark):
    """A third of all rows are empty texts, met by a broadcast; then one text is nearly all rows and is cut into pieces."""
    rows = [(k, "") for k in range(3000)] + [(10_000 + k, f"text {k} " + "x" * (k % 97)) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df, 8).collect()
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= 200 and len({r.shard for r in got if r.id < 3000}) == 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    same = spark.createDataFrame([(k, "all the same") for k in range(4000)] + [(9000 + k, f"t{k}") for k in range(50)], "doc_id long, text string")
    load = Counter(r.shard for r in sharding.shard(same, 4).collect())
    assert len(load) == 4 and max(load.values()) - min(load.values()) <= 60


HELPERS = [
    "_lost_id", "_digest", "_maybe", "_word", "_bits", "_order", "_id", "stays", "n_rows", "row", "digest", "id", "size", "tie", "m", "place", "end", "passes", "split", "times", "copy",
    "_source", "_head", "_here", "_copy", "_times", "k", "number", "part", "component", "n", "node", "h", "best", "kept",
]


def test_stages_leave_columns_of_any_name_as_they_came(spark):
    base = [(k, f"text {k % 40} a b c d e f {k % 40}", "s1" if k % 3 else "s2") for k in range(90)] + [(7, "text 7 a b c d e f 7", "s1")] * 3
    df = spark.createDataFrame(base, "doc_id long, text string, source string")
    named = df.withColumns({n: F.concat(F.lit(n), "doc_id") for n in HELPERS})
    for stage in (exact_dedup.keep_exact, near_dedup.keep_near, mixing.mixed):
        out = stage(named).collect()
        assert out and out[0].asDict().keys() == named.first().asDict().keys()
        assert all(r[n] == f"{n}{r.doc_id}" for r in out for n in HELPERS)
        assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in stage(df).collect())


def test_hot_groups_of_copies(spark):
    """A third of all rows are one text, another tenth repeats one row: the same answers, and no window over a hot group."""
    rows = [(k, "the same old text of this table") for k in range(700)] + [(9000, "one row that comes again and again")] * 200 + [(1000 + k, f"w{k} x{k} y{k} z{k} v{k} u{k}") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = exact_dedup.exact_dedup(df, counters=20).where("kept").collect()
    assert len(kept) == 1002 and exact_dedup.keep_exact(df).count() == 1002
    got = {r.id: r.component for r in near_dedup.near_duplicates(df).collect()}
    assert all(got[k] == 0 for k in range(700)) and near_dedup.keep_near(df).count() == 1002


def test_prefix_join_of_a_shared_passage(spark, monkeypatch):
    """Many documents that share most of their text, but not enough; salted in small parts."""
    monkeypatch.setattr(near_dedup, "SALT_ROWS", 7)
    monkeypatch.setattr(near_dedup, "CENTRES", 0)
    rnd = random.Random(2)
    passage = [f"p{k}" for k in range(70)]
    rows = [(k, " ".join(passage[: rnd.choice([50, 60, 70])] + [f"q{k}_{j}" for j in range(rnd.choice([8, 15, 22]))])) for k in range(60)]
    got = {r.id: (r.n_shingles, r.component) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_components(rows)


def test_sieve_grows_and_keeps_all_keys(spark):
    keys = mixing.cut(spark.range(50_000).select((F.col("id") * 3).alias("k")), "keys")
    made = near_dedup.sieve(keys, "k")
    marked = near_dedup.sifted(spark.range(150_000).select(F.col("id").alias("k")), made, "k")
    assert made._words >= 50_000 * 16 // 64
    assert marked.where("k % 3 = 0 AND NOT _maybe").isEmpty() and marked.where("k % 3 <> 0 AND _maybe").count() < 15_000


def test_shards(messy, rows):
    got = sharding.shard(messy, 4).collect()
    assert Counter((r.id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 1) for i, t in rows)
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(messy.limit(0)).collect() == []


def test_shards_keep_groups_and_split_only_what_no_shard_holds(spark):
    rows = [(k, "hot text") for k in range(900)] + [(1000 + k, f"text {k // 3} " + "x" * (k % 50)) for k in range(1500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    load, where = Counter(), {}
    text = dict(rows)
    for r in got:
        load[r.shard] += r.size
        where.setdefault(text[r.id], set()).add(r.shard)
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 60
    assert all(len(s) == 1 for t, s in where.items() if t != "hot text") and len(where["hot text"]) <= 3


def test_substrings(messy, rows):
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(messy).collect())
    assert got == Counter(brute.without_repeats(rows))
    assert substring_dedup.remove_repeats(messy.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_fuzz(spark, seed):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefgh") + str(rnd.randint(0, 30)) for _ in range(200)] for _ in range(5)]
    rows = []
    for i in range(150):
        w = []
        while len(w) < rnd.randint(0, 260):
            kind = rnd.random()
            if kind < 0.4:
                a = rnd.randint(0, 150)
                w += rnd.choice(base)[a : a + rnd.randint(5, 120)]
            elif kind < 0.5:
                w += ["x", "y"] * rnd.randint(1, 30)
            else:
                w += [str(rnd.randint(0, 10**6)) for _ in range(rnd.randint(1, 30))]
        rows.append((i, " ".join(w)))
    rows += [(1000 + n, f"r{n} " * n) for n in (34, 35, 36, 200)]
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter(brute.without_repeats(rows)) and sum(r[2] for r in got) > 1000
    kept = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True)
    assert all(brute.sha(r.text) == r.kept_sha256 for r in kept.collect())


def test_substring_without_ids(spark):
    """Texts without ids whose 32-bit hashes are equal, of unequal and of equal lengths, are told apart."""
    passage = " ".join(f"p{k}" for k in range(60))
    own = F.concat(F.lit(passage), F.lit(" "), F.expr("array_join(transform(sequence(0, cast(id % 50 as int)), x -> concat('w', cast(id * 100 + x as string))), ' ')"))
    texts = spark.range(300_000).select(own.alias("text")).withColumn("h", F.hash("text"))
    pairs = [r.t for r in texts.groupBy("h").agg(F.collect_list("text").alias("t")).where("size(t) > 1").collect()]
    assert pairs and any(len({len(t.split()) for t in p}) > 1 for p in pairs)
    rows = [(None, t) for p in pairs for t in p] + [(None, None), (None, ""), (1, pairs[0][0])]
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter(brute.without_repeats(rows))
