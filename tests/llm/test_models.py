"""Classifier, mixing, vector searches and language-model scores against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from prefspark.llm.kd_search import KdTree, top_inner_products
from prefspark.llm.kmeans_tree import KMeansTree, nearest, sent
from prefspark.llm.common import as_bytes, from_bytes
from prefspark.llm.lm_score import RECORD, lm_scores
from prefspark.llm import mixing
from prefspark.llm.mixing import mix_sources, mixed_documents, schedule, source_targets, targets, turns
from prefspark.llm import quality
from prefspark.llm.quality import fit_quality, keep_quality, quality_scores
from prefspark.llm.vectors import as_blob, opened, rows_of

DOC = "doc_id long, text string, source string, _block string, row string, size string, label string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], DOC)


# --- quality ---------------------------------------------------------------------------------------------

def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeiourtnsl") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(700):
        good = i % 4 > 0
        if good:
            text = ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(rng.randint(1, 8)))
        else:
            text = " | ".join(word() for _ in range(40)) if i % 8 else " ".join([word()] * 30 + [word()] * 30)
        rows.append((i, text, "s"))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_learns_and_keeps_held_out_labels_out(spark):
    rows, labels = corpus()
    docs, marked = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_scores(docs, fit_quality(docs, marked, fit_rows=400)).collect()}
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in out.items() if r.held_out} == held
    right = [out[i].predicted == q for i, q in labels if i in held]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    # Turning the held-out labels round changes nothing.
    turned = spark.createDataFrame([(i, 1 - q if i in held else q) for i, q in labels], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in quality_scores(docs, fit_quality(docs, turned, fit_rows=400)).collect()}
    assert again == {i: r.score for i, r in out.items()}


def plain_words(text):
    found = (text or "").encode().split()
    return [w[i : i + 256] for w in found for i in range(0, len(w), 256)]


def plain_hash(values):
    total, power = 0, 1
    for v in values:
        total = (total + v * power) % 2**64
        power = power * 0x9E3779B97F4A7C15 % 2**64
    return int(quality.mix(np.array([total], np.uint64), 40)[0])


def plain_form(word):
    kind = lambda b: 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else max(b, 1)
    out = []
    signs = [kind(b) for b in word]
    for i, c in enumerate(signs):
        run = 1 if c in (65, 97, 48) else 3
        if not (i >= run and signs[i - run : i] == [c] * run):
            out.append(c)
    return out


def plain_pool(text, lexicon, vectors):
    found = plain_words(text)
    hashes = [plain_hash(b + 1 + 32 * (65 <= b <= 90) for b in w) for w in found]
    out = np.zeros(quality.DIMS)
    def index(h, dims):
        v = np.zeros(dims)
        for i in range(4):
            slot = (h >> 16 * i) % (2 * dims)
            v[slot % dims] += 1 - 2 * (slot >= dims)
        return v
    for i, (w, h) in enumerate(zip(found, hashes)):
        out[:128] += index(h, 128)
        if h in lexicon:
            out[128:256] += vectors[lexicon.index(h)]
        out[256:320] += index(plain_hash(plain_form(w)), 64)
        out[320] += i > 0 and hashes[i - 1] == h
        out[321] += i > 1 and hashes[i - 2] == h
    return out / max(len(found), 1), hashes, index


@pytest.mark.parametrize("step", [7, 60, 1 << 20])
def test_pooling_and_network_against_plain_versions(step, monkeypatch):
    monkeypatch.setattr(quality, "_STEP", step)
    texts = ["Ab ab AB x1-22!!!!! ....", None, "", " \n", "one two one two one", "é" * 300 + " Ü", "a" * 700, "x\x00y \x85 b", "A A a a 9 99 --- -----"]
    texts += [" ".join(random.Random(i).choices(["the", "The", "of", "q9", "!!", "z"], k=40)) for i in range(6)]
    seen = Counter(h for t in texts for h in plain_pool(t, [], None)[1])
    lexicon = sorted(h for h, n in seen.items() if n > 3)
    index = plain_pool("", [], None)[2]
    sums = np.zeros((len(lexicon), 128))
    for t in texts:
        hashes = plain_pool(t, [], None)[1]
        for i, h in enumerate(hashes):
            if h in lexicon:
                for j in (i - 2, i - 1, i + 1, i + 2):
                    if 0 <= j < len(hashes):
                        sums[lexicon.index(h)] += index(hashes[j], 128)
    array = np.array(lexicon, np.uint64)
    cuts = step < 1 << 20  # a word without white space may then be cut elsewhere
    kept = [t for t in texts if not cuts or max(map(len, (t or "").encode().split()), default=0) <= step]
    if not cuts:
        assert (quality.context_sums(texts, array) == sums).all()
    want = np.array([plain_pool(t, lexicon, sums)[0] for t in kept])
    got = quality.pool(kept, array, sums)
    assert np.allclose(got, want, atol=1e-12)
    net = quality.train(want, np.arange(len(want)) % 2.0, epochs=2)
    z = (want - net.mean) / net.scale
    for row, p in zip(z, net(got)):
        hidden = [max(sum(a * b for a, b in zip(row, column)) + c, 0) for column, c in zip(net.w1.T, net.b1)]
        logit = (sum(a * b for a, b in zip(hidden, net.w2)) + net.b2) / net.temperature
        assert p == pytest.approx(1 / (1 + np.exp(-logit)))


def test_quality_of_odd_rows(spark):
    rows = [(None, None, None), (1, "", "s"), (1, "", "s"), (2, "w " * 50_000, "s"), (3, "é\x00 ß", "s")]
    docs = frame(spark, rows)
    model = fit_quality(docs, spark.createDataFrame([(1, None), (3, 1), (3, 0), (None, 1)], "doc_id long, quality int"))
    out = quality_scores(docs, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert out[0].held_out is False
    assert keep_quality(docs, model, least=0.0).collect() == docs.collect()
    empty = spark.createDataFrame([], DOC)
    assert quality_scores(empty, fit_quality(empty, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


# --- mixing ------------------------------------------------------------------------------------------------


def test_targets_start_no_other_python_workers(spark):
    sized = spark.createDataFrame([("a", 3), (None, 5)], "source string, size long")
    got = source_targets(sized)
    assert "ExistingRDD" not in got._jdf.queryExecution().toString()
    assert [(r["source"], r["index"], r["source_size"]) for r in got.collect()] == [("a", 0, 3), (None, 1, 5)]
    assert source_targets(sized.limit(0)).collect() == []

def mix_rows():
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 80))), rng.choice(["b", "a", "Z", None])) for i in range(300)]
    rows += [(900, "x y " * 4_000, "tiny"), (901, "one two", "less"), (902, None, "less"), (903, "", None), (904, " ", "none")]
    return rows + rows[:5]


def test_targets_by_hand():
    assert targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    # Of 102: 17, 34, 51; the second stops at 3, the rest is shared 1 : 3, where the first has no bound yet.
    assert targets([50, 1, 51], [1, 2, 3]) == pytest.approx([24.75, 3, 74.25])
    assert targets([0, 4], [1, 2]) == [0, 4]
    assert targets([], []) == []


def test_mix_meets_targets(spark):
    rows = mix_rows()
    out = mix_sources(frame(spark, rows)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mix_sources(frame(spark, rows)).collect()), key=str)
    size = lambda t: len((t or "").encode().split())
    assert sorted((r.doc_id, r.size, r.source) for r in out if r.doc_id != 903) == sorted(
        ((i, size(t), s) for i, t, s in rows if i != 903), key=lambda x: x[0]
    ) or Counter((r.doc_id, r.size, r.source) for r in out) == Counter((i, size(t), s) for i, t, s in rows)
    totals = Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, targets([totals[s] for s in names], [1.0 + i % 3 for i in range(len(names))])))
    taken = Counter()
    for r in out:
        assert (r.source_size, r.target) == (totals[r.source], pytest.approx(goal[r.source]))
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - goal[s]) <= 8 + 0.01 * goal[s]


def test_mixed_documents_have_the_words_taken(spark):
    rows = mix_rows()
    df = frame(spark, rows).withColumnsRenamed({"size": "n_chars"})
    taken, got = Counter(), Counter()
    for r in mix_sources(df).collect():
        taken[r.doc_id, r.source] += r.taken
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        got[r.doc_id, r.source] += len(r.text.split())
        assert r._block == "clash" and r.n_chars == str(len(r.text))
    assert got == +taken
    assert mixed_documents(frame(spark, [])).count() == mix_sources(frame(spark, [])).count() == 0


def test_small_sources_beside_large_ones(spark):
    rows = [(i, "w x y z " * 250, "big") for i in range(200)]  # 200,000 words
    rows += [(1_000 + i, "a b c d e " * 10, "mid") for i in range(43)] + [(2_000, "q " * 21, "two"), (2_001, "r s", "wee")]
    df, got = frame(spark, rows), Counter()
    for slots in (1 << 18, 50):  # blocks of one word, and of up to 1,024
        taken, goal = Counter(), {}
        for r in mix_sources(df, slots=slots).collect():
            taken[r.source] += r.taken
            goal[r.source] = r.target
            assert 0 <= r.taken <= 3 * r.size
        assert goal["mid"] == 6_450 and goal["two"] == 63 and goal["wee"] == 6
        for s in goal:
            assert abs(taken[s] - goal[s]) <= 0.5 + goal[s] / 256
    for r in mixed_documents(df, slots=50).collect():
        got[r.source] += len(r.text.split())
    assert got == taken


def test_turns_count_short_last_blocks():
    # 2,100 words in 87 blocks of 24 and one of 12.
    assert turns(2_100, 6_300, 1_024) == (24, 3 * 88)
    assert turns(700_000, 2_100_000, 1_024) == (1_024, 3 * 684)
    # The last block has 608 words, so from half of them on it is nearer to take it.
    assert turns(700_000, 700_000 + 683 * 1_024 + 304, 1_024) == (1_024, 684 + 684)
    assert turns(700_000, 700_000 + 683 * 1_024 + 303, 1_024) == (1_024, 684 + 683)
    assert turns(2, 6.0, 1_024) == (1, 6) and turns(0, 0.0, 7) == (1, 0)


def test_schedule_grows_and_ranks_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 100)
    dealt = [(9_000, 10, 2_000), (50, 1, 150), (0, 1, 0), (3, 1, 7)]
    rows = schedule(spark, dealt).collect()
    assert len({r.slot for r in rows}) == len(rows) == 2_157
    for i, (size, block, n) in enumerate(dealt):
        mine = sorted((r.slot, r.rank, r.block) for r in rows if r["index"] == i)
        assert [m[1] for m in mine] == list(range(n))
        assert all(m[2] == m[1] % -(-size // block) for m in mine)
    half = Counter(r["index"] for r in rows if r.slot < 1_000)
    assert abs(half[0] - 927) <= 8 and abs(half[1] - 70) <= 8


# --- vectors --------------------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, v string, leaf string, shard string"


def vector_rows(n=900, d=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = (centres[rng.integers(0, 6, n)] + rng.normal(size=(n, d)) * 0.6).astype(np.float32)
    x[100:400] = x[100]  # a hot vector
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5_000, None), (5_050, [0.0] * d), (5_100, [float("nan")] * d), (5_150, [None] * d), (5_200, [1.0, 2.0]),
             (5_250, [float("inf")] * d), (None, [1.0] * d), (5_300, []), (-50, [0.5] * d)]
    return rows


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 3) for r in rows], VEC)


def valid(rows, d, zero):
    ok = lambda v: v and len(v) == d and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v))
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and ok(v)]


def test_inner_products_equal_brute_force(spark):
    rows = vector_rows()
    good = [(i, np.floor(256 * v).astype(np.int64)) for i, v in valid(rows, 8, True)]
    want = []
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = top_inner_products(vectors(spark, rows), shard_rows=200, query_block=7).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_inner_products_beyond_doubles(spark):
    rows = [(0, [3e6, 1.0]), (1, [2e6, -4.5]), (2, [2e6, 4.5]), (3, [-1e6, 0.0])]
    got = [(r.vec_id, r.score) for r in top_inner_products(vectors(spark, rows)).orderBy("rank").collect()]
    q = lambda v: [math.floor(256 * c) for c in v]
    want = sorted((-sum(a * b for a, b in zip(q(rows[0][1]), q(v))), i) for i, v in rows[1:])
    assert got == [(i, -s) for s, i in want]


def test_kd_tree_boxes_are_tight():
    rng = np.random.default_rng(0)
    points = np.floor(rng.normal(size=(500, 5)) * 50)
    tree = KdTree(np.arange(500), points, leaf=20)
    for (a, b), low, high in zip(tree.spans, tree.low, tree.high):
        assert np.array_equal(tree.points[a:b].min(axis=0), low) and np.array_equal(tree.points[a:b].max(axis=0), high)
    q = np.floor(rng.normal(size=(30, 5)) * 50)
    bounds = tree.bounds(q)
    for node, (a, b) in enumerate(tree.spans):
        assert (bounds[:, node] >= (q @ tree.points[a:b].T).max(axis=1)).all()


def cosine_brute(rows, d=8):
    good = valid(rows, d, False)
    out = {}
    for q, x in good:
        if q % 50 == 0:
            scored = [(-float((x * y).sum() / (math.sqrt((x * x).sum()) * math.sqrt((y * y).sum()))), i) for i, y in good if i != q]
            out[q] = [(i, -s) for s, i in sorted((round(s, 13), i) for s, i in scored)[:5]]
    return out


@pytest.mark.parametrize("recall,least", [(0.97, 0.9), (1.0, 0.99)])
def test_nearest_reaches_recall(spark, recall, least):
    rows = vector_rows()
    want = cosine_brute(rows)
    got = {}
    for r in nearest(vectors(spark, rows), recall=recall, leaf_sample=20, part_rows=50, query_block=9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want) and all(len(g) == 5 for g in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= least
    exact = dict(valid(rows, 8, False))
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        for i, s in found:
            x, y = exact[q], exact[i]
            assert s == pytest.approx(float(x @ y / math.sqrt((x @ x) * (y @ y))), abs=1e-12)


def test_few_and_no_vectors(spark):
    few = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0])]
    assert [tuple(r)[:3] for r in nearest(vectors(spark, few)).collect()] == [(0, 1, 1)]
    assert [tuple(r)[:3] for r in top_inner_products(vectors(spark, few)).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    for rows in ([], [(0, None)], [(0, [1.0])]):
        assert nearest(vectors(spark, rows)).count() == top_inner_products(vectors(spark, rows)).count() == 0


@pytest.fixture
def small_broadcasts(spark):
    """No join may send more than 3 MB through the driver; the least that Spark counts for one is 1 MB."""
    name = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(name)
    spark.conf.set(name, "3m")
    yield
    spark.conf.set(name, before)


def wide_vectors(n=2_000, d=64):
    x = np.random.default_rng(5).normal(size=(n, d)).astype(np.float32)
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def test_nearest_broadcasts_no_vectors(spark, small_broadcasts):
    rows = wide_vectors()
    found = nearest(vectors(spark, rows), every=2, recall=1.0, query_block=100).collect()
    x = np.array([v for _, v in rows])
    near = x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2)
    np.fill_diagonal(near, -2)
    want = {(q, int(i)) for q in range(0, 2_000, 2) for i in np.argsort(-near[q])[:5]}
    assert len({(r.query_id, r.vec_id) for r in found} & want) >= 0.97 * len(want) and len(found) == len(want)


def test_inner_products_broadcast_no_vectors(spark, small_broadcasts):
    rows = wide_vectors(8_000)
    found = top_inner_products(vectors(spark, rows), every=40, shard_rows=256, query_block=50).collect()
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    want = []
    for q in range(0, 8_000, 40):
        scores = x @ x[q]
        scores[q] = scores.min() - 1
        want += [(q, r + 1, i, scores[i]) for r, i in enumerate(np.lexsort((np.arange(8_000), -scores))[:5])]
    assert sorted(map(tuple, found)) == sorted(want)


def test_queries_leave_a_worker_once_a_run_in_small_batches():
    x, ids = np.random.default_rng(4).normal(size=(100, 16)), np.arange(100) * 50
    visited, starts = np.random.default_rng(5).random((100, 300)) < 0.1, np.array([0, 1, 30, 31, 90, 200])
    visited[:, 30] = False
    batches = list(sent(ids, x, visited, starts, most=20_000))
    assert len(batches) > 1 and max(b.nbytes for b in batches) < 20_000 + 100 * (17 * 8 + 14)
    got = np.zeros_like(visited)
    rows = [row for b in batches for row in rows_of(b)]
    assert [row["run"] for row in rows] == [0, 1, 3, 4, 5]
    for row in rows:
        q, v = opened(row["q_ids"], row["q_data"], 16)
        a, b = [*starts, 300][row["run"] : row["run"] + 2]
        got[q // 50, a:b] = np.unpackbits(np.frombuffer(row["q_leaves"], np.uint8).reshape(len(q), -1), axis=1)[:, : b - a]
        assert np.array_equal(v, x[q // 50])
    assert np.array_equal(got, visited) and list(sent(ids, x, visited & False, starts)) == []


@pytest.mark.parametrize("x,size", [([[0.5, -0.0], [3e38, 1e-45]], 4), ([[0.1, 1.0]], 8), ([[1e300, 1.0]], 8), ([[1e-320, 0.0]], 8)])
def test_vectors_keep_their_numbers_as_bytes(x, size):
    x = np.array(x).astype(np.float32).astype(float) if size == 4 else np.array(x)
    blob = as_blob(x)
    got = opened(np.arange(len(x)).tobytes(), blob, 2)[1]
    assert len(blob) == size * x.size and got.dtype == float and got.tobytes() == x.tobytes()


def test_rows_of_a_batch_are_views():
    batch = pa.RecordBatch.from_pydict({"a": [1, None], "b": [bytes(1 << 20), None], "c": [[1, 2], None]})
    before = pa.total_allocated_bytes()
    one, two = rows_of(batch)
    assert pa.total_allocated_bytes() == before and one["b"].size == 1 << 20
    assert (one["a"], one["c"]) == (1, [1, 2]) and two == {"a": None, "b": None, "c": None}


def test_vectors_go_to_workers_in_small_batches(spark):
    nearest(vectors(spark, vector_rows()))
    rows = spark.range(12, numPartitions=1).selectExpr("cast(repeat('a', 2 << 20) AS binary) AS b")
    sizes = rows.mapInArrow(lambda found: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in found), "n long").collect()
    assert sum(r.n for r in sizes) == 12 and max(r.n for r in sizes) <= 5


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(3).normal(size=(600, 6))
    tree = KMeansTree(x, leaf=30)
    assert sorted(tree.visits(x[0], tree.leaves)) == list(range(tree.leaves))
    assert tree.visits(x[0], 1) and 1 <= tree.calibrate(x, 5, 0.9) <= tree.leaves


# --- language models --------------------------------------------------------------------------------------------

def test_lm_scores(spark):
    rng = random.Random(2)
    text = lambda pool: " ".join(rng.choice(pool) for _ in range(rng.randint(1, 60)))
    rows = [(i, text(["a", "b", "C", "d", f"r{i}"]), "s") for i in range(60)] + [(70, None, "s"), (71, " ", "s"), (None, "a b", "s")]
    rows += rows[:3] + [(80, "zz " * 3_000, "s")]
    aims = [text("abe") for _ in range(20)] + [None, ""]
    vocabulary, split = 6, lambda t: (t or "").lower().split()
    words = [Counter(w for t in side for w in split(t)) for side in (aims, [r[1] for r in rows])]
    both = words[0] + words[1]
    known = sorted(both, key=lambda w: (-both[w], w.encode()))[:vocabulary]
    name = lambda w: w if w in known else "*"
    models = []
    for side in (aims, [r[1] for r in rows]):
        one, two = Counter(), Counter()
        for t in side:
            w = list(map(name, split(t)))
            one.update(w)
            one["^"] += bool(w)
            two.update(zip(["^", *w], w))
        models.append((one, two, sum(v for k, v in one.items() if k != "^")))

    def loss(model, before, now):
        one, two, n = model
        p = 0.7 * two[before, now] / one[before] if one[before] else 0
        return -math.log(p + 0.29 * one[now] / n + 0.01 / (vocabulary + 1))

    want = []
    for i, t, _ in rows:
        w = list(map(name, split(t)))
        parts = [loss(models[0], b, x) - loss(models[1], b, x) for b, x in zip(["^", *w], w)]
        want.append((i, len(w), round(sum(parts) / len(w), 9) if w else None))
    aim = spark.createDataFrame([(t,) for t in aims], "text string")
    got = lm_scores(frame(spark, rows), aim, vocabulary=vocabulary, block_bytes=700).collect()
    assert sorted(((r.doc_id, r.n_words, None if r.score is None else round(r.score, 9)) for r in got), key=str) == sorted(want, key=str)
    assert lm_scores(frame(spark, []), aim).count() == 0
    assert lm_scores(frame(spark, rows), aim.limit(0)).count() == len(rows)


@pytest.mark.parametrize("n", [0, 1, 9000])
def test_records_by_column_come_back_and_compress(n):
    rng = np.random.default_rng(n)
    records = np.zeros(n, RECORD)
    word = lambda: np.minimum(rng.zipf(1.2, n), 16385).astype(np.uint64)
    records["gram"] = np.sort(word() << np.uint64(32) | word())
    records["background"] = rng.zipf(2, n)
    payload = as_bytes(records, True)
    assert len(payload) == records.nbytes and (from_bytes(payload, RECORD, True) == records).all()
    if n > 1:
        plain = b"".join(records[c].tobytes() for c in RECORD.names)
        assert len(pa.compress(payload, codec="lz4_raw", asbytes=True)) < 0.6 * len(pa.compress(plain, codec="lz4_raw", asbytes=True))


def test_lm_scores_over_every_word(spark):
    rng = random.Random(5)
    text = lambda pool: " ".join(rng.choice(pool) for _ in range(rng.randint(1, 40)))
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(300)]
    rows = [(i, text(common), "s") for i in range(200)] + [(300 + i, text(rare), "s") for i in range(20)]
    rows += [(400, None, "s"), (401, " ", "s"), (None, "C1 c2", "s"), (402, "ß\x1c é", "s"), *rows[:2]]
    aims = [text(rare[:100]) for _ in range(20)] + [None, ""]
    split = lambda t: (t or "").lower().replace("\x1c", "~").split()
    models, words = [], set()
    for side in (aims, [r[1] for r in rows]):
        one, two = Counter(), Counter()
        for w in map(split, side):
            one.update(w)
            words.update(w)
            two.update(zip(["^", *w], w))
            one["^"] += bool(w)
        models.append((one, two, sum(v for k, v in one.items() if k != "^")))

    def loss(model, before, now):
        one, two, n = model
        p = 0.7 * two[before, now] / one[before] if one[before] else 0
        return -math.log(p + 0.29 * one[now] / n + 0.01 / (len(words) + 1))

    want = []
    for i, t, _ in rows:
        w = split(t)
        parts = [loss(models[0], b, x) - loss(models[1], b, x) for b, x in zip(["^", *w], w)]
        want.append((i, len(w), round(sum(parts) / len(w), 9) if w else None))
    aim, plain = spark.createDataFrame([(t,) for t in aims], "text string"), lambda rows: sorted(
        ((r.doc_id, r.n_words, None if r.score is None else round(r.score, 9)) for r in rows), key=str
    )
    assert plain(lm_scores(frame(spark, rows), aim, vocabulary=None, block_bytes=700).collect()) == sorted(want, key=str)
    assert lm_scores(frame(spark, []), aim, vocabulary=None).count() == 0
    assert lm_scores(frame(spark, rows), aim.limit(0), vocabulary=None).count() == len(rows)
