"""Every stage of the pipeline against a plain version on its own input, and the whole run."""

import hashlib
import random
from collections import Counter

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from prefspark.llm.bpe_automaton import coder
from prefspark.llm.mixing import targets
from prefspark.llm.quality import fit_quality, quality_scores

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, _block string"


def rows(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(30)]
    out = []
    for i in range(120):
        words = [word() for _ in range(rng.randint(3, 120))]
        if i % 5 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        out.append((i, " ".join(words) if i % 9 else " | ".join(words), f"src{i % 4}"))
    for i in range(120, 150):  # near copies
        words = out[i - 120][1].split()
        if i % 2 and len(words) > 60:
            words[7] = "changed"
        out.append((i, " ".join(words), "src0"))
    out += [(200, None, "src1"), (201, "", None), (None, "no id here", "src1"), (202, "x " * 500, None)]
    return [(i, t, "en", s, len(t or ""), "clash", "clash") for i, t, s in out + out[:3]]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(rows(), SCHEMA)
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    marks = spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(120)], "doc_id long, quality int")
    marks.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def words(text):
    return (text or "").encode().split()


def check_quality(spark, before, after, folder):
    model = fit_quality(before, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = quality_scores(before, model).collect()
    kept = [r for r, s in zip(before.collect(), scores) if s.predicted == 1]
    assert Counter(after.collect()) == Counter(kept)


def check_near(spark, before, after, folder):
    found = before.collect()
    sets = [{tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))} if (w := words((r.text or "").lower())) else set() for r in found]
    least = {x: {x} for x in range(len(found))}
    for x in range(len(found)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]) and least[x] is not least[y]:
                least[x] |= least[y]
                for z in least[y]:
                    least[z] = least[x]
    keep = set()
    for x, r in enumerate(found):
        ids = [found[z].doc_id for z in least[x] if found[z].doc_id is not None]
        if r.doc_id is None or r.doc_id == min(ids):
            keep.add(r)
    assert Counter(after.collect()) == Counter(keep)


def check_substring(spark, before, after, folder):
    found = before.collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    first, want = {}, Counter()
    for r in found:
        w = words(r.text)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            first[k] = min(first.get(k, (key(r), s)), (key(r), s))
    for r in found:
        w, gone = words(r.text), set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (key(r), s):
                gone.update(range(s, s + 20))
        if not w or len(gone) < len(w):
            want[r.doc_id, tuple(x for k, x in enumerate(w) if k not in gone)] += 1
            if not gone:
                assert r.text in {a.text for a in after.where(f"doc_id <=> {'NULL' if r.doc_id is None else r.doc_id}").collect()}
    assert Counter((r.doc_id, tuple(words(r.text))) for r in after.collect()) == want


def check_mix(spark, before, after, folder):
    sizes, taken = Counter(), Counter()
    texts = {}
    for r in before.collect():
        sizes[r.source] += len(words(r.text))
        texts.setdefault(r.doc_id, []).append(words(r.text))
    for r in after.collect():
        taken[r.source] += len(words(r.text))
        assert any(set(words(r.text)) <= set(t) and len(words(r.text)) <= len(t) for t in texts[r.doc_id])
        assert r.n_chars == len(r.text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, goal in zip(names, targets([sizes[s] for s in names], [1.0 + i % 3 for i in range(len(names))])):
        assert abs(taken[s] - goal) <= 10 + 0.01 * goal


def check_codes(spark, before, after, folder):
    code, sha = coder("word_bpe_49k.json"), lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for r in before.collect():
        ids = code.encode(r.text)
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(code.decode(ids))] += 1
    assert Counter(map(tuple, after.collect())) == want


CHECKS = [check_quality, check_near, check_substring, check_mix, check_codes]


def test_stages_equal_plain_versions(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for i, ((name, stage), check) in enumerate(zip(corpus_pipeline.STAGES, CHECKS, strict=True)):
        stage(spark, docs, tables).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert out.columns == docs.columns and 0 < out.count(), name
            assert {r._block for r in out.collect()} == {"clash"}
        check(spark, docs, out, tables)
        docs = out
    whole = corpus_pipeline.run(spark, tables).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, docs.collect()))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    found = entry_module.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in found
