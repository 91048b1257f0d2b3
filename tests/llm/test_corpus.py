import math
import random

import pytest
from pyspark.sql import functions as F

from docloom.llm import bayes_join as B
from docloom.llm import mixing as M
from docloom.llm.components import components


def shingles(text):
    words = (text or "").split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else None


def brute_links(rows):
    sets, words = [shingles(t) for _, t in rows], [tuple((t or "").split()) for _, t in rows]
    links = {k: set() for k in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        same = [rows[j][0] for j in range(len(rows)) if words[j] == words[i]] if words[i] else [key]
        out[key] = (min(rows[j][0] for j in seen), min(same), len(links[i]), len({words[j] for j in links[i]} - {words[i]}))
    return out


@pytest.fixture(scope="module")
def near_rows(prose):
    r, rows = random.Random(1), []
    for g in range(10):
        base = prose(r.choice([30, 60, 200]), g).split()
        for _ in range(r.choice([1, 2, 5, 25])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                words[r.randrange(len(words))] = f"new{r.randrange(99)}"
            rows.append(" ".join(words))
    return list(enumerate([*rows, None, "", "  ", "a b", "a b", "a  b", "a b c d e", "a b c d e f"]))


@pytest.mark.parametrize("block", [8, 1024])
def test_links_equal_brute_force(spark, monkeypatch, near_rows, block):
    monkeypatch.setattr(B, "BLOCK_DOCS", block)
    df = spark.createDataFrame([(k, t, 1, "y") for k, t in near_rows], "doc_id long, text string, digest int, root string")
    got = {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_links"], r["n_texts"]) for r in B.jaccard_links(df).collect()}
    assert got == brute_links(near_rows)


def test_links_of_odd_rows(spark, odd, empty):
    out = B.jaccard_links(odd).collect()
    assert len(out) == odd.count()
    assert sum(r["n_links"] for r in out) == 2  # the repeated row alone
    assert B.jaccard_links(empty).collect() == []


def test_pruning_follows_the_posterior():
    for n, least in B.survival_table().items():
        for m in (least - 1, least):
            # P(s >= t) under Beta(m + 1, n - m + 1), by the midpoint rule
            steps = 20_000
            mass = [((k + 0.5) / steps) ** m * (1 - (k + 0.5) / steps) ** (n - m) for k in range(steps)]
            tail = sum(mass[int(0.8 * steps) :]) / sum(mass)
            assert (tail >= B.TOLERANCE) == (m >= least) or abs(tail - B.TOLERANCE) < 0.02 * B.TOLERANCE


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (4, 4), (20, 1), (30, 31), (31, 32), (32, 33), (33, 34), (34, 30)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7, 30: 30, 31: 30, 32: 30, 33: 30, 34: 30}


def plan(rows, budget, target, limit):
    """Weights by plain bisection, in Python."""
    tokens = {}
    for _, s, n in rows:
        tokens[s] = tokens.get(s, 0) + n
    full = {s: n for s, n in tokens.items() if n}
    total = sum(full.values())
    share = {s: n / total for s, n in full.items()}

    def weights(a):
        z = sum(q**a for q in share.values())
        return {s: q**a / z for s, q in share.items()}

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a).values())

    def repeats(a):
        return max(budget * w / full[s] for s, w in weights(a).items())

    def border(good, low, high):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low

    wanted = target * math.log(len(full))
    a = 1.0 if entropy(1.0) >= wanted else border(lambda x: entropy(x) >= wanted, 0.0, 1.0)
    b = 0.0 if repeats(0.0) <= limit else border(lambda x: repeats(x) > limit, 0.0, 1.0)
    return weights(max(a, b)), full


@pytest.mark.parametrize("target, limit", [(0.97, 9.0), (1.0, 1.5), (0.2, 9.0)])
def test_mixture(spark, target, limit):
    r = random.Random(4)
    rows = [(k, "hot" if k % 3 == 0 else r.choice(["a", "b", "c", None]) if k % 7 else "tiny", r.randint(0, 50)) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n int").withColumn("key", F.lit(1))
    out = M.mixture(df, tokens=F.col("n"), target_entropy=target, max_repeats=limit, block_tokens=500).collect()
    total = sum(n for _, _, n in rows)
    weights, full = plan(rows, total, target, limit)
    taken, times = {}, {}
    for x in out:
        taken[x["source"]] = taken.get(x["source"], 0) + x["n"]
        times[x["doc_id"]] = times.get(x["doc_id"], 0) + 1
        assert x["mix"]["weight"] == pytest.approx(weights[x["source"]], abs=1e-6)
    for s, w in weights.items():
        assert w * total - 51 <= taken.get(s, 0) <= w * total + 1
    for s in full:
        epochs = math.floor(round(weights[s] * total, 3) / full[s])
        assert {times.get(k, 0) - epochs for k, source, _ in rows if source == s} <= {0, 1}
    assert len({(x["doc_id"], x["mix"]["epoch"]) for x in out}) == len(out)


def test_mixture_of_odd_rows(spark, odd, empty):
    out = M.mixture(odd.withColumn("source", F.when(F.col("length") % 2 == 0, "s")), target_entropy=0.0).collect()
    assert len(out) == odd.count() and {r["mix"]["epoch"] for r in out} == {0}  # own shares: every row once
    assert M.mixture(empty).collect() == []
    none = spark.createDataFrame([(1, "s", None), (2, "s", "")], "doc_id long, source string, text string")
    assert len(M.mixture(none).collect()) == 2
    with pytest.raises(ValueError):
        M.mixture(spark.createDataFrame([(1, "s", "a b"), (2, "t", "c")], "doc_id long, source string, text string"), budget=1000)


def test_pipeline(spark, sf_dir, tokens):
    import corpus_pipeline as P
    from docloom.llm.common import library_tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir).cache()
        assert sorted(kept.columns) == sorted(docs.columns)
        if name != "mixing":
            assert kept.exceptAll(before).count() == 0
        if name == "near_duplicates":
            assert brute_representatives(before) == {r["doc_id"] for r in kept.collect()}
    packed = P.packing(spark, kept, sf_dir).collect()
    want = sum(len(library_tokenizer(tokens).encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in kept.collect())
    assert sum(r["length"] for r in packed) == want


def brute_representatives(df):
    rows = sorted((r["doc_id"], r["text"]) for r in df.collect())
    classes = brute_links(rows)
    return {k for k, (root, *_) in classes.items() if k == root}


def test_near_duplicates_of_repeated_and_missing_ids(spark, prose):
    import corpus_pipeline as P

    a, b, c, d, e = (prose(200, 900 + k) for k in range(5))
    near = lambda text: text + " close"
    rows = [(1, a), (2, near(a)), (2, b), (3, c), (3, near(c)), (None, d), (None, near(d)), (4, near(d)), (None, e), (5, "x"), (5, "x")]
    found = [(r["doc_id"], r["text"]) for r in P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert len(found) == 6
    assert {(1, a), (2, b), (4, near(d)), (None, e), (5, "x")} < set(found)
    assert sum(k == 3 for k, _ in found) == 1


@pytest.mark.parametrize("group_rows", [16, 4096])
def test_groups_of_any_size(spark, monkeypatch, near_rows, group_rows):
    monkeypatch.setattr(B, "BLOCK_DOCS", 3)
    monkeypatch.setattr(B, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(B, "PAIRS", 7)
    df = spark.createDataFrame(near_rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_links"], r["n_texts"]) for r in B.jaccard_links(df).collect()}
    assert got == brute_links(near_rows)


def test_links_without_ids(spark, near_rows):
    """Null and repeated ids don't change what is linked."""
    some = [(None if k % 3 == 0 else 7, t, k) for k, t in near_rows]
    rows = B.jaccard_links(spark.createDataFrame(some, "doc_id long, text string, k long")).collect()
    want = brute_links(near_rows)
    assert sorted((r["n_links"], r["n_texts"]) for r in rows) == sorted(w[2:] for w in want.values())
    assert len(B.representatives(spark.createDataFrame(some, "doc_id long, text string, k long")).collect()) == len({w[0] for w in want.values()})


def test_representatives_keep_columns(spark, odd, empty, near_rows):
    kept = B.representatives(spark.createDataFrame([(k, 1.5, t, "x", [k]) for k, t in near_rows], "doc_id long, row double, text string, digest string, others array<long>"))
    assert kept.columns == ["doc_id", "row", "text", "digest", "others"]
    assert {r["doc_id"] for r in kept.collect()} == {w[0] for w in brute_links(near_rows).values()}
    assert B.representatives(odd).count() == odd.count() - 1
    assert B.representatives(empty).collect() == []


def test_recall_on_documents(spark):
    """Every pair at 0.8 or more of sf0.01, found by an inverted index over shingles, is linked."""
    from collections import Counter, defaultdict

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {k: shingles(t) for k, t in docs}
    at = defaultdict(list)
    for k, held in sets.items():
        for x in held or ():
            at[x].append(k)
    common = Counter((a, b) for held in at.values() for i, a in enumerate(held) for b in held[:i])
    want = Counter()
    for (a, b), n in common.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            want[a] += 1
            want[b] += 1
    assert want
    found = {r["doc_id"]: r["n_links"] for r in B.jaccard_links(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {k: want[k] for k, _ in docs}

@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_tables(spark, sf_dir, prose, tokens, stage):
    """Null, empty and long texts, repeated rows and ids, null ids and sources, clashing names, an empty table."""
    import corpus_pipeline as P

    name, run = P.STAGES[stage]
    good = [prose(80, 7000 + k) for k in range(6)]
    texts = [None, "", "  ", *good, good[0], good[0] + " more", "short", prose(20_000, 8000)]
    rows = [(None if k % 5 == 4 else k // 2, t, "en", None if k % 3 else "s", k, 1.5, "x", [k]) for k, t in enumerate(texts)]
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, row string, key array<long>")
    found = run(spark, docs, sf_dir)
    kept = found.collect()
    assert run(spark, docs.limit(0), sf_dir).collect() == []
    if name == "packing":
        assert sum(r["start"] == 0 for r in kept) == len(rows)
        return
    assert found.columns == docs.columns
    every = [tuple(r) for r in docs.collect()]
    assert all(tuple(r) in every for r in kept)
    words = [len((t or "").split()) for _, t, *_ in rows]
    if name == "quality":
        assert len(kept) == sum(w >= 20 for w in words)
    if name == "toxicity":
        assert len(kept) == len(rows)
    if name == "near_duplicates":
        assert len(kept) == 3 + len(good) + 2
    if name == "mixing":
        took = sum(len((r["text"] or "").split()) for r in kept)
        assert 0 < took <= sum(words) + 1 and {r["source"] for r in kept} == {None, "s"}


def test_stages_equal_plain_evaluation(spark, sf_dir):
    """What quality, toxicity and mixing keep, row by row in Python, from the models that the stages fit."""
    import zlib
    from collections import Counter

    import pyarrow as pa

    import corpus_pipeline as P
    from docloom.llm.quality_rules import fit_quality_rules, quality_verdicts
    from docloom.llm.toxicity import fit_toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = P.labels_of(spark, sf_dir)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in labels.collect())
    good = {r["doc_id"] for r in quality_verdicts(docs, fit_quality_rules(docs, labels)).collect() if r["kept"]}
    assert {r["doc_id"] for r in P.quality(spark, docs, sf_dir).collect()} == good
    model, clean = fit_toxicity(docs, labels), set()
    for r in docs.collect():
        if model.score(*model.marginals(pa.array([r["text"] or ""])))[0] < 0.5:
            clean.add(r["doc_id"])
    assert {r["doc_id"] for r in P.toxicity(spark, docs, sf_dir).collect()} == clean
    rows = [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in docs.collect()]
    total = sum(n for *_, n in rows)
    weights, full = plan(rows, total, M.TARGET_ENTROPY, M.MAX_REPEATS)
    times = Counter(r["doc_id"] for r in P.mixing(spark, docs, sf_dir).collect())
    for source, w in weights.items():
        epochs = math.floor(round(w * total, 3) / full[source])
        own = [(k, n) for k, s, n in rows if s == source]
        assert {times[k] - epochs for k, _ in own} <= {0, 1}
        assert sum(times[k] * n for k, n in own) <= w * total + 1
