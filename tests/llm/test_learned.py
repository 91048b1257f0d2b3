import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import language_id as L
from docloom.llm import quality_rules as Q
from docloom.llm import toxicity as X

from .conftest import ODD_TEXTS


def brute_marginals(emission, transition):
    n, weights = len(emission), {}
    for path in itertools.product((0, 1), repeat=n):
        s, last = 0.0, 0
        for e, y in zip(emission, path, strict=True):
            s += transition[last, y] + e * y
            last = y
        weights[path] = np.exp(s)
    total = sum(weights.values())
    return [sum(w for p, w in weights.items() if p[k]) / total for k in range(n)], total


@pytest.mark.parametrize("sizes", [[1], [3, 0, 5], [0, 0], [7, 2]])
def test_marginals_equal_enumeration(sizes):
    r = np.random.default_rng(1)
    transition, emission = r.normal(size=(2, 2)), r.normal(size=sum(sizes)) * 2
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    got, expected = X.forward_backward(emission, offsets, transition)
    want = [m for a, b in zip(offsets, offsets[1:], strict=False) if b > a for m in brute_marginals(emission[a:b], transition)[0]]
    assert np.allclose(got, want)
    assert expected.sum() == pytest.approx(sum(sizes))


def test_segments_do_not_matter(monkeypatch):
    r = np.random.default_rng(2)
    transition, emission, offsets = r.normal(size=(2, 2)), r.normal(size=1000) * 3, np.array([0, 700, 700, 1000])
    whole, expected = X.forward_backward(emission, offsets, transition)
    monkeypatch.setattr(X, "SEGMENT", 7)
    again, expected_again = X.forward_backward(emission, offsets, transition)
    assert np.allclose(whole, again) and np.allclose(expected, expected_again)


@pytest.fixture(scope="module")
def toxic_corpus(prose):
    r, rows = random.Random(5), []
    for k in range(600):
        words = prose(r.randint(20, 120), 1000 + k).split()
        bad = k % 5 == 0
        for _ in range(r.randint(1, 4) if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(["vile", "Scum!", "loserish", "loserdom"]))
        rows.append((k, " ".join(words), int(bad)))
    return rows


def test_toxicity(spark, toxic_corpus, odd, empty):
    df = spark.createDataFrame(toxic_corpus, "doc_id long, text string, toxic int")
    train = df.where("doc_id % 3 != 0")
    model = X.fit_toxicity(train, train.select("doc_id", "toxic"))
    out = {r["doc_id"]: r for r in X.score_toxicity(df, model, spans=True).collect()}
    held = [(out[k]["predicted"], t) for k, _, t in toxic_corpus if k % 3 == 0]
    assert sum(p != t for p, t in held) <= 2
    for k, text, t in toxic_corpus:
        if t and out[k]["predicted"]:
            marked = " ".join(text[s["start"] : s["end"]] for s in out[k]["spans"])
            assert re.search("vile|Scum|loser", marked)
    rows = X.score_toxicity(odd, model).collect()
    assert len(rows) == len(ODD_TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert X.score_toxicity(empty, model).collect() == []


def test_toxicity_without_labels(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int")
    model = X.fit_toxicity(odd, labels)
    assert {r["predicted"] for r in X.score_toxicity(odd, model).collect()} == {0}


def test_spans():
    assert X.offending("ab  cd ef", np.array([0.9, 0.8, 0.1])) == [{"start": 0, "end": 6, "probability": 0.9}]
    assert X.offending(" \x1cab\u00a0ab\u2003c ab", np.array([0.1, 0.9, 0.2, 0.6])) == [{"start": 5, "end": 7, "probability": 0.9}, {"start": 10, "end": 12, "probability": 0.6}]


def test_scores_equal_enumeration(toxic_corpus):
    """Marginals by enumeration of all paths, then the document features and the logistic by hand."""
    texts, toxic = pa.array([t for _, t, _ in toxic_corpus]), np.array([t == 1 for *_, t in toxic_corpus])
    model = X.train(texts, toxic, 0.2)
    for text in ("", "vile scum here", "what a loserly day it is", "Scum!"):
        words = text.split()
        emission = [float(model.weights[X.word_features(pa.array([w]))[0]].sum()) + model.bias for w in words]
        marginal = brute_marginals(emission, model.transition)[0] if words else []
        p = [min(max(m, 1e-6), 1 - 1e-6) for m in marginal]
        best, count = max(p, default=1e-6), sum(p)
        x = [min(6.0, max(-6.0, np.log(best / (1 - best)))), np.log1p(count), 10 * count / max(1, len(words))]
        want = 1 / (1 + np.exp(-(model.logistic[0] + np.dot(model.logistic[1:], x))))
        found, offsets = model.marginals(pa.array([text]))
        assert np.allclose(found, marginal, atol=1e-6)
        assert model.score(found, offsets)[0] == pytest.approx(want, abs=1e-5)


def many_words(n_texts, n_words):
    return [" ".join(f"w{(k * 31 + i * i) % 5000}" for i in range(n_words)) + (" scum vile scum" if k % 3 == 0 else "") for k in range(n_texts)]


def test_training_takes_few_bytes_a_word(monkeypatch):
    """On the driver, beside its JVM: arrays over all words of the sample hold one code and one label each."""
    monkeypatch.setattr(X, "ROUNDS", 2)
    monkeypatch.setattr(X, "FIELD_TOKENS", 1 << 14)
    texts = many_words(900, 1000)
    texts, toxic = pa.array(texts), np.arange(len(texts)) % 3 == 0
    words = sum(len(t.split()) for t in texts.to_pylist())
    tracemalloc.start()
    try:
        X.train(texts, toxic, 0.3)
        assert tracemalloc.get_traced_memory()[1] < 48 * words
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("texts", [["", "  "], ["a b a", "", " b\n c ", "c", "a d"], many_words(9, 40)])
def test_words_of_slices_equal_those_of_all(monkeypatch, texts):
    monkeypatch.setattr(X, "text_slices", lambda texts: (texts.slice(k, 2) for k in range(0, len(texts), 2)))
    (codes, offsets, words), want = X.coded_words(pa.array(texts)), X.split_words(pa.array(texts))
    assert codes.tolist() == want[0].tolist() and offsets.tolist() == want[1].tolist() and words.to_pylist() == want[2].to_pylist()
    monkeypatch.setattr(X, "WORDS", 3)
    assert (X.listed_features(words) == X.word_features(words)).all()


def test_near_copies_of_any_earlier_text_go(prose):
    a, b = prose(200, 1), prose(200, 2)
    texts = [a, b, a + " more", prose(200, 3), b + " more", a + " more again", "", ""]
    assert X.without_near_copies(pa.array(texts)).tolist() == [0, 1, 3, 6]
    assert X.without_near_copies(pa.array([], pa.string())).tolist() == []


def test_scoring_tasks_end_with_giving_memory_back(spark, toxic_corpus, monkeypatch):
    """A worker that waits for the next stage holds little of what the last one took."""
    ended, run_of = [], {}
    monkeypatch.setattr(X, "give_back", lambda: ended.append(True))
    texts = pa.array([t for _, t, _ in toxic_corpus])
    model = X.train(texts, np.array([t == 1 for *_, t in toxic_corpus]), 0.2)
    df = spark.createDataFrame(toxic_corpus, "doc_id long, text string, toxic int")
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: (run_of.update(run=run), plain(self, run, schema))[1])
    X.score_toxicity(df, model)
    scored = list(run_of["run"](iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], ["id", "text"])])))
    assert sum(x.num_rows for x in scored) == len(texts) and ended == [True]


def test_training_on_texts_without_words():
    model = X.train(pa.array(["", " x1", "  "]), np.array([True, False, False]), 0.5)
    assert np.isfinite(model.logistic).all()


def test_sample_is_bounded_by_bytes(spark, toxic_corpus, monkeypatch):
    given = {}
    monkeypatch.setattr(X, "train", lambda texts, toxic, share: given.update(texts=texts.to_pylist(), share=share))
    df = spark.createDataFrame(toxic_corpus, "doc_id long, text string, toxic int")
    X.fit_toxicity(df, df.select("doc_id", "toxic"), max_bytes=20_000)
    whole = {t for _, t, _ in toxic_corpus}
    assert 15_000 < sum(map(len, given["texts"])) <= 20_000 and set(given["texts"]) <= whole
    X.fit_toxicity(df, df.select("doc_id", "toxic"))
    assert len(given["texts"]) == len(toxic_corpus)


LANGUAGES = {"en": "the cat sat with that other thing while it rained", "fr": "le chat était assis avec cette autre chose pendant qu'il pleuvait", "de": "die katze saß mit jenem anderen ding während es regnete"}


def test_languages(spark, odd, empty):
    r, rows = random.Random(3), []
    for k in range(300):
        lang = list(LANGUAGES)[k % 3]
        words = LANGUAGES[lang].split()
        rows.append((k, " ".join(r.choices(words, k=12)), lang if k % 10 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_language_model(df.where("doc_id < 200"))
    assert model.languages == ["de", "en", "fr"]
    out = {x["doc_id"]: x for x in L.identify_languages(df, model, extra={"h": F.col("doc_id") % 2}).collect()}
    assert all(out[k]["lang_pred"] == list(LANGUAGES)[k % 3] and out[k]["h"] == k % 2 for k in range(200, 300))
    rows = L.identify_languages(odd, model).collect()
    assert len(rows) == len(ODD_TEXTS)
    assert sum(x["lang_pred"] == L.UNKNOWN for x in rows) == sum(not any(c.isalpha() for c in t or "") for t in ODD_TEXTS)
    assert L.identify_languages(empty, model).collect() == []
    none = L.fit_language_model(empty)
    assert {x["lang_pred"] for x in L.identify_languages(odd, none).collect()} == {L.UNKNOWN}


def test_predictions_equal_plain_bayes(spark):
    rows = [(1, "aab b", "x"), (2, "ba bb", "y"), (3, "ab", None), (4, "b", "x"), (5, "abba", "z"), (6, "7 8", None), (7, "zz top ab", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_language_model(df)
    counts, documents = {}, {}
    for _, text, lang in rows:
        if lang:
            documents[lang] = documents.get(lang, 0) + 1
            for g in L.word_ngrams(pa.array(text.split()))[0]:
                counts[lang, g] = counts.get((lang, g), 0) + 1
    found = {r["doc_id"]: r for r in L.identify_languages(df, model).collect()}
    for k, text, _ in rows:
        joint = {}
        for lang, n in documents.items():
            total = sum(v for (x, _), v in counts.items() if x == lang) + L.SMOOTHING * L.BUCKETS
            joint[lang] = np.log(n / sum(documents.values())) + sum(np.log((counts.get((lang, g), 0) + L.SMOOTHING) / total) for g in L.word_ngrams(pa.array(text.split()))[0])
        best = max(sorted(joint), key=joint.get)
        if k == 6:
            assert (found[k]["lang_pred"], found[k]["score"]) == (L.UNKNOWN, 0.0)
        else:
            assert found[k]["lang_pred"] == best
            assert found[k]["score"] == pytest.approx(1 / sum(np.exp(v - joint[best]) for v in joint.values()), rel=1e-4)


def test_blocks_of_languages_agree(spark, monkeypatch):
    rows = [(k, "".join(random.Random(k).choices("abcdefgh ", k=40)), f"l{k % 7}") for k in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_language_model(df)
    whole = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in L.identify_languages(df, model).collect())
    monkeypatch.setattr(L, "LANGUAGE_BLOCK", 2)
    assert sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in L.identify_languages(df, model).collect()) == whole


def brute_statistics(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\f\r")]
    places = {}
    for k in range(len(words) - 7):
        places.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for found in places.values() if len(found) > 1 for k in found for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark, odd, empty, prose):
    passage = prose(30, 1)
    texts = [*ODD_TEXTS, passage + " x " + passage, "a b c d e f g h a b c d e f g h a b", "x\ny\nx\n\n\nx", "*#$ a|b\n<c>", f"{passage}\n{passage}\n{prose(10, 2)}", "w " * 9]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r[c] for c in Q.BASE) for r in Q.text_statistics(df).withColumnRenamed("id", "doc_id").collect()}
    assert rows == {k: brute_statistics(t) for k, t in enumerate(texts)}
    verdicts = Q.quality_verdicts(odd, []).collect()
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and r["kept"] == (not r["base_failed"]) for r in verdicts)
    assert Q.quality_verdicts(empty, []).collect() == []


def test_rules_are_found_and_kept_apart(spark, prose):
    rows = []
    for k in range(400):
        text = prose(60, k)
        if k % 4 == 1:
            text = text.upper()
        if k % 4 == 2:
            text = text.replace(" ", "*** ")
        rows.append((k, text, int(k % 4 in (0, 3))))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = Q.fit_quality_rules(df, df.select("doc_id", "quality"))
    assert 1 <= len(rules) <= 4
    out = {r["doc_id"]: r["kept"] for r in Q.quality_verdicts(df, rules).collect()}
    assert sum(out[k] != (q == 1) for k, _, q in rows) <= 4
    plan = Q.quality_verdicts(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert Q.fit_quality_rules(df, df.where("quality = 1").select("doc_id", "quality")) == []


def test_ordered_verdict(spark):
    of = {"a": F.col("a")}
    rules = [[Q.Condition("a", True, 1.0)], [Q.Condition("a", False, 5.0), Q.Condition("a", True, 9.0)]]
    kept = [r["k"] for r in spark.range(12).select(F.col("id").cast("double").alias("a")).select("a", Q.verdict(rules, of).alias("k")).orderBy("a").collect()]
    assert kept == [not (a <= 1 or 5 < a <= 9) for a in range(12)]


def test_the_field_is_fitted_on_whole_texts(monkeypatch, prose):
    bad = "vexulon gromitar"
    texts = [f"{prose(300, k)} {bad} {prose(200, 1000 + k)}" if k < 20 else prose(500, k) for k in range(60)]
    toxic = np.arange(60) < 20
    given, fit = {}, X.fit_field

    def fit_field(codes, offsets, features, label):
        given.update(codes=codes, offsets=offsets, features=features, label=label)
        return fit(codes, offsets, features, label)

    monkeypatch.setattr(X, "fit_field", fit_field)
    monkeypatch.setattr(X, "FIELD_TOKENS", 4000)
    model = X.train(pa.array(texts), toxic, 0.3)
    assert len(given["codes"]) == sum(len(t.split()) for t in texts)
    monkeypatch.setattr(X, "FIELD_TOKENS", 1 << 40)
    assert np.allclose(fit(**given)[0], model.weights, atol=1e-3)


def test_every_language_is_learned(spark):
    n = 520
    rows = [(k, chr(0x4E00 + k) * 5, f"l{k:03}") for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = L.identify_languages(df, L.fit_language_model(df)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {k: lang for k, _, lang in rows}


def plain_covering(rows, names, edges):
    """Sequential covering in plain Python: rows are (statistics by name, bad, prune)."""
    import math

    covers = lambda rule, r: all((r[0][c] <= t) if below else (r[0][c] > t) for c, below, t in rule)
    rules, left = [], rows
    while len(rules) < Q.MOST_RULES:
        rule = []
        while len(rule) < Q.MOST_CONDITIONS:
            here = [r for r in left if not r[2] and covers(rule, r)]
            bad, good = sum(r[1] for r in here), sum(not r[1] for r in here)
            if not bad or not good:
                break
            best, best_gain, was = None, 0.0, math.log2(bad / (bad + good))
            for c in names:
                for t in edges[c]:
                    for below in (True, False):
                        hit = [r for r in here if covers([(c, below, t)], r)]
                        b = sum(r[1] for r in hit)
                        gain = b * (math.log2(b / len(hit)) - was) if b else 0.0
                        if gain > best_gain + 1e-9:
                            best, best_gain = (c, below, t), gain
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        judged = []
        for k in range(len(rule), 0, -1):
            hit = [r for r in left if r[2] and covers(rule[:k], r)]
            judged.append((rule[:k], sum(r[1] for r in hit), sum(not r[1] for r in hit)))
        rule, bad, good = max(judged, key=lambda x: (x[1] - x[2]) / (x[1] + x[2]) if x[1] + x[2] else -1.0)
        if bad < Q.LEAST_COVERED or bad < Q.LEAST_PRECISION * (bad + good):
            break
        moved = []
        for c, below, t in rule:
            low, high = [r[0][c] for r in left if r[0][c] <= t], [r[0][c] for r in left if r[0][c] > t]
            moved.append((c, below, (max(low) + min(high)) / 2 if low and high else t))
        rules.append(moved)
        left = [r for r in left if not covers(moved, r)]
    return rules


def test_rules_equal_plain_covering(spark):
    r, rows = random.Random(8), []
    for k in range(500):
        x, y, z = r.random(), r.random(), r.random()
        bad = (x > 0.7 and y < 0.5) or z > 0.9 if r.random() > 0.02 else r.random() < 0.5
        rows.append((x, y, z, bool(bad), k % 3 == 0))
    table = spark.createDataFrame(rows, "x double, y double, z double, bad boolean, prune boolean")
    names, points = ["x", "y", "z"], [(k + 1) / (Q.THRESHOLDS + 1) for k in range(Q.THRESHOLDS)]
    cuts = [t.agg(*[F.percentile_approx(c, points, 10_000).alias(c) for c in names]).first() for t in (table, table.where("bad"))]
    edges = {c: sorted({*cuts[0][c], *cuts[1][c]}) for c in names}
    want = plain_covering([(dict(zip(names, row[:3], strict=True)), row[3], row[4]) for row in rows], names, edges)
    found = [[(c.statistic, c.below, c.threshold) for c in rule] for rule in Q.learn_rules(table)]
    assert len(want) >= 2 and [[x[:2] for x in rule] for rule in found] == [[x[:2] for x in rule] for rule in want]
    assert all(a[2] == pytest.approx(b[2]) for p, q in zip(found, want, strict=True) for a, b in zip(p, q, strict=True))


def test_kept_follows_the_learned_list(spark, sf_dir):
    """op4's verdict by plain evaluation of its rules on brute-force statistics."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = Q.fit_quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r["doc_id"]: r["kept"] for r in Q.op4_quality_rules(spark, sf_dir).collect()}
    for d in docs.collect():
        text = d["text"] or ""
        n_words, chars, symbols, dup_lines, repeated = brute_statistics(text)
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\f\r")]
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        part = lambda a, b: a / b if b else 0.0
        own = {
            "symbols_per_char": part(symbols, chars), "symbols_per_word": part(symbols, n_words), "shouts_per_word": part(text.count("!"), n_words), "upper_per_char": part(sum("A" <= c <= "Z" for c in text), chars),
            "chars_per_word": part(chars, n_words), "repeated_share": part(repeated, n_words), "dup_line_share": part(dup_lines, len(lines)), "unique_share": part(len(set(words)), n_words),
        }
        failed = n_words < 20 or 100 * repeated > 30 * n_words
        rejected = any(all((own[c.statistic] <= c.threshold) == c.below for c in rule) for rule in rules)
        assert kept[d["doc_id"]] == (not failed and not rejected)
