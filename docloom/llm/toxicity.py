"""Toxicity: a linear-chain conditional random field tags toxic spans.

Words carry hashed features (whole word, prefixes, suffixes); the chain has the
states clean and toxic, and starts behind a clean word.  Token labels come from
document labels: in a toxic document a word is toxic if the word or one of its
features occurs in clearly more toxic than clean documents, by a cautious ratio
of document frequencies; all other words are clean.  The field is fitted to
these labels by gradient descent with exact forward-backward expectations, and
forward-backward marginals aggregate to a document score by a small logistic
model over the strongest word, the expected number of toxic words and their share.

Fitting takes the whole texts of a sample of about MAX_TOXIC and MAX_CLEAN labelled
documents of MAX_BYTES in all at most, without near copies of each other, on the driver.
The model (2**17 weights) is broadcast; scoring is one pass over slices of texts.

Defined results: null and empty texts get the score of a text without toxic
words and no spans; a null id is kept, has no label and counts as the id '' where ids
are hashed; repeated rows give repeated results; without labels of both kinds every
score is the share of toxic labels (0 without labels); an empty table gives an empty
one; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.bayes_join import BANDS, band_keys, minhashes, mixed, shingles, word_hashes
from docloom.llm.common import crc_mod, forget, give_back, map_slices, segment_sum, slices, split_words, stored, text_array, unit_hash

BUCKETS, PREFIXES, SUFFIXES = 1 << 17, (3, 4, 5, 6, 7, 8), (3, 4)
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 1500, 3000, 64 << 20
ROUNDS, RATE, DECAY = 60, 0.25, 1e-4
LEAST_EVIDENCE = 1.8
SEGMENT, FIELD_TOKENS, WORDS = 64, 1 << 17, 1 << 15
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’¡¿…–—"


def word_features(words: pa.StringArray) -> np.ndarray:
    """Feature buckets of each word; bucket 0 where a word is too short for one."""
    core = pc.utf8_trim(pc.utf8_lower(words), characters=EDGES)
    listed = core.to_pylist()
    whole = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in listed), np.uint64, len(listed))
    sizes = pc.utf8_length(core).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.append(np.frombuffer("".join(listed).encode("utf-32-le"), np.uint32).astype(np.uint64), np.uint64(0))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    columns = [np.where(sizes > 0, 1 + whole % np.uint64(BUCKETS - 1), 0).astype(np.int64)]
    value = np.zeros(len(listed), np.uint64)
    for k in range(max(PREFIXES, default=0)):
        value = value * np.uint64(0x100000001B3) + points[np.minimum(starts + k, len(points) - 1)] + np.uint64(1)
        if k + 1 in PREFIXES:
            columns.append(np.where(sizes > k, 1 + mixed(value + np.uint64(k + 1)) % np.uint64(BUCKETS - 1), 0).astype(np.int64))
    value = np.zeros(len(listed), np.uint64)
    for k in range(max(SUFFIXES, default=0)):
        value = value * np.uint64(0x100000001B3) + points[np.maximum(ends - 1 - k, 0)] + np.uint64(7)
        if k + 1 in SUFFIXES:
            columns.append(np.where(sizes > k, 1 + mixed(value + np.uint64(100 + k)) % np.uint64(BUCKETS - 1), 0).astype(np.int64))
    return np.stack(columns, 1) if len(listed) else np.zeros((0, 1 + len(PREFIXES) + len(SUFFIXES)), np.int64)


def forward_backward(emission: np.ndarray, offsets: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state, and expected transition counts (2 x 2).

    A sequence is cut into segments; products of the segments' transfer matrices
    carry the messages from segment to segment, so a long text takes as many array
    steps as SEGMENT plus its number of segments.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    t = np.exp(transition)
    sizes = np.diff(offsets)
    n_segments = -(-sizes // SEGMENT)
    first = np.concatenate([[0], np.cumsum(n_segments)])
    total = int(first[-1])
    doc = np.repeat(np.arange(len(sizes)), n_segments)
    start = offsets[:-1][doc] + (np.arange(total) - first[doc]) * SEGMENT
    stop = np.minimum(start + SEGMENT, offsets[1:][doc])
    place = start + np.arange(SEGMENT)[:, None]
    real = place < stop
    e = np.exp(np.clip(emission, -30, 30))[np.minimum(place, n - 1)]
    a00, a10 = np.where(real, t[0, 0], 1.0), np.where(real, t[1, 0], 0.0)
    a01, a11 = np.where(real, t[0, 1] * e, 0.0), np.where(real, t[1, 1] * e, 1.0)
    p = [np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)]
    for k in range(SEGMENT):
        q = [p[0] * a00[k] + p[1] * a10[k], p[0] * a01[k] + p[1] * a11[k], p[2] * a00[k] + p[3] * a10[k], p[2] * a01[k] + p[3] * a11[k]]
        norm = 1 / (q[0] + q[1] + q[2] + q[3])
        p = [x * norm for x in q]
    alpha, beta = np.empty((2, total)), np.empty((2, total))  # before and behind each segment
    some = np.flatnonzero(n_segments)
    alpha[:, first[some]] = [[1.0], [0.0]]
    beta[:, first[some + 1] - 1] = 0.5
    for k in range(1, int(n_segments.max())):
        has = np.flatnonzero(n_segments > k)
        at = first[has] + k - 1
        x0, x1 = alpha[0, at] * p[0][at] + alpha[1, at] * p[2][at], alpha[0, at] * p[1][at] + alpha[1, at] * p[3][at]
        alpha[0, at + 1], alpha[1, at + 1] = x0 / (x0 + x1), x1 / (x0 + x1)
        at = first[has + 1] - k
        y0, y1 = p[0][at] * beta[0, at] + p[1][at] * beta[1, at], p[2][at] * beta[0, at] + p[3][at] * beta[1, at]
        beta[0, at - 1], beta[1, at - 1] = y0 / (y0 + y1), y1 / (y0 + y1)
    before = np.empty((2, SEGMENT, total))
    x0, x1 = alpha
    for k in range(SEGMENT):
        before[0, k], before[1, k] = x0, x1
        y0, y1 = x0 * a00[k] + x1 * a10[k], x0 * a01[k] + x1 * a11[k]
        norm = 1 / (y0 + y1)
        x0, x1 = y0 * norm, y1 * norm
    marginal, expected = np.empty(n), np.zeros((2, 2))
    b0, b1 = beta
    for k in range(SEGMENT - 1, -1, -1):
        ok = real[k]
        x0, x1 = before[0, k], before[1, k]
        xi = x0 * a00[k] * b0, x0 * a01[k] * b1, x1 * a10[k] * b0, x1 * a11[k] * b1
        norm = 1 / (xi[0] + xi[1] + xi[2] + xi[3])
        marginal[place[k][ok]] = ((xi[1] + xi[3]) * norm)[ok]
        expected += np.array([(v * norm)[ok].sum() for v in xi]).reshape(2, 2)
        y0, y1 = a00[k] * b0 + a01[k] * b1, a10[k] * b0 + a11[k] * b1
        norm = 1 / (y0 + y1)
        b0, b1 = y0 * norm, y1 * norm
    return marginal, expected


def document_features(marginal: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Strongest word's logit, log of the expected number of toxic words, their share."""
    p = np.clip(marginal, 1e-6, 1 - 1e-6)
    sizes = np.diff(offsets)
    best = np.full(len(sizes), 1e-6)
    some = np.flatnonzero(sizes > 0)
    if len(some):
        best[some] = np.maximum.reduceat(p, offsets[some])
    count = segment_sum(p, offsets)
    return np.stack([np.clip(np.log(best / (1 - best)), -6, 6), np.log1p(count), 10 * count / np.maximum(1, sizes)], 1)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    transition: np.ndarray
    logistic: np.ndarray  # constant, then one weight a document feature

    def marginals(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        codes, offsets, words = split_words(texts)
        each = self.weights[word_features(words)].sum(1) + self.bias
        return forward_backward(each[codes].astype(np.float64), offsets, self.transition)[0], offsets

    def score(self, marginal: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(document_features(marginal, offsets) @ self.logistic[1:] + self.logistic[0], -40, 40)))


def constant_model(share: float) -> ToxicityModel:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return ToxicityModel(np.zeros(BUCKETS, np.float32), 0.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0, 0]))


def text_slices(texts: pa.StringArray):
    """Runs of texts of about two megabytes: the driver's memory stays small."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    return (part.column("text") for part in slices(batch, limit=2 << 20))


def without_near_copies(texts: pa.StringArray) -> np.ndarray:
    """Places of texts that share no MinHash band with an earlier text of the sample."""
    keys = [np.zeros((0, BANDS), np.int64), *(band_keys(minhashes(*shingles(*word_hashes(part)))) for part in text_slices(texts))]
    keys = np.concatenate(keys)
    _, first, own = np.unique(keys, return_index=True, return_inverse=True)
    return np.flatnonzero((first[own].reshape(-1, BANDS) // BANDS == np.arange(len(keys))[:, None]).all(1))


def coded_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """What split_words() gives, made of one slice after the other, with codes of four bytes."""
    parts, sizes = [], [np.zeros(1, np.int64)]
    for part in text_slices(texts):
        codes, offsets, words = split_words(part)
        parts.append(pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32)), words))
        sizes.append(np.diff(offsets))
    parts = pa.chunked_array(parts, pa.dictionary(pa.int32(), pa.string())).unify_dictionaries().chunks
    words = parts[0].dictionary if parts else pa.array([], pa.string())
    return np.concatenate([np.zeros(0, np.int32), *(x.indices.to_numpy() for x in parts)]), np.cumsum(np.concatenate(sizes)), words


def listed_features(words: pa.StringArray) -> np.ndarray:
    """word_features() of all words, made of some at a time, in four bytes each."""
    out = np.zeros((len(words), 1 + len(PREFIXES) + len(SUFFIXES)), np.int32)
    for a in range(0, len(words), WORDS):
        out[a : a + WORDS] = word_features(words.slice(a, WORDS))
    return out


def runs_of(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of whole texts of about FIELD_TOKENS words."""
    begin = np.flatnonzero(np.diff(offsets[:-1] // FIELD_TOKENS, prepend=-1))
    return list(zip(begin.tolist(), [*begin[1:].tolist(), len(offsets) - 1], strict=True))


def token_labels(codes: np.ndarray, offsets: np.ndarray, features: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of all tokens, and the evidence of every distinct word."""
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    held = np.zeros((2, features.shape[1], BUCKETS), np.int32)  # clean and toxic texts with each feature
    for a, b in runs_of(offsets):
        doc = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        pairs = np.unique(doc * len(features) + codes[offsets[a] : offsets[b]])
        doc_of, word_of = pairs // len(features), pairs % len(features)
        for k, column in enumerate(features.T):
            found = np.unique(doc_of * BUCKETS + column[word_of])
            bucket, is_toxic = found % BUCKETS, toxic[a + found // BUCKETS]
            for kind in (0, 1):
                held[kind, k] += np.bincount(bucket[is_toxic == kind], minlength=BUCKETS).astype(np.int32)
    evidence = np.full(len(features), -np.inf)
    for column, c, t in zip(features.T, *held, strict=True):
        value = np.log((np.maximum(t - 1.5 * np.sqrt(t), 0) + 0.02) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
        value[(t < 3) | (np.arange(BUCKETS) == 0)] = -np.inf
        evidence = np.maximum(evidence, value[column])
    return (evidence >= LEAST_EVIDENCE)[codes] & np.repeat(toxic, np.diff(offsets)), evidence


def fit_field(codes: np.ndarray, offsets: np.ndarray, features: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Gradient ascent (Adam) on the conditional likelihood of the tokens' labels."""
    n_features = BUCKETS + 5  # weights, bias, transitions
    theta, m, v = np.zeros(n_features), np.zeros(n_features), np.zeros(n_features)
    theta[BUCKETS] = -4.0
    runs, observed = runs_of(offsets), np.zeros(4)  # gradients of the runs add up
    for a, b in runs:
        y = label[offsets[a] : offsets[b]].astype(np.int64)
        previous = np.append(0, y)[:-1]
        begins = offsets[a:b][np.diff(offsets[a : b + 1]) > 0] - offsets[a]
        previous[begins] = 0
        observed += np.bincount(previous * 2 + y, minlength=4)
    some_words = [slice(a, a + WORDS) for a in range(0, max(1, len(features)), WORDS)]
    for k in range(1, ROUNDS + 1):
        each = np.concatenate([theta[features[part]].sum(1) for part in some_words]) + theta[BUCKETS]
        by_word, expected = np.zeros(len(features)), np.zeros((2, 2))
        for a, b in runs:
            part = slice(offsets[a], offsets[b])
            marginal, some = forward_backward(each[codes[part]], offsets[a : b + 1] - offsets[a], theta[BUCKETS + 1 :].reshape(2, 2))
            by_word += np.bincount(codes[part], weights=label[part].astype(np.int64) - marginal, minlength=len(features))
            expected += some
        slope = np.zeros(n_features)
        for part in some_words:
            np.add.at(slope, features[part].ravel(), np.repeat(by_word[part], features.shape[1]))
        slope[0] = 0.0
        slope[BUCKETS] = by_word.sum()
        slope[BUCKETS + 1 :] = observed - expected.ravel()
        slope -= DECAY * len(codes) ** 0.5 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        theta += RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-3)
        theta[0] = 0.0
    return theta[:BUCKETS].astype(np.float32), float(theta[BUCKETS]), theta[BUCKETS + 1 :].reshape(2, 2)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    a, w = np.hstack([np.ones((len(x), 1)), x]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1e-6, *[0.05] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + ridge
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge @ w)
        w = w + np.clip(step, -5, 5)
    return w


def train(texts: pa.StringArray, toxic: np.ndarray, share: float) -> ToxicityModel:
    """share: the toxic share among all labelled documents, to which scores are set."""
    kept = without_near_copies(texts)
    texts, toxic = texts.take(pa.array(kept)), toxic[kept]
    if not toxic.any() or toxic.all():
        return constant_model(share)
    codes, offsets, words = coded_words(texts)
    features = listed_features(words)
    label, _ = token_labels(codes, offsets, features, toxic)
    weights, bias, transition = fit_field(codes, offsets, features, label)
    model = ToxicityModel(weights, bias, transition, np.zeros(4))
    del codes, features, label
    x = np.concatenate([document_features(*model.marginals(part)) for part in text_slices(texts)])
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    model.logistic = fit_logistic(x, toxic.astype(np.float64), weight)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> ToxicityModel:
    """A model from about max_toxic and max_clean labelled documents, chosen by the id's
    hash; beyond max_bytes, as many of these in the hash's order as fit, whole."""
    known = labels.where(F.col(label_col).isNotNull()).select(id_col, (F.col(label_col) == 1).alias("toxic"))
    sizes = known.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    if not sizes[0] or not sizes[1]:
        return constant_model(sizes[0] / max(1, sum(sizes)))
    share = [min(1.0, most / n) for most, n in zip((max_toxic, max_clean), sizes, strict=True)]
    drawn = unit_hash(F.col(id_col), 1)
    known = known.where(drawn < F.when(F.col("toxic"), share[0]).otherwise(share[1]))
    sample = docs.where(drawn < max(share)).select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(known, id_col)
    order = [F.xxhash64(id_col), F.xxhash64("text"), F.col("toxic")]
    held = sample = stored(sample.select(*[c.alias(f"order{k}") for k, c in enumerate(order)], F.octet_length("text").alias("size"), "text", "toxic"), "toxicity-sample")
    # about max_toxic + max_clean rows: their sizes fit the driver, and then the chosen texts
    orders = ["order0", "order1", "order2"]
    listed = sample.select(*orders, "size").orderBy(*orders).toArrow()
    over = np.flatnonzero(listed.column("size").to_numpy().astype(np.int64).cumsum() > max_bytes)
    if len(over):
        sample = sample.where(F.col("order0") < listed.column("order0")[max(1, int(over[0]))].as_py())
    table = sample.orderBy(*orders).select("text", "toxic").toArrow()
    forget(held)
    model = train(text_array(table.column("text")), table.column("toxic").to_numpy(), sizes[0] / sum(sizes))
    del listed, table
    give_back()
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None, spans: bool = False) -> DataFrame:
    """id, the columns of `extra`, score, predicted, and with `spans` the offending
    character ranges (start, end, probability), words in a row as one range."""
    extra = extra or {}
    passed = list(extra)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[c.alias(k) for k, c in extra.items()])
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in ["id", *extra])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_array(batch.column("text"))
        marginal, offsets = shared.value.marginals(texts)
        score = shared.value.score(marginal, offsets)
        columns = [batch.column("id"), *(batch.column(k) for k in passed), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
        names = ["id", *passed, "score", "predicted"]
        if spans:
            some = segment_sum((marginal >= 0.5).astype(np.int64), offsets) > 0
            columns.append(pa.array([offending(texts[k].as_py(), marginal[offsets[k] : offsets[k + 1]]) if some[k] else [] for k in range(len(texts))], span_type))
            names.append("spans")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = f"{kinds}, score double, predicted int" + ", spans array<struct<start:int,end:int,probability:double>>" * spans
    return map_slices(rows, run, schema, after=give_back).withColumnRenamed("id", id_col)


def offending(text: str, marginal: np.ndarray) -> list[dict]:
    """Character ranges of runs of words whose marginal is at least one half."""
    found: list[dict] = []
    at, last = 0, -2
    for k, word in enumerate(w for w in pc.utf8_split_whitespace(pa.array([text], pa.string()))[0].as_py() if w):
        start = text.index(word, at)
        at = start + len(word)
        if marginal[k] >= 0.5:
            if last == k - 1:
                found[-1]["end"] = at
                found[-1]["probability"] = max(found[-1]["probability"], float(marginal[k]))
            else:
                found.append({"start": start, "end": at, "probability": float(marginal[k])})
            last = k
    return found


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = fit_toxicity(docs, labels.where(~held_out))
    return score_toxicity(docs, model, extra={"held_out": held_out}, spans=True)
