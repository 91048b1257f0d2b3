"""Language identification: multinomial naive Bayes over hashed character n-grams.

A word, lower-cased and between boundary marks, gives its character n-grams of 1
to 4 characters, hashed into BUCKETS.  Priors come from the languages of all rows,
counts from a sample of about ROWS_PER_LANGUAGE documents of each language.
Every language is learned; the matrix of log probabilities is made and broadcast
for LANGUAGE_BLOCK languages at a time (64 MB), and one pass a block keeps each
row's best language so far and the sum of all.  A slice of texts is scored through
its distinct words: one sparse sum of matrix rows a word, then one sum of word
vectors a text.  The score is the winner's posterior probability.

Defined results: `und` with score 0 where a text is null or has no letter, or
where nothing was learned; equal scores go to the language that sorts first; a
null id is kept and counts as the id '' where ids are hashed; repeated rows give
repeated results; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.bayes_join import mixed
from docloom.llm.common import crc_mod, map_slices, segment_sum, slices, split_words, stored, text_array, unit_hash

BUCKETS, LONGEST = 1 << 15, 4
ROWS_PER_LANGUAGE, LANGUAGE_BLOCK, SMOOTHING = 3000, 512, 0.5
UNKNOWN = "und"


def word_ngrams(words: pa.StringArray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, with len(words) + 1 offsets."""
    marked = pc.binary_join_element_wise("\x02", pc.utf8_lower(words), "\x03", "")
    sizes = pc.utf8_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))  # characters from here to the word's end
    owner = np.repeat(np.arange(len(sizes)), sizes)
    found, owners = [], []
    value = np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        shifted = np.zeros(len(points), np.uint64)
        shifted[: len(points) - n + 1] = points[n - 1 :]
        value = value * np.uint64(0x100000001B3) + shifted + np.uint64(1)
        at = np.flatnonzero(left >= n)
        if n == 1:  # the marks alone say nothing
            at = at[points[at] > 3]
        found.append((mixed(value[at] + np.uint64(n)) % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[at])
    order = np.argsort(np.concatenate(owners), kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(owners), minlength=len(sizes)))])
    return np.concatenate(found)[order], offsets


def ngram_counts(df: DataFrame) -> DataFrame:
    """(lang, text) to (lang, bucket, n), summed over each task first."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                codes, offsets, words = split_words(text_array(part.column("text")))
                grams, at = word_ngrams(words)
                owner = np.repeat(np.arange(len(words)), np.diff(at))
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in dict.fromkeys(langs.tolist()):
                    docs = np.flatnonzero(langs == lang)
                    chosen = np.concatenate([codes[offsets[d] : offsets[d + 1]] for d in docs]) if len(docs) else codes[:0]
                    weight = np.bincount(chosen, minlength=len(words)).astype(np.float64)
                    sums = np.bincount(grams, weights=weight[owner], minlength=BUCKETS)
                    totals[lang] = totals.get(lang, 0) + sums
        for lang, sums in totals.items():
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(sums[some].astype(np.int64))], ["lang", "bucket", "n"])

    return df.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Languages in order, their log priors, and the stored counts of n-grams (lang, bucket, n)."""

    def __init__(self, languages: list[str], documents: list[int], counts: DataFrame | None):
        self.languages, self.counts = languages, counts
        self.priors = np.log(np.array(documents, np.float64) / max(1, sum(documents)))

    def blocks(self):
        """(first language, log probabilities of buckets x languages) for LANGUAGE_BLOCK languages at a time."""
        for k in range(0, len(self.languages), LANGUAGE_BLOCK):
            names = self.languages[k : k + LANGUAGE_BLOCK]
            index = {x: j for j, x in enumerate(names)}
            weights = np.full((BUCKETS, len(names)), SMOOTHING, np.float32)
            packed = self.counts.where(F.col("lang").between(names[0], names[-1])).groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
            for row in packed.toArrow().to_batches(max_chunksize=64):  # BUCKETS counts a language at most
                for lang, bucket, n in zip(row.column("lang").to_pylist(), row.column("bucket"), row.column("n"), strict=True):
                    weights[bucket.values.to_numpy(), index[lang]] += n.values.to_numpy()
            yield k, np.log(weights / weights.sum(0, dtype=np.float64)).astype(np.float32)


def log_likelihoods(texts: pa.StringArray, weights: np.ndarray) -> np.ndarray:
    """Texts x languages: sums of the log probabilities of all n-grams of a text."""
    codes, offsets, words = split_words(texts)
    grams, at = word_ngrams(words)
    return segment_sum(segment_sum(weights[grams].astype(np.float64), at)[codes], offsets)


def fit_language_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Priors from all rows with a language; n-gram counts of about rows_per_language of each, chosen by the id's hash."""
    known = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    sizes = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().collect())
    if not sizes:
        return LanguageModel([], [], None)
    share = F.create_map(*[x for lang, n in sizes for x in (F.lit(lang), F.lit(min(1.0, rows_per_language / n)))])
    sample = known.where(unit_hash(F.col("id"), 6) < F.try_element_at(share, F.col("lang")))
    return LanguageModel([lang for lang, _ in sizes], [n for _, n in sizes], stored(ngram_counts(sample), "language-counts"))


def identify_languages(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """id, the columns of `extra`, lang_pred and score (the posterior) of every row."""
    extra = extra or {}
    has_letter = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[c.alias(k) for k, c in extra.items()], has_letter.alias("letter_"))
    # the best language so far, its log joint probability, and the log of the sum of all
    rows = rows.withColumns({"best_": F.lit(-1), "top_": F.lit(float("-inf")), "sum_": F.lit(float("-inf"))})
    context = df.sparkSession.sparkContext
    for first, weights in model.blocks():
        shared = context.broadcast((weights, model.priors[first : first + LANGUAGE_BLOCK]))  # LANGUAGE_BLOCK * BUCKETS floats at most
        last = first + LANGUAGE_BLOCK >= len(model.languages)
        names = [c for c in rows.columns if not (last and c == "text")]  # texts go on only where another block reads them
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)

        def run(batch: pa.RecordBatch, shared=shared, first=first, names=tuple(names)) -> pa.RecordBatch:
            matrix, priors = shared.value
            joint = log_likelihoods(text_array(batch.column("text")), matrix) + priors
            here = joint.argmax(1)
            value = joint[np.arange(len(here)), here]
            best, top, total = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("best_", "top_", "sum_"))
            better = value > top
            best, top = np.where(better, first + here, best), np.where(better, value, top)
            total = np.logaddexp(total, value + np.log(np.exp(joint - value[:, None]).sum(1)))
            columns = [*(batch.column(c) for c in names[:-3]), pa.array(best.astype(np.int32)), pa.array(top), pa.array(total)]
            return pa.RecordBatch.from_arrays(columns, list(names))

        rows = map_slices(rows, run, kinds)
    has = F.col("letter_") & (F.col("best_") >= 0)
    named = F.array(*[F.lit(x) for x in [*model.languages, UNKNOWN]])
    return rows.select(
        F.col("id").alias(id_col), *extra,
        F.when(has, F.get(named, F.col("best_"))).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(has, F.least(F.lit(1.0), F.exp(F.col("top_") - F.col("sum_")))).otherwise(0.0).alias("score"),
    )


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = fit_language_model(docs.where(~held_out))
    return identify_languages(docs, model, extra={"held_out": held_out})
