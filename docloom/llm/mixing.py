"""Mixing sources to target weights by temperature, in DataFrame functions alone.

A source's weight is its token share to the power of an exponent, normalised.
The exponent is bisected on [0, 1]: the largest one whose weights reach the
target entropy (a share of the greatest possible), raised where the least
exponent that keeps every source within the repetition limit is higher.  Each
weight times the budget is realised as whole epochs of the source and one part
epoch.  An epoch is a permutation of the source's blocks of about BLOCK_TOKENS
tokens and of the documents in each block; the part epoch takes blocks, and
documents of the block at the border, in that order while their tokens fit.

Only ranges of blocks and the blocks of a range are summed over windows; no source
meets in one task.  Documents within a border block, about BLOCK_TOKENS tokens, are
ordered in one.  Texts are split once, and again in border blocks; whole rows are
shuffled in border blocks alone, while the table of blocks is small enough to broadcast.

Defined results: a null source is a source of its own; null and empty texts have
no tokens; a source without tokens is taken once; equal ids are ordered by their
number of tokens, then by their texts' hashes; a row without id goes by its text's
hash; an empty table gives an empty one; columns of the input are kept, and the
outcome is one struct column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import forget, stored

TARGET_ENTROPY, MAX_REPEATS, BLOCK_TOKENS, SEED = 0.93, 4.0, 1 << 20, "mix"
LEVELS, AT_ONCE, RANGE_BITS = 40, 4, 10


def word_count(text: Column) -> Column:
    """Number of white-space-separated words."""
    return F.size(F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def hashed(*parts: Column | str) -> Column:
    """60 bits of the md5 of the parts."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def bisect(holds, low_side: bool) -> float:
    """The border of a monotone condition on [0, 1] after LEVELS halvings.

    holds(points) gives the condition at each point; low_side: it holds below
    the border, which is approached from there.  AT_ONCE halvings are one pass.
    """
    low, high = 0.0, 1.0
    for _ in range(LEVELS // AT_ONCE):
        n = 1 << AT_ONCE
        points = [low + (high - low) * k / n for k in range(1, n)]
        good = holds(points)
        a, b = 0, n
        while b - a > 1:
            mid = (a + b) // 2
            if good[mid - 1] == low_side:
                a = mid
            else:
                b = mid
        low, high = low + (high - low) * a / n, low + (high - low) * b / n
    return low if low_side else high


def exponent(sources: DataFrame, budget: float, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent for (key, tokens) rows with tokens above 0."""
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not total or n < 2:
        return 1.0
    if budget > max_repeats * total:
        raise ValueError("the budget exceeds what the repetition limit allows")
    share = F.col("tokens") / F.lit(float(total))
    greatest = float(sources.agg(F.log(F.count("*").cast("double"))).first()[0])

    def at(points: list[float]) -> list[tuple[float, float]]:
        """Entropy and largest repetition at each exponent."""
        sums = []
        for p in points:
            w = F.pow(share, F.lit(p))
            sums += [F.sum(w), F.sum(w * F.log(share)), F.max(w / F.col("tokens"))]
        r = sources.agg(*sums).first()
        return [(math.log(r[3 * k]) - p * r[3 * k + 1] / r[3 * k], budget * r[3 * k + 2] / r[3 * k]) for k, p in enumerate(points)]

    entropy, repeats = zip(*at([0.0, 1.0]), strict=True)
    wanted = target_entropy * greatest
    by_entropy = 1.0 if entropy[1] >= wanted else bisect(lambda ps: [h >= wanted for h, _ in at(ps)], True)
    by_repeats = 0.0 if repeats[0] <= max_repeats else bisect(lambda ps: [r > max_repeats for _, r in at(ps)], True)
    if repeats[0] > max_repeats:
        by_repeats += 2.0**-LEVELS
    return round(max(by_entropy, by_repeats), 9)


def mixture(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None, budget: int | None = None,
            target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: str = SEED, out: str = "mix") -> DataFrame:
    """Rows of `df` once for each epoch that takes them, with a struct column `out`:
    weight, epoch, block (its place in the epoch's permutation is block_key), block_key,
    place_key, n_tokens.  budget: tokens in all; by default those of the input.
    """
    text = F.xxhash64(F.col(text_col).cast("string")) if text_col in df.columns else F.lit(0).cast("long")
    key = F.concat_ws("", F.when(F.col(source_col).isNull(), "n").otherwise("s"), F.col(source_col).cast("string"))
    count = word_count(F.col(text_col)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))
    id_text = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), text.cast("string")))
    light = df.select(key.alias("key"), count.alias("n"), id_text.alias("id"))
    if tokens is None:  # texts are split once; every halving and every block reads the counts
        light = stored(light, "mixing-counts")
    sums = stored(light.groupBy("key").agg(F.sum("n").alias("tokens")), "source-tokens")
    full = sums.where("tokens > 0")
    total = full.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    alpha = exponent(full, float(budget), target_entropy, max_repeats) if total else 1.0
    power = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(alpha))
    norm = full.agg(F.sum(power)).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.round(power / F.lit(norm), 12)).otherwise(0.0)
    plan = sums.select("key", "tokens", weight.alias("weight"), F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias("n_blocks"))
    # weights are good to about 1e-12 of the budget; a share that close to whole epochs is whole
    slack = math.ceil(budget * 1e-11)
    plan = plan.withColumn("part", F.floor(F.col("weight") * F.lit(float(budget)) + 0.5).cast("long"))
    epochs = F.floor((F.col("part") + slack) / F.greatest("tokens", F.lit(1))).cast("long")
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, epochs).otherwise(F.lit(1).cast("long")))
    rest = F.greatest(F.lit(0), F.col("part") - F.col("epochs") * F.col("tokens")).cast("long")
    plan = plan.withColumn("rest", F.when(F.col("tokens") > 0, rest).otherwise(F.lit(0).cast("long"))).drop("part")
    block = F.pmod(hashed(seed, F.col("id")), "n_blocks").alias("block")
    block_key = lambda epoch: hashed(seed, epoch, F.col("key"), F.col("block"))
    place_key = lambda epoch: hashed(seed, epoch, F.col("id"))
    sizes = light.join(plan, "key").select("key", "n", "epochs", "rest", block).groupBy("key", "block").agg(F.sum("n").alias("size"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"))
    # prefix sums over a source's blocks: over RANGES ranges of its order, then within each
    sizes = stored(sizes.withColumn("order", block_key(F.col("epochs"))).withColumn("range", F.expr(f"shiftright(order, {60 - RANGE_BITS})")), "mixing-blocks")
    ranges = sizes.groupBy("key", "range").agg(F.sum("size").alias("in_range"))
    ranges = ranges.withColumn("ahead", F.sum("in_range").over(Window.partitionBy("key").orderBy("range")) - F.col("in_range")).drop("in_range")
    before = F.sum("size").over(Window.partitionBy("key", "range").orderBy("order", "block")) - F.col("size") + F.col("ahead")
    placed = sizes.join(ranges, ["key", "range"]).withColumn("before", before)
    border = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest"))
    state = F.when(border, "border").when((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") <= F.col("rest")), "in").otherwise("out")
    placed = stored(placed.select("key", "block", "before", state.alias("state")), "mixing-places")  # a known size: no shuffle of texts for few blocks
    forget(sizes, *([light] if tokens is None else []))
    rows = df.select(F.struct("*").alias("row"), key.alias("key"), id_text.alias("id"), text.alias("text_hash"), *([] if tokens is None else [count.alias("given")]))
    again = word_count(F.col(f"row.{text_col}")) if tokens is None else F.col("given")
    dealt = rows.join(plan, "key").select("*", block).join(placed, ["key", "block"])
    inside = Window.partitionBy("key", "block").orderBy(place_key(F.col("epochs")), "n", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    sure = dealt.where("state != 'border'").withColumn("more", (F.col("state") == "in").cast("long")).withColumn("n", again)
    edge = dealt.where("state = 'border'").withColumn("n", again).withColumn("more", (F.col("before") + F.sum("n").over(inside) <= F.col("rest")).cast("long"))
    counted = sure.unionByName(edge.select(sure.columns)).where(F.col("epochs") + F.col("more") > 0)
    repeated = counted.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") + F.col("more") - 1)))
    mix = F.struct("weight", "epoch", "block", block_key(F.col("epoch")).alias("block_key"), place_key(F.col("epoch")).alias("place_key"), F.col("n").alias("n_tokens"))
    return repeated.select("row.*", mix.alias(out))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    light = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("n_words")), "word-counts")
    mixed = mixture(light, tokens=F.col("n_words"))
    return mixed.select("doc_id", "source", "mix.n_tokens", "mix.epoch", "mix.block", "mix.block_key", "mix.place_key", F.round("mix.weight", 9).alias("weight"))


OP8_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, 's' || source AS key,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS n
  FROM documents
), s AS (SELECT key, sum(n)::BIGINT AS tokens FROM d GROUP BY key),
t AS (SELECT sum(tokens)::DOUBLE AS total, ln(count(*)::DOUBLE) AS greatest, count(*) AS k FROM s WHERE tokens > 0),
q AS (SELECT key, tokens, tokens / total AS share, total FROM s, t WHERE tokens > 0),
e AS (
  SELECT 0 AS level, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT level + 1,
    CASE WHEN h >= {TARGET_ENTROPY} * (SELECT greatest FROM t) THEN (low + high) / 2 ELSE low END,
    CASE WHEN h >= {TARGET_ENTROPY} * (SELECT greatest FROM t) THEN high ELSE (low + high) / 2 END
  FROM (SELECT level, low, high, (SELECT ln(sum(pow(share, (low + high) / 2))) - (low + high) / 2 * sum(pow(share, (low + high) / 2) * ln(share)) / sum(pow(share, (low + high) / 2)) FROM q) AS h FROM e WHERE level < {LEVELS})
), r AS (
  SELECT 0 AS level, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT level + 1,
    CASE WHEN x > {MAX_REPEATS} THEN (low + high) / 2 ELSE low END,
    CASE WHEN x > {MAX_REPEATS} THEN high ELSE (low + high) / 2 END
  FROM (SELECT level, low, high, (SELECT any_value(total) * max(pow(share, (low + high) / 2) / tokens) / sum(pow(share, (low + high) / 2)) FROM q) AS x FROM r WHERE level < {LEVELS})
), a AS (
  SELECT CASE WHEN (SELECT k FROM t) < 2 THEN 1.0 ELSE round(greatest(
    CASE WHEN (SELECT ln(sum(share)) - sum(share * ln(share)) / sum(share) FROM q) >= {TARGET_ENTROPY} * (SELECT greatest FROM t) THEN 1.0 ELSE (SELECT low FROM e WHERE level = {LEVELS}) END,
    CASE WHEN (SELECT any_value(total) * max(1.0 / tokens) / count(*) FROM q) <= {MAX_REPEATS} THEN 0.0 ELSE (SELECT low + pow(2.0, -{LEVELS}) FROM r WHERE level = {LEVELS}) END), 9) END::DOUBLE AS alpha
), p AS (
  SELECT s.key, s.tokens, CASE WHEN s.tokens > 0 THEN round(pow(s.tokens / total, alpha) / (SELECT sum(pow(share, alpha)) FROM q), 12) ELSE 0.0 END AS weight,
         greatest(1, ceil(s.tokens / {BLOCK_TOKENS}.0))::BIGINT AS n_blocks, total
  FROM s, t, a
), plan AS (
  SELECT *, CASE WHEN tokens > 0 THEN greatest(0, part - epochs * tokens) ELSE 0 END AS rest
  FROM (SELECT *, CASE WHEN tokens > 0 THEN (part + ceil(total * 1e-11)::BIGINT) // greatest(tokens, 1) ELSE 1 END AS epochs FROM (SELECT *, floor(weight * total + 0.5)::BIGINT AS part FROM p) y) x
), dealt AS (
  SELECT d.*, plan.weight, plan.epochs, plan.rest, (('0x' || substr(md5('{SEED}:' || doc_id), 1, 15))::BIGINT) % n_blocks AS block
  FROM d JOIN plan USING (key)
), sizes AS (
  SELECT key, block, sum(n)::BIGINT AS size, any_value(rest) AS rest,
         (sum(sum(n)) OVER (PARTITION BY key ORDER BY ('0x' || substr(md5('{SEED}:' || any_value(epochs) || ':' || key || ':' || block), 1, 15))::BIGINT, block) - sum(n))::BIGINT AS before
  FROM dealt GROUP BY key, block
), counted AS (
  SELECT dealt.*, CASE WHEN before >= sizes.rest THEN 0 WHEN before + size <= sizes.rest THEN 1
    WHEN before + sum(n) OVER (PARTITION BY key, block ORDER BY ('0x' || substr(md5('{SEED}:' || epochs || ':' || doc_id), 1, 15))::BIGINT, n ROWS UNBOUNDED PRECEDING) <= sizes.rest THEN 1 ELSE 0 END AS more
  FROM dealt JOIN sizes USING (key, block)
), repeated AS (SELECT *, unnest(range(epochs + more)) AS epoch FROM counted)
SELECT doc_id, source, n AS n_tokens, epoch, block,
       ('0x' || substr(md5('{SEED}:' || epoch || ':' || key || ':' || block), 1, 15))::BIGINT AS block_key,
       ('0x' || substr(md5('{SEED}:' || epoch || ':' || doc_id), 1, 15))::BIGINT AS place_key,
       round(weight, 9) AS weight
FROM repeated
"""
