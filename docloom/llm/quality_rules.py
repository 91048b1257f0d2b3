"""Quality rules: learned decision lists over text statistics, in DataFrame functions alone.

Every text gets counts of words, symbols, repeated lines and repeated eight-word
windows.  Base rules reject short and repetitive texts.  A decision list learned
by sequential covering judges the others: a rule grows condition by condition
(statistic <= or > threshold) by information gain on two thirds of the labelled
rows, is pruned from its end on the remaining third, and is kept while it is
precise enough there; the rows it covers leave.  The list is emitted as one
ordered conditional expression of Spark columns.

Fitting takes a sample of about SAMPLE_ROWS labelled rows; each step is one
grouped count over them with at most statistics x thresholds x 4 result rows.

Defined results: null texts have no words and fail the base rules; a null id is
kept; repeated rows are judged alike; without labelled rows of both kinds the
list is empty and the base rules decide; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import forget, stored, unit_hash

#: Fixed values of the contract: white space, symbols, window, limits.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

SAMPLE_ROWS, THRESHOLDS, MOST_RULES, MOST_CONDITIONS = 20_000, 31, 12, 4
LEAST_PRECISION, LEAST_COVERED = 0.9, 3
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base counts, and the further counts n_lines, n_unique, n_upper, n_shouts, n_chars."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pattern = r"[\x20\x09-\x0D]+"
    trimmed = F.btrim("text", F.lit(SPACE))  # so that the split leaves no empty words
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, pattern))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = bound(rows, ["id", "text"], words=words, lines=lines)
    counted = bound(
        rows,
        ["id"],
        n_words=F.size("words").cast("long"),
        word_chars=F.char_length(F.array_join("words", "")).cast("long"),
        n_chars=F.char_length("text").cast("long"),
        n_symbols=F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long"),
        n_upper=F.regexp_count("text", F.lit("[A-Z]")).cast("long"),
        not_shouts=F.char_length(F.replace("text", F.lit("!"), F.lit(""))).cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_distinct_lines=F.size(F.array_distinct("lines")).cast("long"),
        n_unique=F.size(F.array_distinct("words")).cast("long"),
        windows=F.transform("words", lambda w: F.xxhash64(w)),
    )
    kept = [c for c in counted.columns if c != "windows"]
    step = 1
    while step < WINDOW:  # hashes of 2, 4 and 8 words from those of half as many
        left = F.greatest(F.lit(0), F.size("windows") - step)
        halves = F.slice("windows", F.lit(1), left), F.slice("windows", F.lit(1 + step), left)
        counted = bound(counted, kept, windows=F.zip_with(*halves, lambda a, b: F.xxhash64(a, b)))
        step *= 2
    once = F.size(F.array_distinct("windows")) == F.size("windows")
    return bound(
        counted,
        ["id", "n_words", "word_chars", "n_lines", "n_unique", "n_chars", "n_symbols", "n_upper"],
        n_dup_lines=F.col("n_lines") - F.col("n_distinct_lines"),
        n_repeat_words=F.when(once, F.lit(0)).otherwise(repeated_words(F.col("windows"))).cast("long"),
        n_shouts=F.col("n_chars") - F.col("not_shouts"),
    )


def bound(df: DataFrame, kept: list[str], **made: Column) -> DataFrame:
    """Columns `kept` and `made`, each made value computed once: a generator of one row
    stands between, so that filters above don't repeat the expressions below."""
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))))


def repeated_words(windows: Column) -> Column:
    """Number of words in windows whose hash occurs again: sorts (hash, place), takes the
    places whose neighbour has the same hash, and adds what each covers beyond the one before."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = lambda p, x, k: F.get(p, k - 1)["h"].eqNullSafe(x["h"]) | F.get(p, k + 1)["h"].eqNullSafe(x["h"])
    places = lambda p: F.array_sort(F.filter(F.transform(p, lambda x, k: F.when(again(p, x, k), x["i"])), lambda i: i.isNotNull()))
    tagged = F.transform(F.array(pairs), places)[0]  # the one-element array binds the sorted pairs to a name
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last"))
    return F.aggregate(tagged, start, step, lambda s: s["n"])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """The statistics that rules test; none depends on a text's length alone."""
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "symbols_per_char": part("n_symbols", "word_chars"),
        "symbols_per_word": part("n_symbols", "n_words"),
        "shouts_per_word": part("n_shouts", "n_words"),
        "upper_per_char": part("n_upper", "word_chars"),
        "chars_per_word": part("word_chars", "n_words"),
        "repeated_share": part("n_repeat_words", "n_words"),
        "dup_line_share": part("n_dup_lines", "n_lines"),
        "unique_share": part("n_unique", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    below: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.statistic] <= self.threshold if self.below else of[self.statistic] > self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'<=' if self.below else '>'} {self.threshold:.6g}"


Rule = list[Condition]


def conjunction(rule: Rule, of: dict[str, Column]) -> Column:
    result = F.lit(True)
    for c in rule:
        result = result & c.column(of)
    return result


def verdict(rules: list[Rule], of: dict[str, Column]) -> Column:
    """True for texts to keep: the first rule that holds rejects."""
    if not rules:
        return F.lit(True)
    result = F.when(conjunction(rules[0], of), F.lit(False))
    for rule in rules[1:]:
        result = result.when(conjunction(rule, of), F.lit(False))
    return result.otherwise(F.lit(True))


def bin_of(statistic: str, edges: list[float]) -> Column:
    """Number of edges below the statistic."""
    return F.aggregate(F.lit(edges), F.lit(0), lambda n, t: n + F.when(F.col(statistic) > t, 1).otherwise(0))


def learn_rules(table: DataFrame) -> list[Rule]:
    """Sequential covering on (statistics..., bad boolean, prune boolean)."""
    names = [c for c in table.columns if c not in ("bad", "prune")]
    own = {c: F.col(c) for c in names}
    cuts = table.agg(*[F.percentile_approx(c, [(k + 1) / (THRESHOLDS + 1) for k in range(THRESHOLDS)], 10_000).alias(c) for c in names], F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("n_good")).first()
    bad_cuts = table.where("bad").agg(*[F.percentile_approx(c, [(k + 1) / (THRESHOLDS + 1) for k in range(THRESHOLDS)], 10_000).alias(c) for c in names]).first()
    if not cuts["n_bad"] or not cuts["n_good"]:
        return []
    edges = {c: sorted({*cuts[c], *bad_cuts[c]}) for c in names}

    def counts(rows: DataFrame) -> dict[str, list[list[int]]]:
        """For each statistic and threshold bin: [good, bad] numbers of rows."""
        bins = F.array(*[F.struct(F.lit(c).alias("c"), bin_of(c, edges[c]).alias("b")) for c in names])
        grouped = rows.select("bad", F.explode(bins).alias("x")).groupBy("x.c", "x.b").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
        out = {c: [[0, 0] for _ in range(len(edges[c]) + 1)] for c in names}
        for r in grouped.collect():  # statistics x thresholds rows at most
            out[r["c"]][r["b"]] = [r["good"], r["bad"]]
        return out

    def judged(rows: DataFrame, rule: Rule) -> list[tuple[Rule, int, int]]:
        """The rule and its shorter forms with the bad and good rows they cover, in one pass."""
        forms = [rule[:k] for k in range(len(rule), 0, -1)]
        hit = [conjunction(form, own) for form in forms]
        r = rows.agg(*[F.count_if(h & F.col("bad")) for h in hit], *[F.count_if(h & ~F.col("bad")) for h in hit]).first()
        return [(form, r[k], r[k + len(forms)]) for k, form in enumerate(forms)]

    rules: list[Rule] = []
    left = table
    while len(rules) < MOST_RULES:
        grow, prune, rule = left.where("not prune"), left.where("prune"), []
        while len(rule) < MOST_CONDITIONS:
            here = counts(grow.where(conjunction(rule, own)))
            good, bad = (sum(x[k] for x in here[names[0]]) for k in (0, 1))
            if not bad or not good:
                break
            best, best_gain, was = None, 0.0, math.log2(bad / (bad + good))
            for c in names:
                g = b = 0
                for t, (dg, db) in zip(edges[c], here[c], strict=False):
                    g, b = g + dg, b + db
                    for below, gg, bb in ((True, g, b), (False, good - g, bad - b)):
                        gain = bb * (math.log2(bb / (bb + gg)) - was) if bb else 0.0
                        if gain > best_gain + 1e-9:
                            best, best_gain = Condition(c, below, t), gain
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        scored = judged(prune, rule)
        worth = lambda x: (x[1] - x[2]) / (x[1] + x[2]) if x[1] + x[2] else -1.0
        rule, bad, good = max(scored, key=worth)
        if bad < LEAST_COVERED or bad < LEAST_PRECISION * (bad + good):
            break
        rule = centred(left, rule)
        rules.append(rule)
        left = left.where(~conjunction(rule, own))
    return rules


def centred(rows: DataFrame, rule: Rule) -> Rule:
    """The rule with each threshold moved to the middle of the gap it stands in."""
    c = [F.col(x.statistic) for x in rule]
    r = rows.agg(*[F.max(F.when(v <= x.threshold, v)) for v, x in zip(c, rule, strict=True)], *[F.min(F.when(v > x.threshold, v)) for v, x in zip(c, rule, strict=True)]).first()
    middle = lambda low, high, t: t if low is None or high is None else (low + high) / 2
    return [Condition(x.statistic, x.below, middle(r[k], r[k + len(rule)], x.threshold)) for k, x in enumerate(rule)]


def fit_quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from a sample of about `sample_rows` labelled documents that the base rules keep."""
    known = labels.where(F.col(label_col).isNotNull()).select(id_col, F.col(label_col).alias("quality"))
    share = min(1.0, sample_rows / max(1, known.count()))
    known = known.where(unit_hash(F.col(id_col), 4) < share)
    chosen = docs.where(unit_hash(F.col(id_col), 4) < share).select(id_col, text_col).join(known, id_col)
    stats = text_statistics(chosen.select(F.struct(id_col, "quality").alias("id"), text_col), "id", text_col).where(~base_failed())
    columns = [c.alias(k) for k, c in ratios().items()]
    table = stats.select(*columns, (F.col("id.quality") == 0).alias("bad"), (unit_hash(F.col(f"id.{id_col}"), 5) < 1 / 3).alias("prune"))
    sample = stored(table, "quality-sample")
    rules = learn_rules(sample.coalesce(4))
    forget(sample)
    return rules


def quality_verdicts(df: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base counts, base_failed, kept."""
    stats = text_statistics(df, id_col, text_col)
    kept = F.when(base_failed(), F.lit(False)).otherwise(verdict(rules, ratios()))
    return stats.select(F.col("id").alias(id_col), *BASE, base_failed().alias("base_failed"), kept.alias("kept"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_verdicts(docs, fit_quality_rules(docs, labels))


def quality_base_counts(spark, sf_dir: str) -> DataFrame:
    """The counts and base rules that SQL can state; the learned list is op4's alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_verdicts(docs, []).drop("kept")


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d) x),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) y WHERE n > 1),
u AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(8)) AS j) z GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) v WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
a AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(u.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN u USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a
"""
