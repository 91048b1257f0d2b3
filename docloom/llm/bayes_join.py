"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two documents are linked at a Jaccard
similarity of 0.8 or more.

1. Equal word sequences form one class, found by a 128-bit digest; the join runs
   on one row of each class and carries its number of copies.
2. Bands of MinHash values propose candidates: 32 bands of 6 values find a pair
   at 0.8 with probability 0.99994 and one of higher similarity surely enough.
   The texts of a band's key are a bucket; of buckets with the same texts one is
   compared, and a pair counts in the first compared bucket that both are in.
3. A bucket over a size is cut into blocks of bounded numbers of documents and
   shingles, and each pair of blocks is a group of its own.  Signatures alone meet
   first: MinHash values are compared 32 at a time, and a pair is dropped as soon as
   the posterior probability of reaching the threshold, under a uniform prior, is
   below the tolerance.
4. Shingle sets are made for texts with a surviving pair only and meet in the same
   groups, where the surviving pairs are verified exactly.
5. A group returns one row per linked member: links counted with copies, and the
   least member of its local cluster.  Pairs are never emitted.  Groups are read in
   one sorted stream, many small ones at a time.

Defined results: a text of one to four words is one shingle of all its words; a
document without words (null, empty, white space) links to nothing; copies link
to each other; rows are told apart by a number of their own, so that repeated and
null ids are separate rows whose links all count; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import arrow_rows, few, forget, give_back, map_slices, ragged_gather, segment_sum, slices, split_words, stored, text_array
from docloom.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
TOLERANCE, STEP = 1e-5, 32
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 2_000_000
GROUP_ROWS, GROUP_BYTES, PAIRS, WIDE_ROWS, SIGNED_BYTES, FEW_ENTRIES = 4096, 16 << 20, 1 << 18, 500, 4 << 20, 250_000
SLAB = 1 << 15
SEED = 20_240_801

_draw = np.random.default_rng(SEED)
MULTIPLIERS = _draw.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ADDENDS = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    codes, offsets, words = split_words(texts)
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    return each[codes] if len(codes) else np.zeros(0, np.uint64), offsets


def shingles(h: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all windows of n words and their offsets; shorter texts have one."""
    sizes = np.diff(offsets)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    value = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        value *= PRIME
        value += h[k : len(h) - n + 1 + k] if len(value) else value
    inside = np.ones(len(h), bool)
    for k in range(1, n):  # windows may not run over a document's end
        ends = offsets[1:] - k
        inside[ends[(ends >= offsets[:-1])]] = False
    result = np.zeros(int(out_offsets[-1]), np.uint64)
    long = np.repeat(sizes >= n, counts)
    result[long] = value[np.flatnonzero(inside[: len(value)])] if len(value) else value
    for d in np.flatnonzero((sizes > 0) & (sizes < n)):
        acc = np.uint64(sizes[d])
        for x in h[offsets[d] : offsets[d + 1]]:
            acc = np.uint64((int(acc) * int(PRIME) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        result[out_offsets[d]] = acc
    return mixed(result), out_offsets


def minhashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Matrix of documents by MinHash values; documents without shingles have the greatest value."""
    docs = len(offsets) - 1
    out = np.full((docs, BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    low = (values >> np.uint64(32)).astype(np.uint32)
    begin, limit = 0, 1 << 16
    while begin < docs:
        stop = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
        stop = min(docs, max(begin + 1, stop))
        part = low[offsets[begin] : offsets[stop]]
        rows = begin + np.flatnonzero(np.diff(offsets[begin : stop + 1]) > 0)
        if len(rows):
            first = offsets[rows] - offsets[begin]
            work = np.empty_like(part)
            for k in range(BANDS * ROWS):
                np.multiply(part, MULTIPLIERS[k], out=work)
                np.add(work, ADDENDS[k], out=work)
                out[rows, k] = np.minimum.reduceat(work, first)
        begin = stop
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands, different for different bands."""
    groups = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(ROWS):
        key = mixed(key * PRIME + groups[:, :, r])
    return key.view(np.int64)


def survival_table(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values the least matches at which a pair stays:
    P(similarity >= threshold | m of n) under a uniform prior, through the binomial
    sum that equals the incomplete beta function at whole numbers."""
    table = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        table[n] = m
    return table


def digests(h: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    raw = memoryview(np.ascontiguousarray(h).tobytes())
    return [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, h, g): rows with two hashes of the text, by which it is found again."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(SEED), text).alias("g"))


def signed(rows: DataFrame) -> DataFrame:
    """(id, text, h, g) to (id, h, g, row, digest, n_words, signature, bands); row is a number of its own."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, limit=SIGNED_BYTES):
                h, offsets = word_hashes(text_array(part.column("text")))
                signature = minhashes(*shingles(h, offsets))
                keys = band_keys(signature)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                made = [pa.array(np.arange(row, row + len(keys))), pa.array(digests(h, offsets), pa.binary()), pa.array(np.diff(offsets)), pa.array([x.tobytes() for x in signature], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "h", "g")), *made], ["id", "h", "g", "row", "digest", "n_words", "signature", "bands"])
                row += len(keys)
        give_back()

    return rows.select("id", "text", "h", "g").mapInArrow(run, f"id {kind}, h long, g long, row long, digest binary, n_words long, signature binary, bands array<long>")


def shingle_sets(df: DataFrame) -> DataFrame:
    """(text, ...) to (..., signature, shingles): the sets as sorted distinct 64-bit hashes."""
    names = [c for c in df.columns if c != "text"]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, at = shingles(*word_hashes(text_array(batch.column("text"))))
        sets = [np.unique(values[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        signature = pa.array([x.tobytes() for x in minhashes(values, at)], pa.binary())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), signature, pa.array(sets, pa.binary())], [*names, "signature", "shingles"])

    return map_slices(df, run, f"{kinds}, signature binary, shingles binary", after=give_back)


def surviving(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, table: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no step of the incremental comparison drops."""
    kept = []
    for a in range(0, len(i), 1 << 15):
        x, y = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
        matches = np.zeros(len(x), np.int64)
        for n, least in table.items():
            matches += (left[x, n - STEP : n] == right[y, n - STEP : n]).sum(1)
            stay = matches >= least
            x, y, matches = x[stay], y[stay], matches[stay]
        kept.append((x, y))
    return (np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])) if kept else (i, j)


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs' sets, exactly.  group: of each pair, ascending."""
    out = np.zeros(len(i), np.int64)
    cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        used_a, used_b = np.unique(i[a:b]), np.unique(j[a:b])
        dense = b - a > 2 * (len(used_a) + len(used_b))
        out[a:b] = (products if dense else searches)(sets, i[a:b], j[a:b], used_a, used_b)
    return out


def searches(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, used_a: np.ndarray, used_b: np.ndarray) -> np.ndarray:
    """By searching the partners' shingles in each left set."""
    out = np.zeros(len(i), np.int64)
    order = np.argsort(i, kind="stable")
    cuts = np.searchsorted(i[order], used_a)
    for x, pairs in zip(used_a.tolist(), np.split(order, cuts[1:]), strict=True):
        own, others = sets[x], [sets[k] for k in j[pairs].tolist()]
        flat = np.concatenate(others) if len(others) > 1 else others[0]
        if len(own) and len(flat):
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            out[pairs] = segment_sum(hit.astype(np.int64), np.cumsum([0, *map(len, others)]))
    return out


def products(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, used_a: np.ndarray, used_b: np.ndarray) -> np.ndarray:
    """By products of 0/1 matrices over the shingles that both sides have, where pairs are dense."""
    flat_a, flat_b = np.concatenate([sets[k] for k in used_a]), np.concatenate([sets[k] for k in used_b])
    common = np.intersect1d(flat_a, flat_b)
    row_a = np.repeat(np.arange(len(used_a)), [len(sets[k]) for k in used_a])
    row_b = np.repeat(np.arange(len(used_b)), [len(sets[k]) for k in used_b])

    def columns(flat, rows):
        at = np.minimum(np.searchsorted(common, flat), max(0, len(common) - 1))
        hit = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], rows[hit][order]

    col_a, r_a = columns(flat_a, row_a)
    col_b, r_b = columns(flat_b, row_b)
    total = np.zeros((len(used_a), len(used_b)), np.float32)  # whole numbers up to 2**24 are exact
    for c in range(0, len(common), 2048):
        pieces = []
        for col, r, n in ((col_a, r_a, len(used_a)), (col_b, r_b, len(used_b))):
            lo, hi = np.searchsorted(col, [c, c + 2048])
            m = np.zeros((n, 2048), np.float32)
            m[r[lo:hi], col[lo:hi] - c] = 1
            pieces.append(m)
        total += pieces[0] @ pieces[1].T
    return total[np.searchsorted(used_a, i), np.searchsorted(used_b, j)].astype(np.int64)


def pairs_within(starts: np.ndarray, sizes: np.ndarray, left: np.ndarray, whole: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of groups of neighbouring entries, about PAIRS at a time: each of a group's
    first `left` entries with all behind it where the group is whole, else with those from `left` on."""
    group = np.repeat(np.arange(len(sizes)), left)
    place = np.arange(len(group)) - np.repeat(np.cumsum(left) - left, left)
    first = starts[group] + place
    begin = np.where(whole[group], first + 1, starts[group] + left[group])
    count = starts[group] + sizes[group] - begin
    total = np.cumsum(count)
    at = 0
    while at < len(first):
        done = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        i = np.repeat(first[at:stop], count[at:stop])
        yield i, ragged_gather(begin[at:stop], count[at:stop])
        at = stop


class Groups:
    """Whole groups (key, bi, bj) of a sorted stream; in a group the entries of block bi come first."""

    def __init__(self, table: pa.Table, survival: dict[int, int]):
        self.table, self.survival = table, survival
        column = lambda c: table.column(c).to_numpy()
        at = np.stack([column(c) for c in ("key", "bi", "bj")])
        self.starts = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0).any(0)])) if table.num_rows else np.zeros(0, np.int64)
        self.sizes = np.diff(np.append(self.starts, table.num_rows))
        self.left = np.add.reduceat((column("block") == at[1]).astype(np.int64), self.starts) if table.num_rows else self.sizes
        self.whole = at[1][self.starts] == at[2][self.starts]
        raw = table.column("signature").combine_chunks()
        self.signature = np.frombuffer(b"".join(raw.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
        self.band, self.mask = column("band").astype(np.int64), column("mask")

    def survivors(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that the posterior keeps, each in the first bucket of both that is compared."""
        keys = band_keys(self.signature)
        bit = np.int64(1) << np.arange(BANDS)
        for i, j in pairs_within(self.starts, self.sizes, self.left, self.whole):
            i, j = surviving(self.signature, self.signature, i, j, self.survival)
            own = np.zeros(len(i), bool)
            for a in range(0, len(i), SLAB):  # a slab's keys are 16 MB
                x, y = i[a : a + SLAB], j[a : a + SLAB]
                same = (keys[x] == keys[y]) & ((self.mask[x, None] & bit) != 0)
                own[a : a + SLAB] = same.argmax(1) == self.band[x]
            yield i[own], j[own]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A stream sorted by (key, bi, bj) in runs of whole groups of about GROUP_ROWS rows or GROUP_BYTES."""
    held: list[pa.RecordBatch] = []
    rows, size, last = 0, 0.0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(c).to_numpy() for c in ("key", "bi", "bj")])
        new = np.concatenate([[last is not None and (at[:, 0] != last).any()], (np.diff(at) != 0).any(0)])
        last, width, begin = at[:, -1], batch.nbytes / batch.num_rows, 0
        for cut in np.flatnonzero(new).tolist():  # a group begins here
            if rows + cut - begin >= GROUP_ROWS or size + (cut - begin) * width >= GROUP_BYTES:
                if cut > begin:
                    held.append(batch.slice(begin, cut - begin))
                yield pa.Table.from_batches(held)
                held, rows, size, begin = [], 0, 0.0, cut
        held.append(batch.slice(begin))
        rows += batch.num_rows - begin
        size += (batch.num_rows - begin) * width
    if held:
        yield pa.Table.from_batches(held)


def sorted_groups(df: DataFrame) -> DataFrame:
    return df.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", F.col("block") != F.col("bi"), "row")


def with_survivors(df: DataFrame, survival: dict[int, int]) -> DataFrame:
    """The (row, key, band, block, bi, bj) of entries that have a pair to verify."""
    names = ["row", "key", "band", "block", "bi", "bj"]

    def run(batches):
        for table in whole_groups(batches):
            groups, hit = Groups(table, survival), np.zeros(table.num_rows, bool)
            for i, j in groups.survivors():
                hit[i] = hit[j] = True
            if hit.any():
                yield from table.select(names).filter(pa.array(hit)).combine_chunks().to_batches()
        give_back()

    return sorted_groups(df).mapInArrow(run, "row long, key long, band int, block long, bi long, bj long")


def verified(df: DataFrame, threshold: Fraction, survival: dict[int, int]) -> DataFrame:
    """(row, links, texts, hub) of entries with a link: links counts copies, hub is the least row of the local cluster."""

    def run(batches):
        for table in whole_groups(batches):
            groups, n = Groups(table, survival), table.num_rows
            row, copies = table.column("row").to_numpy(), table.column("copies").to_numpy()
            held = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            size = np.array([len(x) for x in held], np.int64)
            links, texts, label = np.zeros(n, np.int64), np.zeros(n, np.int64), row.copy()
            found = []
            for i, j in groups.survivors():
                inter = overlaps(held, i, j, np.searchsorted(groups.starts, i, "right"))
                good = inter * threshold.denominator >= (size[i] + size[j] - inter) * threshold.numerator
                found.append((i[good], j[good]))
            if not found:
                continue
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            np.add.at(texts, i, 1)
            np.add.at(texts, j, 1)
            before = None
            while before is None or (label != before).any():
                before = label.copy()
                least = np.minimum(label[i], label[j])
                np.minimum.at(label, i, least)
                np.minimum.at(label, j, least)
            some = np.flatnonzero(texts)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (row, links, texts, label)], ["row", "links", "texts", "hub"])
        give_back()

    return sorted_groups(df).mapInArrow(run, "row long, links long, texts long, hub long")


def bucket_members(reps: DataFrame) -> DataFrame:
    """(row, mask, places): the buckets in which a text is compared, as structs (key, band, n_blocks).

    A bucket is compared if it has two texts or more and no other bucket with the same
    texts has a lesser key; mask has a bit for each of a text's bands that is compared.
    """
    keys = reps.select("row", "n_words", F.posexplode("bands").alias("band", "key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y"))
    alike = counts.where("n > 1").groupBy("n", "w", "x", "y").agg(F.min("key").alias("key"))
    n_blocks = F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("long")
    chosen = stored(alike.select("key", n_blocks.alias("n_blocks")), "buckets")
    places = stored(keys.join(few(chosen), "key").groupBy("row").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("mask"), F.collect_list(F.struct("key", "band", "n_blocks")).alias("places")), "bucket-members")  # BANDS places a row at most
    forget(chosen)
    return places


def link_classes(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """keyed() rows to two stored tables: every row's id, h, g, row and digest; and the classes of
    equal texts: digest, copy (least (no id, id, h, row)), copies, links, texts, class."""
    if threshold < 0.8:
        raise ValueError("the bands are laid out for thresholds of 0.8 and more")
    exact, survival = Fraction(str(threshold)), survival_table(threshold)
    marks = stored(signed(rows), "signatures")
    names = stored(marks.select("id", "h", "g", "row", "digest"), "names")
    name = F.struct(F.col("id").isNull().alias("none"), "id", "h", "row")
    by_digest = names.where("digest is not null").select("digest", name.alias("copy"), "g").groupBy("digest")
    classes = stored(by_digest.agg(F.min("copy").alias("copy"), F.min_by("g", "copy").alias("g"), F.count("*").alias("copies")), "copies")
    first = classes.select(F.col("copy.row").alias("row"), F.col("copy.h").alias("h"), "g", "copies")
    places = bucket_members(marks.select("row", "n_words", "bands").join(few(first.select("row")), "row"))
    block = F.pmod(F.xxhash64("row"), F.col("p.n_blocks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)
    met = marks.select("row", "signature").join(few(places.select("row")), "row")
    entries = met.join(places, "row").select("row", "signature", "mask", F.explode("places").alias("p"))
    entries = entries.select("row", "signature", "mask", "p.key", "p.band", "p.n_blocks", block.alias("block")).withColumn("other", F.explode(others))
    entries = entries.select("row", "signature", "mask", "key", "band", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    with arrow_rows(marks.sparkSession, WIDE_ROWS):
        hits = stored(with_survivors(entries, survival), "survivors")
        wanted = stored(hits.select("row").distinct().join(places.select("row", "mask"), "row").join(first, "row"), "wanted")
        # copies of a text are one group: pre-aggregated, so that no copy is shuffled
        texts = rows.select("h", "g", "text").join(few(wanted.select("h", "g"), FEW_ENTRIES), ["h", "g"], "left_semi").groupBy("h", "g").agg(F.first("text").alias("text"))
        sets = stored(shingle_sets(texts.join(few(wanted, FEW_ENTRIES), ["h", "g"]).select("row", "mask", "copies", "text")), "shingles")
        links = stored(verified(sets.join(few(hits, FEW_ENTRIES), "row"), exact, survival), "links")
    counts = links.groupBy("row").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    tree = components(links.select(F.col("row").alias("a"), F.col("hub").alias("b")), "classes")
    info = classes.withColumn("row", F.col("copy.row")).join(counts, "row", "left").join(tree.withColumnRenamed("node", "row"), "row", "left")
    info = stored(info.select("digest", "copy", "copies", F.coalesce("root", "row").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts")), "linked")
    least = stored(info.groupBy("root").agg(F.min("copy").alias("class")), "least")  # stored: a hot root's join can be split
    linked = stored(info.join(least, "root").drop("root"), "linked-classes")
    forget(marks, classes, places, hits, wanted, sets, links, tree, info, least)
    return names, linked


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, class_id (least id of its connected class), copy_id
    (least id of the same word sequence), n_links (other documents at the threshold
    or above) and n_texts (different texts among them).

    The bands are laid out for thresholds of 0.8 and more.
    """
    names, info = link_classes(keyed(df, id_col, text_col), threshold)
    joined = names.select("id", "digest").join(info, "digest", "left")
    n_links = F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0).cast("long"))
    own = [F.coalesce(F.col(f"{c}.id"), F.col("id")).alias(f"{c}_id") for c in ("class", "copy")]
    return joined.select(F.col("id").alias(id_col), *own, n_links.alias("n_links"), F.coalesce("texts", F.lit(0).cast("long")).alias("n_texts"))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df` without near copies: of each class the row with the least id (none
    comes last; then by the text's hash) stays, and every row without words.

    Rows are found again by id and text; where several rows share both, one of them stays.
    """
    rows = keyed(df, id_col, text_col)
    names, info = link_classes(rows, threshold)
    heads = info.where("copy = class").select(F.col("copy.none").alias("none"), F.col("copy.id").alias("head"), F.col("copy.h").alias("h"), F.col("copy.row").alias("row"))
    key = [F.col("id").isNull().alias("none"), F.col("id").alias("head"), "h"]
    sharing = names.where("digest is not null").groupBy(*key).agg(F.count("*").alias("n"))
    found = stored(heads.join(sharing.where("n > 1").select("none", F.col("head").alias("of"), F.col("h").alias("its"), "n"), (F.col("h") == F.col("its")) & F.col("head").eqNullSafe(F.col("of")), "left").select("head", "h", "row", (F.coalesce("n", F.lit(1)) > 1).alias("shared")), "heads")
    whole = df.select(F.struct("*").alias("whole"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    match = (F.col("h") == F.col("own_h")) & F.col("id").eqNullSafe(F.col("head"))
    kept = whole.withColumnRenamed("h", "own_h").join(few(found), match)
    one = kept.where("shared").groupBy("row").agg(F.first("whole").alias("whole"))
    wordless = names.where("digest is null").select("h", "g").distinct()
    wordless = stored(wordless, "wordless")
    forget(names, info)
    text = F.col(text_col).cast("string")
    empty = df.select(F.struct("*").alias("whole"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(SEED), text).alias("g")).join(few(wordless), ["h", "g"], "left_semi")
    return kept.where("not shared").select("whole").unionByName(one.select("whole")).unionByName(empty.select("whole")).select("whole.*")


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_links(docs)


#: The exact join over an inverted index of shingles; classes by reachability.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM documents),
c AS (SELECT array_to_string(w, ' ') AS t, any_value(w) AS w, min(doc_id) AS copy_id, count(*) AS copies FROM d WHERE len(w) > 0 GROUP BY 1),
s AS (SELECT DISTINCT copy_id, unnest(CASE WHEN len(w) < 5 THEN [t] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM c),
n AS (SELECT copy_id, count(*) AS n FROM s GROUP BY copy_id),
p AS (SELECT a.copy_id AS a, b.copy_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.copy_id <> b.copy_id GROUP BY ALL),
l AS (SELECT p.a, p.b, c.copies FROM p JOIN n x ON x.copy_id = p.a JOIN n y ON y.copy_id = p.b JOIN c ON c.copy_id = p.b WHERE 5 * k >= 4 * (x.n + y.n - k)),
m AS (SELECT a, sum(copies) AS links, count(*) AS texts FROM l GROUP BY a),
r(a, b) AS (SELECT copy_id, copy_id FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a, min(b) AS class_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(c.copy_id, d.doc_id) AS copy_id, coalesce(c.copies - 1 + coalesce(m.links, 0), 0)::BIGINT AS n_links, coalesce(m.texts, 0)::BIGINT AS n_texts
FROM d LEFT JOIN c ON c.t = array_to_string(d.w, ' ') AND len(d.w) > 0 LEFT JOIN m ON m.a = c.copy_id LEFT JOIN k ON k.a = c.copy_id
"""
