"""Many pages at once give what each page gives alone."""

import random

import numpy as np
import pyarrow as pa
import pytest

from docloom.operators import items as I
from docloom.operators import pages as P

SCHEMA = "page_no long, item_no int, str string, x double, y double, w double, h double, font_size double, bold boolean"
FORMS = [("group_lines", I.line_rows, False), ("lines_to_rows", lambda p: list(enumerate(I.sheet_lines(p))), False), ("detect_tables", I.table_rows, False), ("sheet_cells", I.sheets_of, False), ("reconstruct_blocks", I.block_rows, True)]
WORDS = ["a", "Ab-", "cd", "The end.", "go on:", "• x", "12) item", "- dash", "-", "word", "  ", "", " y", "z ", "p  q", "k l", "\t", "é", "\U0001f600\U0001f600", "　", "long " * 30, "(q)", "9", 'said."', "x\ny"]


def random_page(r: random.Random, page: int) -> list[dict]:
    kind, n = r.choice(["grid", "prose", "mess", "long"]), r.choice([1, 2, 5, 12, 30])
    rows = []
    for k in range(n * (6 if kind == "long" else 1)):
        if kind == "grid":
            x, y = 50.0 + 60 * (k % 3) + r.choice([0, 0, 1, 2.5, 7]), 700.0 - 14 * (k // 3) + r.choice([0, 0, 0.5])
        elif kind == "prose":
            x, y = 50.0 + r.choice([0, 0, 0, 6, 12]), 700.0 - 12 * k - r.choice([0, 0, 30])
        elif kind == "long":
            x, y = float(r.randint(0, 40) * 10), 700.0 - 6 * r.randint(0, 30)
        else:
            x, y = r.choice([0.0, 10, 10.5, 40, 44, 90]), r.choice([0.0, 0.25, 0.5, 0.75, 3, 4, 5.5, 20, 31])
        size = r.choice([10.0, 10.0, 10.0, 10.25, 10.75, 12, 16, 0.0 if kind == "mess" else 9])
        rows.append({"page_no": page, "item_no": k, "str": r.choice(WORDS), "x": x, "y": y, "w": r.choice([10.0, 40, 200, 400, -3]), "h": r.choice([10.0, 9, 0, -1, None, 14]), "font_size": size, "bold": r.choice([True, False, None])})
    return rows


def chunk(rows: list[dict], prose: bool):
    kinds = {"str": pa.string(), "bold": pa.bool_()}
    columns = {c: pa.array([x[c] for x in rows], kinds.get(c, pa.float64())) for c in ("str", *"xywh", *(("font_size", "bold") if prose else ()))}
    return np.array([x["page_no"] for x in rows], np.int64), columns


@pytest.mark.parametrize("name, slow, prose", FORMS)
def test_many_pages_are_pages_one_by_one(name, slow, prose):
    r, odd = random.Random(7), 0
    for _ in range(40):
        found = [random_page(r, p) for p in range(r.choice([1, 3, 40]))]
        page, columns = chunk([x for p in found for x in p], prose)
        mixed = set(P.odd_pages(page, columns, prose).tolist())
        odd += len(mixed)
        rest = ~np.isin(page, list(mixed))
        at, *made = getattr(P, name)(P.Items(page[rest], {c: v.filter(pa.array(rest)) for c, v in columns.items()}))
        got: dict[int, list] = {}
        for p, *row in zip(at.tolist(), *(c.to_pylist() if isinstance(c, pa.Array) else c.tolist() for c in made), strict=True):
            got.setdefault(p, []).append(tuple(row))
        for p, own in enumerate(found):
            if p not in mixed:
                assert sorted(got.get(p, [])) == sorted(map(tuple, slow(own))), own
    assert bool(odd) == prose  # pages whose items have no order are left to the other form


def test_a_thousand_pages_take_little_time():
    import time

    r = random.Random(3)
    rows = [x for p in range(4000) for x in random_page(r, p)]
    page, columns = chunk(rows, True)
    rest = ~np.isin(page, P.odd_pages(page, columns, True))
    chosen = P.Items(page[rest], {c: v.filter(pa.array(rest)) for c, v in columns.items()})
    plain = [[x for x in rows if x["page_no"] == p] for p in range(0, 300) if rest[page == p].all()]
    began = time.process_time()
    for own in plain:
        I.block_rows(own)
    alone = (time.process_time() - began) / sum(map(len, plain))
    began = time.process_time()
    P.reconstruct_blocks(chosen)
    assert (time.process_time() - began) / len(chosen.page) < alone / 2


def test_pages_of_batches_and_odd_pages(spark):
    r = random.Random(11)
    found = [random_page(r, p) for p in range(150)]
    found[5] = [dict(x, page_no=5, h=None, bold=None) for x in found[5]]
    rows = [tuple(float(v) if isinstance(v, int) and c not in ("page_no", "item_no", "bold") else v for c, v in x.items()) for p in found for x in p]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        blocks = sorted(tuple(x) for x in I.reconstruct_blocks(df, ["page_no"]).collect())
        lines = sorted(tuple(x) for x in I.group_lines(df.withColumnRenamed("page_no", "p"), ["p"]).collect())
        keyed = I.lines_to_rows(spark.createDataFrame([(None, 1, "a", 1.0, 2.0, 3.0, 4.0), ("k", 2, "b", 1.0, 2.0, 3.0, 4.0)], "k string, item_no int, str string, x double, y double, w double, h double"), ["k"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert blocks == sorted((p, *b) for p, own in enumerate(found) for b in I.block_rows(own))
    assert lines == sorted((p, *b) for p, own in enumerate(found) for b in I.line_rows(own))
    assert sorted(map(str, map(tuple, keyed))) == ["('k', 0, 'b')", "(None, 0, 'a')"]


@pytest.mark.parametrize("least", [0, 3, 40, 10_000])
def test_pages_are_never_cut(least):
    r = random.Random(least)
    keys = [(k // 3, None if k % 3 == 0 else f"p{k % 3}") for k in range(60) for _ in range(r.choice([1, 2, 9, 50 if k == 30 else 4]))]
    table = pa.table({"a": [a for a, _ in keys], "b": pa.array([b for _, b in keys], pa.string()), "n": range(len(keys))})
    batches = [b for k in range(0, len(keys), 4) for b in table.slice(k, 4).combine_chunks().to_batches()]
    seen = []
    for chunk, starts in P.whole_pages(iter([batches[0].slice(0, 0), *batches]), ["a", "b"], least):
        for begin, stop in zip(starts, [*starts[1:], chunk.num_rows], strict=True):
            rows = chunk.slice(begin, stop - begin).to_pylist()
            assert len({(x["a"], x["b"]) for x in rows}) == 1
            seen.append((rows[0]["a"], rows[0]["b"], [x["n"] for x in rows]))
    assert len(seen) == 60 and [n for *_, own in seen for n in own] == list(range(len(keys)))


def test_clusters_of_many_pages(spark):
    r, expected, rows = random.Random(2), [], []
    for p in range(60):
        own = [(p, r.choice([0, 1, 2, 5]), k, r.choice([None, 1.0, 4.0, 7.5, 11.5, 12.0, 40.0]), 4.0) for k in range(r.choice([1, 4, 20]))]
        rows += own
        ordered = sorted(own, key=lambda s: (s[3] is not None, s[3] or 0.0))
        found: list[list] = []
        for s in ordered:
            if not found or (s[3] is not None and found[-1][-1][3] is not None and s[3] - found[-1][-1][3] > 4.0):
                found.append([])
            found[-1].append(s)
        for k, c in enumerate(found):
            xs = [s[3] for s in c if s[3] is not None]
            if len({s[1] for s in c}) >= max(2, -(-len({s[1] for s in own}) // 2)):
                expected.append((p, k, len({s[1] for s in c}), sum(xs) / len(xs) if xs else None))
    df = spark.createDataFrame([*rows, (None, 1, 1, 1.0, 4.0), (None, 2, 1, 1.0, 4.0)], "page_no long, line_no int, item_no int, x double, x_tol double")
    made = I.x_clusters(df, ["page_no"])
    assert made.columns == ["page_no", "cluster", "n_lines", "center"]
    rounded = lambda found: sorted((*r[:3], r[3] is None or round(r[3], 9)) for r in found)
    assert rounded(map(tuple, made.collect())) == rounded(expected)


def test_clusters_and_columns_take_one_sort_each(spark):
    """The memory of a task is that of its sorts and hash tables: one for the clusters, and no window beside the join."""
    df = spark.createDataFrame([(1, 1, 1, 1.0, 4.0), (1, 2, 1, 1.0, 4.0)], "page_no long, line_no int, item_no int, x double, x_tol double")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    made = plan(I.x_clusters(df, ["page_no"]))
    assert made.count(" Sort [") == 1 and "Window" not in made and "Join" not in made and "Aggregate" not in made
    assert "Window" not in plan(I.nearest_column(df, I.x_clusters(df, ["page_no"]).select("page_no", "center"), ["page_no"]))
