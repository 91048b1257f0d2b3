"""Inputs of the registered queries, as SQL that Spark and DuckDB both run.

The driver's tables hold no lists, tables, forms or images, so these are derived
from their keys by plain arithmetic.  `{table}` stands for a driver table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Tables of few bytes a row whose rows become texts, pages or images: stored bytes for a task (about 20,000
#: customers or parts, 100,000 orders, 2,000 suppliers).  Tasks for each core, at least.
EXPANDED, TASKS_PER_CORE = {"customer": 400_000, "orders": 2_000_000, "part": 200_000, "supplier": 40_000}, 4

INPUTS = {
    # range expressions of many shapes, good and bad
    "range_specs": """
        SELECT o_orderkey AS case_id, CAST(1 + o_orderkey % 10 AS INT) AS page_count,
          CASE o_orderkey % 11
            WHEN 0 THEN CAST(1 + o_custkey % 12 AS VARCHAR(9))
            WHEN 1 THEN concat(CAST(1 + o_custkey % 5 AS VARCHAR(9)), '-', CAST(1 + o_custkey % 7 AS VARCHAR(9)))
            WHEN 2 THEN concat(CAST(1 + o_custkey % 6 AS VARCHAR(9)), '-')
            WHEN 3 THEN concat('-', CAST(1 + o_custkey % 6 AS VARCHAR(9)))
            WHEN 4 THEN '-'
            WHEN 5 THEN concat(' 3, ', CAST(o_custkey % 4 AS VARCHAR(9)), ' - 2 ; 1')
            WHEN 6 THEN 'abc'
            WHEN 7 THEN ','
            WHEN 8 THEN '1 3'
            WHEN 9 THEN concat('2,,', CAST(1 + o_custkey % 3 AS VARCHAR(9)), ';1-1')
            ELSE '' END AS spec
        FROM {orders}""",
    "file_names": """
        SELECT p_partkey AS file_id, CAST(p_partkey % 7 AS INT) AS folder,
          CASE p_partkey % 5 WHEN 0 THEN 'a.txt' WHEN 1 THEN concat('b', CAST(p_size % 4 AS VARCHAR(9)), '.PDF') WHEN 2 THEN 'c' WHEN 3 THEN '.hidden' ELSE 'x.tar.gz' END AS name
        FROM {part}""",
    "strings": """
        SELECT p_partkey AS id, CASE p_partkey % 9
            WHEN 0 THEN concat('plain ', p_name) WHEN 1 THEN concat('-', CAST(p_size AS VARCHAR(9)), '.50') WHEN 2 THEN concat('0', CAST(p_size AS VARCHAR(9)))
            WHEN 3 THEN '1,234' WHEN 4 THEN concat('&amp;lt;', p_brand, '&gt; &quot;x&#39;') WHEN 5 THEN concat('<b>', p_name, '</b><i> y </i>')
            WHEN 6 THEN concat('caf', 'é', ' ', '→', ' ', p_brand) WHEN 7 THEN concat(' ', CAST(p_size AS VARCHAR(9)), ' ') ELSE concat('مرحبا ', p_brand) END AS s
        FROM {part}""",
    "colors": """
        SELECT p_partkey AS id, concat('rgba(', CAST(p_size * 5 % 256 AS VARCHAR(9)), ', ', CAST(p_partkey % 256 AS VARCHAR(9)), ', ', CAST(p_partkey * 3 % 256 AS VARCHAR(9)), CASE p_partkey % 3 WHEN 0 THEN ', 0.4' WHEN 1 THEN ', 1' ELSE '' END, ')') AS css,
          p_size * 5 % 256 AS r, p_partkey % 256 AS g, p_partkey * 3 % 256 AS b, p_partkey % 3 AS shape
        FROM {part}""",
    # sessions: documents of one remainder are the sources of a session
    "sources": """
        SELECT concat('s', CAST(doc_id % 40 AS VARCHAR(19))) AS session_id, concat('d', CAST(doc_id AS VARCHAR(19))) AS source_id, doc_id AS source_no,
          concat('file', CAST(doc_id AS VARCHAR(19)), CASE WHEN doc_id % 5 = 0 THEN '.jpeg' ELSE '.pdf' END) AS name,
          CASE WHEN doc_id % 5 = 0 THEN 'image' ELSE 'pdf' END AS kind, CASE WHEN doc_id % 10 = 0 THEN 'image/png' WHEN doc_id % 5 = 0 THEN 'image/jpeg' ELSE 'application/pdf' END AS mime,
          CASE WHEN doc_id % 5 = 0 THEN 1 ELSE CAST(floor((coalesce(n_chars, 0) + 1799) / 1800) AS INT) END AS page_count
        FROM {documents}""",
    # one table a page: an order's lines are its rows, and a caption stands below
    "items": """
        SELECT l_orderkey AS page_no, CAST(l_linenumber * 10 + c.k AS INT) AS item_no,
          CASE c.k WHEN 0 THEN concat('part ', CAST(l_partkey AS VARCHAR(19))) WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR(19)) ELSE l_returnflag END AS str,
          CAST(50 + 100 * c.k + (l_partkey + c.k) % 3 AS DOUBLE) AS x, CAST(700 - 20 * l_linenumber AS DOUBLE) AS y,
          CAST(6 * length(CASE c.k WHEN 0 THEN concat('part ', CAST(l_partkey AS VARCHAR(19))) WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR(19)) ELSE l_returnflag END) AS DOUBLE) AS w,
          CAST(CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE 8 + l_suppkey % 4 END AS DOUBLE) AS h,
          CAST(9 + l_suppkey % 3 AS DOUBLE) AS font_size, l_suppkey % 5 = 0 AS bold
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l
        CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) c""",
    "bands": """
        SELECT l_orderkey AS page_no, CAST(700 - 20 * min(l_linenumber) AS DOUBLE) AS y_top, CAST(700 - 20 * min(l_linenumber) - 5 AS DOUBLE) AS y_bottom
        FROM {lineitem} GROUP BY l_orderkey""",
    "lines": """
        SELECT o_orderkey AS line_id, CASE o_orderkey % 4 WHEN 0 THEN concat('• ', o_orderpriority) WHEN 1 THEN concat('12) ', o_orderstatus) WHEN 2 THEN o_orderpriority ELSE repeat('long line ', 13) END AS text,
          CAST(8 + o_custkey % 12 AS DOUBLE) AS font_size, o_custkey % 3 = 0 AS bold, CAST(10 AS DOUBLE) AS page_median
        FROM {orders}""",
    "texts": """
        SELECT p_partkey AS doc_id, concat('SECTION ', upper(p_brand), chr(10), chr(10), p_name, chr(10), 'goes on here.', chr(10), chr(10), '- ', p_type, chr(10), '  - size ', CAST(p_size AS VARCHAR(9)), chr(10), '1. first', chr(10), chr(10),
          '> quoted ', p_brand, chr(10), '> twice', chr(10), chr(10), '    code(', CAST(p_size AS VARCHAR(9)), ')', chr(10), chr(10), 'Next steps:', chr(10), 'end', chr(10), '***', chr(10), 'Title', chr(10), '=====') AS text
        FROM {part}""",
    "runs": """
        SELECT l_orderkey AS block_ord, CAST(l_linenumber AS INT) AS run_ord, CASE WHEN l_quantity < 3 THEN '' ELSE concat(l_returnflag, CAST(l_linenumber AS VARCHAR(9))) END AS text,
          CASE WHEN l_linestatus = 'O' THEN true END AS bold, l_quantity > 25 AS italic, false AS code, CASE WHEN l_tax > 0.04 THEN 'http://x' END AS href, CAST(NULL AS VARCHAR(9)) AS color
        FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_tax) AS l_tax FROM {lineitem} GROUP BY l_orderkey, l_linenumber) t""",
    "pixels": """
        SELECT s_suppkey AS img_id, CAST(a.n AS INT) AS x, CAST(b.n AS INT) AS y,
          CAST((s_suppkey * 7 + a.n * 3 + b.n * 11) % 200 + 20 AS INT) AS r, CAST((s_suppkey * 5 + a.n * 13 + b.n) % 180 + 30 AS INT) AS g, CAST((s_suppkey + a.n + b.n * 17) % 160 + 40 AS INT) AS b
        FROM {supplier} CROSS JOIN (SELECT DISTINCT n_nationkey AS n FROM {nation} WHERE n_nationkey < 16) a CROSS JOIN (SELECT DISTINCT n_nationkey AS n FROM {nation} WHERE n_nationkey < 16) b""",
    "fields": """
        SELECT CAST(floor(p_partkey / 5) AS BIGINT) AS doc_id, concat('f', CAST(p_partkey AS VARCHAR(19))) AS name,
          CASE p_partkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' WHEN 2 THEN 'dropdown' WHEN 3 THEN 'radio' ELSE 'other' END AS field_type,
          CASE WHEN p_partkey % 5 = 1 THEN NULL ELSE 'old' END AS value_str, CASE WHEN p_partkey % 5 = 1 THEN false END AS value_bool, p_size % 7 = 0 AS read_only
        FROM {part}""",
    "values": """
        SELECT CAST(floor(p_partkey / 5) AS BIGINT) AS doc_id, concat('f', CAST(p_partkey AS VARCHAR(19))) AS name, CASE p_size % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'red' WHEN 2 THEN '' ELSE 'blue' END AS value
        FROM {part} WHERE p_size % 3 <> 0""",
    "images": """
        SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS doc_id, concat('o', CAST(p_partkey AS VARCHAR(19))) AS ref, CASE p_partkey % 4 WHEN 0 THEN 'DCTDecode' WHEN 1 THEN 'FlateDecode' WHEN 2 THEN 'JPXDecode' ELSE 'DCTDecode' END AS filter_name, CASE WHEN p_partkey % 13 = 0 THEN 2 ELSE 1 END AS n_filters,
          CAST(p_size * 40 AS INT) AS width, CAST(p_partkey % 17 * 60 AS INT) AS height, CASE WHEN p_partkey % 6 = 0 THEN 4 ELSE 8 END AS bpc,
          CASE p_partkey % 5 WHEN 0 THEN 'DeviceRGB' WHEN 1 THEN 'DeviceGray' WHEN 2 THEN 'ICCBased' WHEN 3 THEN 'DeviceCMYK' ELSE 'Indexed' END AS cs_family, CAST(p_size % 5 AS INT) AS icc_n,
          p_partkey % 19 = 0 AS image_mask, p_partkey % 23 = 0 AS has_decode, p_partkey % 29 = 0 AS has_decode_parms, p_partkey % 31 = 0 AS has_external,
          CASE WHEN p_partkey % 8 = 0 THEN concat('o', CAST(p_partkey + 1 AS VARCHAR(19))) END AS smask_ref, CAST(NULL AS VARCHAR(9)) AS mask_ref, CAST(p_retailprice * 40 AS BIGINT) AS n_bytes, CAST(p_retailprice * 40 AS BIGINT) - p_size * 100 + 2000 AS new_bytes
        FROM {part}""",
    "words": """
        SELECT o_orderkey AS word_id, CASE WHEN o_orderkey % 9 = 0 THEN '  ' ELSE o_orderpriority END AS text, CAST(o_custkey % 900 AS DOUBLE) AS x0, CAST(o_orderkey % 1200 AS DOUBLE) AS y0,
          CAST(o_custkey % 900 + 60 AS DOUBLE) AS x1, CAST(o_orderkey % 1200 + 3 + o_custkey % 90 AS DOUBLE) AS y1, 1000 AS canvas_w, 1400 AS canvas_h, CAST(500 AS DOUBLE) AS page_w, CAST(700 AS DOUBLE) AS page_h
        FROM {orders}""",
    "progress": """
        SELECT o_orderkey AS event_id, CAST(o_custkey % 7 AS INT) AS page_no, 8 AS pages, CASE o_orderkey % 4 WHEN 0 THEN 'render' WHEN 1 THEN 'cleanup' WHEN 2 THEN 'ocr' ELSE 'build' END AS stage, CAST((o_custkey % 9 - 1) / 7.0 AS DOUBLE) AS part
        FROM {orders}""",
    # a page of prose: a title, paragraphs that wrap, a hyphen, an item that goes on, shifted pieces of a word
    "prose_items": """
        SELECT o_orderkey AS page_no, CAST(n.k AS INT) AS item_no,
          CASE n.k WHEN 0 THEN o_orderpriority WHEN 1 THEN concat('The order ', CAST(o_orderkey AS VARCHAR(19)), ' came from cus-') WHEN 2 THEN concat('tomer ', CAST(o_custkey AS VARCHAR(19)), ' and is done.')
            WHEN 3 THEN 'A second text follows' WHEN 4 THEN 'and goes on' WHEN 5 THEN concat(CASE o_orderkey % 3 WHEN 0 THEN '1) ' WHEN 1 THEN '- ' ELSE '• ' END, 'item ', o_orderstatus)
            WHEN 6 THEN 'wrapped on' WHEN 7 THEN 'ab' WHEN 8 THEN 'cd' WHEN 9 THEN 'Part B' WHEN 10 THEN 'continued' ELSE '  ' END AS str,
          CAST(CASE n.k WHEN 6 THEN 62 WHEN 8 THEN 60.5 ELSE 50 END AS DOUBLE) AS x,
          CAST(CASE n.k WHEN 0 THEN 700 WHEN 1 THEN 660 WHEN 2 THEN 648 WHEN 3 THEN 636 WHEN 4 THEN 624 WHEN 5 THEN 590 WHEN 6 THEN 578 WHEN 7 THEN 540 WHEN 8 THEN 541.5 WHEN 9 THEN 500 WHEN 10 THEN 486 ELSE 400 END AS DOUBLE) AS y,
          CAST(CASE n.k WHEN 0 THEN 120 WHEN 1 THEN 400 WHEN 4 THEN 400 WHEN 2 THEN 200 WHEN 3 THEN 150 WHEN 7 THEN 10 WHEN 8 THEN 10 ELSE 70 END AS DOUBLE) AS w,
          CAST(CASE WHEN n.k = 0 THEN 18 WHEN n.k IN (9, 10) THEN 12 ELSE 10 END AS DOUBLE) AS h, CAST(CASE WHEN n.k = 0 THEN 18 WHEN n.k IN (9, 10) THEN 12 ELSE 10 END AS DOUBLE) AS font_size, n.k = 9 AS bold
        FROM {orders} CROSS JOIN (SELECT DISTINCT n_nationkey AS k FROM {nation} WHERE n_nationkey < 12) n
        WHERE n.k <> 6 OR o_orderkey % 2 = 0""",
    # text, two tables and text on a page, with starts off by a point or two; every fifth page is blank, every third has no table
    "mixed_items": """
        SELECT p_partkey AS page_no, CAST(l.k * 10 + c.k AS INT) AS item_no,
          CASE WHEN l.k IN (0, 4, 8) THEN concat('Text ', CAST(l.k AS VARCHAR(9)), ' of ', CAST(p_partkey AS VARCHAR(19))) ELSE concat(CASE c.k WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END, CAST(l.k AS VARCHAR(9)), ' ', CAST(p_size AS VARCHAR(9))) END AS str,
          CAST(50 + 150 * c.k + CASE WHEN l.k IN (0, 4, 8) THEN 0 ELSE (l.k + c.k) % 3 END AS DOUBLE) AS x, CAST(740 - 40 * l.k + CASE WHEN l.k % 4 = 2 THEN 0.5 * c.k ELSE 0 END AS DOUBLE) AS y, CAST(40 AS DOUBLE) AS w, CAST(10 AS DOUBLE) AS h, CAST(10 AS DOUBLE) AS font_size, false AS bold
        FROM {part} CROSS JOIN (SELECT DISTINCT n_nationkey AS k FROM {nation} WHERE n_nationkey < 9) l CROSS JOIN (SELECT DISTINCT r_regionkey AS k FROM {region} WHERE r_regionkey < 3) c
        WHERE p_partkey % 5 <> 0 AND (p_partkey % 3 <> 0 OR l.k IN (0, 4, 8)) AND (l.k NOT IN (0, 4, 8) OR c.k = 0)""",
    "markdown": """
        SELECT p_partkey AS doc_id, CASE p_partkey % 3
            WHEN 0 THEN concat('# ', p_brand, chr(10), chr(10), 'Some *em* and **', p_type, '** with `code`.', chr(10), 'next line', chr(10), chr(10), '- one ', CAST(p_size AS VARCHAR(9)), chr(10), '  - two', chr(10), '- three', chr(10), chr(10),
              '1. first', chr(10), '2. second', chr(10), chr(10), '> quoted ', p_brand, chr(10), chr(10), '```sql', chr(10), 'select 1', chr(10), '```', chr(10), chr(10), '---', chr(10))
            WHEN 1 THEN concat('Title ', p_brand, chr(10), '=====', chr(10), chr(10), '| a | b |', chr(10), '|---|---|', chr(10), '| ', CAST(p_size AS VARCHAR(9)), ' | x |', chr(10), chr(10), '<div>raw ', p_brand, '</div>', chr(10), chr(10), '    indented', chr(10))
            ELSE concat('## ', p_brand, ' ##', chr(10), chr(10), 'line [link](http://x.y) and ![img](z) ~~gone~~ a', chr(92), '*b &amp; c', chr(10), chr(10), 'Sub', chr(10), '---', chr(10), '5. five', chr(10), '6. six') END AS text
        FROM {part}""",
    # one-line blocks in the order of ord
    "cards": """
        SELECT p_partkey AS doc_id, CAST(b.k AS INT) AS ord, CASE b.k WHEN 0 THEN 'paragraph' WHEN 1 THEN 'code' WHEN 2 THEN 'listItem' ELSE 'hr' END AS kind, b.k = 2 AS ordered, CAST(p_size AS INT) AS index, 0 AS depth,
          CASE b.k WHEN 0 THEN CAST(p_partkey AS VARCHAR(19)) WHEN 1 THEN concat('f(', CAST(p_size AS VARCHAR(9)), ')') WHEN 2 THEN '0' END AS text
        FROM {part} CROSS JOIN (SELECT DISTINCT r_regionkey AS k FROM {region} WHERE r_regionkey < 4) b""",
    "phrases": """
        SELECT p_partkey AS id, CASE p_partkey % 8
            WHEN 0 THEN concat('  ', p_name, chr(9), chr(10), ' ', p_brand, '  ') WHEN 1 THEN concat(p_name, '.') WHEN 2 THEN concat('He said "', p_type, '!"') WHEN 3 THEN concat('Size ', CAST(p_size AS VARCHAR(9)), ':')
            WHEN 4 THEN concat('a: ', p_brand, ':') WHEN 5 THEN concat('x', chr(1), chr(7), p_brand, chr(13), chr(10), 'y') WHEN 6 THEN concat('highlight language-', lower(substring(p_type, 1, 3)), ' x') ELSE concat('म ', p_brand, ' مر') END AS s
        FROM {part}""",
    "raw_layer": """
        SELECT o_orderkey AS doc_id, CAST(1 + o_custkey % 3 AS INT) AS page_no, CAST(o_orderkey % 7 AS INT) AS item_no, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE o_orderpriority END AS str,
          CAST(o_orderkey % 5 * 3 AS DOUBLE) AS c, CAST(o_orderkey % 5 * 4 AS DOUBLE) AS d, CAST(o_custkey % 500 AS DOUBLE) AS e, CAST(o_custkey % 700 AS DOUBLE) AS f,
          CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 60 AS DOUBLE) END AS w, CASE WHEN o_custkey % 3 = 0 THEN 0 WHEN o_custkey % 3 = 1 THEN NULL ELSE 9 END * CAST(1 AS DOUBLE) AS h,
          CASE o_custkey % 4 WHEN 0 THEN 'g_d0_f1' WHEN 1 THEN 'Arial-BoldMT' WHEN 2 THEN 'g_d0_f2' ELSE 'Times' END AS font_name
        FROM {orders}""",
    "uploads": """
        SELECT c_custkey AS file_id, CASE c_custkey % 5 WHEN 0 THEN concat(c_name, '.pdf') WHEN 1 THEN concat(c_name, '.PDF') WHEN 2 THEN '' WHEN 3 THEN NULL ELSE concat(c_name, '.png') END AS name,
          CASE c_custkey % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN '' ELSE NULL END AS mime, CASE c_custkey % 3 WHEN 0 THEN '%PDF-1.7' WHEN 1 THEN '%PDF' ELSE 'GIF89a' END AS head
        FROM {customer}""",
    "sources_of_images": """
        SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'https://a.example/x/y' WHEN 1 THEN 'http://A.example:81/' ELSE 'https://b.example' END AS page_url,
          CASE c_custkey % 8 WHEN 0 THEN 'pic.png' WHEN 1 THEN '/p/q.jpg' WHEN 2 THEN 'https://a.example/z.png' WHEN 3 THEN '//b.example/z.png' WHEN 4 THEN 'data:image/png;base64,AA' WHEN 5 THEN 'HTTP://a.example:81/k' WHEN 6 THEN 'http://a.example/k' ELSE 'ftp://a.example/k' END AS src
        FROM {customer}""",
    "raw_fields": """
        SELECT CAST(floor(p_partkey / 6) AS BIGINT) AS doc_id, concat('f', CAST(p_partkey AS VARCHAR(19))) AS name, CASE p_partkey % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' WHEN 2 THEN 'dropdown' WHEN 3 THEN 'radio' WHEN 4 THEN 'optionlist' ELSE 'signature' END AS field_type,
          CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_brand ELSE 'مر' END AS text_value, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 4 = 1 END AS checked, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS chosen, p_size % 11 = 0 AS read_only
        FROM {part}""",
    "starts": """
        SELECT l_orderkey AS page_no, CAST(l_linenumber AS INT) AS line_no, CAST(c.k AS INT) AS item_no, CAST(40 + 100 * c.k + (l_partkey + c.k) % 5 AS DOUBLE) AS x, CAST(6 AS DOUBLE) AS x_tol
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l CROSS JOIN (SELECT DISTINCT r_regionkey AS k FROM {region} WHERE r_regionkey < 4) c
        WHERE c.k < 3 OR l_linenumber = 1""",
    "markup": """
        SELECT p_partkey AS page_id, concat('<body><h2>', p_brand, '</h2><ol start=3><li>', p_type, '<ul><li>in</ul><li>two</ol><pre><code class="language-sql">', chr(10), 'a &lt; b', chr(10), '</code></pre><table><thead><tr><th>h<th>k<tbody><tr><td>',
          CAST(p_size AS VARCHAR(9)), '<td> <tr><td> <td></table><hr><figure><img src="i.png"><figcaption> cap ', p_brand, ' </figcaption></figure><div>in <b>line</b></div><blockquote>said</blockquote><p hidden>no</p><p style="display:none">no</p><section><p>yes</p>loose</section><custom>odd</custom>') AS html
        FROM {part}""",
    "code": """SELECT p_partkey AS doc_id, concat(repeat(p_name, 1 + p_size % 9), chr(9), 'end', chr(10), chr(10), p_type) AS text FROM {part}""",
}


def for_spark(sql: str) -> str:
    """Spark names unbounded strings otherwise."""
    return re.sub(r"VARCHAR\(\d+\)", "STRING", sql)


def dealt(table: DataFrame, task_bytes: int) -> DataFrame:
    """Rows dealt out by their key before they are expanded: a scan is split by bytes, and a file of a few MB
    or one row group would keep the work and the memory of millions of rows in one task."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(max(TASKS_PER_CORE * table.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes)), table.columns[0])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input as a DataFrame over the tables of a folder."""
    sql = INPUTS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    tables = {t: dealt(table, EXPANDED[t]) if t in EXPANDED else table for t, table in tables.items()}
    return spark.sql(for_spark(sql), **tables)


def duck(name: str) -> str:
    """An input as DuckDB SQL."""
    return re.sub(r"\{(\w+)\}", r"\1", INPUTS[name])
