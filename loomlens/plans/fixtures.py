"""Views that give the driver's tables the shapes of the operators' inputs.

Each is one SELECT that Spark and DuckDB both accept, so the two engines start from equal rows. Table
names stand in braces. All rows are kept: the last raster may lack cells, and so may any where ids have gaps.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_patches": """
        SELECT vec_id AS patch_id, cast(floor(vec_id / 16) AS bigint) AS image_id,
               cast(floor(vec_id % 16 / 4) AS bigint) AS row_id, vec_id % 4 AS col_id,
               CASE WHEN cast(floor(vec_id / 16) AS bigint) % 2 = 0 THEN 'train' ELSE 'test' END AS split,
               CASE WHEN cast(floor(vec_id / 16) AS bigint) % 4 = 3 THEN 1 ELSE 0 END AS label,
               concat('cat', cast(cast(floor(vec_id / 64) AS bigint) % 2 AS varchar(8))) AS category, embedding AS feature
        FROM {embeddings}""",
    "fx_pixels": """
        SELECT cast(floor(event_id / 256) AS bigint) AS image_id, cast(floor(event_id % 256 / 16) AS bigint) AS y,
               event_id % 16 AS x, value AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS gt
        FROM {events}""",
    "fx_images": """
        SELECT d.doc_id AS image_id, d.lang AS category, cast(d.n_chars AS double) AS score, l.toxic AS label
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "fx_proba": """
        SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
               l_quantity / (l_quantity + (l_discount * 100 + 1) + (l_tax * 200 + 1)) AS p0,
               (l_discount * 100 + 1) / (l_quantity + (l_discount * 100 + 1) + (l_tax * 200 + 1)) AS p1,
               (l_tax * 200 + 1) / (l_quantity + (l_discount * 100 + 1) + (l_tax * 200 + 1)) AS p2
        FROM {lineitem}""",
    "fx_defects": """
        SELECT l_orderkey AS roll_id, l_quantity * 30 AS w_px, cast(l_partkey % 1500 AS double) AS h_px,
               l_returnflag = 'R' AS is_hole, cast(5 AS double) AS ppm, l_returnflag AS flag, l_linestatus AS status FROM {lineitem}""",
    "fx_rolls": "SELECT o_orderkey AS roll_id, o_totalprice / 10 AS length_mm, cast(1500 AS double) AS width_mm FROM {orders}",
    "fx_strips": """
        SELECT o_custkey AS roll, o_orderkey AS strip, 200 + (o_orderkey * 37) % 4096 AS width_px,
               cast(256 AS bigint) AS height_px FROM {orders}""",
    "fx_catalog": """
        SELECT concat('/data/', lower(p_type), '/', CASE p_partkey % 3 WHEN 0 THEN 'train/good' WHEN 1 THEN 'test/good'
               ELSE concat('test/', replace(lower(p_brand), '#', '')) END, '/', cast(p_partkey AS varchar(20)), '.png') AS path,
               p_partkey AS part_id FROM {part}""",
    "fx_uploads": """
        SELECT page_id AS upload_id, CASE page_id % 5 WHEN 0 THEN 'carpet' WHEN 1 THEN 'leather' WHEN 2 THEN 'grid'
               WHEN 3 THEN 'aitex' ELSE 'denim' END AS category,
               CASE WHEN page_id % 17 = 0 THEN '' ELSE html END AS payload FROM {pages}""",
    "fx_frames": """
        SELECT event_id AS frame_id, ts, user_id % 10 AS roll_id, value AS score,
               CASE WHEN value > 50 THEN 2 WHEN value > 25 THEN 1 ELSE 0 END AS num_defects,
               event_id % 101 = 0 AS failed FROM {events}""",
    "fx_runs": """
        SELECT o_orderpriority AS category, o_orderstatus AS layer_set, avg(o_totalprice) / 500000 AS pro,
               count(*) AS n_test FROM {orders} GROUP BY o_orderpriority, o_orderstatus""",
    "fx_rgb": "SELECT l_orderkey AS pixel, l_linenumber % 3 AS channel, l_quantity * 5 AS v FROM {lineitem}",
    "fx_tokens": """
        SELECT cast(floor(vec_id / 10) AS bigint) AS image_id, vec_id % 10 AS pos, embedding AS token
        FROM {embeddings}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def with_views(*names: str) -> str:
    """The start of a DuckDB query that may use the views (and recursion)."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names)
