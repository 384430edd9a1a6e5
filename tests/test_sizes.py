"""Queries against their SQL where the smallest tables don't tell them apart."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from maploom.plans.queries import QUERIES, SQL


def differing(spark, folder, name, tables):
    """Rows that only the query has, and rows that only its SQL has."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want, got = set(cur.fetchall()), {tuple(r[n] for n in names) for r in QUERIES[name](spark, str(folder)).collect()}
    assert want
    return got - want, want - got


def parts(folder, n, size=lambda k: k % 50 + 1):
    pq.write_table(pa.table({"p_partkey": pa.array(range(n), pa.int64()), "p_size": pa.array([size(k) for k in range(n)], pa.int32())}), folder / "part.parquet")


def test_halftone_of_a_high_image(spark, tmp_path):
    """400 rows of 50 pixels: blocks stay 2 x 2, and radii that are half a unit of the sixth place round as in SQL."""
    parts(tmp_path, 20000, lambda k: 8 if k % 3 else k // 7 % 50 + 1)
    assert differing(spark, tmp_path, "triple_halftone", ["part"]) == (set(), set())


@pytest.mark.parametrize("n", [2000, 3140, 5049])
def test_block_means_of_a_high_image(spark, tmp_path, n):
    """Blocks stay 2 x 2 whatever the height; an odd last row of pixels goes."""
    parts(tmp_path, n)
    assert differing(spark, tmp_path, "block_means", ["part"]) == (set(), set())


@pytest.mark.parametrize("name", ["region_summary", "region_figures"])
def test_cells_at_the_threshold(spark, tmp_path, name):
    """0.15 in single precision is more than 0.15, but SQL compares it in single precision: such cells are not above."""
    rows = [[0.15 if (r * 64 + c) % 7 == 0 else (r * 5 + c * 3) % 16 / 40 for c in range(64)] for r in range(12)]
    pq.write_table(pa.table({"vec_id": pa.array(range(12), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    assert differing(spark, tmp_path, name, ["embeddings"]) == (set(), set())
