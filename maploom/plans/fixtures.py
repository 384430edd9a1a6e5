"""The given tables read as rasters, features, photographs and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.functions.frames import Frame

WEST, NORTH, CRS = 654000.0, 7738000.0, "EPSG:25833"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_of(cells: DataFrame, ncols: int) -> Frame:
    """One row comes back: the last row of the raster."""
    return Frame((cells.agg(F.max("r")).first()[0] or 0) + 1, ncols, 1.0, WEST, NORTH, CRS)


def steps(spark, sf_dir) -> DataFrame:
    """A raster of steps, 50 columns: r, c, z."""
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(F.expr("cast(p_partkey div 50 as int)").alias("r"), (k % 50).cast("int").alias("c"), F.col("p_retailprice").cast("double").alias("z"))


def noise(spark, sf_dir) -> DataFrame:
    """Noise of both signs, 64 columns."""
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("r"), F.posexplode("embedding").alias("c", "z"))


def holed(spark, sf_dir) -> DataFrame:
    """Values with unmeasured cells, 100 columns."""
    i = F.col("event_id")
    return _table(spark, sf_dir, "events").select(F.expr("cast(event_id div 100 as int)").alias("r"), (i % 100).cast("int").alias("c"), F.when(F.col("event_type") != "error", F.col("value")).alias("z"))


def later(spark, sf_dir) -> DataFrame:
    """A second epoch on the cells of holed."""
    n = _table(spark, sf_dir, "events").count()
    return _table(spark, sf_dir, "orders").where(F.col("o_orderkey") < n).select(F.expr("cast(o_orderkey div 100 as int)").alias("r"), (F.col("o_orderkey") % 100).cast("int").alias("c"), (F.col("o_totalprice").cast("double") / 1000.0).alias("z"))


def photos(spark, sf_dir) -> DataFrame:
    """Photographs, some without a place: n, name, lat, lon, direction."""
    k = F.col("c_custkey")
    lost = F.col("c_acctbal") < 0
    return _table(spark, sf_dir, "customer").select(k.alias("n"), F.col("c_name").alias("name"), F.when(~lost, 58 + (k % 1300) / 100.0).alias("lat"), F.when(~lost, 5 + (k % 2500) / 100.0).alias("lon"), ((k * 7) % 360).cast("int").alias("direction"))


def tracks(spark, sf_dir) -> DataFrame:
    """Polylines a point a row: path_id, i, x, y."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = F.round((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000.0, 6)
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("path_id"), (F.row_number().over(w) - 1).cast("int").alias("i"), x.alias("x"), F.col("value").alias("y"))


def track_paths(spark, sf_dir) -> DataFrame:
    """The same with one row a path: path_id, closed, pts."""
    rows = tracks(spark, sf_dir).groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("s"))
    return rows.select("path_id", F.lit(False).alias("closed"), F.transform("s", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))


def rings(spark, sf_dir) -> DataFrame:
    """Squares on a lattice, some with a hole: feature_id, ring, hole, pts."""
    k = F.col("n_nationkey")
    n = _table(spark, sf_dir, "nation").select(k.alias("feature_id"), F.col("n_regionkey").alias("g"), ((k % 5) * 12.0).alias("ox"), (F.floor(k / 5.0) * 12.0).alias("oy"))
    ring = lambda *xy: F.array(*[F.struct((F.col("ox") + x).alias("x"), (F.col("oy") + y).alias("y")) for x, y in xy])
    outer, inner = ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((3, 3), (3, 7), (7, 7), (7, 3))
    both = F.when(F.col("g").isin(0, 2), F.array(outer, inner)).otherwise(F.array(outer))
    return n.select("feature_id", F.posexplode(both).alias("ring", "pts")).select(F.col("feature_id").cast("int").alias("feature_id"), "ring", (F.col("ring") == 1).alias("hole"), "pts")


def trees(spark, sf_dir) -> DataFrame:
    """Points with an attribute that is partly missing: ord, x, y, dbh."""
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(k.alias("ord"), ((k * 37) % 600 / 10.0).alias("x"), ((k * 53) % 600 / 10.0).alias("y"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal").cast("double")).alias("dbh"))


def image(spark, sf_dir) -> DataFrame:
    """An image of 50 columns: y, x, red, green, blue."""
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(F.expr("cast(p_partkey div 50 as int)").alias("y"), (k % 50).cast("int").alias("x"), (F.col("p_size") * 5).cast("int").alias("red"), (k % 256).cast("int").alias("green"), ((k * 7) % 256).cast("int").alias("blue"))


def synthetic(spark: SparkSession, nrows: int, ncols: int, z) -> DataFrame:
    """A raster made by an expression of the columns r and c."""
    rows = spark.range(nrows * ncols).select(F.floor(F.col("id") / ncols).cast("int").alias("r"), (F.col("id") % ncols).cast("int").alias("c"))
    return rows.select("r", "c", z(F.col("c").cast("double"), F.col("r").cast("double")).alias("z"))


#: The same as DuckDB views; each query's SQL starts with those that it uses.
SQL = {
    "steps": "select (p_partkey // 50)::int r, (p_partkey % 50)::int c, p_retailprice::double z from part",
    "noise": "select vec_id::int r, unnest(range(64))::int c, unnest(embedding) z from embeddings",
    "holed": "select (event_id // 100)::int r, (event_id % 100)::int c, case when event_type = 'error' then null else value end z from events",
    "later": "select (o_orderkey // 100)::int r, (o_orderkey % 100)::int c, o_totalprice::double / 1000.0::double z from orders where o_orderkey < (select count(*) from events)",
    "photos": "select c_custkey n, c_name as name, case when c_acctbal < 0 then null else 58 + (c_custkey % 1300) / 100.0::double end lat, case when c_acctbal < 0 then null else 5 + (c_custkey % 2500) / 100.0::double end lon, ((c_custkey * 7) % 360)::int direction from customer",
    "tracks": "select user_id path_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int i, round((epoch_us(ts) - 1704067200000000) / 3600000000.0::double, 6) x, value y from events",
    "rings": """select k feature_id, ring, ring = 1 hole, i, ox + dx x, oy + dy y
                from (select n_nationkey::int k, n_regionkey g, (n_nationkey % 5) * 12.0::double ox, floor(n_nationkey / 5.0::double) * 12.0::double oy from nation) n,
                     (values (0,0,0.0,0.0),(0,1,10.0,0.0),(0,2,10.0,10.0),(0,3,0.0,10.0),(1,0,3.0,3.0),(1,1,3.0,7.0),(1,2,7.0,7.0),(1,3,7.0,3.0)) t(ring,i,dx,dy)
                where ring = 0 or g in (0, 2)""",
    "trees": "select s_suppkey ord, (s_suppkey * 37 % 600) / 10.0::double x, (s_suppkey * 53 % 600) / 10.0::double y, case when s_acctbal < 0 then null else s_acctbal::double end dbh from supplier",
    "image": "select (p_partkey // 50)::int y, (p_partkey % 50)::int x, (p_size * 5)::int red, (p_partkey % 256)::int green, ((p_partkey * 7) % 256)::int blue from part",
}


def with_views(*names: str) -> str:
    """The start of a query over these views."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names)
