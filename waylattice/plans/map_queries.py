"""Queries on scans, clouds, maps, descriptors, graphs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import descriptors, graph, maps, telemetry
from ..sources.tables import table
from . import views
from .trajectory_queries import _rounded
from .views import _YAW, with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


_POINTS = """pts AS (SELECT scan_id, sensor_id, beam, r * cos(angle_min + beam * angle_inc) AS x, r * sin(angle_min + beam * angle_inc) AS y, odom FROM (
  SELECT scan_id, sensor_id, odom, angle_min, angle_inc, range_min, range_max, beam_stride, unnest(ranges) AS r, generate_subscripts(ranges, 1) - 1 AS beam FROM v_scans s JOIN datasets d ON s.dataset = d.name)
  WHERE r IS NOT NULL AND NOT isnan(r) AND r >= range_min AND r < range_max AND beam % beam_stride = 0)"""
_WORLD = _POINTS + """, world AS (SELECT scan_id, sensor_id, beam, odom.x + cos(odom.theta) * x - sin(odom.theta) * y AS x, odom.y + sin(odom.theta) * x + cos(odom.theta) * y AS y, odom.x AS ox, odom.y AS oy
  FROM pts WHERE odom.x IS NOT NULL AND odom.y IS NOT NULL AND odom.theta IS NOT NULL)"""


def _cell(x: str, size: float) -> str:
    return f"CAST(floor(round(({x}) / {size}, 6)) AS BIGINT)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return maps.scan_points(views.scans(spark, d), table(spark, d, "datasets"))


def _world(spark: SparkSession, d: str) -> DataFrame:
    return maps.world_points(_points(spark, d))


@query(f"WITH {_POINTS} SELECT scan_id, CAST(beam AS INTEGER) AS beam, round(x, 6) AS x, round(y, 6) AS y FROM pts")
def scan_to_points(spark: SparkSession, d: str) -> DataFrame:
    """Every reading of every scan as a point."""
    return _rounded(_points(spark, d).select("scan_id", "beam", "x", "y"))


@query(f"WITH {_WORLD} SELECT sensor_id, {_cell('x', 0.5)} AS vx, {_cell('y', 0.5)} AS vy, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM world GROUP BY ALL")
def voxel_centroid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(maps.voxel_centroids(_world(spark, d), 0.5, ["sensor_id"], ["x", "y"]))


SQL["voxel_centroid"] = with_views(f"WITH {_WORLD}, k AS (SELECT sensor_id, {_cell('x', 0.5)} AS vx, {_cell('y', 0.5)} AS vy, x, y FROM world) SELECT sensor_id, vx, vy, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM k GROUP BY sensor_id, vx, vy")


@query(f"WITH k AS (SELECT sequence_id, pose_id, tx, ty, tz, {_cell('tx', 0.25)} AS a, {_cell('ty', 0.25)} AS b, {_cell('tz', 0.25)} AS c FROM v_gt) SELECT sequence_id, pose_id, tx, ty, tz FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id, a, b, c ORDER BY pose_id) AS k FROM k) WHERE k = 1")
def voxel_first(spark: SparkSession, d: str) -> DataFrame:
    return maps.voxel_first(views.gt(spark, d), 0.25, ["sequence_id"], ["tx", "ty", "tz"], "pose_id")


@query(f"WITH k AS (SELECT {_cell('tx', 0.1)} AS vtx, {_cell('ty', 0.1)} AS vty, {_cell('tz', 0.1)} AS vtz, tx, ty, tz FROM v_gt) SELECT vtx, vty, vtz, round(avg(tx), 9) AS tx, round(avg(ty), 9) AS ty, round(avg(tz), 9) AS tz, count(*) AS n FROM k GROUP BY vtx, vty, vtz HAVING count(*) >= 2")
def voxel_min_obs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(maps.voxel_centroids(views.gt(spark, d), 0.1, [], ["tx", "ty", "tz"], least=2), 9)


@query()
def adaptive_voxel(spark: SparkSession, d: str) -> DataFrame:
    """Greatest voxel size per sensor that leaves 200 points."""
    return maps.adaptive_voxel_size(_world(spark, d), "sensor_id", ["x", "y"], 2.0, 200)


_SIZE = 0.5
_AT = "CASE WHEN n = 0 THEN 0 ELSE CAST(sign({0}) AS BIGINT) * ((abs({0}) * i * 2 + n) // (2 * n)) END"
_RAYS = f"""{_WORLD}, ends AS (SELECT scan_id, sensor_id, beam, {_cell('ox', _SIZE)} AS x0, {_cell('oy', _SIZE)} AS y0, {_cell('x', _SIZE)} AS x1, {_cell('y', _SIZE)} AS y1 FROM world),
steps AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM ends),
walk AS (SELECT *, unnest(generate_series(0, n)) AS i FROM steps),
cells AS (SELECT scan_id, sensor_id, beam, x0 + {_AT.format('dx')} AS gx, y0 + {_AT.format('dy')} AS gy, i = n AS hit FROM walk),
occ AS (SELECT sensor_id, gx, gy, count(*) FILTER (WHERE NOT hit) AS free, count(*) FILTER (WHERE hit) AS hits, greatest(-5.0::DOUBLE, least(5.0::DOUBLE, count(*) FILTER (WHERE NOT hit) * {maps.LOG_ODDS_FREE}::DOUBLE + count(*) FILTER (WHERE hit) * {maps.LOG_ODDS_HIT}::DOUBLE)) AS l FROM cells GROUP BY sensor_id, gx, gy)"""


def _rays(spark: SparkSession, d: str) -> DataFrame:
    return maps.ray_cells(_world(spark, d), _SIZE)


def _occupancy(spark: SparkSession, d: str) -> DataFrame:
    return maps.occupancy_counts(maps.count_rays(_world(spark, d), _SIZE, "sensor_id"), ["sensor_id"])


@query(f"WITH {_RAYS} SELECT sensor_id, gx, gy, free, hits, round(l, 6) AS l FROM occ")
def occupancy_counts_clip(spark: SparkSession, d: str) -> DataFrame:
    """Occupancy map per sensor, counts times weights, clipped once."""
    return _rounded(_occupancy(spark, d))


@query()
def occupancy_fold_exact(spark: SparkSession, d: str) -> DataFrame:
    """Occupancy map with every visit clipped in order."""
    return _rounded(maps.occupancy_fold(_rays(spark, d), ["sensor_id"], "scan_id", "beam"))


@query(f"""WITH {_WORLD}, i AS (SELECT *, unnest(generate_series(0, 39)) AS i FROM world),
c AS (SELECT DISTINCT scan_id, sensor_id, CASE WHEN i = 39 THEN -1 ELSE beam END AS beam, CAST(round_even(round((ox + (x - ox) * i / 39::DOUBLE) / 0.5, 6), 0) AS BIGINT) AS gx, CAST(round_even(round((oy + (y - oy) * i / 39::DOUBLE) / 0.5, 6), 0) AS BIGINT) AS gy, i = 39 AS hit FROM i)
SELECT sensor_id, gx, gy, count(*) FILTER (WHERE NOT hit) AS free, count(*) FILTER (WHERE hit) AS hits, round(greatest(-5.0::DOUBLE, least(5.0::DOUBLE, count(*) FILTER (WHERE NOT hit) * {maps.LOG_ODDS_FREE}::DOUBLE + count(*) FILTER (WHERE hit) * {maps.LOG_ODDS_HIT}::DOUBLE)), 6) AS l FROM c GROUP BY sensor_id, gx, gy""")
def occupancy_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Occupancy map from evenly sampled rays, each cell once per ray."""
    return _rounded(maps.occupancy_counts(maps.sampled_ray_cells(_world(spark, d), _SIZE), ["sensor_id"]))


@query(f"""WITH {_RAYS}, pose AS (SELECT sensor_id, min_by(odom, scan_id) AS p FROM v_scans WHERE odom.x IS NOT NULL AND odom.y IS NOT NULL AND odom.theta IS NOT NULL GROUP BY sensor_id),
m AS (SELECT {_cell(f'p.x + cos(p.theta) * (gx + 0.5) * {_SIZE} - sin(p.theta) * (gy + 0.5) * {_SIZE}', _SIZE)} AS mx, {_cell(f'p.y + sin(p.theta) * (gx + 0.5) * {_SIZE} + cos(p.theta) * (gy + 0.5) * {_SIZE}', _SIZE)} AS my, l FROM occ JOIN pose USING (sensor_id) WHERE abs(l) > 1e-9),
t AS (SELECT mx AS gx, my AS gy, greatest(-10.0::DOUBLE, least(10.0::DOUBLE, sum(l))) AS l FROM m GROUP BY mx, my)
SELECT gx, gy, round(l, 6) AS l, round(1 / (1 + exp(-l)), 6) AS p FROM t""")
def tile_merge(spark: SparkSession, d: str) -> DataFrame:
    """Maps of all sensors moved by their first pose and added up."""
    good = "odom.x IS NOT NULL AND odom.y IS NOT NULL AND odom.theta IS NOT NULL"
    pose = views.scans(spark, d).where(good).groupBy("sensor_id").agg(F.min_by("odom", "scan_id").alias("pose"))
    return _rounded(maps.merge_tiles(_occupancy(spark, d), pose, "sensor_id", _SIZE))


@query(f"WITH {_RAYS} SELECT sensor_id, CAST(floor(gx / 2) AS BIGINT) AS px, CAST(floor(gy / 2) AS BIGINT) AS py, round(max(l), 6) AS l FROM occ GROUP BY ALL")
def occupancy_pyramid(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(maps.max_pool(_occupancy(spark, d), ["sensor_id"])).withColumnsRenamed({"gx": "px", "gy": "py"})


@query(f"WITH {_RAYS}, s AS (SELECT sensor_id, gx - dx AS gx, gy - dy AS gy, l FROM occ, (SELECT unnest(generate_series(0, 3)) AS dx) a, (SELECT unnest(generate_series(0, 3)) AS dy) b) SELECT sensor_id, gx, gy, round(max(l), 6) AS l FROM s GROUP BY sensor_id, gx, gy")
def occupancy_forward_max(spark: SparkSession, d: str) -> DataFrame:
    """Upper bounds for branch and bound: greatest value of four by four cells."""
    return _rounded(maps.forward_max(_occupancy(spark, d), ["sensor_id"], 4))


@query(f"WITH {_RAYS}, s AS (SELECT sensor_id, count(*) AS cells, count(*) FILTER (WHERE 1 / (1 + exp(-l)) >= 0.65) AS occupied, (max(gx) - min(gx) + 1) * (max(gy) - min(gy) + 1) AS area FROM occ GROUP BY sensor_id) SELECT *, round(occupied / area, 6) AS share FROM s")
def occupied_share(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(maps.occupied_share(_occupancy(spark, d), ["sensor_id"]))


_CONTEXT = _POINTS + """, ctx AS (SELECT DISTINCT scan_id, CAST(least(19, floor(round(sqrt(x * x + y * y) / 1.0, 6))) AS INTEGER) AS ring,
  CAST(least(59, floor(round((atan2(y, x) - 2 * pi() * floor(atan2(y, x) / (2 * pi()))) / (2 * pi() / 60), 6))) AS INTEGER) AS sector FROM pts WHERE sqrt(x * x + y * y) > 0.05 AND sqrt(x * x + y * y) <= 20)"""


@query(f"WITH {_CONTEXT} SELECT scan_id, ring, sector FROM ctx")
def scan_context(spark: SparkSession, d: str) -> DataFrame:
    return maps.ring_sector(_points(spark, d))


@query(f"""WITH {_CONTEXT}, pairs AS (SELECT lag(scan_id) OVER (PARTITION BY sensor_id ORDER BY t, scan_id) AS a, scan_id AS b FROM v_scans),
one AS MATERIALIZED (SELECT a, b, ring, sector FROM pairs JOIN ctx ON a = scan_id),
m AS (SELECT a, b, shift, count(*) AS common FROM (SELECT a, b, (one.sector - two.sector + 60) % 60 AS shift FROM one JOIN ctx two ON b = two.scan_id AND one.ring = two.ring) GROUP BY a, b, shift),
n AS (SELECT scan_id, count(*) AS n FROM ctx GROUP BY scan_id),
k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY common DESC, shift) AS k FROM m)
SELECT a, b, CAST(shift AS INTEGER) AS shift, round(common / sqrt(x.n * y.n), 6) AS cosine FROM k JOIN n x ON a = x.scan_id JOIN n y ON b = y.scan_id WHERE k = 1""")
def scan_context_shift(spark: SparkSession, d: str) -> DataFrame:
    """Best shift between the contexts of consecutive scans."""
    from ..operators.blocks import in_blocks, own, window

    cut_up = in_blocks(views.scans(spark, d).select("sensor_id", "t", "scan_id"), "sensor_id", ["t", "scan_id"], before=1)
    pairs = own(cut_up.withColumn("a", F.lag("scan_id").over(window("sensor_id")))).where("a IS NOT NULL").select("a", F.col("scan_id").alias("b"))
    return _rounded(maps.best_shift(pairs, maps.ring_sector(_points(spark, d))))


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY ts) AS ord FROM v_gt),
m AS (SELECT q.pose_id AS query_id, p.pose_id AS point_id, sqrt((p.tx - q.tx) * (p.tx - q.tx) + (p.ty - q.ty) * (p.ty - q.ty)) AS distance FROM o q JOIN o p ON q.sequence_id = p.sequence_id AND p.ord < q.ord - 100 WHERE q.pose_id % 20 = 0)
SELECT query_id, point_id, round(distance, 6) AS distance, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id) AS place FROM m WHERE distance <= 0.5) WHERE place <= 10""")
def radius_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest earlier poses within half a metre; queries are the poses whose id is divisible by 20."""
    from ..operators.blocks import ranked

    p = ranked(views.gt(spark, d).select("sequence_id", F.col("pose_id").alias("id"), "ts", F.col("tx").alias("x"), F.col("ty").alias("y")), "sequence_id", ["ts"], "ord")
    return _rounded(maps.radius_nearest(p.where("id % 20 = 0"), p, "sequence_id", 0.5, 10, 100))


@query("""
WITH s AS (SELECT sequence_id, median(tx) AS mx, stddev_pop(tx) AS dx, median(ty) AS my, stddev_pop(ty) AS dy, median(tz) AS mz, stddev_pop(tz) AS dz FROM v_est GROUP BY sequence_id)
SELECT pose_id FROM v_est JOIN s USING (sequence_id) WHERE abs(tx - mx) < 3.5 * greatest(dx, 0.01) AND abs(ty - my) < 3.5 * greatest(dy, 0.01) AND abs(tz - mz) < 3.5 * greatest(dz, 0.01)""")
def outlier_clip(spark: SparkSession, d: str) -> DataFrame:
    return maps.clip_outliers(views.est(spark, d), ["sequence_id"], ["tx", "ty", "tz"]).select("pose_id")


@query("SELECT sequence_id, round(quantile_cont(tx, 0.005), 9) AS lo_tx, round(quantile_cont(tx, 0.995), 9) AS hi_tx, round(quantile_cont(ty, 0.005), 9) AS lo_ty, round(quantile_cont(ty, 0.995), 9) AS hi_ty FROM v_gt GROUP BY sequence_id")
def robust_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(maps.robust_bounds(views.gt(spark, d), ["sequence_id"], ["tx", "ty"]), 9)


@query("""WITH b AS (SELECT sequence_id, min(tx) AS ax, max(tx) AS bx, min(ty) AS ay, max(ty) AS byy, min(tz) AS az, max(tz) AS bz FROM v_gt GROUP BY sequence_id)
SELECT pose_id FROM v_est JOIN b USING (sequence_id) WHERE tx BETWEEN ax - 0.1 AND bx + 0.1 AND ty BETWEEN ay - 0.1 AND byy + 0.1 AND tz BETWEEN az - 0.1 AND bz + 0.1""")
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    """Estimated poses within the padded box of the ground truth."""
    return maps.within_reference(views.est(spark, d), views.gt(spark, d), ["sequence_id"], ["tx", "ty", "tz"], 0.1).select("pose_id")


def _descriptors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return e.select(F.col("vec_id").alias("id"), "label", descriptors.sign_bits(F.col("embedding"), 64).alias("des"))


def _word(w: int) -> str:
    return "list_sum(list_transform(generate_series(1, 32), lambda i: CASE WHEN embedding[i + {0}] > 0 THEN (1::BIGINT << (i - 1)) ELSE 0::BIGINT END))::BIGINT".format(w)


_DES = f"des AS (SELECT vec_id AS id, label, {_word(0)} AS a, {_word(32)} AS b FROM embeddings)"


@query(f"""WITH {_DES}, m AS (SELECT q.id AS query_id, t.id AS t_id, bit_count(xor(q.a, t.a)) + bit_count(xor(q.b, t.b)) AS d FROM des q JOIN des t ON q.id <> t.id WHERE q.id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, t_id) AS k, lead(d) OVER (PARTITION BY query_id ORDER BY d, t_id) AS d2 FROM m)
SELECT query_id, t_id AS best, CAST(d AS INTEGER) AS d1, CAST(d2 AS INTEGER) AS d2, d < 0.9 * d2 AS passes FROM k WHERE k = 1""")
def knn_ratio_hamming(spark: SparkSession, d: str) -> DataFrame:
    """Two nearest descriptors and the ratio test; queries are the rows whose id is divisible by 20."""
    des = _descriptors(spark, d)
    near = descriptors.nearest_two(des.where("id % 20 = 0"), des, 2)
    return near.select("query_id", "best", F.col("d1").cast("int").alias("d1"), F.col("d2").cast("int").alias("d2"), (F.col("d1") < 0.9 * F.col("d2")).alias("passes"))


@query(f"""WITH {_DES}, m AS (SELECT q.id AS query_id, t.id AS t_id, bit_count(xor(q.a, t.a)) + bit_count(xor(q.b, t.b)) AS d FROM des q JOIN des t ON q.id <> t.id WHERE q.id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, t_id) AS k, lead(d) OVER (PARTITION BY query_id ORDER BY d, t_id) AS d2 FROM m),
u AS (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY d, query_id) AS place FROM k WHERE k = 1 AND d < 0.95 * d2)
SELECT query_id, t_id AS best, CAST(d AS INTEGER) AS d1 FROM u WHERE place = 1""")
def knn_unique_matches(spark: SparkSession, d: str) -> DataFrame:
    des = _descriptors(spark, d)
    near = descriptors.ratio_matches(descriptors.nearest_two(des.where("id % 20 = 0"), des, 2), 0.95)
    return descriptors.unique_train(near).select("query_id", "best", F.col("d1").cast("int").alias("d1"))


@query(f"""WITH {_DES}, m AS (SELECT q.label, q.id, median(bit_count(xor(q.a, t.a)) + bit_count(xor(q.b, t.b))) AS median FROM des q JOIN des t ON q.label = t.label WHERE q.id % 20 = 0 GROUP BY ALL)
SELECT label, id, median FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY median, id) AS k FROM m) WHERE k = 1""")
def medoid_descriptor(spark: SparkSession, d: str) -> DataFrame:
    """Most central descriptor of each label among the queries (ids divisible by 20), by its distances to all of the label."""
    des = _descriptors(spark, d)
    return descriptors.medoid_of_queries(des.where("id % 20 = 0"), des, "label", 2)


@query(f"""WITH a AS (SELECT sequence_id, pose_id, (({_YAW.format('e_')} - {_YAW.format('g_')}) * 180 / pi()) AS ang FROM v_near),
b AS (SELECT sequence_id, pose_id, CAST(round_even((ang - 360 * floor(ang / 360)) * 12 / 360, 0) AS INTEGER) % 12 AS bin FROM a),
c AS (SELECT sequence_id, bin, count(*) AS c FROM b GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY c DESC, bin) AS k, max(c) OVER (PARTITION BY sequence_id) AS most FROM c)
SELECT b.pose_id, b.bin FROM b JOIN k USING (sequence_id, bin) WHERE k.k = 1 OR (k.k <= 3 AND k.c >= 0.1 * k.most)""")
def rotation_histogram_filter(spark: SparkSession, d: str) -> DataFrame:
    """Pose pairs whose rotation agrees with most of their sequence."""
    yaw = lambda s: geom.quaternion_to_yaw(*[F.col(s + c) for c in ("qx", "qy", "qz", "qw")])
    m = views.matched(spark, d).withColumn("angle", F.degrees(yaw("e_") - yaw("g_")))
    return descriptors.rotation_histogram(m, "sequence_id", "angle").select("pose_id", "bin")


# Keyframe graphs: orders stand for keyframes, the parts in them for the points they observe


def _observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey")


_EDGES = """obs AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS i FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL),
edges AS (SELECT a.o AS a, b.o AS b, count(*) AS shared FROM obs a JOIN obs b ON a.i = b.i AND a.o <> b.o WHERE a.o % 20 = 0 GROUP BY ALL)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_items(_observations(spark, d), "l_orderkey", "l_partkey", queries=F.col("l_orderkey") % 20 == 0)


@query(f"WITH {_EDGES} SELECT a, b, shared FROM edges")
def covisibility(spark: SparkSession, d: str) -> DataFrame:
    """Shared points of each query keyframe (id divisible by 20) with every other one, by the inverted index."""
    return _edges(spark, d)


@query(f"WITH {_EDGES} SELECT a, b, shared, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS k FROM edges) WHERE k <= 10")
def best_covisibles_topn(spark: SparkSession, d: str) -> DataFrame:
    return graph.best_neighbours(_edges(spark, d).withColumnRenamed("shared", "w"), 10).select("a", "b", F.col("w").alias("shared"), "place")


# The graph of all keyframes of the log: pairs that were compared, weighed by their common words

_LOG_EDGES = """edges AS (SELECT a, b, max(w) AS shared FROM (SELECT current_kf_id AS a, candidate_kf_id AS b, common_words AS w FROM v_loops UNION ALL SELECT candidate_kf_id, current_kf_id, common_words FROM v_loops)
  WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b AND w IS NOT NULL GROUP BY a, b)"""
_LEAST = 100


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """Undirected edges (a, b, w) of all keyframes."""
    log = views.loops(spark, d).where("current_kf_id IS NOT NULL AND candidate_kf_id IS NOT NULL")
    return graph.undirected(log.select(F.col("current_kf_id").alias("a"), F.col("candidate_kf_id").alias("b"), F.col("common_words").alias("w")))


@query(f"WITH {_LOG_EDGES} SELECT a, b, shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS k, max(shared) OVER (PARTITION BY a) AS most FROM edges) WHERE shared >= {_LEAST} OR (most < {_LEAST} AND k = 1)")
def keyframe_connections(spark: SparkSession, d: str) -> DataFrame:
    """Connections of at least a hundred common words, else the single best."""
    return graph.connections(_graph(spark, d), _LEAST).select("a", "b", F.col("w").alias("shared"))


@query(f"WITH {_LOG_EDGES} SELECT a AS kf_id, b AS parent, shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS k FROM edges WHERE b < a) WHERE k = 1")
def spanning_parents(spark: SparkSession, d: str) -> DataFrame:
    return graph.parents(_graph(spark, d))


def _all_edges(spark: SparkSession, d: str) -> DataFrame:
    e = _graph(spark, d)
    tree = graph.parents(e).select(F.col("kf_id").alias("a"), F.col("parent").alias("b"), F.col("shared").alias("w"))
    loop = e.where("w >= 200").select("a", "b", "w")
    return graph.edge_union(("covisibility", graph.connections(e, _LEAST)), ("spanning_tree", tree), ("loop", loop))


_UNION = f"""{_LOG_EDGES}, tree AS (SELECT a, b, shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS k FROM edges WHERE b < a) WHERE k = 1),
conn AS (SELECT a, b, shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS k, max(shared) OVER (PARTITION BY a) AS most FROM edges) WHERE shared >= {_LEAST} OR (most < {_LEAST} AND k = 1)),
every AS (SELECT 'covisibility' AS kind, a, b, shared FROM conn UNION ALL SELECT 'spanning_tree', a, b, shared FROM tree UNION ALL SELECT 'loop', a, b, shared FROM edges WHERE shared >= 200),
graph AS (SELECT kind, least(a, b) AS source, greatest(a, b) AS target, max(shared) AS weight FROM every WHERE a <> b AND a >= 0 AND b >= 0 GROUP BY ALL)"""
_UNION = _UNION.replace("least(a, b) AS source, greatest(a, b) AS target, max(shared) AS weight FROM every WHERE a <> b AND a >= 0 AND b >= 0 GROUP BY ALL", "s AS source, t AS target, max(shared) AS weight FROM (SELECT kind, least(a, b) AS s, greatest(a, b) AS t, shared FROM every WHERE a <> b AND a >= 0 AND b >= 0) GROUP BY kind, s, t")


@query(f"WITH {_UNION} SELECT kind, source, target, weight FROM graph")
def edge_union_graph(spark: SparkSession, d: str) -> DataFrame:
    return _all_edges(spark, d)


@query(f"""WITH {_UNION} SELECT source, target, kind, weight, CASE kind WHEN 'loop' THEN 10.0 WHEN 'spanning_tree' THEN 1.0 ELSE greatest(0.5, least(5.0, weight * 0.01)) END::DOUBLE AS information
FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY CASE kind WHEN 'loop' THEN 0 WHEN 'spanning_tree' THEN 1 ELSE 2 END) AS k FROM graph) WHERE k = 1""")
def essential_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.essential_edges(_all_edges(spark, d))


_PARENTS = "p AS (SELECT a AS kf_id, b AS parent, shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS k FROM edges WHERE b < a) WHERE k = 1)"


@query(f"""WITH RECURSIVE {_LOG_EDGES}, p AS (SELECT a AS kf_id, b AS parent FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS k FROM edges WHERE b < a) WHERE k = 1),
up AS (SELECT kf_id, parent AS ancestor, 1 AS hops FROM p UNION ALL SELECT up.kf_id, p.parent, hops + 1 FROM up JOIN p ON up.ancestor = p.kf_id WHERE hops < 10)
SELECT kf_id, ancestor, CAST(hops AS INTEGER) AS hops FROM up""")
def tree_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors of each keyframe along its spanning parents, up to ten hops."""
    return graph.ancestors(graph.parents(_graph(spark, d)))


@query(f"""WITH {_UNION}, v AS (SELECT source AS kf_id, false AS c FROM graph UNION ALL SELECT target, false FROM graph UNION ALL SELECT current_kf_id, false FROM v_loops UNION ALL SELECT candidate_kf_id, false FROM v_loops
  UNION ALL SELECT current_kf_id, true FROM v_loops WHERE passed_consistency)
SELECT kf_id, bool_or(c) AS corrected FROM v WHERE kf_id >= 0 GROUP BY kf_id""")
def essential_graph_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Keyframes of the essential graph: of the log, of its edges, and those that a consistent loop corrects."""
    log = views.loops(spark, d)
    kfs = log.select(F.col("current_kf_id").alias("kf_id")).unionByName(log.select(F.col("candidate_kf_id").alias("kf_id")))
    return graph.essential_vertices(kfs, _all_edges(spark, d), log.where("passed_consistency").select(F.col("current_kf_id").alias("kf_id")))


@query(f"""WITH RECURSIVE {_LOG_EDGES}, {_PARENTS}, up AS (SELECT kf_id, parent AS ancestor, 1 AS hops FROM p UNION ALL SELECT up.kf_id, p.parent, hops + 1 FROM up JOIN p ON up.ancestor = p.kf_id WHERE hops < 10),
gone AS (SELECT kf_id FROM p WHERE shared < 150), near AS (SELECT kf_id, min_by(ancestor, hops) AS parent FROM up WHERE ancestor NOT IN (SELECT kf_id FROM gone) GROUP BY kf_id)
SELECT p.kf_id, near.parent FROM p LEFT JOIN near USING (kf_id) WHERE p.kf_id NOT IN (SELECT kf_id FROM gone)""")
def keyframe_erase_repair(spark: SparkSession, d: str) -> DataFrame:
    """The spanning tree after weakly tied keyframes (under 150 common words with their parent) are erased: children go to the nearest ancestor left."""
    tree = graph.parents(_graph(spark, d))
    return graph.erase_keyframes(tree.select("kf_id", "parent"), tree.where("shared < 150").select("kf_id"))


@query(f"""WITH {_LOG_EDGES}, best AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS k FROM edges) WHERE k <= 5),
f AS (SELECT DISTINCT current_kf_id AS frame, current_kf_id AS kf FROM v_loops), one AS (SELECT frame, b AS kf FROM f JOIN best ON kf = a), two AS (SELECT frame, b AS kf FROM one JOIN best ON kf = a)
SELECT frame, kf, CAST(min(ring) AS INTEGER) AS ring FROM (SELECT frame, kf, 0 AS ring FROM f UNION ALL SELECT frame, kf, 1 FROM one UNION ALL SELECT frame, kf, 2 FROM two) GROUP BY frame, kf""")
def local_covisibility_rings(spark: SparkSession, d: str) -> DataFrame:
    """Local covisibility map of each keyframe: itself, its five best neighbours and theirs."""
    frames = views.loops(spark, d).where("current_kf_id IS NOT NULL").select(F.col("current_kf_id").alias("frame"), F.col("current_kf_id").alias("kf")).distinct()
    return graph.second_ring(_graph(spark, d), frames, 5)


# Run logs

_SECTIONS = ["load_rgb_sec", "load_depth_sec", "local_mapping_sec", "loop_closing_sec", "prune_old_frame_views_sec", "memory_profile_sec"]


@query(f"""WITH l AS ({' UNION ALL '.join(f"SELECT run_id, frame_idx, '{c}' AS section, {c} AS sec FROM v_timing" for c in _SECTIONS)})
SELECT run_id, section, count(*) AS calls, round(sum(sec), 9) AS total, round(avg(sec), 9) AS mean, round(max(sec), 9) AS most, round(max_by(sec, frame_idx), 9) AS last FROM l WHERE sec > 0 AND NOT isnan(sec) GROUP BY run_id, section""")
def profiler_sections(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(telemetry.sections(views.timing(spark, d), ["run_id"], "frame_idx", _SECTIONS), 9)


@query("SELECT run_id, frame_idx FROM (SELECT run_id, frame_idx, coalesce(loop_closing_sec > 0, false) AS f, lag(coalesce(loop_closing_sec > 0, false), 1, false) OVER (PARTITION BY run_id ORDER BY frame_idx) AS was FROM v_timing) WHERE f AND NOT was")
def edge_detect_0_1(spark: SparkSession, d: str) -> DataFrame:
    """Frames at which loop closing begins."""
    return telemetry.rising_edges(views.timing(spark, d), "run_id", "frame_idx", F.col("loop_closing_sec") > 0).select("run_id", "frame_idx")


@query("SELECT run_id, frame_idx, keyframes FROM (SELECT run_id, frame_idx, keyframes, max(keyframes) OVER (PARTITION BY run_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v_timing) WHERE b IS NULL OR keyframes > b")
def new_keyframes(spark: SparkSession, d: str) -> DataFrame:
    """Frames whose keyframe count exceeds all before."""
    return telemetry.new_highs(views.timing(spark, d), "run_id", "frame_idx", "keyframes").select("run_id", "frame_idx", "keyframes")


@query("""WITH m AS (SELECT run_id, count(*) AS rows, max(keyframes) AS final, round(avg(CASE WHEN frame_total_sec >= 0 AND NOT isnan(frame_total_sec) THEN frame_total_sec END), 6) AS mean, round(quantile_cont(CASE WHEN frame_total_sec >= 0 AND NOT isnan(frame_total_sec) THEN frame_total_sec END, 0.5), 6) AS median,
  round(max(CASE WHEN frame_total_sec >= 0 AND NOT isnan(frame_total_sec) THEN frame_total_sec END), 6) AS most FROM v_timing GROUP BY run_id)
SELECT m.*, (SELECT min(frame_idx) FROM v_timing t WHERE t.run_id = m.run_id AND t.keyframes = m.final) AS reached_at FROM m""")
def run_log_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(telemetry.run_summary(views.timing(spark, d), "run_id", "frame_idx", "keyframes", "frame_total_sec"))


@query("SELECT run_id, frame_idx, buffered, round(m, 9) AS rolling_mean FROM (SELECT run_id, frame_idx, count(*) OVER w AS buffered, avg(load_rgb_sec) OVER w AS m FROM v_timing WINDOW w AS (PARTITION BY run_id ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))")
def rolling_buffer(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(telemetry.rolling(views.timing(spark, d), "run_id", "frame_idx", "load_rgb_sec").select("run_id", "frame_idx", "buffered", "rolling_mean"), 9)


@query("SELECT pose_id FROM (SELECT pose_id, row_number() OVER (PARTITION BY sequence_id ORDER BY ts) - 1 AS n FROM v_gt) WHERE n % 5 = 0")
def keyframe_stride(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.every_nth(views.gt(spark, d), "sequence_id", "ts", 5).select("pose_id")


@query()
def hash_ratio_sample(spark: SparkSession, d: str) -> DataFrame:
    """The three tenths of the frames that a seeded hash draws."""
    return telemetry.ratio_sample(views.timing(spark, d), "run_id", "frame_idx", 0.3).select("run_id", "frame_idx")


@query(f"SELECT pose_id, round({_YAW.format('')} * 180 / pi(), 4) AS yaw_deg, round(sqrt(qx * qx + qy * qy + qz * qz + qw * qw), 6) AS norm FROM v_est")
def pose_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Yaw and norm of every estimated rotation."""
    q = [F.col(c) for c in ("qx", "qy", "qz", "qw")]
    norm = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return views.est(spark, d).select("pose_id", F.round(F.degrees(geom.quaternion_to_yaw(*q)), 4).alias("yaw_deg"), F.round(norm, 6).alias("norm"))
