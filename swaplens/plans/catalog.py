"""All registered queries of the matched-audit engine, and their SQL.

A query binds the test tables to an operator and rounds its doubles, so that engines can be
compared. Those without SQL need state or kernels; tests hold them against brute force.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded, signed_round
from ..functions.stored import shared_dir, stored
from ..operators import aggregation, allocator, arrays, bootstrap, diagnostics, features, imaging, joins, matching, merging, metadata, metrics, sampling, scoring
from ..sources import bindings as b
from ..sources import shards, tables
from .sqltext import Z, distance, hashed, rounds, uniform, with_

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PAIR = "source_split, source_hospital, target_hospital"
TRIPLET = (
    "triplet_id, source_id, source_split, source_hospital, target_hospital, source_slide, source_patient, source_physical_id, label, within_donor, within_slide, "
    "within_physical_id, cross_donor, cross_slide, cross_physical_id, " + rounds("matching_distance_within", "matching_distance_cross", "matching_distance_pair", "matching_cost") + ", donor_index"
)
DRAWS = 2000


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _then(steps: tuple[str, ...], more: str, query: str) -> str:
    return with_(*steps, then="").rstrip() + more + " " + query


# --- metadata -----------------------------------------------------------------------------------

@registered(with_("meta", then="SELECT source_id, split, hospital_id, slide_id, label, patient_id, physical_id FROM meta"))
def meta_canonical(spark, sf_dir):
    return metadata.canonicalize(b.raw_metadata(spark, sf_dir))


@registered(with_("meta", then="SELECT source_id, split, hospital_id FROM meta WHERE split <> 'test'"))
def meta_held_in(spark, sf_dir):
    from .govern import readable

    return readable(b.metadata(spark, sf_dir)).select("source_id", "split", "hospital_id")


@registered(with_("meta", then="SELECT count(DISTINCT slide_id) AS slide_id, count(DISTINCT patient_id) AS patient_id, count(DISTINCT physical_id) AS physical_id FROM meta"))
def meta_cluster_counts(spark, sf_dir):
    return metadata.cluster_counts(b.metadata(spark, sf_dir), ["slide_id", "patient_id", "physical_id"])


@registered(with_("meta", then="SELECT split, hospital_id, slide_id, label, count(*) AS patch_count FROM meta GROUP BY ALL"))
def meta_summary(spark, sf_dir):
    return metadata.summary(b.metadata(spark, sf_dir))


HOSPITALS = {"train": [0, 3, 4], "id_val": [0, 3, 4], "val": [1], "test": [2]}


@registered(_then(("meta",), """
    , checks AS (SELECT 'row_count' AS "check", count(*) = (SELECT count(*) FROM customer) AS passed FROM meta UNION ALL SELECT 'slide_count', count(DISTINCT slide_id) = 25 FROM meta
      UNION ALL SELECT 'hospitals_' || split, CASE split WHEN 'val' THEN h = [1] WHEN 'test' THEN h = [2] ELSE h = [0, 3, 4] END
        FROM (SELECT split, list_sort(list(DISTINCT hospital_id)) AS h FROM meta GROUP BY 1)
      UNION ALL SELECT 'physical_id_in_one_hospital', max(n) = 1 FROM (SELECT count(DISTINCT hospital_id) AS n FROM meta GROUP BY physical_id))""",
    "SELECT * FROM checks UNION ALL SELECT 'overall', bool_and(passed) FROM checks"))
def meta_integrity(spark, sf_dir):
    return metadata.integrity(b.metadata(spark, sf_dir), b.table(spark, sf_dir, "customer").count(), 25, HOSPITALS)


@registered("""
    SELECT l_orderkey * 10 + l_linenumber AS source_id, l_suppkey % 5 AS center,
      CASE WHEN l_returnflag = 'R' THEN 'train' WHEN l_returnflag = 'A' THEN 'test' WHEN l_suppkey % 5 = 1 THEN 'val' ELSE 'id_val' END AS split FROM lineitem""")
def source_shards(spark, sf_dir):
    """SRC-2, SRC-3: shards per raw split, renamed columns."""
    l = b.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), (F.col("l_suppkey") % 5).alias("center"), "l_returnflag")
    raw = {"train": l.where("l_returnflag = 'R'"), "test": l.where("l_returnflag = 'A'"), "validation": l.where("l_returnflag NOT IN ('R', 'A')")}
    return tables.metadata_frame(tables.read_shards(raw, "center"), {"row": "source_id", "center": "center", "split": "split"})


@registered("SELECT c_custkey AS source_id, r_name AS split FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def source_split_names(spark, sf_dir):
    """SRC-5: split code to name."""
    names = b.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("split_code"), F.col("r_name").alias("split"))
    coded = b.metadata(spark, sf_dir).select("source_id", F.col("hospital_id").alias("split_code"))
    return tables.decode_split(coded, names)


@registered(with_("meta", then="SELECT m.* FROM meta m JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) o ON m.source_id = o.o_custkey"))
def source_rows_by_id(spark, sf_dir):
    """SRC-4."""
    wanted = b.table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("source_id"))
    return tables.rows_by_id(b.metadata(spark, sf_dir), wanted)


@registered(with_("meta", then="SELECT m.* FROM meta m WHERE m.source_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"))
def source_kept_ids(spark, sf_dir):
    """FLT-2: each once, unlike SRC-4."""
    wanted = b.table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("source_id"))
    return tables.kept_ids(b.metadata(spark, sf_dir), wanted)


@registered("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey IN (3, 7, 11) AND c_acctbal > 1000")
def source_dataset(spark, sf_dir):
    """SRC-6: customers through the data source of audited tables; both comparisons are pushed to it."""
    found = shards.load_dataset(spark, f"{sf_dir}/customer.parquet", "shards")
    return found.where(F.col("c_nationkey").isin(3, 7, 11) & (F.col("c_acctbal") > 1000)).select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@registered(with_("meta", then="SELECT source_id, split, hospital_id, label FROM meta"))
def source_table_csv(spark, sf_dir):
    """SRC-1, SRC-7, SNK-1: metadata written as CSV to the shared folder, read back and made canonical."""
    path = f"{shared_dir(spark)}/swaplens-metadata-{uuid.uuid4().hex}.csv"
    raw = b.raw_metadata(spark, sf_dir)
    tables.save_table(raw, path)
    return metadata.canonicalize(tables.read_table(spark, path, raw.schema)).select("source_id", "split", "hospital_id", "label")


@registered("""
    SELECT vec_id AS id, CAST(3 + vec_id % 3 AS INTEGER) AS n_points, floor(embedding[1]::DOUBLE * 1000) AS x, floor(embedding[2]::DOUBLE * 1000) AS y FROM embeddings WHERE vec_id % 7 <> 0""")
def source_polygons(spark, sf_dir):
    """SRC-9: annotation files written from the vectors, a thousand in each; every seventh has too few points to be a polygon."""
    e = b.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000)).alias("v"))
    n = F.when(F.col("vec_id") % 7 == 0, 2).otherwise(3 + F.col("vec_id") % 3).cast("int")
    point = lambda i: F.format_string('<Coordinate Order="%d" X="%d" Y="%d" />', i, F.get("v", 2 * i), F.get("v", 2 * i + 1))
    row = F.concat(F.format_string('<Annotation Name="%d"><Coordinates>', "vec_id"), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), point), ""), F.lit("</Coordinates></Annotation>"))
    files = e.groupBy(F.floor(F.col("vec_id") / 1000).alias("file")).agg(F.concat(F.lit("<Annotations>"), F.array_join(F.collect_list(row), ""), F.lit("</Annotations>")).alias("value"))
    path = f"{shared_dir(spark)}/swaplens-polygons-{uuid.uuid4().hex}"
    files.write.partitionBy("file").text(path)
    found, first = tables.read_polygons(spark, path), F.get("polygon", F.lit(0))
    return found.select(F.col("name").cast("long").alias("id"), F.size("polygon").alias("n_points"), first["x"].alias("x"), first["y"].alias("y"))


_PATHS = """SELECT page_id, path FROM (SELECT page_id, list_extract(['audits', 'Figures', 'figures', '/p0/./', 'raw', ''], CAST(page_id % 6 + 1 AS INTEGER)) || '/' ||
    list_extract(['final', 'WSI', 'wild\\s', 'x'], CAST(page_id % 4 + 1 AS INTEGER)) || '//p' || page_id || list_extract(['.csv', '.PNG', '.tar.xml', ''], CAST(page_id % 9 % 4 + 1 AS INTEGER)) AS path FROM pages)"""


@registered(f"""
    WITH p AS ({_PATHS}), q AS (SELECT *, list_filter(string_split(replace(path, '\\', '/'), '/'), lambda x: x NOT IN ('', '.')) AS parts FROM p),
    r AS (SELECT *, CASE WHEN parts[1] NOT IN ({', '.join(f"'{x}'" for x in tables.TOP_LEVEL)}) THEN 'outside the layout'
      WHEN list_has_any(list_transform(parts, lambda x: lower(x)), [{', '.join(f"'{x}'" for x in tables.FORBIDDEN_PARTS)}]) THEN 'source data'
      WHEN regexp_matches(lower(path), '[^.](\\.png|\\.xml)$') AND NOT (parts[1] = 'figures' AND parts[2] = 'final') THEN 'not a final figure' END AS reason FROM q)
    SELECT page_id, path, reason, CASE WHEN reason IS NULL THEN array_to_string(parts, '/') END AS artifact_path FROM r""")
def artifact_policy(spark, sf_dir):
    """SNK-3: paths made of page numbers, against the layout of artifacts."""
    k = F.col("page_id")
    pick = lambda items, i: F.get(F.array(*[F.lit(x) for x in items]), i.cast("int"))
    path = F.concat(
        pick(["audits", "Figures", "figures", "/p0/./", "raw", ""], k % 6), F.lit("/"), pick(["final", "WSI", "wild\\s", "x"], k % 4), F.lit("//p"), k.cast("string"),
        pick([".csv", ".PNG", ".tar.xml", ""], k % 9 % 4))
    return tables.artifact_paths(b.table(spark, sf_dir, "pages").select("page_id", path.alias("path")))


@registered("""
    SELECT coalesce(c_custkey, o) AS source_id, CASE WHEN o IS NULL THEN 'right' ELSE 'left' END AS missing_side
    FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_totalprice > 300000) ON c_custkey = o WHERE c_custkey IS NULL OR o IS NULL""")
def join_unmatched(spark, sf_dir):
    """JOIN-2: customers in credit and customers with large orders: whom only one side has."""
    a = b.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("source_id"))
    large = b.table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("source_id")).agg(F.max("o_totalprice").alias("price"))
    return joins.unmatched(a, large, ["source_id"])


@registered("""
    SELECT c_custkey AS source_id, c_acctbal, n_orders, round(price, 6) AS price FROM customer
    JOIN (SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS price FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON c_custkey = o_custkey""")
def join_one_to_one(spark, sf_dir):
    """JOIN-2: customers with their large orders."""
    a = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), "c_acctbal")
    large = b.table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("source_id")).agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("price"))
    return joins.one_to_one(a, large, ["source_id"]).withColumn("price", F.round("price", 6))


_MANIFEST = """
    , manifest AS (SELECT 'slide_' || n_nationkey AS k, 'patient_' || n_nationkey || '_node_' || (n_nationkey % 3) || s AS w
      FROM nation, (VALUES (''), ('_b')) v(s) WHERE n_nationkey % 6 <> 5 AND (s = '' OR n_nationkey % 6 = 0)),
    mapped AS (SELECT m.slide_id, m.splits, m.hospitals, CASE WHEN n = 1 THEN 'mapped' WHEN n > 1 THEN 'ambiguous' ELSE 'unmapped' END AS mapping_status,
      CASE WHEN n = 1 THEN 'exact manifest match' WHEN n > 1 THEN 'several manifest rows' ELSE 'no manifest row' END AS mapping_reason,
      CASE WHEN n = 1 THEN ws END AS camelyon_wsi, coalesce(ws, '') AS candidates
      FROM (SELECT slide_id, array_to_string(list_sort(list(DISTINCT split)), ';') AS splits, array_to_string(list_sort(list(DISTINCT CAST(hospital_id AS VARCHAR))), ';') AS hospitals FROM meta GROUP BY 1) m
      LEFT JOIN (SELECT k, count(*) AS n, array_to_string(list_sort(list(DISTINCT w)), ';') AS ws FROM manifest GROUP BY 1) g ON g.k = m.slide_id)"""


@registered(_then(("meta",), _MANIFEST, "SELECT * FROM mapped"))
def slide_mapping(spark, sf_dir):
    return metadata.map_slides(b.metadata(spark, sf_dir), b.slide_manifest(spark, sf_dir))


_FILES = """
    , files AS (SELECT 'Patient_' || n_nationkey || '_Node_' || (n_nationkey % 3) AS stem, kind, '/slides/Patient_' || n_nationkey || '_Node_' || (n_nationkey % 3) || '.' || kind AS path
      FROM nation, (VALUES ('tif'), ('xml')) v(kind) WHERE n_nationkey % 4 <> 3 AND (kind = 'tif' OR n_nationkey % 5 <> 0))"""


@registered(_then(("meta",), _FILES, """
    SELECT slide_id, p AS patient_id, node, path FROM (SELECT 'slide_' || n_nationkey AS slide_id, CAST(n_nationkey AS VARCHAR) AS p, CAST(n_nationkey % 3 AS VARCHAR) AS node FROM nation) s
    JOIN files f ON lower(regexp_replace(f.stem, '[^A-Za-z0-9]', '', 'g')) = 'patient' || p || 'node' || node WHERE slide_id IN (SELECT slide_id FROM meta)"""))
def slide_manifest_by_name(spark, sf_dir):
    m = b.metadata(spark, sf_dir).withColumn("n", F.regexp_extract("slide_id", r"(\d+)$", 1))
    named = m.select("slide_id", F.col("n").alias("patient_id"), (F.col("n").cast("int") % 3).cast("string").alias("node"))
    return metadata.manifest_by_name(named, b.files(spark, sf_dir))


@registered(_then(("meta",), _MANIFEST + _FILES + """
    , slides AS (SELECT *, '/slides/Patient_' || split_part(camelyon_wsi, '_', 2) || '_Node_' || split_part(camelyon_wsi, '_', 4) || '.tif' AS wsi_path FROM mapped),
    xml AS (SELECT lower(stem) AS s, count(*) AS n, min(path) AS x FROM files WHERE kind = 'xml' GROUP BY 1)""", """
    SELECT m.source_id, m.label, m.split, m.hospital_id, m.slide_id, m.patient_id, s.camelyon_wsi, s.wsi_path, m.source_id % 96 AS x, CASE WHEN m.source_id % 10 <> 0 THEN m.source_id % 64 END AS y,
      x.x AS annotation_path,
      CASE WHEN mapping_status = 'ambiguous' THEN 'ambiguous' WHEN mapping_status <> 'mapped' OR m.source_id % 10 = 0 OR f.path IS NULL OR x.x IS NULL THEN 'unavailable' ELSE 'mapped' END AS mapping_status,
      CASE WHEN mapping_status = 'ambiguous' THEN 'ambiguous slide mapping' WHEN mapping_status <> 'mapped' THEN mapping_reason WHEN m.source_id % 10 = 0 THEN 'missing patch coordinates'
        WHEN f.path IS NULL THEN 'mapped slide file is missing' WHEN x.x IS NULL THEN 'annotation file is missing' ELSE 'exact mapping' END AS mapping_reason
    FROM meta m JOIN slides s USING (slide_id) LEFT JOIN (SELECT path FROM files) f ON f.path = s.wsi_path LEFT JOIN xml x ON x.s = lower(s.camelyon_wsi)"""))
def patch_mapping(spark, sf_dir):
    m = b.metadata(spark, sf_dir).withColumns({"x": F.col("source_id") % 96, "y": F.when(F.col("source_id") % 10 != 0, F.col("source_id") % 64)})
    slides = metadata.map_slides(m, b.slide_manifest(spark, sf_dir))
    name = F.regexp_replace("camelyon_wsi", r"patient_(\d+)_node_(\d+)", "Patient_$1_Node_$2")
    slides = slides.withColumns({"wsi_path": F.concat(F.lit("/slides/"), name, F.lit(".tif")), "annotation_path": F.lit(None).cast("string")})
    return metadata.patch_mapping(m, slides, b.files(spark, sf_dir), 96, 1.0, 0, "identity", "top_left")


# --- standardization and candidates ------------------------------------------------------------

@registered(_then(("fit",), "", "SELECT feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, m_{c} AS mean, s_{c} AS scale FROM fit" for c in b.FEATURES) + ")"))
def std_fit(spark, sf_dir):
    return rounded(features.fit_standardizer(b.descriptors(spark, sf_dir), b.FEATURES))


@registered(_then(("z",), "", f"SELECT source_id, {rounds(*Z)} FROM z"))
def std_transform(spark, sf_dir):
    return rounded(b.bank(spark, sf_dir).select("source_id", *Z))


@registered(_then(("pool",), "", "SELECT source_id, role, d_hospital, donor_id, d_slide, d_physical, round(distance, 6) AS distance, rank FROM pool WHERE rank <= 16"))
def knn_pool(spark, sf_dir):
    z = b.bank(spark, sf_dir)
    found = matching.nearest(matching.requests(b.audited(z), b.TARGETS), z, b.FEATURES, 16)
    return rounded(found.select("source_id", "role", "d_hospital", "donor_id", "d_slide", "d_physical", "distance", F.col("rank").cast("long").alias("rank")))


@registered(_then(("pool",), "", "SELECT source_id, role, d_hospital, donor_id, round(distance, 6) AS distance, rank FROM pool WHERE rank <= 16"))
def knn_pool_ranges(spark, sf_dir):
    """The same pools, searched in small cells: as groups of any size are."""
    z = b.bank(spark, sf_dir)
    found = matching.nearest(matching.requests(b.audited(z), b.TARGETS), z, b.FEATURES, 16, size=32)
    return rounded(found.select("source_id", "role", "d_hospital", "donor_id", "distance", F.col("rank").cast("long").alias("rank")))


@registered(_then(("near",), "", """
    SELECT source_id, role, d_hospital, donor_id, round(distance, 6) AS distance FROM near QUALIFY row_number() OVER (PARTITION BY source_id, role, d_hospital ORDER BY distance, donor_id) <= 16"""))
def knn_pool_raw_ties(spark, sf_dir):
    z = b.bank(spark, sf_dir)
    found = matching.nearest(matching.requests(b.audited(z), b.TARGETS), z, b.FEATURES, 16, by_string=False)
    return rounded(found.select("source_id", "role", "d_hospital", "donor_id", "distance"))


@registered(_then(("near",), "", "SELECT source_id, role, d_hospital, donor_id, round(distance, 6) AS distance FROM near WHERE distance <= 0.5"))
def radius_join(spark, sf_dir):
    z = b.bank(spark, sf_dir)
    return rounded(matching.radius_join(matching.requests(b.audited(z), b.TARGETS), z, b.FEATURES, 0.5))


@registered(_then(("z",), "", f"""
    SELECT s.source_id, d.source_id AS donor_id, round({distance('s.', 'd.')}, 6) AS distance FROM z s JOIN z d ON s.slide_id = d.slide_id AND s.label = d.label WHERE s.split = 'val'"""))
def pair_distances(spark, sf_dir):
    """DST-1 within slides and labels."""
    z = b.bank(spark, sf_dir)
    return rounded(features.pair_distances(b.audited(z), z, ["slide_id", "label"], b.FEATURES))


@registered(_then(("z",), "", "SELECT hospital_id, label, split, count(*) AS n FROM z WHERE n_orders <= 12 GROUP BY ALL"))
def group_sizes(spark, sf_dir):
    z = b.bank(spark, sf_dir)
    return matching.group_sizes(z, z.where("n_orders > 12"))


_CAPACITY = """
    , demand AS (SELECT h, sum(n) AS required FROM (SELECT hospital_id AS s, count(*) * 3 AS n FROM z WHERE split = 'val' GROUP BY 1), (VALUES (0), (3), (4)) v(t), (VALUES (0), (1)) e(side),
      LATERAL (SELECT CASE WHEN side = 0 THEN s ELSE t END AS h) WHERE t <> s GROUP BY 1),
    room AS (SELECT hospital_id AS h, least(count(*) * 20, 200000) AS a FROM z GROUP BY hospital_id, slide_id)"""


@registered(_then(("z",), _CAPACITY, """
    SELECT *, required_donor_uses <= available_donor_uses AS feasible FROM (
      SELECT 'hospital' AS scope, r.h AS hospital_id, CAST(coalesce(d.required, 0) AS BIGINT) AS required_donor_uses, CAST(r.a AS BIGINT) AS available_donor_uses
      FROM (SELECT h, sum(a) AS a FROM room GROUP BY 1) r LEFT JOIN demand d ON d.h = r.h
      UNION ALL SELECT 'global', NULL, CAST((SELECT sum(required) FROM demand) AS BIGINT), CAST((SELECT sum(a) FROM room) AS BIGINT))"""))
def reuse_capacity(spark, sf_dir):
    z = b.bank(spark, sf_dir)
    return matching.reuse_capacity(b.audited(z), z, {"val": b.TARGETS}, 3, 20, 200_000)


# --- matching ----------------------------------------------------------------------------------

@registered(_then(("cand",), "", """
    SELECT source_id, target_hospital, count(*) AS n_pairs, round(min(matching_cost), 6) AS least_cost, round(avg(matching_distance_pair), 6) AS mean_pair_distance FROM cand GROUP BY 1, 2"""))
def pair_costs(spark, sf_dir):
    """PAIR-1, per source and target."""
    z = b.bank(spark, sf_dir)
    pools = matching.nearest(matching.requests(b.audited(z), b.TARGETS), z, b.FEATURES, 64)
    pairs = matching.pair_candidates(b.audited(z), pools, b.FEATURES, matching.Rules(), b.TARGETS)
    return rounded(pairs.groupBy("source_id", "target_hospital").agg(F.count("*").alias("n_pairs"), F.min("matching_cost").alias("least_cost"), F.avg("matching_distance_pair").alias("mean_pair_distance")))


@registered(_then(("trip",), "", f"SELECT {TRIPLET} FROM trip"))
def match_triplets(spark, sf_dir):
    return rounded(b.matched(spark, sf_dir)[0])


@registered(_then(("ledger",), "", "SELECT * FROM ledger"))
def match_ledger(spark, sf_dir):
    return b.matched(spark, sf_dir)[1]


CAPPED = matching.Rules(donor_cap=20, slide_cap=200_000)


@registered()
def match_capped(spark, sf_dir):
    """The frozen caps; order-dependent, so no SQL."""
    z = b.bank(spark, sf_dir)
    return allocator.match_capped(b.audited(z), z, b.FEATURES, CAPPED, b.TARGETS)[0]


@registered()
def match_capped_ledger(spark, sf_dir):
    z = b.bank(spark, sf_dir)
    return allocator.match_capped(b.audited(z), z, b.FEATURES, CAPPED, b.TARGETS)[1]


def _side(role: str, order: str, table: str = "near") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY source_id, d_hospital ORDER BY {order}) AS k FROM {table} WHERE role = '{role}' QUALIFY k <= 3)"


def _paired(order_w: str, order_c: str, extra: str = "", more: str = "", table: str = "near") -> str:
    return _then(("near",), more, f"""
        SELECT w.source_id, s.split AS source_split, s.hospital_id AS source_hospital, c.d_hospital AS target_hospital, s.label, w.donor_id AS within_donor, c.donor_id AS cross_donor{extra},
          CAST(w.k - 1 AS INTEGER) AS donor_index
        FROM {_side('within', order_w, table)} w JOIN {_side('cross', order_c, table)} c ON w.source_id = c.source_id AND w.k = c.k JOIN z s ON s.source_id = w.source_id
        QUALIFY count(*) OVER (PARTITION BY w.source_id, c.d_hospital) = 3""")


def _feistel_sql() -> str:
    """The draw at which a request meets the donor at ``place``: the permutation of its key read backwards."""
    steps = ["SELECT *, place // side AS l, place % side AS r FROM placed"]
    for round_ in reversed(range(matching.FEISTEL)):
        f = uniform("2026", "source_id", "role", "d_hospital", str(round_), "l")
        steps.append(f"SELECT * REPLACE (xor(r, CAST(floor({f} * side) AS BIGINT)) AS l, l AS r) FROM ({steps[-1]})")
    return steps[-1]


_DRAWN = f"""
    , numbered AS (SELECT source_id AS donor_id, hospital_id AS d_hospital, label, split AS d_split, row_number() OVER (PARTITION BY hospital_id, label, split ORDER BY {hashed('2026', 'source_id')}, source_id) - 1 AS place,
      CAST(pow(2, (length(bin(count(*) OVER (PARTITION BY hospital_id, label, split) - 1)) + 1) // 2) AS BIGINT) AS side FROM z),
    placed AS (SELECT source_id, role, d_hospital, donor_id, place, side FROM near JOIN numbered USING (d_hospital, donor_id)),
    drawn AS MATERIALIZED (SELECT *, l * side + r AS j FROM ({_feistel_sql()}))"""


@registered(_paired("j", "j", more=_DRAWN, table="drawn"))
def match_random(spark, sf_dir):
    z = b.bank(spark, sf_dir)
    return matching.random_pairs(b.audited(z), z, b.TARGETS, 3, 2026)


@registered(_paired("distance, donor_id", "distance, donor_id", ", round(w.distance, 6) AS matching_distance_within, round(c.distance, 6) AS matching_distance_cross"))
def match_nearest(spark, sf_dir):
    z = b.bank(spark, sf_dir)
    return rounded(matching.independent_nearest(b.audited(z), z, b.FEATURES, b.TARGETS, 3))


@registered(_then(("trip",), "", "SELECT triplet_id, source_id AS within_donor, source_slide AS within_slide, source_physical_id AS within_physical_id, cross_donor, 0.0::DOUBLE AS matching_distance_within FROM trip"))
def match_identity(spark, sf_dir):
    own = matching.identity_level(b.matched(spark, sf_dir)[0])
    return own.select("triplet_id", "within_donor", "within_slide", "within_physical_id", "cross_donor", "matching_distance_within")


@registered("SELECT 5 AS level, 'not_implemented' AS status, 'matching policy is not implemented' AS reason UNION ALL SELECT 6, 'unavailable', 'missing columns: stain'")
def match_level_status(spark, sf_dir):
    return matching.level_status(spark, 5, ["f1"], ["f1"]).unionByName(matching.level_status(spark, 6, ["f1"], ["stain"]))


# --- diagnostics --------------------------------------------------------------------------------

def _support(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    triplets, ledger = b.matched(spark, sf_dir)
    return triplets, diagnostics.annotate_common_support(ledger)


_COVERAGE = f"SELECT {PAIR}, count(*) AS n_sources, count(*) FILTER (coverage_status = 'accepted') AS n_accepted, round(avg(CAST(coverage_status = 'accepted' AS INTEGER)), 6) AS coverage FROM ledger GROUP BY ALL"


@registered(_then(("ledger",), "", _COVERAGE))
def coverage_directed(spark, sf_dir):
    return rounded(diagnostics.directed_coverage(b.matched(spark, sf_dir)[1]))


@registered(_then(("support",), "", "SELECT * FROM support"))
def coverage_annotated(spark, sf_dir):
    return _support(spark, sf_dir)[1]


@registered(_then(("support",), "", """
    SELECT source_split, source_hospital, count(*) AS n_sources, count(*) FILTER (common_support) AS n_common_support, round(avg(CAST(common_support AS INTEGER)), 6) AS coverage
    FROM (SELECT DISTINCT source_split, source_hospital, source_id, common_support FROM support) GROUP BY ALL"""))
def coverage_common_support(spark, sf_dir):
    return rounded(diagnostics.common_support_coverage(_support(spark, sf_dir)[1]))


@registered(_then(("ledger",), "", f"SELECT {PAIR}, coalesce(exclusion_reason, 'accepted') AS exclusion_reason, count(*) AS n FROM ledger GROUP BY ALL"))
def attrition(spark, sf_dir):
    return diagnostics.attrition(b.matched(spark, sf_dir)[1])


@registered(_then(("trip", "support"), "", "SELECT triplet_id, common_support FROM trip JOIN support USING (source_id, target_hospital)"))
def triplets_common_support(spark, sf_dir):
    t, l = _support(spark, sf_dir)
    return diagnostics.stamp_common_support(t, l).select("triplet_id", "common_support")


_BALANCE = f"""
    , balance AS (SELECT {PAIR}, count(*) AS n_triplets, avg(matching_distance_within) AS within_mean, avg(matching_distance_cross) AS cross_mean, median(matching_distance_within) AS within_median,
      median(matching_distance_cross) AS cross_median, avg(matching_distance_cross - matching_distance_within) AS mean_paired_difference, avg(matching_distance_pair) AS mean_pair_distance FROM trip GROUP BY ALL),
    pooled AS (SELECT {PAIR}, stddev_samp(d) AS s FROM (SELECT {PAIR}, matching_distance_within AS d FROM trip UNION ALL SELECT {PAIR}, matching_distance_cross FROM trip) GROUP BY ALL)"""
_BALANCE_ROWS = f"""SELECT {PAIR}, n_triplets, {rounds('within_mean', 'cross_mean', 'within_median', 'cross_median', 'mean_paired_difference', 'mean_pair_distance')},
    round((cross_mean - within_mean) / s, 6) AS paired_smd FROM balance JOIN pooled USING ({PAIR})"""


@registered(_then(("trip",), _BALANCE, _BALANCE_ROWS))
def balance_distances(spark, sf_dir):
    return rounded(diagnostics.balance_summary(b.matched(spark, sf_dir)[0]))


_FEATURE_ROWS = " UNION ALL ".join(
    f"SELECT {PAIR}, '{c}' AS feature, w.{c} AS w, x.{c} AS c, s_{c} AS train_scale FROM trip JOIN z w ON w.source_id = within_donor JOIN z x ON x.source_id = cross_donor, fit" for c in b.FEATURES)
_FEATURE_BALANCE = f"""SELECT {PAIR}, feature, count(*) AS n_pairs, round(avg(w), 6) AS within_mean, round(avg(c), 6) AS cross_mean, round(median(w), 6) AS within_median, round(median(c), 6) AS cross_median,
    round(avg(c - w), 6) AS paired_mean_difference, round(train_scale, 6) AS train_scale, round(avg(c - w) / train_scale, 6) AS paired_smd, 'estimable' AS paired_smd_status
    FROM ({_FEATURE_ROWS}) GROUP BY {PAIR}, feature, train_scale"""


@registered(_then(("trip", "z", "fit"), "", _FEATURE_BALANCE))
def balance_features(spark, sf_dir):
    d = b.descriptors(spark, sf_dir)
    return rounded(diagnostics.feature_balance(b.matched(spark, sf_dir)[0], d, b.FEATURES, features.fit_standardizer(d, b.FEATURES)))


_DETAIL = """
    , detail AS (SELECT donor_id, slide, count(*) FILTER (kind = 'within') AS w, count(*) FILTER (kind = 'cross') AS c, count(*) AS t FROM uses GROUP BY ALL)"""
_STATS = {"min": "min(t)", "median": "median(t)", "p90": "quantile_cont(t, 0.9)", "p95": "quantile_cont(t, 0.95)", "p99": "quantile_cont(t, 0.99)", "max": "max(t)"}


@registered(_then(("uses", "z"), _DETAIL, """
    SELECT 'donor' AS row_type, donor_id AS donor_source_id, slide, w AS within_reuse, c AS cross_reuse, CAST(t AS DOUBLE) AS total_reuse, hospital_id AS hospital, label, NULL AS statistic
    FROM detail JOIN z ON z.source_id = donor_id """ + " ".join(f"UNION ALL SELECT 'summary', NULL, NULL, NULL, NULL, round(CAST({f} AS DOUBLE), 6), NULL, NULL, '{n}' FROM detail" for n, f in _STATS.items())))
def donor_reuse(spark, sf_dir):
    return rounded(diagnostics.donor_reuse_summary(b.matched(spark, sf_dir)[0], b.descriptors(spark, sf_dir)))


@registered(_then(("uses", "z"), f"""
    , d AS (SELECT {PAIR}, hospital_id AS hospital, slide, count(*) FILTER (kind = 'within') AS w, count(*) FILTER (kind = 'cross') AS c, count(*) AS t FROM uses JOIN z ON z.source_id = donor_id GROUP BY ALL),
    e AS (SELECT *, t / sum(t) OVER (PARTITION BY {PAIR}) AS f FROM d)""", f"""
    SELECT {PAIR}, hospital, slide, w AS within_uses, c AS cross_uses, t AS total_donor_uses, round(f, 6) AS directed_pair_fraction, 'slide' AS row_type,
      CAST(NULL AS BIGINT) AS unique_donor_slides, CAST(NULL AS DOUBLE) AS effective_donor_slide_count, CAST(NULL AS DOUBLE) AS maximum_slide_share FROM e
    UNION ALL SELECT {PAIR}, NULL, NULL, NULL, NULL, CAST(sum(t) AS BIGINT), NULL, 'summary', count(*), round(1 / sum(f * f), 6), round(max(f), 6) FROM e GROUP BY {PAIR}"""))
def slide_reuse(spark, sf_dir):
    return rounded(diagnostics.slide_reuse_summary(b.matched(spark, sf_dir)[0], b.descriptors(spark, sf_dir)))


@registered(_then(("uses", "z"), _DETAIL, "SELECT donor_id, hospital_id AS donor_hospital, slide AS donor_slide, label AS donor_label, w AS within_uses, c AS cross_uses, t AS total_uses FROM detail JOIN z ON z.source_id = donor_id"))
def donor_reuse_detail(spark, sf_dir):
    return diagnostics.donor_reuse_detail(b.matched(spark, sf_dir)[0], b.descriptors(spark, sf_dir))


@registered(_then(("uses",), _DETAIL, "SELECT count(*) AS n_unique_donors, " + ", ".join(f"round(CAST({f} AS DOUBLE), 6) AS {n}" for n, f in _STATS.items() if n != "min") + " FROM detail"))
def donor_reuse_distribution(spark, sf_dir):
    return rounded(diagnostics.donor_reuse_distribution(b.matched(spark, sf_dir)[0], b.descriptors(spark, sf_dir)))


_SLIDES = """
    , slides AS (SELECT hospital_id AS hospital, slide AS slide_id, count(*) FILTER (kind = 'within') AS w, count(*) FILTER (kind = 'cross') AS c, count(*) AS t FROM uses JOIN z ON z.source_id = donor_id GROUP BY ALL)"""


@registered(_then(("uses", "z"), _SLIDES, "SELECT hospital, slide_id, w AS within_uses, c AS cross_uses, t AS total_uses, round(t / (SELECT sum(t) FROM slides), 6) AS share_of_all_donor_uses FROM slides"))
def slide_reuse_detail(spark, sf_dir):
    return rounded(diagnostics.slide_reuse_detail(b.matched(spark, sf_dir)[0], b.descriptors(spark, sf_dir)))


@registered(_then(("uses", "z"), _SLIDES, "SELECT count(*) AS n_unique_slides, " + ", ".join(f"round(CAST({f} AS DOUBLE), 6) AS {n}" for n, f in _STATS.items() if n != "min") + ", round(max(t) / sum(t), 6) AS maximum_slide_share FROM slides"))
def slide_reuse_distribution(spark, sf_dir):
    return rounded(diagnostics.slide_reuse_distribution(b.matched(spark, sf_dir)[0], b.descriptors(spark, sf_dir)))


@registered(_then(("ledger",), "", f"SELECT 'directed_coverage' AS \"check\", min(coverage) AS observed, 0.9::DOUBLE AS threshold, min(coverage) >= 0.9 AS passed FROM ({_COVERAGE})"))
def gate_coverage(spark, sf_dir):
    return rounded(diagnostics.coverage_gate(coverage_directed(spark, sf_dir)))


@registered(_then(("trip", "support", "uses", "z", "fit"), _BALANCE + _DETAIL + f"""
    , checks AS (SELECT 'finite_descriptors' AS "check", 1.0::DOUBLE AS observed, 1.0::DOUBLE AS threshold, TRUE AS passed
    UNION ALL SELECT 'directed_coverage', min(coverage), 0.9, min(coverage) >= 0.9 FROM ({_COVERAGE})
    UNION ALL SELECT 'expected_hospital_pairs', abs(count(*) - 3), 0, count(*) = 3 FROM (SELECT DISTINCT {PAIR} FROM ledger)
    UNION ALL SELECT 'common_support_coverage', avg(CAST(s AS INTEGER)), 0.9, avg(CAST(s AS INTEGER)) >= 0.9 FROM (SELECT source_id, bool_and(common_support) AS s FROM support GROUP BY 1)
    UNION ALL SELECT 'aggregate_matching_smd', sum(abs((cross_mean - within_mean) / s) * n_triplets) / sum(n_triplets), 0.1, sum(abs((cross_mean - within_mean) / s) * n_triplets) / sum(n_triplets) <= 0.1
      FROM balance JOIN pooled USING ({PAIR})
    UNION ALL SELECT 'per_feature_balance', max(abs(paired_smd)), 0.1, max(abs(paired_smd)) <= 0.1 FROM ({_FEATURE_BALANCE})
    UNION ALL SELECT 'donor_reuse_cap', max(t), 20, max(t) <= 20 FROM detail)""",
    "SELECT \"check\", round(observed, 5) AS observed, threshold, passed FROM checks UNION ALL SELECT 'overall', NULL, NULL, bool_and(passed) FROM checks"))
def gate_preflight(spark, sf_dir):
    d = b.descriptors(spark, sf_dir)
    t, l = _support(spark, sf_dir)
    found = diagnostics.preflight(
        d, b.FEATURES, diagnostics.directed_coverage(l), diagnostics.common_support_coverage(l), diagnostics.balance_summary(t),
        diagnostics.feature_balance(t, d, b.FEATURES, features.fit_standardizer(d, b.FEATURES)), diagnostics.donor_reuse_detail(t, d), [("val", 1, x) for x in b.TARGETS])
    return rounded(found, 5)


@registered(f"""WITH wanted AS (SELECT '/slides/Patient_' || n_nationkey || '_Node_' || (n_nationkey % 3) || '.' || kind AS path FROM nation, (VALUES ('tif'), ('xml')) v(kind)) {_FILES}
    , checks AS (SELECT 'required_file:' || w.path AS "check", CASE WHEN f.path IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS observed, 1.0::DOUBLE AS threshold, f.path IS NOT NULL AS passed
      FROM wanted w LEFT JOIN files f ON f.path = w.path
      UNION ALL SELECT * FROM (VALUES ('protocol_hash', 1.0::DOUBLE, 1.0::DOUBLE, TRUE), ('git_clean', 0.0, 1.0, FALSE), ('unit_tests', 1.0, 1.0, TRUE)) v("check", observed, threshold, passed))
    SELECT * FROM checks UNION ALL SELECT 'overall', NULL, NULL, FALSE""")
def gate_files(spark, sf_dir):
    """GATE-2's other checks: files of all slides, of which some are absent, the protocol's hash, a commit that isn't clean, a marker of tests."""
    n = b.table(spark, sf_dir, "nation")
    stem = F.format_string("/slides/Patient_%d_Node_%d", F.col("n_nationkey"), F.col("n_nationkey") % 3)
    wanted = n.select(F.explode(F.array(F.concat(stem, F.lit(".tif")), F.concat(stem, F.lit(".xml")))).alias("path"))
    state = diagnostics.recorded_state(spark, "h0", "h0", "c0", True, {"unit_tests": "PASS"})
    return diagnostics.gated(diagnostics.required_files(wanted, b.files(spark, sf_dir)), state)


def _with_test(sql: str) -> str:
    """The steps with sources of both audited splits."""
    return sql.replace("split = 'val'", "split IN ('val', 'test')")


def _merged(spark, sf_dir) -> dict[str, DataFrame]:
    """The diagnostics of the matching of ``val`` with that of ``test`` merged into it."""
    z = b.bank(spark, sf_dir)
    parts = []
    for split in ("val", "test"):
        triplets, ledger = matching.match(b.audited(z, split), z, b.FEATURES, matching.Rules(), b.TARGETS)
        parts.append(merging.Matching(stored(triplets, "triplets"), stored(ledger, "ledger")))
    return merging.recomputed(merging.merged(*parts), z, b.FEATURES, features.validated(features.fit_standardizer(z, b.FEATURES), b.FEATURES))


@registered(_with_test(_then(("ledger",), "", _COVERAGE)))
def merged_coverage(spark, sf_dir):
    """MRG-1: directed coverage after the merge."""
    return rounded(_merged(spark, sf_dir)["directed_coverage"])


@registered(_with_test(_then(("trip", "support", "uses", "z", "fit"), f"""
    , checks AS (SELECT 'directed_coverage' AS "check", min(coverage) AS observed, 0.9::DOUBLE AS threshold, min(coverage) >= 0.9 AS passed FROM ({_COVERAGE}) WHERE source_split = 'test'
    UNION ALL SELECT 'common_support_coverage', min(c), 0.9, min(c) >= 0.9 FROM (SELECT source_hospital, avg(CAST(s AS INTEGER)) AS c FROM (
      SELECT source_hospital, source_id, bool_and(common_support) AS s FROM support WHERE source_split = 'test' GROUP BY 1, 2) GROUP BY 1)
    UNION ALL SELECT 'per_feature_abs_smd', max(abs(paired_smd)), 0.1, max(abs(paired_smd)) <= 0.1 FROM ({_FEATURE_BALANCE}) WHERE source_split = 'test'
    UNION ALL SELECT 'donor_reuse_cap', max(t), 20, max(t) <= 20 FROM (SELECT count(*) AS t FROM uses GROUP BY donor_id, slide))""",
    "SELECT \"check\", round(observed, 5) AS observed, threshold, passed FROM checks UNION ALL SELECT 'overall', NULL, NULL, bool_and(passed) FROM checks")))
def merge_check(spark, sf_dir):
    """MRG-1: what the merged matching must keep."""
    return rounded(merging.final_check(_merged(spark, sf_dir)), 5)


# --- sampling and controls ----------------------------------------------------------------------

_ELIGIBLE = "SELECT DISTINCT source_id, source_split, source_hospital, source_slide, source_physical_id, label FROM trip WHERE source_split = 'val'"


@registered(_then(("trip",), "", _ELIGIBLE))
def subset_eligible(spark, sf_dir):
    return sampling.eligible_sources(b.matched(spark, sf_dir)[0], "val")


def _quota(cells: str, keys: str, weight: str, total: str) -> str:
    return f"""(SELECT *, CAST(floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, {keys}) <= {total} - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota
      FROM (SELECT *, round({weight} * {total} / sum({weight}) OVER (), 9) AS e FROM {cells}))"""


@registered(_then(("trip",), f", el AS ({_ELIGIBLE}), cells AS (SELECT label, source_slide, count(*) AS n FROM el GROUP BY 1, 2), q AS {_quota('cells', 'label, source_slide', 'n', 'least(10000, (SELECT sum(n) FROM cells))')}", f"""
    SELECT el.* FROM el JOIN q USING (label, source_slide) QUALIFY row_number() OVER (PARTITION BY label, source_slide ORDER BY {hashed('2026', 'source_id')}, source_id) <= quota"""))
def subset_sample(spark, sf_dir):
    return sampling.audit_subset(sampling.eligible_sources(b.matched(spark, sf_dir)[0], "val"), 10000, 2026)


@registered(_then(("trip",), f", el AS ({_ELIGIBLE}), cells AS (SELECT label, source_slide, count(*) AS n FROM el GROUP BY 1, 2), q AS {_quota('cells', 'label, source_slide', 'n', 'least(100, (SELECT sum(n) FROM cells))')}", f"""
    SELECT el.* FROM el JOIN q USING (label, source_slide) QUALIFY row_number() OVER (PARTITION BY label, source_slide ORDER BY {hashed('2026', 'source_id')}, source_id) <= quota"""))
def subset_sample_small(spark, sf_dir):
    """SUB-2 where there are more sources than wanted: quotas and the draw decide."""
    return sampling.audit_subset(sampling.eligible_sources(b.matched(spark, sf_dir)[0], "val"), 100, 2026)


@registered(_then(("z",), f", cells AS (SELECT hospital_id, label, count(*) AS available FROM z WHERE split = 'train' GROUP BY 1, 2), q AS {_quota('cells', 'hospital_id, label', 'available', '1000')}",
                  "SELECT hospital_id, label, available, quota FROM q"))
def quota_cells(spark, sf_dir):
    return sampling.cell_quotas(b.bank(spark, sf_dir).where("split = 'train'"), 1000)


@registered(_then(("meta",), f""", a AS (SELECT source_id, hospital_id, label, row_number() OVER (PARTITION BY hospital_id ORDER BY source_id) AS r FROM meta),
    p AS (SELECT hospital_id, label AS permuted_label, row_number() OVER (PARTITION BY hospital_id ORDER BY {hashed('7', 'source_id')}, source_id) AS r FROM meta)""",
    "SELECT source_id, hospital_id, label, permuted_label FROM a JOIN p USING (hospital_id, r)"))
def permuted_in_strata(spark, sf_dir):
    m = b.metadata(spark, sf_dir).select("source_id", "hospital_id", "label")
    return sampling.permuted(m, "label", 7, strata=["hospital_id"])


@registered(_then(("meta",), f""", a AS (SELECT source_id, label, row_number() OVER (ORDER BY source_id) AS r FROM meta),
    p AS (SELECT label AS permuted_label, row_number() OVER (ORDER BY {hashed('7', 'source_id')}, source_id) AS r FROM meta)""", "SELECT source_id, label, permuted_label FROM a JOIN p USING (r)"))
def permuted_all(spark, sf_dir):
    return sampling.permuted(b.metadata(spark, sf_dir).select("source_id", "label"), "label", 7)


@registered(_then(("img",), "", f"""
    SELECT source_id, planted, list_transform(px, lambda v, i: CASE WHEN planted AND (i - 1) % 8 < 2 AND i - 1 < 16 THEN CASE WHEN label > 0 THEN 255.0 ELSE 0.0 END ELSE v END) AS pixels
    FROM (SELECT *, {uniform('5', 'source_id')} <= 0.5 AS planted FROM img)"""))
def planted_cue(spark, sf_dir):
    return sampling.corner_cue(b.images(spark, sf_dir), 0.5, b.SIDE, b.ROI, 2, 5).select("source_id", "planted", "pixels")


@registered()
def context_assignments(spark, sf_dir):
    z = b.bank(spark, sf_dir)
    return sampling.independent_assignments(b.audited(z), z.where("split = 'train'"), 11, 2)


@registered(_then(("z",), "", """
    SELECT label AS source_label, count(*) AS n_sources, count(*) AS n_assigned, TRUE AS once, TRUE AS independent, TRUE AS within_cap, TRUE AS from_bank FROM z WHERE split = 'val' GROUP BY 1"""))
def context_invariants(spark, sf_dir):
    """ASG-1: what must hold of any assignment, checked by joins with the tables it was made from."""
    z = b.bank(spark, sf_dir)
    made = stored(sampling.independent_assignments(b.audited(z), z.where("split = 'train'"), 11, 2), "assignments")
    uses = made.groupBy("donor_source_id").agg(F.count("*").alias("uses"))
    own = b.audited(z).select("source_id", F.col("label").alias("source_label"), F.col("physical_id").alias("own"))
    donors = z.where("split = 'train'").select(F.col("source_id").alias("donor_source_id"), F.col("physical_id").alias("theirs"))
    got = own.join(made.drop("source_label"), "source_id", "left").join(uses, "donor_source_id", "left").join(donors, "donor_source_id", "left")
    return got.groupBy("source_label").agg(
        F.count_distinct("source_id").alias("n_sources"), F.count("donor_source_id").alias("n_assigned"), (F.count("*") == F.count_distinct("source_id")).alias("once"),
        F.bool_and((F.col("own") != F.col("theirs")) & (F.col("source_id") != F.col("donor_source_id"))).alias("independent"), F.bool_and(F.col("uses") <= 2).alias("within_cap"),
        F.bool_and(F.col("theirs").isNotNull()).alias("from_bank"))


@registered()
def context_diagnostics(spark, sf_dir):
    return sampling.assignment_diagnostics(context_assignments(spark, sf_dir))


@registered("SELECT * FROM (VALUES ('assignment_quota_preparation', 'completed', 'joint-cell quotas are written'), ('control_training', 'unavailable', 'training is outside this engine'), "
            "('control_audit', 'implemented', 'uses the audit of the primary runs')) v(stage, status, reason)")
def control_status(spark, sf_dir):
    return sampling.control_status(spark, "context_randomized")


# --- images --------------------------------------------------------------------------------------

def _in(i: str, lo: int, hi: int) -> str:
    """Whether 1-based pixel ``i`` of an 8 x 8 image lies in rows and columns lo..hi-1."""
    return f"(({i} - 1) // 8 >= {lo} AND ({i} - 1) // 8 < {hi} AND ({i} - 1) % 8 >= {lo} AND ({i} - 1) % 8 < {hi})"


@registered(_then(("img",), "", f"SELECT source_id, list_transform(px, lambda v, i: CASE WHEN {_in('i', 2, 6)} THEN v ELSE 0.0 END) AS pixels FROM img"))
def image_roi_only(spark, sf_dir):
    return b.images(spark, sf_dir).select("source_id", arrays.roi_only(F.col("pixels"), b.SIDE, b.ROI).alias("pixels"))


@registered("SELECT i AS pixel, (i // 8 BETWEEN 1 AND 6) AND (i % 8 BETWEEN 1 AND 6) AS protected, round(28.0 / 48.0, 6) AS area_ratio FROM range(64) t(i)")
def image_protected(spark, sf_dir):
    """ROI-2, ROI-4: a buffer of 1 around the region."""
    ratio = round(arrays.area_ratio(b.SIDE, b.ROI, 1), 6)
    return spark.range(64).select(F.col("id").alias("pixel"), arrays.is_protected(F.col("id"), b.SIDE, b.ROI, 1).alias("protected"), F.lit(ratio).alias("area_ratio"))


_ALPHA = """
    , alpha AS (SELECT i, CASE WHEN d = 0 THEN 1.0 WHEN d < 2 THEN 0.5 * (1 + cos(pi() * d / 2)) ELSE 0.0 END AS a
      FROM (SELECT i, greatest(1 - y, y - 6, 1 - x, x - 6, 0) AS d FROM (SELECT i, i // 8 AS y, i % 8 AS x FROM range(64) t(i)))),
    mixed AS (SELECT source_id, i, CASE WHEN i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5 THEN px[i + 1] ELSE a * px[i + 1] + (1 - a) * donor[i + 1] END AS v, px[i + 1] AS s FROM imgp, alpha)"""


@registered("SELECT pixel, round(CASE WHEN d = 0 THEN 1.0 WHEN d < 2 THEN 0.5 * (1 + cos(pi() * d / 2)) ELSE 0.0 END, 6) AS alpha FROM (SELECT i AS pixel, greatest(1 - i // 8, i // 8 - 6, 1 - i % 8, i % 8 - 6, 0) AS d FROM range(64) t(i))")
def image_alpha(spark, sf_dir):
    a = F.posexplode(arrays.alpha_column(b.SIDE, b.ROI, 1, 2)).alias("pixel", "alpha")
    return rounded(spark.range(1).select(a).select(F.col("pixel").cast("long").alias("pixel"), "alpha"))


def _composites(spark, sf_dir) -> DataFrame:
    return b.image_pairs(spark, sf_dir).withColumn("composite", arrays.transplant(F.col("pixels"), F.col("donor"), b.SIDE, b.ROI, 1, 2))


@registered(_then(("imgp",), _ALPHA, "SELECT source_id, list(round(v, 6) ORDER BY i) AS composite FROM mixed GROUP BY 1"))
def image_transplant(spark, sf_dir):
    return _composites(spark, sf_dir).select("source_id", F.transform("composite", lambda v: signed_round(v)).alias("composite"))


@registered(_then(("imgp",), _ALPHA, """
    SELECT source_id, round(max(abs(v - s)) FILTER (r), 6) AS max_roi_difference, round(avg(abs(v - s)) FILTER (r), 6) AS mean_roi_difference, bool_and(v = s OR NOT r) AS roi_equal,
      CASE WHEN bool_and(v = s OR NOT r) THEN 1.0::DOUBLE END AS roi_ssim FROM (SELECT *, i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5 AS r FROM mixed) GROUP BY 1"""))
def image_roi_checks(spark, sf_dir):
    made = _composites(spark, sf_dir)
    checks = arrays.roi_metrics(F.col("pixels"), F.col("composite"), b.SIDE, b.ROI)
    return rounded(made.select("source_id", *[c.alias(n) for n, c in checks.items()]))


@registered(_then(("imgp",), "", f"""
    SELECT source_id, round(abs(list_avg(list_filter(px, lambda v, i: {_in('i', 2, 6)} AND NOT {_in('i', 3, 5)}))
      - list_avg(list_filter(px, lambda v, i: NOT {_in('i', 2, 6)} AND (((i - 1) // 8 BETWEEN 1 AND 6 AND (i - 1) % 8 BETWEEN 2 AND 5) OR ((i - 1) // 8 BETWEEN 2 AND 5 AND (i - 1) % 8 BETWEEN 1 AND 6))))), 6) AS jump FROM imgp"""))
def image_boundary_jump(spark, sf_dir):
    return rounded(b.image_pairs(spark, sf_dir).select("source_id", arrays.boundary_jump(F.col("pixels"), b.SIDE, b.ROI).alias("jump")))


@registered(_then(("imgp",), "", """
    SELECT source_id, round(2 * n / greatest(a + c, 1), 6) AS dice, round(n / greatest(a + c - n, 1), 6) AS jaccard
    FROM (SELECT source_id, len(list_filter(px, lambda v: v > 0)) AS a, len(list_filter(donor, lambda v: v > 0)) AS c, len(list_filter(list_zip(px, donor), lambda p: p[1] > 0 AND p[2] > 0)) AS n FROM imgp)"""))
def mask_overlap(spark, sf_dir):
    masks = b.image_pairs(spark, sf_dir).select("source_id", arrays.mask_of(F.col("pixels")).alias("a"), arrays.mask_of(F.col("donor")).alias("c"))
    return rounded(masks.select("source_id", *[x.alias(n) for n, x in arrays.overlap(F.col("a"), F.col("c")).items()]))


def _share_sql(name: str, r: tuple[int, int], c: tuple[int, int]) -> str:
    return f"round(count(*) FILTER (v > 0 AND i // 8 >= {r[0]} AND i // 8 < {r[1]} AND i % 8 >= {c[0]} AND i % 8 < {c[1]}) / {(r[1] - r[0]) * (c[1] - c[0])}.0, 6) AS {name}"


_HALVES, _THIRDS = [(0, 4), (4, 8)], [(0, 2), (2, 5), (5, 8)]
_SHARES = ", ".join([_share_sql(f"quadrant_{2 * r + c}", _HALVES[r], _HALVES[c]) for r in range(2) for c in range(2)] + [_share_sql(f"grid_{3 * r + c}", _THIRDS[r], _THIRDS[c]) for r in range(3) for c in range(3)])


@registered(_then(("img",), "", f"""
    SELECT source_id, round(count(*) FILTER (v > 0) / 64.0, 6) AS tissue_fraction, round(coalesce(avg(i % 8) FILTER (v > 0) / 8, -1), 6) AS centroid_x, round(coalesce(avg(i // 8) FILTER (v > 0) / 8, -1), 6) AS centroid_y,
      CAST(count(*) FILTER (v > 0) = 0 AS DOUBLE) AS empty_mask, {_SHARES} FROM (SELECT source_id, i, px[i + 1] AS v FROM img, range(64) t(i)) GROUP BY 1"""))
def mask_shares(spark, sf_dir):
    masks = b.images(spark, sf_dir).select("source_id", arrays.mask_of(F.col("pixels")).alias("mask"))
    return rounded(masks.select("source_id", *[x.alias(n) for n, x in arrays.mask_shares(F.col("mask"), b.SIDE).items()]))


def _beside(a: str, dy: int, dx: int, side: int, outside: str) -> str:
    """List ``a`` at 1-based pixel i moved by (dy, dx)."""
    return f"CASE WHEN (i - 1) // {side} + {dy} BETWEEN 0 AND {side - 1} AND (i - 1) % {side} + {dx} BETWEEN 0 AND {side - 1} THEN {a}[i + {dy * side + dx}] ELSE {outside} END"


def _labelled(of: str, name: str, side: int, near) -> str:
    """(id, m) to (id, l): each pixel of a mask takes the largest number near it until no list changes."""
    spread = ", ".join(_beside("l", y, x, side, "0") for y, x in near)
    return f"""
    , {name}_p AS (SELECT id, list_transform(m, lambda v, i: CASE WHEN v THEN i ELSE 0 END) AS l, FALSE AS same FROM {of}
      UNION ALL SELECT id, n, n = l FROM (SELECT id, l, list_transform(l, lambda v, i: CASE WHEN v = 0 THEN 0 ELSE greatest(v, {spread}) END) AS n FROM {name}_p WHERE NOT same)),
    {name} AS (SELECT id, l FROM {name}_p WHERE same)"""


def _recursive(steps: tuple[str, ...], more: str, query: str) -> str:
    return _then(steps, more, query).replace("WITH", "WITH RECURSIVE", 1)


_ALL_NEAR = [*imaging.AXES, *imaging.CORNERS]
_SIX = lambda x, name: f"round({x}, 6) AS {name}"
_CODE = f"1 + 2 * ({' + '.join(_beside('b', y, x, 8, '0') for y, x in imaging.AXES)}) + 10 * ({' + '.join(_beside('b', y, x, 8, '0') for y, x in imaging.CORNERS)})"


@registered(_recursive(("img",), f"""
    , msk AS (SELECT source_id AS id, list_transform(px, lambda v: v > 0) AS m FROM img)""" + _labelled("msk", "lab", 8, _ALL_NEAR) + f"""
    , cell AS (SELECT id, i // 8 AS y, i % 8 AS x, l[i + 1] AS k FROM lab, range(64) t(i) WHERE l[i + 1] > 0),
    part AS (SELECT id, count(*) AS n, var_pop(y) + 1.0 / 12 AS yy, var_pop(x) + 1.0 / 12 AS xx, covar_pop(x, y) AS xy FROM cell GROUP BY id, k),
    ell AS (SELECT id, n, (yy + xx) / 2 AS c, sqrt((yy - xx) * (yy - xx) + 4 * xy * xy) / 2 AS h FROM part),
    areas AS (SELECT id, count(*) AS parts, sum(n) AS a, avg(n) AS mean, stddev_pop(n) AS sd, max(n) AS most, sum(n * sqrt(greatest(0, 1 - (c - h) / (c + h)))) / sum(n) AS ecc FROM ell GROUP BY id),
    rim AS (SELECT id, list_transform(m, lambda v, i: CASE WHEN v AND NOT ({' AND '.join(_beside('m', y, x, 8, 'FALSE') for y, x in imaging.AXES)}) THEN 1 ELSE 0 END) AS b FROM msk),
    len AS (SELECT id, list_sum(list_transform(b, lambda v, i: CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE CASE {_CODE} {' '.join(f'WHEN {k} THEN {w!r}::DOUBLE' for k, w in imaging.WEIGHTS.items())} ELSE 0.0 END END)) AS rim FROM rim),
    shares AS (SELECT source_id, round(count(*) FILTER (v > 0) / 64.0, 6) AS tissue_fraction, round(coalesce(avg(i % 8) FILTER (v > 0) / 8, -1), 6) AS centroid_x, round(coalesce(avg(i // 8) FILTER (v > 0) / 8, -1), 6) AS centroid_y,
      CAST(count(*) FILTER (v > 0) = 0 AS DOUBLE) AS empty_mask, {_SHARES} FROM (SELECT source_id, i, px[i + 1] AS v FROM img, range(64) t(i)) GROUP BY 1)""", f"""
    SELECT shares.*, coalesce(parts, 0)::DOUBLE AS component_count, {_SIX('coalesce(mean, 0) / 64', 'area_mean')}, {_SIX('coalesce(sd, 0) / 64', 'area_std')}, {_SIX('coalesce(most, 0)::DOUBLE / 64', 'area_max')},
      {_SIX('rim / 32', 'normalized_perimeter')}, {_SIX('4 * pi() * coalesce(a, 0) / greatest(rim * rim, 1)', 'compactness')}, {_SIX('coalesce(ecc, -1)', 'eccentricity')}
    FROM shares JOIN len ON len.id = source_id LEFT JOIN areas ON areas.id = source_id"""))
def mask_descriptors(spark, sf_dir):
    return rounded(imaging.mask_descriptors(b.images(spark, sf_dir).withColumn("mask", arrays.mask_of(F.col("pixels"))), b.SIDE))


def _at(dy: int, dx: int) -> str:
    """The pixel beside 1-based pixel i of an 8 x 8 image, edges reflected."""
    return f"px[least(greatest((i - 1) // 8 + {dy}, 0), 7) * 8 + least(greatest((i - 1) % 8 + {dx}, 0), 7) + 1]"


_GRADIENT = (
    f"sqrt((pow(({_at(-1, 1)} + 2 * {_at(0, 1)} + {_at(1, 1)} - {_at(-1, -1)} - 2 * {_at(0, -1)} - {_at(1, -1)}) / 8, 2) + "
    f"pow(({_at(1, -1)} + 2 * {_at(1, 0)} + {_at(1, 1)} - {_at(-1, -1)} - 2 * {_at(-1, 0)} - {_at(-1, 1)}) / 8, 2)) / 2)")


@registered(_then(("img",), f"""
    , g AS (SELECT source_id, i, px[i] AS v, {_GRADIENT} AS g, {_in('i', 1, 7)} AND NOT {_in('i', 2, 6)} AS inner_, NOT {_in('i', 1, 7)} AND ((i - 1) // 8 BETWEEN 1 AND 6 OR (i - 1) % 8 BETWEEN 1 AND 6) AS outer_
      FROM img, range(1, 65) r(i))""", """
    SELECT source_id, round(avg(g) FILTER (outer_), 6) AS seam_gradient, round(abs(avg(v) FILTER (inner_) - avg(v) FILTER (outer_)), 6) AS cross_boundary_intensity_jump,
      round(avg(g) FILTER (inner_ OR outer_), 6) AS edge_magnitude FROM g GROUP BY 1"""))
def image_seams(spark, sf_dir):
    """QA-2 around the protected square and one pixel more."""
    return rounded(arrays.seam_metrics(b.images(spark, sf_dir), b.SIDE, b.ROI, 1))


def _colour(spark, sf_dir) -> DataFrame:
    """Three values a pixel, from the embedding."""
    scaled = F.transform("pixels", lambda v: F.least(F.greatest(v * 0.2 + 0.5, F.lit(0.0)), F.lit(1.0)))
    return b.images(spark, sf_dir).select("source_id", F.flatten(F.transform(scaled, lambda v: F.array(v, v * v, 1 - v))).alias("pixels"))


_COLOURS = """
    , colour AS (SELECT source_id, list_transform(s, lambda v: v) AS r, list_transform(s, lambda v: v * v) AS g, list_transform(s, lambda v: 1 - v) AS b
      FROM (SELECT source_id, list_transform(px, lambda v: least(greatest(v * 0.2 + 0.5, 0.0), 1.0)) AS s FROM img))"""


def _median(c: str) -> str:
    return f"list_transform({c}, lambda v, i: list_sort([{', '.join(_at(y, x).replace('px[', f'{c}[') + '::FLOAT' for y in (-1, 0, 1) for x in (-1, 0, 1))}])[5]) AS {c}"


def _big(m: str) -> str:
    return f"list_transform(l, lambda v: {m}(v > 0 AND len(list_filter(l, lambda w: w = v)) >= 3))"


def _tissue(settings: list[tuple[float, float]]) -> str:
    """MSK-1 of each (least saturation, largest value), numbered from 0 in id = source_id * 4 + number."""
    rows = ", ".join(f"({k}, {lo}::FLOAT, {hi}::FLOAT)" for k, (lo, hi) in enumerate(settings))
    around = [(0, 0), *imaging.AXES]
    return _COLOURS + f"""
    , smooth AS (SELECT source_id, {', '.join(_median(c) for c in 'rgb')} FROM colour),
    spans AS (SELECT source_id, list_transform(r, lambda v, i: greatest(v, g[i], b[i])) AS hi, list_transform(r, lambda v, i: least(v, g[i], b[i])) AS lo FROM smooth),
    cut AS (SELECT source_id * 4 + k AS id, list_transform(hi, lambda v, i: (CASE WHEN v > 0 THEN (v - lo[i]) / v ELSE 0::FLOAT END) >= s_min AND v <= v_max) AS m FROM spans, (VALUES {rows}) t(k, s_min, v_max)),
    wide AS (SELECT id, list_transform(m, lambda v, i: {' OR '.join(_beside('m', y, x, 8, 'FALSE') for y, x in around)}) AS m FROM cut),
    closed AS (SELECT id, list_transform(m, lambda v, i: {' AND '.join(_beside('m', y, x, 8, 'TRUE') for y, x in around)}) AS m FROM wide)""" + _labelled("closed", "things", 8, imaging.AXES) + f"""
    , kept AS (SELECT id, {_big('NOT ')} AS m FROM things)""" + _labelled("kept", "holes", 8, imaging.AXES) + f"""
    , tissue AS (SELECT id, {_big('NOT ')} AS m FROM holes)"""


@registered(_recursive(("img",), _tissue([(0.05, 0.95)]), "SELECT id // 4 AS source_id, m AS mask FROM tissue"))
def tissue_masks(spark, sf_dir):
    return imaging.tissue_masks(_colour(spark, sf_dir), b.SIDE, {"min_object_size": 3})


@registered(_recursive(("img",), _tissue([(0.05, 0.95), (0.2, 0.95), (0.05, 0.8)]) + """
    , pairs AS (SELECT f.id // 4 AS source_id, o.id % 4 - 1 AS perturbation, len(list_filter(f.m, lambda v: v)) AS a, len(list_filter(o.m, lambda v: v)) AS c, len(list_filter(list_zip(f.m, o.m), lambda p: p[1] AND p[2])) AS n
      FROM tissue f JOIN tissue o ON o.id // 4 = f.id // 4 AND f.id % 4 = 0 AND o.id % 4 > 0)""", """
    SELECT source_id, perturbation::INTEGER AS perturbation, round(2 * n / greatest(a + c, 1), 6) AS dice, round(n / greatest(a + c - n, 1), 6) AS jaccard FROM pairs"""))
def mask_stability(spark, sf_dir):
    return rounded(imaging.mask_stability(_colour(spark, sf_dir), b.SIDE, {"min_object_size": 3}, [{"saturation_min": 0.2}, {"value_max": 0.8}]))


def _stains(h: float, e: float) -> str:
    """MSK-4 in steps of one list a pixel: densities, stains, colours."""
    apart, dark = np.linalg.inv(np.array(imaging.STAINS)).tolist(), math.log(1e-6)
    product = lambda a, m, k: " + ".join(f"{a}[{j + 1}] * ({m[j][k]!r}::DOUBLE)" for j in range(3))
    return _COLOURS + f"""
    , density AS (SELECT source_id, i, [ln(greatest(r[i], 1e-6)) / ({dark!r}::DOUBLE), ln(greatest(g[i], 1e-6)) / ({dark!r}::DOUBLE), ln(greatest(b[i], 1e-6)) / ({dark!r}::DOUBLE)] AS d FROM colour, range(1, 65) t(i)),
    stain AS (SELECT source_id, i, [{', '.join(f"greatest({product('d', apart, k)}, 0) * {scale}::DOUBLE" for k, scale in enumerate((h, e, 1.0)))}] AS h FROM density),
    back AS (SELECT source_id, i, unnest([{', '.join(f"round(least(exp(({product('h', imaging.STAINS, k)}) * ({dark!r}::DOUBLE)), 1.0), 6)" for k in range(3))}]) AS v, unnest([0, 1, 2]) AS k FROM stain)"""


@registered(_then(("img",), _stains(1.3, 0.8), "SELECT source_id, list(v ORDER BY i, k) AS pixels FROM back GROUP BY 1"))
def stains_scaled(spark, sf_dir):
    """MSK-4: more hematoxylin, less eosin."""
    made = imaging.stains_scaled(_colour(spark, sf_dir), 1.3, 0.8)
    return made.withColumn("pixels", F.transform("pixels", lambda v: F.round(v, 6)))


def _lesions(spark, sf_dir) -> DataFrame:
    m = b.metadata(spark, sf_dir).select("source_id", F.col("slide_id").alias("slide"), (F.col("source_id") % 40).cast("double").alias("x"), (F.col("source_id") % 30).cast("double").alias("y"))
    corners = [(10.0, 10.0), (30.0, 10.0), (30.0, 25.0), (10.0, 25.0)]
    square = F.array(*[F.struct((F.lit(x) + F.col("n_nationkey") % 5).alias("x"), F.lit(y).alias("y")) for x, y in corners])
    polygons = b.table(spark, sf_dir, "nation").select(F.concat(F.lit("slide_"), F.col("n_nationkey").cast("string")).alias("slide"), square.alias("polygon"))
    return imaging.lesion_masks(m, polygons, 16)


#: Every pixel of every patch against the four sides of its slide's polygon.
_LESIONS = """
    , side AS (SELECT 'slide_' || n_nationkey AS slide, x0 + n_nationkey % 5 AS x0, y0, x1 + n_nationkey % 5 AS x1, y1 FROM nation,
      (VALUES (10.0::DOUBLE, 10.0::DOUBLE, 30.0::DOUBLE, 10.0::DOUBLE), (30, 10, 30, 25), (30, 25, 10, 25), (10, 25, 10, 10)) t(x0, y0, x1, y1)),
    spot AS (SELECT source_id, label, slide_id, i, source_id % 40 + i % 16 AS x, source_id % 30 + i // 16 AS y FROM meta, range(256) t(i)),
    hit AS (SELECT source_id, label, i, coalesce(bool_or(abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) < 1e-9 AND y BETWEEN least(y0, y1) AND greatest(y0, y1) AND x BETWEEN least(x0, x1) AND greatest(x0, x1)), FALSE)
        OR count(*) FILTER (y0 <> y1 AND (y0 > y) <> (y1 > y) AND x < x0 + (y - y0) * (x1 - x0) / (y1 - y0)) % 2 = 1 AS v
      FROM spot LEFT JOIN side ON slide = slide_id GROUP BY ALL)"""
_INNER = "i // 16 BETWEEN 6 AND 9 AND i % 16 BETWEEN 6 AND 9"


@registered(_recursive(("meta",), _LESIONS + f"""
    , out_ AS (SELECT source_id AS id, list(v AND NOT ({_INNER}) ORDER BY i) AS m FROM hit GROUP BY 1)""" + _labelled("out_", "lab", 16, _ALL_NEAR) + """
    , sizes AS (SELECT id, max(n) AS most FROM (SELECT id, k, count(*) AS n FROM (SELECT id, unnest(l) AS k FROM lab) WHERE k > 0 GROUP BY ALL) GROUP BY 1),
    far AS (SELECT id, count(*) FILTER (m[i + 1]) AS n, min(sqrt(pow(greatest(6 - i // 16, i // 16 - 9, 0), 2) + pow(greatest(6 - i % 16, i % 16 - 9, 0), 2))) FILTER (m[i + 1]) AS d FROM out_, range(256) t(i) GROUP BY 1)""", """
    SELECT far.id AS source_id, (n > 0)::DOUBLE AS peripheral_presence, round(n / 256.0, 6) AS peripheral_fraction, round(d, 6) AS peripheral_distance,
      coalesce(most, 0)::DOUBLE AS peripheral_largest_component, round(n / 240.0, 6) AS transplanted_area_fraction FROM far LEFT JOIN sizes ON sizes.id = far.id"""))
def lesion_features(spark, sf_dir):
    return rounded(imaging.lesion_features(_lesions(spark, sf_dir), 16, 4))


@registered(_then(("meta",), _LESIONS + f"""
    , ok AS (SELECT (bool_or(v AND {_INNER})::INTEGER = label)::INTEGER AS ok FROM hit GROUP BY source_id, label)""", """
    SELECT CASE WHEN count(*) = 0 THEN 'unavailable' WHEN avg(ok) >= 0.99 THEN 'validated' ELSE 'failed' END AS status, round(avg(ok), 6) AS agreement, count(*) AS n, 0.99::DOUBLE AS threshold FROM ok"""))
def lesion_alignment(spark, sf_dir):
    labels = b.metadata(spark, sf_dir).select("source_id", "label")
    return rounded(arrays.alignment(_lesions(spark, sf_dir).join(labels, "source_id"), 16, 4))


def linear_model(images: np.ndarray) -> np.ndarray:
    """A frozen scorer of 8 x 8 images for the query."""
    return images @ (np.cos(np.arange(images.shape[1])) / images.shape[1])


@registered(_then(("imgp",), _ALPHA + """
    , w AS (SELECT i, cos(CAST(i AS DOUBLE)) / 64 AS k FROM range(64) t(i)),
    cross_donor AS (SELECT a.source_id, c.px AS d FROM img a JOIN img c ON c.source_id = a.source_id + 2),
    base AS (SELECT a.source_id, a.px, a.donor, c.d FROM imgp a JOIN cross_donor c USING (source_id)),
    each AS (SELECT source_id, k, px[i + 1] AS s, CASE WHEN i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5 THEN px[i + 1] ELSE a * px[i + 1] + (1 - a) * donor[i + 1] END AS w1,
      CASE WHEN i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5 THEN px[i + 1] ELSE a * px[i + 1] + (1 - a) * d[i + 1] END AS c1 FROM base JOIN alpha ON TRUE JOIN w USING (i))""",
    "SELECT source_id, round(sum(k * s), 6) AS original_logit, round(sum(k * w1), 6) AS within_logit, round(sum(k * c1), 6) AS cross_logit FROM each GROUP BY 1"))
def inference(spark, sf_dir):
    """INF-1: each image with the next two as donors, scored by a frozen model."""
    images = b.images(spark, sf_dir)
    n = images.agg(F.max("source_id").alias("last"))
    t = images.join(F.broadcast(n)).where(F.col("source_id") + 2 <= F.col("last")).select(  # one row
        F.format_string("t%09d", "source_id").alias("triplet_id"), "source_id", (F.col("source_id") + 1).alias("within_donor"), (F.col("source_id") + 2).alias("cross_donor"))
    found = scoring.infer(t, images, linear_model, b.SIDE, b.ROI, 1, 2)
    return rounded(found.select("source_id", "original_logit", "within_logit", "cross_logit"))


# --- metrics and estimands ------------------------------------------------------------------------

def _pairs(spark, sf_dir) -> DataFrame:
    z = b.bank(spark, sf_dir)
    triplets, ledger = matching.match(b.audited(z), z, b.FEATURES, matching.Rules(), b.TARGETS)
    t = diagnostics.stamp_common_support(triplets, diagnostics.annotate_common_support(ledger))
    normal = metrics.fit_normalizer(b.id_logits(z), by=["seed"])
    return metrics.donor_pair_metrics(b.predictions(t, z), normal, by=["seed"])


def _sources(spark, sf_dir) -> DataFrame:
    return metrics.source_metrics(_pairs(spark, sf_dir))


def _directed(spark, sf_dir) -> DataFrame:
    return metrics.directed(_sources(spark, sf_dir))


@registered(_then(("norm",), "", "SELECT seed, round(median, 6) AS median, round(scale, 6) AS scale FROM norm"))
def normalizer(spark, sf_dir):
    return rounded(metrics.fit_normalizer(b.id_logits(b.bank(spark, sf_dir)), by=["seed"]))


@registered(_then(("pm",), "", """
    SELECT triplet_id, seed, round(aw, 6) AS absolute_within_change, round(ac, 6) AS absolute_cross_change, round(hcs_pair, 6) AS hcs_pair, round(ws, 6) AS within_signed_shift_pair,
      round(cs, 6) AS cross_signed_shift_pair, round(hce_pair, 6) AS hce_pair FROM pm"""))
def pair_metrics(spark, sf_dir):
    return rounded(_pairs(spark, sf_dir).select("triplet_id", "seed", "absolute_within_change", "absolute_cross_change", "hcs_pair", "within_signed_shift_pair", "cross_signed_shift_pair", "hce_pair"))


_SM = ["normalized_original_logit", "delta_within", "delta_cross", "hcs_source", "within_signed_shift", "cross_signed_shift", "hce_source"]


@registered(_then(("sm",), "", f"SELECT source_id, source_split, source_hospital, target_hospital, source_slide, source_patient, source_physical_id, label, seed, backbone, common_support, n_donor_pairs, {rounds(*_SM)} FROM sm"))
def source_metrics(spark, sf_dir):
    return rounded(_sources(spark, sf_dir))


@registered(_then(("pm", "sm"), "", "SELECT triplet_id, pm.seed, round(hcs_pair, 6) AS hcs_pair, round(sm.hcs_source, 6) AS hcs_source FROM pm JOIN sm USING (source_id, target_hospital, seed)"))
def pairs_with_sources(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return rounded(metrics.pairs_with_sources(p, metrics.source_metrics(p)).select("triplet_id", "seed", "hcs_pair", "hcs_source"))


_DIR = ["delta_within", "delta_cross", "hcs", "within_signed_shift", "cross_signed_shift", "hce"]


@registered(_then(("dir",), "", f"SELECT {PAIR}, seed, backbone, n_sources, {rounds(*_DIR)} FROM dir"))
def hcs_directed(spark, sf_dir):
    """The flagship: directed excess instability and signed shift per hospital pair and seed."""
    return rounded(_directed(spark, sf_dir))


def _weighted(metric: str) -> str:
    return _then(("dir",), "", f"""
        SELECT source_split, seed, backbone, CASE WHEN count(*) = 3 THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN count(*) = 3 THEN round(avg({metric}), 6) END AS {metric}_pair_weighted,
          CAST(count(*) AS INTEGER) AS n_pairs, '' AS missing_pairs, '' AS unexpected_pairs FROM dir GROUP BY ALL""")


@registered(_weighted("hcs"))
def hcs_pair_weighted(spark, sf_dir):
    return rounded(metrics.pair_weighted(_directed(spark, sf_dir), "hcs", b.EXPECTED_PAIRS))


@registered(_weighted("hce"))
def hce_pair_weighted(spark, sf_dir):
    return rounded(metrics.pair_weighted(_directed(spark, sf_dir), "hce", b.EXPECTED_PAIRS))


@registered(_then(("dir",), "", """
    SELECT source_split, seed, backbone, 'unavailable' AS status, CAST(NULL AS DOUBLE) AS hcs_pair_weighted, CAST(count(*) AS INTEGER) AS n_pairs, '1>2' AS missing_pairs, '1>4' AS unexpected_pairs FROM dir GROUP BY ALL"""))
def hcs_incomplete(spark, sf_dir):
    """A missing and an unexpected pair: no mean."""
    return metrics.pair_weighted(_directed(spark, sf_dir), "hcs", [(1, 0), (1, 2), (1, 3)])


def _common(metric: str) -> str:
    return _then(("sm",), f"""
        , per AS (SELECT source_split, seed, backbone, target_hospital, avg({metric}_source) AS v, avg(delta_within) AS dw, avg(delta_cross) AS dc FROM sm WHERE common_support GROUP BY ALL)""", f"""
        SELECT source_split, seed, backbone, 'available' AS status, n AS n_unique_sources, round(avg(dw), 6) AS delta_within, round(avg(dc), 6) AS delta_cross, round(avg(v), 6) AS {metric}_common_support
        FROM per JOIN (SELECT seed, count(DISTINCT source_id) AS n FROM sm WHERE common_support GROUP BY 1) USING (seed) GROUP BY ALL""")


@registered(_common("hcs"))
def hcs_common_support(spark, sf_dir):
    return rounded(metrics.common_support(_sources(spark, sf_dir), "hcs", {1: set(b.TARGETS)}))


@registered(_common("hce"))
def hce_common_support(spark, sf_dir):
    return rounded(metrics.common_support(_sources(spark, sf_dir), "hce", {1: set(b.TARGETS)}))


@registered(_then(("sm",), "", f"""
    SELECT {PAIR}, seed, backbone, setting, count(DISTINCT source_id) AS n_sources, {', '.join(f'round(avg({c}), 6) AS {n}' for c, n in zip(['delta_within', 'delta_cross', 'hcs_source', 'within_signed_shift', 'cross_signed_shift', 'hce_source'], _DIR, strict=True))}
    FROM (SELECT *, CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END AS setting FROM sm) GROUP BY ALL"""))
def robustness(spark, sf_dir):
    s = _sources(spark, sf_dir).withColumn("setting", F.when(F.col("label") == 1, "positive").otherwise("negative"))
    return rounded(metrics.directed(s, ["setting"]))


ROLES = ["source_physical_id", "within_physical_id", "cross_physical_id"]
#: Multipliers of all identities; pairs of the same identities added up; each of those weighed once a draw.
_WEIGHED = f"""
    , mult AS MATERIALIZED (SELECT id, draw, -ln({uniform('42', 'draw', 'id')}) AS x FROM ({' UNION '.join(f'SELECT {r} AS id FROM pm' for r in ROLES)}), range({DRAWS}) t(draw)),
    cell AS (SELECT seed, target_hospital, {', '.join(ROLES)}, sum(hcs_pair) AS hcs_all, sum(hce_pair) AS hce_all, count(*) AS n_all,
        sum(hcs_pair) FILTER (common_support) AS hcs_cs, sum(hce_pair) FILTER (common_support) AS hce_cs, count(*) FILTER (common_support) AS n_cs FROM pm GROUP BY ALL),
    sums AS MATERIALIZED (SELECT seed, target_hospital, a.draw AS draw, {', '.join(f'sum(a.x * b.x * c.x * {v}_{k}) AS {v}_{k}' for k in ('all', 'cs') for v in ('hcs', 'hce', 'n'))}
        FROM cell JOIN mult a ON a.id = {ROLES[0]} JOIN mult b ON b.id = {ROLES[1]} AND b.draw = a.draw JOIN mult c ON c.id = {ROLES[2]} AND c.draw = a.draw GROUP BY ALL)"""


@registered(_then(("pm",), _WEIGHED + """
    , draws AS (SELECT seed, target_hospital, draw, hcs_all / n_all AS estimate FROM sums)""", """
    SELECT p.seed, p.target_hospital, p.n, round(p.estimate, 6) AS estimate, draws, round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper, round(se, 6) AS standard_error, 'available' AS status
    FROM (SELECT seed, target_hospital, count(*) AS n, avg(hcs_pair) AS estimate FROM pm GROUP BY 1, 2) p
    JOIN (SELECT seed, target_hospital, count(*) AS draws, quantile_cont(estimate, 0.025) AS lo, quantile_cont(estimate, 0.975) AS hi, stddev_samp(estimate) AS se FROM draws GROUP BY 1, 2) d USING (seed, target_hospital)"""))
def bootstrap_directed(spark, sf_dir):
    pairs = stored(_pairs(spark, sf_dir), "pairs")  # read twice
    return rounded(bootstrap.crossed(pairs, "hcs_pair", ROLES, ["seed", "target_hospital"], DRAWS, confidence=0.95))


_GROUPED = """
    , outer_{m}_{k} AS (SELECT seed, draw, avg({m}_{k} / n_{k}) AS estimate FROM sums WHERE n_{k} > 0 GROUP BY ALL)"""
_GROUPED_ROWS = """
    SELECT p.seed, p.n, p.n_groups, round(p.estimate, 6) AS estimate, d.draws, round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper, round(se, 6) AS standard_error, 'available' AS status{tag}
    FROM (SELECT seed, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_groups, avg(m) AS estimate FROM (SELECT seed, target_hospital, count(*) AS n, avg({m}_pair) AS m FROM pm WHERE {where} GROUP BY 1, 2) GROUP BY 1) p
    JOIN (SELECT seed, count(*) AS draws, quantile_cont(estimate, 0.025) AS lo, quantile_cont(estimate, 0.975) AS hi, stddev_samp(estimate) AS se FROM outer_{m}_{k} GROUP BY 1) d USING (seed)"""


@registered(_then(("pm",), _WEIGHED + _GROUPED.format(m="hcs", k="all"), _GROUPED_ROWS.format(m="hcs", k="all", where="TRUE", tag="")))
def bootstrap_grouped(spark, sf_dir):
    pairs = stored(_pairs(spark, sf_dir), "pairs")  # read twice
    return rounded(bootstrap.grouped(pairs, "hcs_pair", ROLES, ["source_hospital", "target_hospital"], ["seed"], DRAWS))


_KINDS = [("pair_weighted", "all", "TRUE"), ("common_support", "cs", "common_support")]


@registered(_then(("pm",), _WEIGHED + "".join(_GROUPED.format(m=m, k=k) for _, k, _ in _KINDS for m in ("hcs", "hce")), " UNION ALL ".join(
    _GROUPED_ROWS.format(m=m, k=k, where=where, tag=f", 'val' AS source_split, '{kind}' AS summary_type, '{m}' AS metric") for kind, k, where in _KINDS for m in ("hcs", "hce"))))
def bootstrap_audit(spark, sf_dir):
    pairs = stored(_pairs(spark, sf_dir), "pairs")  # read three times
    return rounded(bootstrap.audit_intervals(pairs, b.EXPECTED_PAIRS, DRAWS, run_keys=("source_split", "seed")))


@registered(_then(("dir",), "", f"SELECT {PAIR}, count(*) AS n_seeds, round(avg(hcs), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(hcs) ELSE 0 END, 6) AS std FROM dir GROUP BY ALL"))
def seed_estimates(spark, sf_dir):
    return rounded(bootstrap.seed_estimates(_directed(spark, sf_dir), "hcs", ["source_split", "source_hospital", "target_hospital"]))


@registered("""
    WITH t AS (SELECT l_shipdate AS f, l_orderkey * 10 + l_linenumber AS id, (l_extendedprice * 100) % 10000 / 10000 AS p FROM lineitem),
    r AS (SELECT f, id, p, p * count(*) OVER (PARTITION BY f) / row_number() OVER (PARTITION BY f ORDER BY p, id) AS q FROM t)
    SELECT CAST(f AS VARCHAR) AS family, id, round(p, 6) AS p, round(least(min(q) OVER (PARTITION BY f ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) + 1e-9, 6) AS q FROM r""")
def false_discovery(spark, sf_dir):
    l = b.table(spark, sf_dir, "lineitem")
    p = l.select(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("family"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ((F.col("l_extendedprice") * 100) % 10000 / 10000).alias("p"))
    return rounded(metrics.benjamini_hochberg(p).withColumn("q", F.col("q") + 1e-9))  # many end exactly in a half at the seventh digit


@registered("""
    WITH t AS (SELECT quality AS y, ln(n_chars + 1.0) - 7 AS x FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
    r AS (SELECT y, x, (rank() OVER (ORDER BY x) + rank() OVER (ORDER BY x) + count(*) OVER (PARTITION BY x) - 1) / 2.0 AS k FROM t)
    SELECT count(*) AS n, round(avg(CAST((x >= 0) = (y = 1) AS INTEGER)), 6) AS accuracy,
      round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1)), 6) AS auroc FROM r""")
def performance(spark, sf_dir):
    """PRF-1: document length as a score of quality."""
    d = b.table(spark, sf_dir, "documents").select("doc_id", (F.log(F.col("n_chars") + 1.0) - 7).alias("logit"))
    labels = b.table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("label"))
    return rounded(metrics.performance(labels.join(d, "doc_id")))


# --- experiments -----------------------------------------------------------------------------------

_RUNS = """
    SELECT r.r_name AS backbone, n.n_nationkey AS seed, 'val' AS split, CASE WHEN n_nationkey % 4 = 1 THEN 'failed' ELSE 'completed' END AS run_status, n_nationkey + CASE WHEN n_nationkey % 7 = 3 THEN 1 ELSE 0 END AS run_seed,
      CASE WHEN n_nationkey % 5 = 2 THEN 'v0' ELSE 'v1' END AS dataset_version, r_name AS architecture, 'c0' AS config_hash, '/runs/' || n_nationkey AS run_path FROM nation n JOIN region r ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 0"""
_LEDGER = f"""
    WITH runs AS ({_RUNS}), led AS (SELECT e.r_name AS backbone, e.n_nationkey AS seed, 'val' AS split,
      CASE WHEN run_path IS NULL THEN 'missing' WHEN run_status = 'failed' OR run_seed <> seed OR dataset_version = 'v0' THEN 'invalid' ELSE 'completed' END AS status,
      CASE WHEN run_path IS NULL THEN 'the expected run is missing' WHEN run_status = 'failed' THEN 'run status is failed' WHEN run_seed <> seed THEN 'seed ' || run_seed || ' is not the expected one'
        WHEN dataset_version = 'v0' THEN 'dataset version v0 is not v1' ELSE '' END AS reason, coalesce(run_path, '') AS run_path
      FROM (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) e LEFT JOIN runs ON backbone = r_name AND seed = n_nationkey)"""


def _run_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(expected, runs): nations stand for runs of regions as architectures."""
    n = b.table(spark, sf_dir, "nation").join(F.broadcast(b.table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions
    k = F.col("n_nationkey")
    base = n.select(F.col("r_name").alias("backbone"), k.alias("seed"), F.lit("val").alias("split"), k)
    runs = base.where(k % 6 != 0).select(
        "backbone", "seed", "split", F.when(k % 4 == 1, "failed").otherwise("completed").alias("run_status"), (k + F.when(k % 7 == 3, 1).otherwise(0)).alias("run_seed"),
        F.when(k % 5 == 2, "v0").otherwise("v1").alias("dataset_version"), F.col("backbone").alias("architecture"), F.lit("c0").alias("config_hash"),
        F.array(F.lit("directed")).alias("tables"), F.concat(F.lit("/runs/"), k.cast("string")).alias("run_path"))
    return base.drop("n_nationkey"), runs


def _run_ledger(spark, sf_dir) -> DataFrame:
    expected, runs = _run_tables(spark, sf_dir)
    names = {r["backbone"]: "v1" for r in expected.select("backbone").distinct().collect()}  # 5 architectures
    return aggregation.run_ledger(expected, runs, names, "c0", ["directed"])


@registered(_LEDGER + " SELECT * FROM led")
def run_ledger(spark, sf_dir):
    return _run_ledger(spark, sf_dir)


@registered(_LEDGER + """
    SELECT n AS number_expected_runs, ok AS number_completed_runs, detail AS missing_runs_detail, 'incomplete' AS run_status, 'p0' AS protocol_hash, led.backbone, led.seed, CAST(led.seed * 2 AS BIGINT) AS value
    FROM led, (SELECT count(*) AS n, count(*) FILTER (status = 'completed') AS ok, array_to_string(list_sort(list(backbone || ':' || seed || ':' || reason) FILTER (status <> 'completed')), ';') AS detail FROM led) WHERE status = 'completed'""")
def runs_combined(spark, sf_dir):
    l = _run_ledger(spark, sf_dir)
    table = _run_tables(spark, sf_dir)[1].select("backbone", "seed", (F.col("seed") * 2).cast("long").alias("value"))
    return aggregation.stamped(aggregation.completed_only(table, l), l, "p0")


@registered(_LEDGER + " SELECT * FROM led WHERE status <> 'completed'")
def runs_missing(spark, sf_dir):
    return aggregation.missing_runs(_run_ledger(spark, sf_dir), "val")


@registered(_then(("dir",), "", """
    SELECT metric, source_split, backbone, source_hospital, target_hospital, count(v) AS n_seeds, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
      CAST(3 AS BIGINT) AS expected_seeds, CASE WHEN count(v) = 3 THEN 'available' ELSE 'unavailable' END AS status
    FROM (SELECT *, 'directed_hcs' AS metric, hcs AS v FROM dir UNION ALL SELECT *, 'directed_hce', hce FROM dir) GROUP BY metric, source_split, backbone, source_hospital, target_hospital"""))
def seed_stability(spark, sf_dir):
    return rounded(aggregation.seed_stability(_directed(spark, sf_dir), {"linear": 3}))


@registered("""
    WITH e AS (SELECT r_name AS population, s AS setting, seed FROM region, (VALUES ('primary'), ('roi_only')) a(s), (VALUES (11), (42), (101)) c(seed)),
    d AS (SELECT * FROM e WHERE NOT (population = 'ASIA' AND setting = 'roi_only' AND seed > 11))
    SELECT e.population, e.setting, count(*) AS expected_runs, count(d.seed) AS completed_runs, coalesce(array_to_string(list_sort(list(e.seed) FILTER (d.seed IS NULL)), ';'), '') AS missing_seeds,
      CASE WHEN count(*) = count(d.seed) THEN 'complete' ELSE 'incomplete' END AS status FROM e LEFT JOIN d ON d.population = e.population AND d.setting = e.setting AND d.seed = e.seed GROUP BY 1, 2""")
def settings_completeness(spark, sf_dir):
    settings = F.explode(F.array(F.lit("primary"), F.lit("roi_only"))).alias("setting")
    e = b.with_seeds(b.table(spark, sf_dir, "region").select(F.col("r_name").alias("population"), settings))
    return aggregation.settings_completeness(e, e.where("NOT (population = 'ASIA' AND setting = 'roi_only' AND seed > 11)"))


@registered(_then(("dir",), "", """
    SELECT seed, target_hospital, round(hcs, 6) AS hcs, CAST(NULL AS DOUBLE) AS hce, 'hospital1' AS population, 'primary' AS analysis_class FROM dir
    UNION ALL SELECT seed, target_hospital, NULL, round(hce, 6), 'hospital2', 'post-hoc exploratory' FROM dir"""))
def assembled(spark, sf_dir):
    """AGG-5, AGG-6: tables of unlike columns under their population and class of analysis."""
    d = _directed(spark, sf_dir)
    return rounded(aggregation.assemble({
        "hospital1": (d.select("seed", "target_hospital", "hcs"), "primary"), "hospital2": (d.select("seed", "target_hospital", "hce"), "post-hoc exploratory")}))


@registered(_then(("dir",), "", """
    SELECT setting, source_split, backbone, seed, source_hospital, target_hospital, n_sources, metric, round(v, 6) AS value, 'hospital1' AS population
    FROM (SELECT *, 'directed_hcs' AS metric, hcs AS v FROM dir UNION ALL SELECT *, 'directed_hce', hce FROM dir), (VALUES ('primary'), ('roi_only')) s(setting) WHERE setting = 'primary' OR seed = 42"""))
def individual_seeds(spark, sf_dir):
    """AGG-5: directed results of each seed under their settings."""
    d = _directed(spark, sf_dir)
    return rounded(aggregation.individual_seeds({"primary": d, "roi_only": d.where("seed = 42")}, "hospital1"))


@registered(_then(("dir",), "", """
    SELECT setting, seed, status, source_split, source_hospital, target_hospital, n_sources, round(hcs, 6) AS hcs, 'hospital1' AS population, 'linear' AS backbone
    FROM (SELECT e.setting, e.seed, CASE WHEN d.seed IS NULL THEN 'missing' ELSE 'available' END AS status, source_split, source_hospital, target_hospital, n_sources, hcs
      FROM (SELECT * FROM (VALUES ('jpeg'), ('roi_shift')) s(setting), (VALUES (11), (42), (7)) r(seed)) e LEFT JOIN dir d ON d.seed = e.seed)"""))
def robustness_by_seed(spark, sf_dir):
    """AGG-5: the same directed table under two settings; seed 7 was never run, seed 101 not expected."""
    runs = aggregation.combine({s: _directed(spark, sf_dir).drop("backbone") for s in ("jpeg", "roi_shift")}, "setting")
    expected = b.with_seeds(b.table(spark, sf_dir, "region").select(F.explode(F.array(F.lit("jpeg"), F.lit("roi_shift"))).alias("setting")), (11, 42, 7))
    found = aggregation.robustness_by_seed(runs, expected, "hospital1", "linear")
    return rounded(found.select("setting", "seed", "status", "source_split", "source_hospital", "target_hospital", "n_sources", "hcs", "population", "backbone"))


@registered(" UNION ALL BY NAME ".join(f"SELECT *, '{n}' AS source_table, 'hospital1' AS population, 'p0' AS protocol_hash FROM ({_SQL[q]})" for n, q in (
    ("matching_balance", "balance_distances"), ("feature_balance", "balance_features"), ("directed_coverage", "coverage_directed"), ("common_support_coverage", "coverage_common_support"))))
def matching_results(spark, sf_dir):
    """AGG-5: the tables of one matching in one."""
    z = b.bank(spark, sf_dir)
    t, l = (stored(x, "matched") for x in matching.match(b.audited(z), z, b.FEATURES, matching.Rules(), b.TARGETS))
    support = diagnostics.annotate_common_support(l)
    return rounded(aggregation.matching_results({
        "matching_balance": diagnostics.balance_summary(t), "feature_balance": diagnostics.feature_balance(t, z, b.FEATURES, features.fit_standardizer(z, b.FEATURES)),
        "directed_coverage": diagnostics.directed_coverage(l), "common_support_coverage": diagnostics.common_support_coverage(support)}, "hospital1", "p0"))


@registered(_then(("dir",), "", """
    SELECT setting, round(hcs_pair_weighted, 6) AS hcs_pair_weighted, seed, 'hospital1' AS population
    FROM (SELECT seed, avg(hcs) AS hcs_pair_weighted FROM dir GROUP BY 1), (VALUES ('primary'), ('roi_only')) s(setting) WHERE setting = 'primary' OR seed <> 101"""))
def population_global(spark, sf_dir):
    """AGG-5: the global table of a population over its settings, one of which lacks a seed."""
    d = metrics.pair_weighted(_directed(spark, sf_dir), "hcs", b.EXPECTED_PAIRS).select("seed", "hcs_pair_weighted")
    return rounded(aggregation.population_tables({"primary": {"global_hcs": d}, "roi_only": {"global_hcs": d.where("seed <> 101")}}, "hospital1")["global_hcs"])


@registered("SELECT page_id, lower(split_part(split_part(url, '://', 2), '/', 1)) AS host, length(html) AS bytes, sha256(html) AS sha256 FROM pages")
def content_manifest(spark, sf_dir):
    """SNK-3's digests over a table of contents."""
    p = b.table(spark, sf_dir, "pages")
    host = F.lower(F.substring_index(F.substring_index(F.col("url"), "://", -1), "/", 1))
    m = tables.manifest(p.select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content")))
    sizes = p.select(F.col("page_id").cast("string").alias("path"), "page_id", host.alias("host"), F.length("html").cast("long").alias("chars"))
    return m.join(sizes, "path").select("page_id", "host", F.col("chars").alias("bytes"), "sha256")
