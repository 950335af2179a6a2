"""DuckDB SQL of the bound tables and of the steps that several queries share.

Written from the definitions of the operators: plain joins, windows and unrolled steps. ``with_(...)``
puts the named steps, and those that they need, in front of a query.
"""

from __future__ import annotations

from ..sources.bindings import CONTEXT_FEATURES, FEATURES, ROI_FEATURES, SEEDS, TARGETS

Z = [f"z_{c}" for c in FEATURES]
TARGET_ROWS = ", ".join(f"({t})" for t in TARGETS)
SEED_ROWS = ", ".join(f"({s})" for s in SEEDS)


def uniform(*parts: str) -> str:
    told = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((('0x' || substr(md5({told}), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"


def hashed(*parts: str) -> str:
    return "md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def distance(a: str, b: str) -> str:
    total = " + ".join(f"({a}{z} - {b}{z}) * ({a}{z} - {b}{z})" for z in Z)
    return f"round(sqrt({total}), 9)"


def score(roi: str, context: str) -> str:
    parts = [f"({uniform('seed', repr(c))} * 2 - 1) * {p}z_{c}" for p, names in ((roi, ROI_FEATURES), (context, CONTEXT_FEATURES)) for c in names]
    return " + ".join(["0.0", *parts])


_zs = ", ".join(Z)

STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw": ((), """
        SELECT c_custkey AS id, CASE WHEN n_regionkey = 1 THEN 'val' WHEN n_regionkey = 2 THEN 'test' WHEN c_custkey % 5 = 0 THEN 'id_val' ELSE 'train' END AS split,
          CAST(n_regionkey AS INTEGER) AS hospital, 'slide_' || n_nationkey AS slide,
          CASE WHEN c_custkey % 7 <> 0 THEN n_nationkey || '-' || (c_custkey % 11) END AS patient, CAST(c_acctbal > 4500 AS INTEGER) AS y
        FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "meta": (("raw",), """
        SELECT id AS source_id, split, hospital AS hospital_id, slide AS slide_id, patient AS patient_id, y AS label,
          CASE WHEN patient IS NULL THEN 'slide:' || slide ELSE 'patient:' || patient END AS physical_id FROM raw"""),
    "descr": (("meta",), """
        SELECT m.*, o.n_orders, o.price_mean, o.price_std, o.open_share FROM meta m JOIN (
          SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n_orders, avg(o_totalprice) AS price_mean, stddev_pop(o_totalprice) AS price_std,
            avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END) AS open_share FROM orders GROUP BY 1) o ON m.source_id = o.o_custkey"""),
    "fit": (("descr",), "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES) + " FROM descr WHERE split = 'train'"),
    "z": (("descr", "fit"), "SELECT d.*, " + ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 9) AS z_{c}" for c in FEATURES) + " FROM descr d, fit"),
    "req": (("z",), f"""
        SELECT source_id, physical_id, label, 'within' AS role, hospital_id AS d_hospital, split AS d_split, {_zs} FROM z WHERE split = 'val'
        UNION ALL SELECT source_id, physical_id, label, 'cross', t, 'train', {_zs} FROM z, (VALUES {TARGET_ROWS}) v(t) WHERE split = 'val' AND t <> hospital_id"""),
    "near": (("req", "z"), f"""
        SELECT r.source_id, r.role, r.d_hospital, d.source_id AS donor_id, d.slide_id AS d_slide, d.physical_id AS d_physical, {distance('r.', 'd.')} AS distance,
          {', '.join(f'd.{z}' for z in Z)}
        FROM req r JOIN z d ON d.hospital_id = r.d_hospital AND d.label = r.label AND d.split = r.d_split
        WHERE d.physical_id <> r.physical_id AND d.source_id <> r.source_id"""),
    "pool": (("near",), """
        SELECT *, row_number() OVER (PARTITION BY source_id, role, d_hospital ORDER BY distance, CAST(donor_id AS VARCHAR)) AS rank FROM near
        QUALIFY rank <= 64"""),
    "cand": (("pool",), f"""
        SELECT *, round(matching_distance_within + matching_distance_cross + 2.0 * abs(matching_distance_within - matching_distance_cross) + 0.25 * matching_distance_pair, 9) AS matching_cost
        FROM (SELECT w.source_id, c.d_hospital AS target_hospital, w.donor_id AS within_donor, w.d_slide AS within_slide, w.d_physical AS within_physical_id,
          c.donor_id AS cross_donor, c.d_slide AS cross_slide, c.d_physical AS cross_physical_id, w.distance AS matching_distance_within, c.distance AS matching_distance_cross,
          {distance('w.', 'c.')} AS matching_distance_pair
          FROM pool w JOIN pool c ON w.source_id = c.source_id AND w.role = 'within' AND c.role = 'cross'
          WHERE w.distance <= 6 AND c.distance <= 6 AND abs(w.distance - c.distance) <= 1 AND w.d_physical <> c.d_physical)"""),
    "ranked": (("cand",), """
        SELECT *, row_number() OVER (PARTITION BY source_id, target_hospital ORDER BY matching_cost, CAST(within_donor AS VARCHAR), CAST(cross_donor AS VARCHAR)) AS place FROM cand"""),
    "g0": (("ranked",), "SELECT * FROM ranked WHERE place = 1"),
    "r1": (("ranked", "g0"), """
        SELECT r.* FROM ranked r JOIN g0 g USING (source_id, target_hospital) WHERE r.within_donor <> g.within_donor AND r.cross_donor <> g.cross_donor"""),
    "g1": (("r1",), "SELECT * FROM r1 QUALIFY row_number() OVER (PARTITION BY source_id, target_hospital ORDER BY place) = 1"),
    "g2": (("r1", "g1"), """
        SELECT r.* FROM r1 r JOIN g1 g USING (source_id, target_hospital) WHERE r.within_donor <> g.within_donor AND r.cross_donor <> g.cross_donor
        QUALIFY row_number() OVER (PARTITION BY source_id, target_hospital ORDER BY r.place) = 1"""),
    "chosen": (("g0", "g1", "g2"), "SELECT *, 0 AS donor_index FROM g0 UNION ALL SELECT *, 1 FROM g1 UNION ALL SELECT *, 2 FROM g2"),
    "trip": (("chosen", "z"), """
        SELECT 't' || c.source_id || '-' || target_hospital || '-' || donor_index AS triplet_id, c.source_id, s.split AS source_split, s.hospital_id AS source_hospital,
          target_hospital, s.slide_id AS source_slide, s.patient_id AS source_patient, s.physical_id AS source_physical_id, s.label, within_donor, within_slide, within_physical_id,
          cross_donor, cross_slide, cross_physical_id, matching_distance_within, matching_distance_cross, matching_distance_pair, matching_cost, donor_index
        FROM chosen c JOIN z s ON c.source_id = s.source_id QUALIFY count(*) OVER (PARTITION BY c.source_id, target_hospital) = 3"""),
    "ledger": (("z", "pool", "chosen"), f"""
        SELECT source_id, source_split, source_hospital, target_hospital, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'excluded' END AS coverage_status, reason AS exclusion_reason
        FROM (SELECT s.source_id, s.split AS source_split, s.hospital_id AS source_hospital, t AS target_hospital,
          CASE WHEN coalesce(w.n, 0) = 0 THEN 'no_within_candidate' WHEN coalesce(c.n, 0) = 0 THEN 'no_cross_candidate'
            WHEN w.near = 0 OR c.near = 0 THEN 'distance_threshold' WHEN coalesce(g.n, 0) < 3 THEN 'insufficient_balanced_pairs' END AS reason
          FROM (SELECT * FROM z WHERE split = 'val') s JOIN (VALUES {TARGET_ROWS}) v(t) ON t <> s.hospital_id
          LEFT JOIN (SELECT source_id, count(*) AS n, count(*) FILTER (distance <= 6) AS near FROM pool WHERE role = 'within' GROUP BY 1) w ON w.source_id = s.source_id
          LEFT JOIN (SELECT source_id, d_hospital, count(*) AS n, count(*) FILTER (distance <= 6) AS near FROM pool WHERE role = 'cross' GROUP BY 1, 2) c ON c.source_id = s.source_id AND c.d_hospital = t
          LEFT JOIN (SELECT source_id, target_hospital, count(*) AS n FROM chosen GROUP BY 1, 2) g ON g.source_id = s.source_id AND g.target_hospital = t)"""),
    "support": (("ledger",), "SELECT *, bool_and(coverage_status = 'accepted') OVER (PARTITION BY source_split, source_hospital, source_id) AS common_support FROM ledger"),
    "pred": (("trip", "support", "z"), f"""
        SELECT t.*, u.common_support, seed, 'linear' AS backbone, {score('s.', 's.')} AS original_logit, {score('s.', 'w.')} AS within_logit, {score('s.', 'c.')} AS cross_logit
        FROM trip t JOIN z s ON s.source_id = t.source_id JOIN z w ON w.source_id = t.within_donor JOIN z c ON c.source_id = t.cross_donor
        JOIN support u ON u.source_id = t.source_id AND u.target_hospital = t.target_hospital, (VALUES {SEED_ROWS}) v(seed)"""),
    "idl": (("z",), f"SELECT source_id, label, seed, {score('', '')} AS logit FROM z, (VALUES {SEED_ROWS}) v(seed) WHERE split = 'id_val'"),
    "norm": (("idl",), "SELECT seed, median(logit) AS median, greatest(quantile_cont(logit, 0.75) - quantile_cont(logit, 0.25), 0.001) AS scale FROM idl GROUP BY 1"),
    "pm": (("pred", "norm"), """
        SELECT *, abs(nw - no) AS aw, abs(nc - no) AS ac, abs(nc - no) - abs(nw - no) AS hcs_pair, nw - no AS ws, nc - no AS cs, nc - nw AS hce_pair
        FROM (SELECT p.*, (original_logit - median) / scale AS no, (within_logit - median) / scale AS nw, (cross_logit - median) / scale AS nc FROM pred p JOIN norm USING (seed))"""),
    "sm": (("pm",), """
        SELECT source_id, source_split, source_hospital, target_hospital, source_slide, source_patient, source_physical_id, label, seed, backbone, common_support, count(*) AS n_donor_pairs,
          min(no) AS normalized_original_logit, avg(aw) AS delta_within, avg(ac) AS delta_cross, avg(ac) - avg(aw) AS hcs_source, avg(nw) - min(no) AS within_signed_shift,
          avg(nc) - min(no) AS cross_signed_shift, avg(nc) - avg(nw) AS hce_source FROM pm GROUP BY ALL"""),
    "dir": (("sm",), """
        SELECT source_split, seed, backbone, source_hospital, target_hospital, count(DISTINCT source_id) AS n_sources, avg(delta_within) AS delta_within, avg(delta_cross) AS delta_cross,
          avg(hcs_source) AS hcs, avg(within_signed_shift) AS within_signed_shift, avg(cross_signed_shift) AS cross_signed_shift, avg(hce_source) AS hce FROM sm GROUP BY ALL"""),
    "uses": (("trip",), """
        SELECT source_split, source_hospital, target_hospital, within_donor AS donor_id, within_slide AS slide, 'within' AS kind FROM trip
        UNION ALL SELECT source_split, source_hospital, target_hospital, cross_donor, cross_slide, 'cross' FROM trip"""),
    "img": ((), "SELECT vec_id AS source_id, label, CAST(embedding AS DOUBLE[]) AS px FROM embeddings"),
    "imgp": (("img",), "SELECT a.source_id, a.px, b.px AS donor FROM img a JOIN img b ON b.source_id = a.source_id + 1"),
}


def with_(*names: str, then: str) -> str:
    """The query ``then`` after the steps that it names and all that those need, each once."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in STEPS[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({STEPS[n][1]})" for n in order) + " " + then


def rounds(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
