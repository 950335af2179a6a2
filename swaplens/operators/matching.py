"""Matching: nearest donors in equality groups, pair costs, uncapped greedy choice, capacity.

A source of split s is matched to a target hospital by ``K`` disjoint pairs of donors: one within its own
hospital and split, one across in the target hospital (of ``train`` for held-out splits). Donors share the
label, never the physical identity.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import euclidean, hash_order, require_columns, uniform
from ..functions.ordering import hash_bucket, ranked
from ..functions.stored import stored
from . import cells
from .features import z_columns


@dataclass(frozen=True)
class Rules:
    """Parameters of the primary matching."""

    k: int = 3
    lambda_balance: float = 2.0
    lambda_pair: float = 0.25
    tau_distance: float = 6.0
    tau_balance: float = 1.0
    pool: int = 64
    donor_cap: int | None = None
    slide_cap: int | None = None
    min_slides: int = 1
    calipers: tuple[tuple[str, float], ...] = ()


HELD_OUT = ("val", "test")


def donor_split(split: Column) -> Column:
    return F.when(split.isin(*HELD_OUT), F.lit("train")).otherwise(split)


def with_targets(sources: DataFrame, targets: Sequence[int]) -> DataFrame:
    """One row per source and target hospital other than its own, in list order."""
    spread = F.explode(F.array(*[F.lit(t) for t in targets])).alias("target_hospital")
    return sources.select("*", spread).where(F.col("target_hospital") != F.col("hospital_id"))


def requests(sources: DataFrame, targets: Sequence[int]) -> DataFrame:
    """What each source asks for: (role, hospital, split) of its donors, once per hospital."""
    within = sources.withColumns({"role": F.lit("within"), "d_hospital": F.col("hospital_id"), "d_split": F.col("split")})
    cross = with_targets(sources, targets).withColumns({"role": F.lit("cross"), "d_hospital": F.col("target_hospital"), "d_split": donor_split(F.col("split"))})
    return within.unionByName(cross.drop("target_hospital"))


def nearest(asked: DataFrame, bank: DataFrame, features: Sequence[str], k: int, by_string: bool = True, size: int = cells.SIZE) -> DataFrame:
    """KNN-1/2/5, JOIN-6, FLT-3: the k nearest eligible donors of each request, with rank.

    Groups are (hospital, label, split); ties go by the donor id as text (``by_string``) or as it is. Donors are
    searched in cells of about ``size``, see ``cells``; the result doesn't depend on it."""
    s, d = _grouped(asked, bank, features)
    tie = F.col("donor_id").cast("string") if by_string else F.col("donor_id")
    return cells.nearest(s, d, GROUP, features, k, tie, size)


#: What donors of a request share.
GROUP = ["d_hospital", "label", "d_split"]


def _grouped(asked: DataFrame, bank: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    s = asked.select("source_id", "physical_id", "role", *GROUP, *[F.col(f"z_{c}").cast("double").alias(f"s_z_{c}") for c in features])
    d = bank.select(
        F.col("hospital_id").alias("d_hospital"), "label", F.col("split").alias("d_split"), F.col("source_id").alias("donor_id"),
        F.col("physical_id").alias("d_physical"), F.col("slide_id").alias("d_slide"), *[F.col(f"z_{c}").cast("double").alias(f"d_z_{c}") for c in features],
    )
    return s, d


def radius_join(asked: DataFrame, bank: DataFrame, features: Sequence[str], radius: float) -> DataFrame:
    """JOIN-7: all eligible donors of the group within the radius, searched in cells as ``nearest`` does."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    s, d = _grouped(asked, bank, features)
    return cells.within(s, d, GROUP, features, radius, F.col("donor_id"))


def group_sizes(bank: DataFrame, saturated: DataFrame | None = None) -> DataFrame:
    """KNN-3: donors per group, without the saturated ones."""
    active = bank if saturated is None else bank.join(saturated.select("source_id"), "source_id", "left_anti")
    return active.groupBy("hospital_id", "label", "split").agg(F.count("*").alias("n"))


def pair_candidates(sources: DataFrame, pools: DataFrame, features: Sequence[str], rules: Rules, targets: Sequence[int]) -> DataFrame:
    """PAIR-1, JOIN-8: pairs of a within and a cross donor of a source and target that keep the
    thresholds, with cost. Both pools hold ``rules.pool`` rows a source, so the product is bounded."""
    kept = ["donor_id", "d_slide", "d_physical", "distance", *[f"d_z_{c}" for c in features]]
    # the pools of a source are one row that is read once; a join of two sides would search for each of them
    listed = F.collect_list(F.struct("role", "d_hospital", *kept)).alias("pool")
    one = pools.where((F.col("distance") <= rules.tau_distance) & F.col("source_id").isNotNull()).groupBy("source_id").agg(listed)
    of = lambda role: F.filter("pool", lambda p: p["role"] == role)
    both = one.select("source_id", of("within").alias("w"), of("cross").alias("c")).select("source_id", "c", F.explode("w").alias("w")).select("source_id", "w", F.explode("c").alias("c"))
    side = lambda role, p: [
        F.col(f"{p}.donor_id").alias(f"{role}_donor"), F.col(f"{p}.d_slide").alias(f"{role}_slide"), F.col(f"{p}.d_physical").alias(f"{role}_physical_id"),
        F.col(f"{p}.distance").alias(f"matching_distance_{role}"), *[F.col(f"{p}.d_z_{c}").alias(f"{p}_z_{c}") for c in features]]
    return _priced(both.select("source_id", F.col("c.d_hospital").alias("target_hospital"), *side("cross", "c"), *side("within", "w")), features, rules)


def _priced(pairs: DataFrame, features: Sequence[str], rules: Rules) -> DataFrame:
    """Pairs of donors that keep the thresholds, with the distance between them and their cost."""
    dw, dc = F.col("matching_distance_within"), F.col("matching_distance_cross")
    valid = (F.abs(dw - dc) <= rules.tau_balance) & (F.col("within_physical_id") != F.col("cross_physical_id"))
    for feature, limit in rules.calipers:
        valid = valid & (F.abs(F.col(f"w_z_{feature}") - F.col(f"c_z_{feature}")) <= limit)
    dp = euclidean(z_columns(features, "w_"), z_columns(features, "c_"))
    return pairs.where(valid).withColumn("matching_distance_pair", dp).withColumn("matching_cost", _cost(dw, dc, F.col("matching_distance_pair"), rules)).drop(
        *[f"{p}_z_{c}" for p in "wc" for c in features])


def _cost(within: Column, cross: Column, pair: Column, rules: Rules) -> Column:
    return F.round(within + cross + rules.lambda_balance * F.abs(within - cross) + rules.lambda_pair * pair, 9)


def _few(rows: dict[str, np.ndarray], z: Sequence[str], k: int) -> np.ndarray:
    """Of a pool the places that a choice of ``k`` pairs can take, where many donors are alike. Donors at one distance with the same z
    form the same pairs at the same cost, which are taken in order of the ids as text: of those that share the physical identity
    too the first k, and of all alike the first 2 k are enough, as k of those before bar no pair that a later one could form."""
    def nth(*keys: np.ndarray) -> np.ndarray:
        """Number of each among those of equal keys, in order of the text."""
        order = np.lexsort((rows["text"], *keys))
        new = np.zeros(len(order), bool)
        new[:1] = True
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        index = np.arange(len(order))
        out = np.empty(len(order), int)
        out[order] = index - np.maximum.accumulate(np.where(new, index, 0))
        return out

    alike = [rows[c] for c in ("distance", *z)]
    places = np.flatnonzero(nth(rows["physical"], *alike) < k)
    rows, alike = {c: v[places] for c, v in rows.items()}, [v[places] for v in alike]
    return places[nth(*alike) < 2 * k]


def _cheap(cost: np.ndarray, k: int, margin: float) -> np.ndarray:
    """Which pairs (rows: within donors, columns: cross donors; inf: none) a greedy choice of ``k`` can take. Of each within donor its k cheapest,
    as k - 1 cross donors are taken at most before. And none above the cost T up to which 2 k - 1 disjoint pairs exist: what is chosen
    up to T can't be extended, so it is at least half as many, and that is k."""
    limit = np.partition(cost, k - 1, axis=1)[:, k - 1 : k] if cost.shape[1] > k else np.full((len(cost), 1), np.inf)
    left, most = cost.copy(), np.inf
    for _ in range(2 * k - 1):
        place = int(left.argmin()) if left.size else 0
        most = left.flat[place] if left.size else np.inf
        if most == np.inf:
            break
        i, j = divmod(place, left.shape[1])
        left[i, :], left[:, j] = np.inf, np.inf
    return (cost <= np.minimum(limit, most) + margin) & (cost < np.inf)


def unit_candidates(pools: DataFrame, features: Sequence[str], rules: Rules, targets: Sequence[int]) -> DataFrame:
    """A row for each target hospital and source for which a donor was found: counts for the ledger, and ``pairs``, those of ``pair_candidates`` that
    the uncapped choice of ``rules.k`` pairs without a demand on slides can take. The pools of a source are one row, and
    the product of two of them is a matrix of one vectorised step; few pairs leave it, and these are priced again by ``unit_choice``."""
    z = [f"d_z_{c}" for c in features]
    columns = ["donor_id", "d_slide", "d_physical", "distance", *z]
    listed = F.collect_list(F.struct("role", "d_hospital", F.col("donor_id").cast("string").alias("text"), *columns))  # at most rules.pool for each role and hospital
    kinds = dict(pools.dtypes)
    counts = [f"{c}_{s}" for s in "wc" for c in ("n", "near", "slides")]
    names = {"donor_id": "donor", "d_slide": "slide", "d_physical": "physical_id", "distance": "distance"}
    fields = [(f"{role}_{names[c]}" if c in names else f"{p}_{c[2:]}", kinds[c], c) for role, p in (("cross", "c"), ("within", "w")) for c in columns]
    schema = f"source_id {kinds['source_id']}, target_hospital {kinds['d_hospital']}, {', '.join(f'{c} long' for c in counts)}, pairs array<struct<{', '.join(f'{n}: {t}' for n, t, _ in fields)}>>"
    margin = 4e-9 * (1 + rules.lambda_pair)  # more than what rounding to nine digits moves
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def choose(batches):
        for batch in batches:
            lists = batch.column("pool")
            flat, edges = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            number = lambda c: flat.field(c).to_numpy(zero_copy_only=False)  # noqa: E731,B023
            coded = lambda c: flat.field(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)  # noqa: E731,B023
            told = {c: number(c) for c in ("distance", *z)} | {"physical": coded("d_physical"), "text": pc.rank(flat.field("text"), tiebreaker="dense").to_numpy().astype(np.int64)}
            slides, hospitals, within = coded("d_slide"), number("d_hospital"), pc.equal(flat.field("role"), "within").to_numpy(zero_copy_only=False)
            head, counted, sizes, taken = [], [], [0], ([], [])
            for i in range(batch.num_rows):
                own = np.arange(edges[i], edges[i + 1])

                def side(places):
                    """(n, near, slides) of a pool, and of its places those that pairs are made of."""
                    near = places[told["distance"][places] <= rules.tau_distance]  # noqa: B023
                    unlike, known = np.unique(slides[near]), near[told["physical"][near] >= 0]  # noqa: B023
                    return (len(places), len(near), int((unlike >= 0).sum())), known[_few({c: v[known] for c, v in told.items()}, z, rules.k)]  # noqa: B023

                here = side(own[within[own]])
                for target in targets:
                    there = side(own[~within[own] & (hospitals[own] == target)])
                    w, c = here[1], there[1]
                    dw, dc = told["distance"][w][:, None], told["distance"][c][None, :]
                    pw, pc_ = told["physical"][w][:, None], told["physical"][c][None, :]
                    valid = (np.abs(dw - dc) <= rules.tau_balance) & (pw != pc_)
                    for feature, limit in rules.calipers:
                        valid &= np.abs(told[f"d_z_{feature}"][w][:, None] - told[f"d_z_{feature}"][c][None, :]) <= limit
                    apart = sum((told[n][w][:, None] - told[n][c][None, :]) ** 2 for n in z)
                    cost = np.where(valid, dw + dc + rules.lambda_balance * np.abs(dw - dc) + rules.lambda_pair * np.sqrt(apart), np.inf)
                    rows, at = np.nonzero(_cheap(cost, rules.k, margin))
                    taken[0].append(c[at])
                    taken[1].append(w[rows])
                    head.append((i, target))
                    counted.append((*here[0], *there[0]))
                    sizes.append(len(rows))
            if not head:
                continue
            cross, own = (pa.array(np.concatenate(t)) for t in taken)
            per = len(columns)
            pair = pa.StructArray.from_arrays([flat.field(c).take(cross if n < per else own) for n, (_, _, c) in enumerate(fields)], fields=list(arrow.field("pairs").type.value_type))
            pairs = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pair, type=arrow.field("pairs").type)
            yield pa.RecordBatch.from_arrays([
                batch.column("source_id").take(pa.array([i for i, _ in head])), pa.array([t for _, t in head], arrow.field("target_hospital").type),
                *[pa.array([c[n] for c in counted], pa.int64()) for n in range(len(counts))], pairs], schema=arrow)

    return pools.groupBy("source_id").agg(listed.alias("pool")).mapInArrow(choose, schema)


def _field(rows: Column, name: str) -> Column:
    return F.transform(rows, lambda r: r[name])


def greedy_pairs(pairs: DataFrame, k: int, min_slides: int = 1) -> DataFrame:
    """GRD-1 without caps: per source and target k times the cheapest pair whose donors are both
    new, ordered by (cost, within, cross) with ids as text; donor_index from 0. While fewer than
    ``min_slides`` slides are used on a side, a pair must bring a new one. Sources with fewer than
    k pairs keep what they have.

    The pairs of a source and target, at most the product of its two pools, are sorted in one
    array and folded once; only chosen pairs leave the row.
    """
    keys = ["source_id", "target_hospital"]
    rest = [c for c in pairs.columns if c not in keys]
    grouped = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(_ordered(F.struct(*rest)))).alias("sorted"))
    kind = dict(pairs.select(F.array(F.struct(*rest)).alias("p")).dtypes)["p"]
    return grouped.select(*keys, F.posexplode(_greedy(F.col("sorted"), kind, k, min_slides)).alias("donor_index", "pair")).select(*keys, "pair.*", "donor_index")


def _ordered(p: Column) -> Column:
    return F.struct(p["matching_cost"].alias("o1"), p["within_donor"].cast("string").alias("o2"), p["cross_donor"].cast("string").alias("o3"), p.alias("pair"))


def _greedy(ordered: Column, kind: str, k: int, min_slides: int = 1) -> Column:
    def step(chosen: Column, item: Column) -> Column:
        p = item["pair"]
        free = ~F.exists(chosen, lambda c: (c["within_donor"] == p["within_donor"]) | (c["cross_donor"] == p["cross_donor"]))
        if min_slides > 1:
            for side in ("within_slide", "cross_slide"):
                used = _field(chosen, side)
                free = free & ((F.size(F.array_distinct(used)) >= min_slides) | ~F.array_contains(used, p[side]))
        return F.when((F.size(chosen) < k) & free, F.concat(chosen, F.array(p))).otherwise(chosen)

    return F.aggregate(ordered, F.array().cast(kind), step)


def unit_choice(units: DataFrame, features: Sequence[str], rules: Rules) -> DataFrame:
    """``unit_candidates`` with ``chosen`` in the place of ``pairs``: the greedy choice of ``greedy_pairs``, in the row."""
    plain = [f"{role}_{c}" for role in ("cross", "within") for c in ("donor", "slide", "physical_id")] + ["matching_distance_cross", "matching_distance_within"]
    told = {c: (f"{c[18:]}_distance" if c.startswith("matching") else c) for c in plain}

    def apart(p: Column) -> Column:
        pair = euclidean([p[f"w_z_{c}"] for c in features], [p[f"c_z_{c}"] for c in features])
        return F.struct(*[p[told[c]].alias(c) for c in plain], pair.alias("matching_distance_pair"))

    def priced(p: Column) -> Column:
        cost = _cost(p["matching_distance_within"], p["matching_distance_cross"], p["matching_distance_pair"], rules)
        return F.struct(*[p[c].alias(c) for c in (*plain, "matching_distance_pair")], cost.alias("matching_cost"))

    shaped = units.withColumn("pairs", F.transform(F.transform("pairs", apart), priced))
    kind = dict(shaped.dtypes)["pairs"]
    return shaped.withColumn("chosen", _greedy(F.array_sort(F.transform("pairs", _ordered)), kind, rules.k)).drop("pairs")


def ledger(sources: DataFrame, pools: DataFrame, chosen: DataFrame, rules: Rules, targets: Sequence[int]) -> DataFrame:
    """One row per source and target: accepted, or excluded for the first reason that applies."""
    near = F.col("distance") <= rules.tau_distance
    counted = pools.groupBy("source_id", "role", "d_hospital").agg(
        F.count("*").alias("n"), F.count_if(near).alias("near"), F.count_distinct(F.when(near, F.col("d_slide"))).alias("slides"))
    columns = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("n", "near", "slides")]
    within = counted.where("role = 'within'").select("source_id", *columns("w"))
    cross = counted.where("role = 'cross'").select("source_id", F.col("d_hospital").alias("target_hospital"), *columns("c"))
    got = chosen.groupBy("source_id", "target_hospital").agg(F.count("*").alias("pairs"))
    rows = with_targets(sources, targets).join(within, "source_id", "left").join(cross, ["source_id", "target_hospital"], "left").join(got, ["source_id", "target_hospital"], "left")
    return _told(rows, rules)


def _told(rows: DataFrame, rules: Rules) -> DataFrame:
    """Sources and targets with counts of both pools and of the pairs chosen, null as none -> the ledger."""
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    reason = (
        F.when(none("n_w"), "no_within_candidate").when(none("n_c"), "no_cross_candidate")
        .when(none("near_w") | none("near_c"), "distance_threshold")
        .when(F.least("slides_w", "slides_c") < rules.min_slides, "insufficient_donor_slide_diversity")
        .when(F.coalesce(F.col("pairs"), F.lit(0)) < rules.k, "insufficient_balanced_pairs")
    )
    return rows.select(
        "source_id", F.col("split").alias("source_split"), F.col("hospital_id").alias("source_hospital"), "target_hospital",
        F.when(reason.isNull(), "accepted").otherwise("excluded").alias("coverage_status"), reason.alias("exclusion_reason"))


def match(sources: DataFrame, bank: DataFrame, features: Sequence[str], rules: Rules, targets: Sequence[int], size: int = cells.SIZE) -> tuple[DataFrame, DataFrame]:
    """Balanced matching without caps -> (triplets, ledger); with caps see ``allocator``."""
    require_columns(bank, ["source_id", "hospital_id", "label", "split", "physical_id", "slide_id"], "donor bank")
    pools = nearest(requests(sources, targets), bank, features, rules.pool, size=size)
    if rules.min_slides == 1:
        units = stored(unit_choice(unit_candidates(pools, features, rules, targets), features, rules), "units")
        full = units.where(F.size("chosen") == rules.k)
        whole = full.select("source_id", "target_hospital", F.posexplode("chosen").alias("donor_index", "pair")).select("source_id", "target_hospital", "pair.*", "donor_index")
        counts = units.withColumn("pairs", F.size("chosen")).drop("chosen")
        return finish(whole, sources), _told(with_targets(sources, targets).join(counts, ["source_id", "target_hospital"], "left"), rules)
    pools = stored(pools, "pools")
    chosen = greedy_pairs(pair_candidates(sources, pools, features, rules, targets), rules.k, rules.min_slides)
    full = Window.partitionBy("source_id", "target_hospital")
    whole = chosen.withColumn("_n", F.count("*").over(full)).where(F.col("_n") == rules.k).drop("_n")
    return finish(whole, sources), ledger(sources, pools, chosen, rules, targets)


def finish(chosen: DataFrame, sources: DataFrame) -> DataFrame:
    """Add the source's columns; triplet_id names source, target and pair, and needs no order."""
    s = sources.select(
        "source_id", F.col("split").alias("source_split"), F.col("hospital_id").alias("source_hospital"), F.col("slide_id").alias("source_slide"),
        F.col("patient_id").alias("source_patient"), F.col("physical_id").alias("source_physical_id"), "label")
    key = F.format_string("t%d-%d-%d", F.col("source_id"), F.col("target_hospital"), F.col("donor_index"))
    return chosen.join(s, "source_id").select(
        key.alias("triplet_id"), "source_id", "source_split", "source_hospital", "target_hospital", "source_slide", "source_patient", "source_physical_id", "label",
        "within_donor", "within_slide", "within_physical_id", "cross_donor", "cross_slide", "cross_physical_id",
        "matching_distance_within", "matching_distance_cross", "matching_distance_pair", "matching_cost", "donor_index")


def reuse_capacity(sources: DataFrame, bank: DataFrame, targets: Mapping[str, Sequence[int]], k: int, donor_cap: int, slide_cap: int, prior: DataFrame | None = None) -> DataFrame:
    """CAP-2: required and available donor uses, globally and per hospital. ``prior`` has
    (donor_id, slide_id) of earlier uses, which count against the caps."""
    spark = sources.sparkSession
    listed = spark.createDataFrame([(s, t) for s, ts in targets.items() for t in ts], "split string, target int")
    counts = sources.groupBy("split", "hospital_id").agg(F.count("*").alias("n"))
    wanted = counts.join(F.broadcast(listed), "split").where("target <> hospital_id")
    uses = wanted.select(F.explode(F.array("hospital_id", "target")).alias("hospital_id"), (F.col("n") * k).alias("uses"))
    demand = uses.groupBy("hospital_id").agg(F.sum("uses").alias("required"))
    if prior is None:
        prior = bank.select(F.col("source_id").alias("donor_id"), "slide_id").limit(0)
    by_donor = prior.groupBy(F.col("donor_id").alias("source_id")).agg(F.count("*").alias("used"))
    by_slide = prior.groupBy("slide_id").agg(F.count("*").alias("slide_used"))
    left = bank.join(by_donor, "source_id", "left").withColumn("left", F.greatest(F.lit(donor_cap) - F.coalesce("used", F.lit(0)), F.lit(0)))

    def capacity(keys: list[str]) -> DataFrame:
        per = left.groupBy(*keys, "slide_id").agg(F.sum("left").alias("left")).join(by_slide, "slide_id", "left")
        room = F.greatest(F.lit(slide_cap) - F.coalesce("slide_used", F.lit(0)), F.lit(0))
        return per.groupBy(*keys).agg(F.sum(F.least("left", room)).alias("available"))

    hospital = capacity(["hospital_id"]).join(demand, "hospital_id", "left").select(
        F.lit("hospital").alias("scope"), "hospital_id", F.coalesce("required", F.lit(0)).alias("required_donor_uses"), F.col("available").alias("available_donor_uses"))
    total = capacity([]).crossJoin(demand.agg(F.coalesce(F.sum("required"), F.lit(0)).alias("required"))).select(
        F.lit("global").alias("scope"), F.lit(None).cast("int").alias("hospital_id"), F.col("required").alias("required_donor_uses"), F.col("available").alias("available_donor_uses"))
    return hospital.unionByName(total).withColumn("feasible", F.col("required_donor_uses") <= F.col("available_donor_uses"))


#: Rounds of the permutation that sources draw by.
FEISTEL = 4


def keyed_permutation(j: Column, width: Column, *key: Column | str | int) -> Column:
    """The place of ``j`` in a permutation of 0 .. 4^width - 1 that the key chooses: a Feistel network whose round functions are
    hash numbers. Places of different j are different."""
    side = F.pow(F.lit(2), width).cast("long")
    left, right = F.floor(j / side).cast("long"), (j % side).cast("long")
    for round_ in range(FEISTEL):
        left, right = right, left.bitwiseXOR(F.floor(uniform(*key, round_, right) * side).cast("long"))
    return left * side + right


def random_pairs(sources: DataFrame, bank: DataFrame, targets: Sequence[int], k: int, seed: int) -> DataFrame:
    """LAD-1: k random donors of each role without replacement; only full sets stay.

    Donors are numbered once in each group, in hash order. A request draws numbers j = 0, 1, 2, ... and meets the donors at
    the places that its own permutation gives them; places beyond the group, its own id and its own identity are drawn over.
    Few rounds of equality joins on (group, place), each over twice the draws of the one before for those requests that still
    lack donors, end at the latest when a group is exhausted. So rows are linear in requests, whatever a group's size."""
    keys = ["d_hospital", "label", "d_split"]
    d = bank.select(F.col("hospital_id").alias("d_hospital"), "label", F.col("split").alias("d_split"), F.col("source_id").alias("donor_id"), F.col("physical_id").alias("d_physical"))
    d = ranked(d.withColumn("_h", hash_order(seed, F.col("donor_id"))), ["_h", "donor_id"], hash_bucket(F.col("_h")), "place", keys).drop("_h")
    d = stored(d, "numbered")
    width = F.floor((F.length(F.bin(F.col("n") - 1)) + 1) / 2).cast("int")
    sizes = d.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("width", width)
    asked = requests(sources, targets).select("source_id", "physical_id", "role", *keys).join(sizes, keys).withColumn("last", F.pow(F.lit(4), F.col("width")).cast("long") - 1)
    request = ["source_id", "role", "d_hospital"]
    open_, done, start, draws = stored(asked, "asked"), None, 0, 8 * k
    while True:
        j = F.sequence(F.lit(start).cast("long"), F.least(F.lit(start + draws - 1).cast("long"), F.col("last")))
        place = keyed_permutation(F.col("j"), F.col("width"), seed, F.col("source_id"), F.col("role"), F.col("d_hospital"))
        drawn = open_.select("*", F.explode(j).alias("j")).withColumn("place", place).where(F.col("place") < F.col("n"))
        good = (F.col("d_physical") != F.col("physical_id")) & (F.col("donor_id") != F.col("source_id"))
        found = stored(drawn.join(d, [*keys, "place"]).where(good).select(*request, "donor_id", "j"), "drawn")
        done = found if done is None else done.unionByName(found)
        start, draws = start + draws, 2 * draws
        served = done.groupBy(*request).agg(F.count("*").alias("got")).where(F.col("got") >= k)
        open_ = stored(open_.where(F.col("last") >= start).join(served, request, "left_anti"), "asked")
        if open_.isEmpty():
            break
    w = Window.partitionBy(*request).orderBy("j")
    drawn = done.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return _paired(drawn, sources, targets, k, [])


def independent_nearest(sources: DataFrame, bank: DataFrame, features: Sequence[str], targets: Sequence[int], k: int) -> DataFrame:
    """LAD-2: the k nearest of each role, independently; ties by the id as it is, no thresholds."""
    return _paired(nearest(requests(sources, targets), bank, features, k, by_string=False), sources, targets, k, ["distance"])


def _paired(ranked: DataFrame, sources: DataFrame, targets: Sequence[int], k: int, extra: list[str]) -> DataFrame:
    side = lambda role: ranked.where(F.col("role") == role).select(
        "source_id", "rank", *([F.col("d_hospital").alias("target_hospital")] if role == "cross" else []), F.col("donor_id").alias(f"{role}_donor"),
        *[F.col(c).alias(f"matching_{c}_{role}") for c in extra])
    both = side("cross").join(side("within"), ["source_id", "rank"])
    full = Window.partitionBy("source_id", "target_hospital")
    s = sources.select("source_id", F.col("split").alias("source_split"), F.col("hospital_id").alias("source_hospital"), "label")
    return both.withColumn("_n", F.count("*").over(full)).where(F.col("_n") == k).join(s, "source_id").select(
        "source_id", "source_split", "source_hospital", "target_hospital", "label", "within_donor", "cross_donor",
        *[f"matching_{c}_{r}" for c in extra for r in ("within", "cross")], (F.col("rank") - 1).alias("donor_index"))


def identity_level(triplets: DataFrame) -> DataFrame:
    """LAD-3, level 1: the within donor is the source itself."""
    return triplets.withColumns({"within_donor": F.col("source_id"), "within_slide": F.col("source_slide"), "within_physical_id": F.col("source_physical_id"),
                                 "matching_distance_within": F.lit(0.0)})


def level_status(spark, level: int, available: Sequence[str], required: Sequence[str]) -> DataFrame:
    """LAD-3, levels 5 and 6: never looks like success."""
    if level not in (5, 6):
        raise ValueError("only levels 5 and 6 have a status row")
    missing = sorted(set(required) - set(available))
    status = "unavailable" if missing else "not_implemented"
    reason = f"missing columns: {', '.join(missing)}" if missing else "matching policy is not implemented"
    return spark.createDataFrame([(level, status, reason)], "level int, status string, reason string")
