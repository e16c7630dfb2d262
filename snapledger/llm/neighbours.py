"""Near-duplicate vectors by NN-descent.

Vectors are compared by cosine, only inside a group (an equal label, and equal dimension). The steps:

1. Equal vectors become one. Vectors whose angle to a common centre is at most half the link angle form a ball: inside a ball all
   vectors link, by the triangle inequality on the sphere, so tight groups of any size are one node and make no pairs.
2. Neighbour lists of the ball centres start from random projections: centres on the same side of several random planes are compared.
3. NN-descent: everything that lists a centre, or is listed by it, meets there; every member learns the best of the others; lists keep the
   nearest. A list whose last entry could still link is saturated and is enlarged. This repeats until hardly any centre gains a link.
4. The recall of possible links is audited by centre: queries drawn by hash are compared with all centres. While it is below the goal,
   descent goes on with longer lists and more projections; if the rounds end below it, the groups in which the audit missed a link
   are compared exactly, block by block. That takes time with the square of a group's centres.
5. Pairs of balls that must link as a whole are counted by weight; pairs that may link are compared vector by vector, in blocks.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors without a label, link with nothing and are
their own component. Repeated rows are vectors of their own that link with each other. A null id never names a component if there is
another id. An empty table gives no rows. The number of links is that of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from snapledger.llm.common import cut
from snapledger.llm.components import components

LEAF = 128  # centres that a leaf of a projection holds on average
CHUNK = 384  # vectors compared at a time; larger leaves and meeting places are split by hash
LIST = 8  # neighbours per list at first
STRATA = [3, 11, 101]  # numbers of links at which another stratum of the audit begins
BLOCK = 1024  # centres on a side of an exact comparison
EPS = 1e-9
PLANES = 24


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _planes(seed: int):
    """Which side of ``PLANES`` random planes a vector lies on, as bits."""

    def side(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors), np.int64)
        rows = vectors.to_pylist()
        by_size: dict[int, list[int]] = {}
        for k, v in enumerate(rows):
            by_size.setdefault(len(v), []).append(k)
        for size, at in by_size.items():
            normals = np.random.default_rng([seed, size]).normal(size=(size, PLANES))
            bits = _matrix([rows[k] for k in at]) @ normals > 0
            out[at] = bits @ (1 << np.arange(PLANES, dtype=np.int64))
        return pa.array(out)

    return arrow_udf(side, "long")


def _leaves(points: DataFrame, seed: int) -> DataFrame:
    """``points`` (node, grp, vec, ...) with a leaf and a part of it; parts hold about ``CHUNK`` rows at most."""
    sizes = points.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    bits = F.least(F.lit(PLANES), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / LEAF)))).cast("int")
    sizes = cut(sizes.select(F.col("grp").alias("_g"), bits.alias("_bits")))
    coded = points.withColumn("_code", _planes(seed)("vec")).join(sizes, F.col("grp").eqNullSafe(F.col("_g")))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1
    placed = coded.withColumn("leaf", F.xxhash64("grp", F.col("_code").bitwiseAND(mask), F.lit(seed))).drop("_g", "_code", "_bits")
    placed = cut(placed)
    full = cut(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CHUNK).withColumnRenamed("leaf", "_l"))
    joined = placed.join(full, F.col("leaf") == F.col("_l"), "left")
    parts = F.ceil(F.coalesce("_n", F.lit(1)) / CHUNK).cast("int")
    return joined.withColumn("part", F.pmod(F.xxhash64("node", F.lit(seed)), parts).cast("int")).drop("_l", "_n")


def _make_balls(link_angle: float):
    half = math.cos(link_angle / 2 - EPS)
    seed_cos = math.cos(link_angle / 2)

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        u, weight = _matrix(rows["vec"]), rows["weight"].to_numpy()
        near = u @ u.T >= seed_cos
        free = np.ones(len(u), bool)
        ball = np.zeros(len(u), np.int64)
        centre: list = [None] * len(u)
        radius, total = np.zeros(len(u)), np.zeros(len(u), np.int64)
        for k in np.argsort(-near.sum(1), kind="stable"):
            if not free[k]:
                continue
            members = np.flatnonzero(near[k] & free)
            if len(members) > 1:
                c = u[members].sum(0)
                c /= np.linalg.norm(c)
                members = members[u[members] @ c >= half]
            if len(members) < 2:
                members, c = np.array([k]), u[k]
            free[members] = False
            head = members[0]
            ball[members] = rows["node"].iloc[head]
            centre[head] = c
            total[head] = weight[members].sum()
            # A little more than measured, so that rounding cannot make it too small.
            radius[head] = 0.0 if len(members) == 1 else math.acos(max(-1.0, min(1.0, float((u[members] @ c).min())))) + EPS
        return pd.DataFrame({"node": rows["node"], "ball": ball, "centre": centre, "radius": radius, "total": total})

    return make, "node long, ball long, centre array<double>, radius double, total long"


def _nearest(size: int):
    """Best ``size`` others of every row of a group, as (u, v, cos)."""

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        u, ids = _matrix(rows["vec"]), rows["node"].to_numpy()
        cos = u @ u.T
        np.fill_diagonal(cos, -2)
        k = min(size, len(ids) - 1)
        if k < 1:
            return pd.DataFrame({"u": [], "v": [], "cos": []})
        at = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"u": np.repeat(ids, k), "v": ids[at].ravel(), "cos": np.take_along_axis(cos, at, 1).ravel()})

    return best, "u long, v long, cos double"


def _meet(best: int, chunk: int, angle: float):
    """What the members of each meeting place learn of each other, over sorted Arrow batches of (at, node, vec, radius).

    Every member learns of its ``best`` nearest, and of all with which it may have a link.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            if table.num_rows < 4096:
                continue
            at = table["at"].to_numpy()
            cutoff = int(np.searchsorted(at, at[-1]))  # the last place may go on in the next batch
            if cutoff:
                yield from done(table.slice(0, cutoff))
                held = table.slice(cutoff).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    def done(table: pa.Table):
        at, ids, radius = table["at"].to_numpy(), table["node"].to_numpy(), table["radius"].to_numpy()
        flat = table["vec"].combine_chunks()
        values, offsets = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
        edges = np.flatnonzero(np.diff(at)) + 1
        us, vs, cs = [], [], []
        for lo, hi in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(at)]])):
            for a in range(lo, hi, chunk):
                b = min(hi, a + chunk)
                n = b - a
                if n < 2:
                    continue
                x = values[offsets[a] : offsets[b]].reshape(n, -1)
                cos = x @ x.T
                np.fill_diagonal(cos, -2)
                k = min(best, n - 1)
                told = np.zeros((n, n), bool)
                np.put_along_axis(told, np.argpartition(-cos, k - 1, axis=1)[:, :k], True, 1)
                r = radius[a:b]
                told |= cos >= np.cos(np.minimum(np.pi, angle + r[:, None] + r[None]))
                i, j = np.nonzero(told)
                us.append(ids[a:b][i])
                vs.append(ids[a:b][j])
                cs.append(cos[i, j])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, cs)], names=["u", "v", "cos"])

    return run


def _lists(pairs: DataFrame, size: DataFrame) -> DataFrame:
    """The nearest entries of every node's list, as many as its list is long: rows (u, v, cos)."""
    found = pairs.groupBy("u").agg(F.sort_array(F.collect_set(F.struct((-F.col("cos")).alias("d"), "v"))).alias("all"))
    kept = found.join(size, F.col("u") == F.col("node")).select("u", F.explode(F.slice("all", F.lit(1), F.col("room"))).alias("e"))
    return kept.select("u", F.col("e.v").alias("v"), (-F.col("e.d")).alias("cos"))


def _possible(lists: DataFrame, balls: DataFrame, angle: float) -> DataFrame:
    """Pairs of balls that may hold a link: (a, b, cos, ra, rb, wa, wb), each once."""
    pairs = lists.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "cos").groupBy("a", "b").agg(F.max("cos").alias("cos"))
    left = balls.select(F.col("node").alias("_a"), F.col("radius").alias("ra"), F.col("total").alias("wa"))
    right = balls.select(F.col("node").alias("_b"), F.col("radius").alias("rb"), F.col("total").alias("wb"))
    near = pairs.filter(F.col("cos") >= math.cos(min(math.pi, 2 * angle)) - EPS)  # radii are at most half the angle
    joined = near.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).drop("_a", "_b")
    return joined.filter(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "cos"))) <= F.lit(angle + EPS) + F.col("ra") + F.col("rb"))


def _audit(balls: DataFrame, possible: DataFrame, angle: float, queries: int, count: int) -> tuple[float, list[str]]:
    """Recall of the possible links of ``queries`` centres, drawn by hash, and the groups in which one was missed.

    Queries are compared with all centres. Each queried centre counts once, whatever its number of links; centres with few links are
    averaged by themselves, and the lowest of the averages is the recall.
    """
    draw = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 20)) < F.lit(int(min(1.0, queries / count) * (1 << 20)) + 1)
    asked = balls.filter(draw).select("node", "grp", "vec", "radius").toPandas()  # about ``queries`` rows
    if asked.empty:
        return 1.0, []
    groups = {g: (part["node"].to_numpy(), _matrix(part["vec"]), part["radius"].to_numpy()) for g, part in asked.groupby("grp")}

    def compare(batches):
        for batch in batches:
            rows = batch.to_pandas()
            us, vs = [], []
            for g, part in rows.groupby("grp"):
                if g not in groups:
                    continue
                ids, q, r = groups[g]
                gap = np.arccos(np.clip(q @ _matrix(part["vec"]).T, -1, 1))
                hit = (gap <= angle + r[:, None] + part["radius"].to_numpy()[None]) & (ids[:, None] != part["node"].to_numpy()[None])
                i, j = np.nonzero(hit)
                us.append(ids[i])
                vs.append(part["node"].to_numpy()[j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["q", "o"])

    truth = balls.select("node", "grp", "vec", "radius").mapInArrow(compare, "q long, o long")
    truth = truth.select("q", F.least("q", "o").alias("a"), F.greatest("q", "o").alias("b"))
    hits = truth.join(possible.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    per = hits.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("k")).toPandas()  # a row per query
    if per.empty:
        return 1.0, []
    share = per["k"] / per["n"]
    recall = share.groupby(np.digitize(per["n"], STRATA)).mean().min()
    missed = set(per["q"][per["k"] < per["n"]])
    return float(recall), sorted(set(asked["grp"][asked["node"].isin(missed)]))


def _exact(balls: DataFrame, angle: float) -> DataFrame:
    """All pairs of centres of a group that may hold a link, as (u, v, cos), compared block by block."""
    sizes = balls.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")).withColumnRenamed("grp", "_g")
    placed = balls.select("node", "grp", "vec", "radius").join(sizes, F.col("grp") == F.col("_g"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("_blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("grp", "node", "vec", "radius", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        one, two = rows[rows["block"] == low], rows[rows["block"] == high]
        if one.empty or two.empty:
            return pd.DataFrame({"u": [], "v": [], "cos": []})
        a, b = one["node"].to_numpy(), two["node"].to_numpy()
        cos = _matrix(one["vec"]) @ _matrix(two["vec"]).T
        least = np.cos(np.minimum(np.pi, angle + one["radius"].to_numpy()[:, None] + two["radius"].to_numpy()[None]))
        i, j = np.nonzero((cos >= least) & ((a[:, None] < b[None]) | (low != high)))
        return pd.DataFrame({"u": a[i], "v": b[j], "cos": cos[i, j]})

    return dealt.groupBy("grp", "low", "high").applyInPandas(compare, "u long, v long, cos double")


def _starts(largest: int, angle: float, least: int) -> int:
    """Projections after which a pair at the link angle has met in a leaf with probability 0.95, at most 24."""
    planes = min(PLANES, max(0, math.ceil(math.log2(max(1, largest) / LEAF))))
    together = (1 - angle / math.pi) ** planes
    return least if together >= 0.95 else max(least, min(24, math.ceil(math.log(0.05) / math.log(1 - together))))


def descend(balls: DataFrame, angle: float, room: int = LIST, goal: float = 0.99, max_rounds: int = 12, queries: int = 400, starts: int = 3) -> DataFrame:
    """Possible links of ``balls`` (node, grp, vec, radius, total) by NN-descent, audited; groups that fail the audit are compared exactly."""
    count = balls.count()
    best, kind = _nearest(room)
    largest = balls.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    starts = _starts(largest, angle, starts)

    def projected(seed: int) -> DataFrame:
        return _leaves(balls.select("node", "grp", "vec"), seed).groupBy("leaf", "part").applyInPandas(best, kind)

    pairs = projected(1)
    for seed in range(2, starts + 1):
        pairs = pairs.unionByName(projected(seed))
    size = balls.select("node", F.lit(room).alias("room"))
    lists = cut(_lists(pairs, size))
    possible = cut(_possible(lists, balls, angle))
    vectors = balls.select(F.col("node").alias("_n"), F.transform("vec", lambda x: x.cast("float")).alias("vec"), "radius")
    reach = balls.select(F.col("node").alias("_n"), (F.lit(1.5 * angle) + F.col("radius")).alias("reach"))
    for round_no in range(max_rounds):
        both = lists.select("u", "v").unionByName(lists.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        own = lists.select("u").distinct().select("u", F.col("u").alias("v"))
        visits = both.unionByName(own)  # v meets the others at u
        crowd = cut(visits.groupBy("u").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 64).withColumnRenamed("u", "_c"))
        rooms = F.ceil(F.coalesce("m", F.lit(1)) / 64).cast("int")
        spread = visits.join(crowd, F.col("u") == F.col("_c"), "left")
        place = F.xxhash64("u", F.pmod(F.xxhash64("v", F.lit(round_no)), rooms))
        carried = spread.select(place.alias("at"), F.col("v").alias("node")).join(vectors, F.col("node") == F.col("_n")).select("at", "node", "vec", "radius")
        met = carried.repartition("at").sortWithinPartitions("at").mapInArrow(_meet(3, CHUNK, angle + 1e-3), "u long, v long, cos float")
        # Lists whose last entry could still link are saturated: they get twice the room.
        last = lists.groupBy("u").agg(F.min("cos").alias("low"), F.count(F.lit(1)).alias("n"))
        roomy = size.join(last, F.col("node") == F.col("u"), "left").join(reach, F.col("node") == F.col("_n"))
        saturated = (F.col("n") >= F.col("room")) & (F.acos(F.least(F.lit(1.0), "low")) <= F.col("reach"))
        size = cut(roomy.select("node", F.when(saturated, 2 * F.col("room")).otherwise(F.col("room")).alias("room")))
        fresh = lists.unionByName(met.select("u", "v", F.col("cos").cast("double").alias("cos")))
        # One distance per pair: those met again in single precision must not stand beside the first.
        fresh = fresh.groupBy("u", "v").agg(F.max("cos").alias("cos"))
        lists = cut(_lists(fresh, size))
        before, possible = possible, cut(_possible(lists, balls, angle + 1e-3))  # single precision may be off by this
        gained = possible.join(before.select("a", "b"), ["a", "b"], "left_anti").select(F.explode(F.array("a", "b"))).distinct().count()
        if gained <= 0.001 * count:
            recall, _ = _audit(balls, possible, angle, queries, count)
            if recall >= goal:
                return possible
            size = cut(size.select("node", (F.col("room") + room).alias("room")))
            # Other projections bring together what no list leads to.
            starts += 1
            lists = cut(_lists(lists.unionByName(projected(starts)).groupBy("u", "v").agg(F.max("cos").alias("cos")), size))
    recall, missed = _audit(balls, possible, angle, queries, count)
    if recall >= goal:
        return possible
    whole = _exact(balls.filter(F.col("grp").isin(missed)), angle + 1e-3)
    return cut(_possible(lists.unionByName(whole), balls, angle + 1e-3))


def _compare(threshold: float):
    """Links between the two sides of a block: rows (node, found)."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if a.empty or b.empty:
            return pd.DataFrame({"node": [], "found": [], "a": [], "b": []})
        link = _matrix(a["vec"]) @ _matrix(b["vec"]).T >= threshold
        nodes = np.concatenate([a["node"], b["node"]])
        found = np.concatenate([link @ b["weight"].to_numpy(), a["weight"].to_numpy() @ link])
        out = pd.DataFrame({"node": nodes, "found": found.astype(np.int64)})
        out["a"], out["b"] = rows["a"].iloc[0], rows["b"].iloc[0]
        return out[out["found"] > 0]

    return compare, "node long, found long, a long, b long"


def near_vectors(
    df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", **options
) -> DataFrame:
    """Rows (id, n_links, component) for every row of the input."""
    angle = math.acos(threshold)
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("label"), vec.alias("raw"))
    # null, NaN and infinite components all make the sum of squares unusable
    square = F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x)
    good = F.col("label").isNotNull() & (square > 0) & (square < float("inf")) & ~F.isnan(square)
    rows = rows.withColumn("norm", F.when(good, F.sqrt(square)))
    unit = F.when(F.col("norm").isNotNull(), F.transform("raw", lambda x: x / F.col("norm")))
    rows = rows.select("id", F.concat_ws(":", F.size("raw").cast("string"), "label").alias("grp"), unit.alias("vec"))
    rows = rows.withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("grp", "vec")))
    rows = cut(rows)
    points = cut(
        rows.filter("vec is not null").groupBy("node", "grp", "vec").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
    )
    make, kind = _make_balls(angle)
    placed = cut(_leaves(points.select("node", "grp", "vec", "weight"), 0).groupBy("leaf", "part").applyInPandas(make, kind))
    members = cut(placed.select(F.col("node").alias("_m"), "ball").join(points, F.col("_m") == F.col("node")).drop("_m"))
    grp = members.filter("node = ball").select(F.col("node").alias("_b"), "grp")
    heads = placed.filter(F.col("centre").isNotNull()).select(F.col("ball").alias("node"), F.col("centre").alias("vec"), "radius", "total")
    balls = cut(heads.join(grp, F.col("node") == F.col("_b")).drop("_b"))
    if balls.isEmpty():
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    possible = descend(balls, angle, **options)
    gap = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "cos")))
    surely = gap + F.col("ra") + F.col("rb") <= F.lit(angle - 1e-3)
    whole = possible.filter(surely)
    ball_links = cut(
        whole.select(F.col("a").alias("ball"), F.col("wb").alias("more")).unionByName(whole.select(F.col("b").alias("ball"), F.col("wa").alias("more")))
        .groupBy("ball").agg(F.sum("more").alias("more")).withColumnRenamed("ball", "_b")
    )
    found = cut(_members_compared(possible.filter(~surely), members, threshold))
    own = cut(found.groupBy("node").agg(F.sum("found").alias("found")).withColumnRenamed("node", "_f"))
    edges = whole.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        found.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    )
    roots = cut(components(edges).withColumnRenamed("node", "_r"))
    totals = balls.select(F.col("node").alias("_t"), "total")
    # Per distinct vector: the other vectors of its ball, of balls linked as a whole, and those found one by one.
    summed = (
        members.select("node", "ball", "least").join(totals, F.col("ball") == F.col("_t")).join(ball_links, F.col("ball") == F.col("_b"), "left")
        .join(own, F.col("node") == F.col("_f"), "left").join(roots, F.col("ball") == F.col("_r"), "left")
    )
    n_links = F.col("total") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("found", F.lit(0))
    summed = cut(summed.select(F.col("node").alias("_s"), n_links.alias("n_links"), F.coalesce("root", "ball").alias("root"), "least"))
    names = cut(summed.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "_root"))
    named = cut(summed.join(names, F.col("root") == F.col("_root")).select("_s", "n_links", "component"))
    joined = rows.select("id", "node").join(named, F.col("node") == F.col("_s"), "left")
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))


def _members_compared(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Vector-by-vector links of pairs of balls, in blocks of bounded size on either side."""
    held = cut(members.select(F.col("ball").alias("_ball"), "node", "vec", "weight"))
    counts = cut(held.groupBy("_ball").agg(F.count(F.lit(1)).alias("n")))
    left = counts.select(F.col("_ball").alias("_a"), F.ceil(F.col("n") / CHUNK).cast("int").alias("na"))
    right = counts.select(F.col("_ball").alias("_b"), F.ceil(F.col("n") / CHUNK).cast("int").alias("nb"))
    sized = cut(pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).select("a", "b", "na", "nb"))
    one = sized.join(held, F.col("a") == F.col("_ball")).select(
        "a", "b", F.pmod(F.xxhash64("node"), F.col("na")).alias("pa"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("pb"),
        F.lit(0).alias("side"), "node", "vec", "weight",
    )
    two = sized.join(held, F.col("b") == F.col("_ball")).select(
        "a", "b", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("pa"), F.pmod(F.xxhash64("node"), F.col("nb")).alias("pb"),
        F.lit(1).alias("side"), "node", "vec", "weight",
    )
    compare, kind = _compare(threshold)
    one = one.withColumn("pa", F.col("pa").cast("int"))
    two = two.withColumn("pb", F.col("pb").cast("int"))
    return one.unionByName(two).groupBy("a", "b", "pa", "pb").applyInPandas(compare, kind)
