"""Judging measured series against claims, replication across processes, drift.

A series is a table (series_id, x, y); points are ordered by x. Points with a null or
non-finite y or a null x are no points. Verdicts are strings. Guards for NaN stand before
every comparison, since Spark orders NaN above all numbers.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AFFIRMING = ("VERIFIED", "VERIFIED_WITH_CAVEAT")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def points(series: DataFrame) -> DataFrame:
    """The usable points."""
    return series.filter(F.col("x").isNotNull() & _finite(F.col("y")))


def steps(series: DataFrame) -> DataFrame:
    """points with i (0-based), dy, dx of the logs and their local slope to the next point of the series."""
    w = Window.partitionBy("series_id").orderBy("x", "y")
    both = (F.col("x") > 0) & (F.col("y") > 0)
    p = points(series).withColumn("i", F.row_number().over(w) - 1).withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w))
    slope = F.when(both & (F.col("nx") > 0) & (F.col("ny") > 0) & (F.col("nx") != F.col("x")), (F.ln("ny") - F.ln("y")) / (F.ln("nx") - F.ln("x")))
    return p.withColumn("dy", F.col("ny") - F.col("y")).withColumn("slope", slope)


def elasticity(series: DataFrame, low: float, high: float) -> DataFrame:
    """(series_id, slope, verdict): global log-log slope in the band, all local slopes too or with a caveat; a point not above zero flags."""
    g = steps(series).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("x") > 0) & (F.col("y") > 0)).alias("positive"), F.regr_slope(F.when(F.col("y") > 0, F.ln("y")), F.when(F.col("x") > 0, F.ln("x"))).alias("slope"), F.min("slope").alias("lo"), F.max("slope").alias("hi"))
    inside = (F.col("lo") >= low) & (F.col("hi") <= high)
    v = F.when((F.col("n") < 2) | ~F.col("positive") | F.col("slope").isNull(), "FLAGGED").when((F.col("slope") < low) | (F.col("slope") > high), "REFUTED").when(inside, "VERIFIED").otherwise("VERIFIED_WITH_CAVEAT")
    return g.select("series_id", F.round("slope", 6).alias("slope"), v.alias("verdict"))


def direction(series: DataFrame, sign: str = "+") -> DataFrame:
    """(series_id, verdict): the trend from first to last point has the sign, strictly all along or with a caveat; a flat one flags."""
    w = 1 if sign == "+" else -1
    g = steps(series).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("y", "i").alias("first"), F.max_by("y", "i").alias("last"), F.bool_and(F.col("dy") * w > 0).alias("mono"))
    trend = F.col("last") - F.col("first")
    scale = (F.abs("first") + F.abs("last")) / 2
    flat = F.abs(trend) <= 1e-6 * F.when(scale == 0, 1.0).otherwise(scale)
    v = F.when((F.col("n") < 2) | flat, "FLAGGED").when(F.signum(trend) != w, "REFUTED").when(F.col("mono"), "VERIFIED").otherwise("VERIFIED_WITH_CAVEAT")
    return g.select("series_id", v.alias("verdict"))


def optimum(series: DataFrame, sign: str = "+") -> DataFrame:
    """(series_id, at, verdict): strictly better up to the first best point; best at the end verifies, inside with a caveat (also at index 0)."""
    w = 1 if sign == "+" else -1
    s = steps(series)
    best = s.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((F.col("y") * -w).alias("y"), "i"))["i"].alias("at"))
    up = s.join(best, "series_id").groupBy("series_id", "n", "at").agg(F.coalesce(F.bool_and(F.when(F.col("i") < F.col("at"), F.col("dy") * w > 0)), F.lit(True)).alias("rises"))
    v = F.when(F.col("n") < 2, "FLAGGED").when(~F.col("rises"), "REFUTED").when(F.col("at") < F.col("n") - 1, "VERIFIED_WITH_CAVEAT").otherwise("VERIFIED")
    return up.select("series_id", "at", v.alias("verdict"))


def invariance(series: DataFrame, cov_max: float | None = None, spread_max: float | None = None, range_max: float | None = None) -> DataFrame:
    """(series_id, verdict): spread, or else spread over mean, within the bound; a zero mean or no point in range flags.
    A negative mean gives a negative ratio, which passes."""
    g = points(series).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), *(f(F.when(F.col("x") <= range_max, F.col("y")) if range_max is not None else F.col("y")).alias(a) for f, a in ((F.min, "lo"), (F.max, "hi"), (F.avg, "mean"))))
    spread = F.col("hi") - F.col("lo")
    ok = spread <= spread_max if spread_max is not None else spread / F.nullif("mean", F.lit(0.0)) <= cov_max
    v = F.when((F.col("n") < 2) | F.col("lo").isNull(), "FLAGGED")
    v = v if spread_max is not None else v.when(F.col("mean") == 0, "FLAGGED")
    return g.select("series_id", v.when(ok, "VERIFIED").otherwise("REFUTED").alias("verdict"))


def value(measured: DataFrame, tol: float) -> DataFrame:
    """(series_id, verdict): |asserted - measured| within tol; a missing number flags."""
    ok = F.abs(F.col("asserted") - F.col("measured")) <= tol
    return measured.select("series_id", F.when(~(_finite(F.col("asserted")) & _finite(F.col("measured"))), "FLAGGED").when(ok, "VERIFIED").otherwise("REFUTED").alias("verdict"))


def probit(n: int) -> float:
    """The expected extreme of n samples in standard deviations."""
    return NormalDist().inv_cdf(1 - 1 / max(2, n))


def statistical(series: DataFrame, bound: float, k: float | None = None, columns: int | None = None, absolute: bool = True, three_sigma: bool = False) -> DataFrame:
    """(series_id, stat, verdict): k population deviations (over |mean| unless absolute) within the bound; under 8 samples or a zero mean flags."""
    kk = 3.0 if three_sigma else (k or probit(columns or 2))
    g = points(series).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("y").alias("sd"), F.avg("y").alias("mean"))
    stat = F.col("sd") * kk if absolute else F.col("sd") * kk / F.nullif(F.abs("mean"), F.lit(0.0))
    v = F.when((F.col("n") < 8) | stat.isNull(), "FLAGGED").when(stat <= bound, "VERIFIED").otherwise("REFUTED")
    return g.select("series_id", F.round(stat, 6).alias("stat"), v.alias("verdict"))


def corner(series: DataFrame, bound: float, sign: str = "+") -> DataFrame:
    """(series_id, n_failing, verdict): every point, NaN never, on the bound's side; under two points flag."""
    y = F.col("y")
    meets = F.when(y.isNull() | F.isnan(y), False).otherwise(y >= bound if sign == "+" else y <= bound)
    g = series.filter("x is not null").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~meets).alias("n_failing"))
    return g.select("series_id", "n_failing", F.when(F.col("n") < 2, "FLAGGED").when(F.col("n_failing") == 0, "VERIFIED").otherwise("REFUTED").alias("verdict"))


def conditions_complete(kind: Column, corner: Column, temp: Column, vdd: Column) -> Column:
    """Digital conditions always are; analog ones need a corner, a finite temperature and a finite supply."""
    return (kind == "digital") | (F.coalesce(corner != "", F.lit(False)) & _finite(temp) & _finite(vdd))


def teaching(verdict: Column, narrative: Column, hardened: bool = True) -> Column:
    """Certified, and without a narrative if hardened."""
    ok = verdict.isin(*AFFIRMING)
    return ok & (F.coalesce(narrative, F.lit("")) == "") if hardened else ok


def scorecard(claims: DataFrame) -> DataFrame:
    """One row: leak_naive, leak_hardened of injected claims; usefulness_ok and usefulness_total of the others."""
    naive, hard = teaching(F.col("verdict"), F.col("narrative"), False), teaching(F.col("verdict"), F.col("narrative"))
    return claims.agg(F.count_if(F.col("injected") & naive).alias("leak_naive"), F.count_if(F.col("injected") & hard).alias("leak_hardened"), F.count_if(~F.col("injected") & naive).alias("usefulness_ok"), F.count_if(~F.col("injected")).alias("usefulness_total"))


def paired(a: DataFrame, b: DataFrame, ratio: bool = False) -> DataFrame:
    """(i, x, y): two series per series_id paired by position up to the shorter: b - a, or b / a (NaN for a zero base)."""
    w = Window.partitionBy("series_id").orderBy("x", "y")
    one = lambda s, n: points(s).withColumn("i", F.row_number().over(w) - 1).select("series_id", "i", *([F.col("x")] if n == "a" else []), F.col("y").alias(n))
    y = F.when(F.col("a") == 0, float("nan")).otherwise(F.col("b") / F.nullif("a", F.lit(0.0))) if ratio else F.col("b") - F.col("a")
    return one(a, "a").join(one(b, "b"), ["series_id", "i"]).select("series_id", "x", y.alias("y"))


def against(series: DataFrame, reference: float, ratio: bool = False) -> DataFrame:
    """Each point against one reference value."""
    y = F.lit(float("nan")) if ratio and reference == 0 else F.col("y") / reference if ratio else F.col("y") - reference
    return points(series).select("series_id", "x", y.alias("y"))


def validity(series: DataFrame, wanted: DataFrame) -> DataFrame:
    """(series_id, n, valid): a series is invalid if empty or shorter than wanted (series_id, n_points)."""
    n = points(series).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(n, "series_id", "left").select("series_id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= F.greatest("n_points", F.lit(1))).alias("valid"))


def area_sigma(samples: DataFrame) -> DataFrame:
    """(series_id, x, y): the population deviation per area, 0 for one sample."""
    return points(samples).groupBy("series_id", "x").agg(F.coalesce(F.stddev_pop("y"), F.lit(0.0)).alias("y"))


def lookup(table: DataFrame, requests: DataFrame) -> DataFrame:
    """(series_id, at, y): linear interpolation of (series_id, x, y) at requests (series_id, at), clamped at the ends.

    Brackets come from lead(); the request joins its table by id and range, each bracket half open."""
    w = Window.partitionBy("series_id").orderBy("x")
    p = points(table).groupBy("series_id", "x").agg(F.avg("y").alias("y")).withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).withColumn("first", F.row_number().over(w) == 1)
    lo = F.when(F.col("first"), F.lit(float("-inf"))).otherwise(F.col("x"))
    br = p.select("series_id", "x", "y", "nx", "ny", lo.alias("lo"), F.coalesce("nx", F.lit(float("inf"))).alias("hi"))
    hit = requests.join(br, "series_id").filter((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    y = F.when(F.col("nx").isNull() | (F.col("at") <= F.col("x")), F.col("y")).otherwise(F.col("y") + (F.col("at") - F.col("x")) / (F.col("nx") - F.col("x")) * (F.col("ny") - F.col("y")))
    return hit.select("series_id", "at", F.round(y, 6).alias("y"))


def sizing(unit: DataFrame, target: float, unit_width: float) -> DataFrame:
    """(series_id, multiplicity, total_width): how many unit devices carry the target."""
    m = target / F.nullif("y", F.lit(0.0))
    return unit.select("series_id", "at", F.round(m, 6).alias("multiplicity"), F.round(m * unit_width, 6).alias("total_width"))


def gain_bandwidth(gm: str = "gm", c: str = "c") -> Column:
    """Transconductance over the capacitor that sets the pole."""
    return F.col(gm) / (2 * math.pi * F.col(c))


def gain_db(gm: str = "gm", loads: tuple[str, ...] = ("gds_n", "gds_p")) -> Column:
    """Transconductance over the sum of the output conductances, in dB."""
    total = F.col(loads[0])
    for c in loads[1:]:
        total = total + F.col(c)
    return 20 * F.log10(F.col(gm) / total)


def envelope(measured: DataFrame, models: dict[tuple[str, str], tuple[Column, float]]) -> DataFrame:
    """(id, topology_class, metric, predicted, ratio, status): a closed form from operating quantities against the measured value.

    models: (class, metric) -> (formula, band). The ratio is linear, or 10^(difference/20) for metrics in dB; within the formula's band
    it concurs, else it violates; a class and metric without a formula is NA. A zero prediction or an
    overflow is an infinite ratio."""
    pred, band = F.lit(None).cast("double"), F.lit(None).cast("double")
    for (cls, m), (f, b) in models.items():
        own = (F.col("topology_class") == cls) & (F.col("metric") == m)
        pred, band = F.when(own, f).otherwise(pred), F.when(own, F.lit(b)).otherwise(band)
    db = F.col("metric").endswith("_db")
    ratio = F.when(F.col("p").isNull(), None).when(F.col("p") == 0, float("inf")).when(db, F.pow(F.lit(10.0), (F.col("measured") - F.col("p")) / 20)).otherwise(F.col("measured") / F.nullif("p", F.lit(0.0)))
    out = measured.withColumn("p", pred).withColumn("band", band).withColumn("ratio", ratio)
    status = F.when(F.col("p").isNull(), "NA").when(F.abs(F.col("ratio") - 1) <= F.col("band"), "CONCUR").otherwise("VIOLATED")
    return out.select("id", "metric", F.round("p", 6).alias("predicted"), F.round("ratio", 6).alias("ratio"), status.alias("status"))


def input_pair(bias: DataFrame, gm_id: float) -> DataFrame:
    """(id, id1_ua, m, gm1_us, gbw_mhz) of bias(id, iref, w5, w8, cc, unit_current), values with SI suffixes: half the mirrored tail current through
    each input device, so many (not rounded) unit devices of ``unit_current`` at the target gm/ID, the transconductance and gain-bandwidth that predicts."""
    from lodeweave.operators.text import si_number

    n = {c: si_number(F.col(c)) for c in ("iref", "w5", "w8", "cc")}
    id1 = n["iref"] * (n["w5"] / F.nullif(n["w8"], F.lit(0.0))) / 2
    b = bias.select("id", id1.alias("i"), n["cc"].alias("c"), "unit_current")
    gm = gm_id * F.col("i")
    return b.select("id", F.round(F.col("i") * 1e6, 6).alias("id1_ua"), F.round(F.col("i") / F.nullif("unit_current", F.lit(0.0)), 6).alias("m"), F.round(gm * 1e6, 6).alias("gm1_us"), F.round(gm / (2 * math.pi * F.nullif("c", F.lit(0.0))) / 1e6, 4).alias("gbw_mhz"))


def nominal(series: DataFrame, x0: float) -> DataFrame:
    """(series_id, y): the value at the point nearest to x0, which must match within 1e-6 of it."""
    g = points(series).groupBy("series_id").agg(F.min(F.struct(F.abs(F.col("x") - x0).alias("d"), "x", "y")).alias("m"))
    return g.filter(F.col("m.d") <= 1e-6 * max(abs(x0), 1e-300)).select("series_id", F.col("m.y").alias("y"))


def agreement(runs: DataFrame) -> DataFrame:
    """(claim_id, topology_class, pdk, verdict): the last verdict of each claim and process, runs that failed say nothing."""
    return runs.filter("ok").groupBy("claim_id", "topology_class", "pdk").agg(F.max_by("verdict", "seq").alias("verdict"))


def law_status(agreed: DataFrame) -> DataFrame:
    """(claim_id, n_agree, n_disagree, status, reason) from the verdict per process."""
    yes = F.col("verdict").isin(*AFFIRMING)
    g = agreed.groupBy("claim_id", "topology_class").agg(F.count_if(yes).alias("n_agree"), F.count_if(~yes).alias("n_disagree"), F.array_sort(F.collect_set(F.when(yes, F.col("pdk")))).alias("agreeing"))
    a, d = F.col("n_agree"), F.col("n_disagree")
    reason = F.when((a > 0) & (d > 0), "divergent").when(a >= 3, "law").when(a == 2, "two_member").when(d == 0, "insufficient").otherwise("unanimous_non_verified")
    return g.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "law", "law").otherwise("process_scoped"))


def demotions(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """(claim_id, status, newly_demoted): divergent now and a law (or demoted) before is demoted; only the step from law is new."""
    was = stored.select("claim_id", F.col("status").alias("was"))
    down = (F.col("reason") == "divergent") & F.coalesce(F.col("was").isin("law", "demoted"), F.lit(False))
    return fresh.join(was, "claim_id", "left").select("claim_id", F.when(down, "demoted").otherwise(F.col("status")).alias("status"), (down & (F.col("was") == "law")).alias("newly_demoted"))


def law_id(topology_class: Column, metric: Column, knob: Column, kind: Column) -> Column:
    """A stable id that no process enters."""
    return F.sha1(F.concat_ws("|", topology_class, metric, knob, kind))


def content_id(*parts: Column) -> Column:
    """'sha256:' and the digest of the parts joined by NUL."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\u0000", *parts), 256))


def law_text(laws: DataFrame) -> DataFrame:
    """(claim_id, text): the shape of the claim and where it holds, never a magnitude."""
    shape = F.concat_ws(" ", F.lit("y"), F.when(F.col("kind") == "direction", "increases with").otherwise("is invariant to"), F.lit("x"))
    where = F.array_join("agreeing", ", ")
    tail = F.when(F.col("reason") == "divergent", F.concat(F.lit(" in "), where, F.lit(" only; process-dependent."))).when(F.col("reason") == "law", F.concat(F.lit(", replicated across "), where, F.lit("."))).when(F.col("reason") == "two_member", F.concat(F.lit(", replicated across "), where, F.lit(" (candidate)."))).when(F.col("reason") == "insufficient", F.lit(": insufficient replication.")).otherwise(F.lit(" does not hold."))
    return laws.select("claim_id", F.concat(F.lit("For "), "topology_class", F.lit(", "), shape, tail).alias("text"))


def write_plan(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(claim_id, action): written, unchanged, updated, demoted, or refused_narrowing if a stored process would be lost.

    Both have claim_id, status and agreeing (array)."""
    s = stored.select("claim_id", F.col("status").alias("s0"), F.col("agreeing").alias("a0"))
    j = incoming.join(s, "claim_id", "full")
    lost = F.size(F.array_except(F.col("a0"), F.coalesce("agreeing", F.array().cast("array<string>")))) > 0
    act = F.when(F.col("s0").isNull(), "written").when(F.col("status").isNull(), "kept").when(lost, "refused_narrowing").when((F.col("s0") == "law") & (F.col("reason") == "divergent"), "demoted").when((F.col("s0") == F.col("status")) & F.col("a0").eqNullSafe(F.col("agreeing")), "unchanged").otherwise("updated")
    return j.select("claim_id", act.alias("action"))


def drift(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(claim_id, pdk, drift): ERROR if the run failed, MISSING without a stored verdict, DRIFTED if it changed,
    VALUE-DRIFT if the scalar moved over a quarter of the tolerance, else CONCORDANT.

    fresh: claim_id, pdk, ok, verdict, scalar; stored: claim_id, pdk, verdict, scalar, tolerance. Where fresh tells kind and
    seeded, a drift of an unseeded statistical or elasticity claim is NOISE."""
    s = stored.select("claim_id", "pdk", F.col("verdict").alias("v0"), F.col("scalar").alias("s0"), "tolerance")
    j = fresh.join(s, ["claim_id", "pdk"], "left")
    moved = F.coalesce(F.abs(F.col("scalar") - F.col("s0")) > 0.25 * F.col("tolerance"), F.lit(False))
    kind = F.when(~F.col("ok"), "ERROR").when(F.col("v0").isNull(), "MISSING").when(~F.col("v0").eqNullSafe(F.col("verdict")), "DRIFTED").when(moved, "VALUE-DRIFT").otherwise("CONCORDANT")
    if {"kind", "seeded"} <= set(fresh.columns):
        loose = F.col("kind").isin("statistical", "elasticity") & ~F.coalesce("seeded", F.lit(False))
        kind = F.when(kind.isin("DRIFTED", "VALUE-DRIFT") & F.coalesce(loose, F.lit(False)), "NOISE").otherwise(kind)
    return j.select("claim_id", "pdk", kind.alias("drift"))


def drifted_groups(drifts: DataFrame, classes: DataFrame) -> DataFrame:
    """(topology_class, pdk, n, claims) having drifted claims."""
    d = drifts.filter(F.col("drift").isin("DRIFTED", "VALUE-DRIFT")).join(classes.select("claim_id", "topology_class").distinct(), "claim_id")
    return d.groupBy("topology_class", "pdk").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("claim_id")), ",").alias("claims"))


def merge_cards(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by id; an incoming card replaces a stored one only if its signature (knob, metric, kind) is the same."""
    cols = ["knob", "metric", "kind", "verdict"]
    o = stored.select("id", F.struct(*cols).alias("o"))
    n = incoming.select("id", F.struct(*cols).alias("n"))
    same = F.struct("n.knob", "n.metric", "n.kind").eqNullSafe(F.struct("o.knob", "o.metric", "o.kind"))
    pick = F.when(F.col("o").isNull() | (F.col("n").isNotNull() & same), F.col("n")).otherwise(F.col("o"))
    return o.join(n, "id", "full").select("id", pick.alias("c")).select("id", "c.*")


def sweep_points(sweeps: DataFrame) -> DataFrame:
    """(id, i, point): count and range as points: geometric if flagged or over two decades, else linear; fewer than 2 or no range gives none."""
    ok = (F.col("n") >= 2) & (F.col("lo") > 0) & (F.col("hi") > F.col("lo"))
    s = sweeps.filter(ok).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    t = F.col("i") / (F.col("n") - 1)
    log = F.coalesce("log", F.lit(False)) | (F.col("hi") / F.col("lo") >= 100)
    return s.select("id", "i", F.when(log, F.col("lo") * F.pow(F.col("hi") / F.col("lo"), t)).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * t).alias("point"))


def sweep_clamp(points_: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, n_kept, n_dropped, executable) after points outside the id's declared range are dropped; no range keeps all."""
    j = points_.join(ranges.select("id", "min", "max"), "id", "left")
    keep = F.coalesce((F.col("point") >= F.col("min")) & (F.col("point") <= F.col("max")), F.lit(True))
    return j.groupBy("id").agg(F.count_if(keep).alias("n_kept"), F.count_if(~keep).alias("n_dropped")).withColumn("executable", F.col("n_kept") > 0)


def scope(pdk: Column, corner: Column, *flags: tuple[str, Column]) -> Column:
    """pdk/corner and the names of the flags that are set."""
    return F.concat_ws("/", pdk, corner, *(F.when(c, F.lit(n)) for n, c in flags))


def quant_errors(quants: DataFrame) -> DataFrame:
    """(id, error): what a quantitative test lacks for its kind, null if nothing."""
    k = F.col("kind")
    sign = F.coalesce(F.col("sign").isin("+", "-"), F.lit(False))
    e = F.when(k.isin("direction", "direction_to_optimum") & ~sign, F.concat(k, F.lit(" requires a sign"))).when((k == "elasticity") & (F.col("lo").isNull() | F.col("hi").isNull()), "elasticity requires a band").when((k == "value") & (F.col("value").isNull() | F.col("tol").isNull()), "value requires value and tol").when((k == "corner") & (~sign | F.col("bound").isNull()), "corner requires a sign and a bound").when((k == "statistical") & F.col("bound").isNull(), "statistical requires a bound")
    return quants.select("id", e.alias("error"))


def member_cards(runs: DataFrame) -> DataFrame:
    """(topology_class, pdk, claim_id, n): the smallest claim of each class and process, and how many there are."""
    return runs.groupBy("topology_class", "pdk").agg(F.min("claim_id").alias("claim_id"), F.count_distinct("claim_id").alias("n"))
