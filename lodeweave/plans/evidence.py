"""Evidence queries: verdicts over series, laws, drift, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.operators import evidence as V
from lodeweave.sources.views import view, with_views


def ser(s, d):
    """All series."""
    return view(s, d, "series")


def _laws(s, d):
    return V.law_status(V.agreement(view(s, d, "runs")))


def _stored(s, d):
    """What was known before: all laws of even claims, one process more for some."""
    law = _laws(s, d)
    even = F.substring("claim_id", -1, 1).isin("2", "4")
    more = F.when(F.substring("claim_id", -1, 1) == "4", F.array_sort(F.concat("agreeing", F.array(F.lit("MARS"))))).otherwise(F.col("agreeing"))
    return law.filter(even).select("claim_id", F.lit("law").alias("status"), more.alias("agreeing"))


def _fresh(s, d):
    a = V.agreement(view(s, d, "runs"))
    n = F.ascii(F.substring("claim_id", -1, 1)) + F.length("pdk")
    return a.select("claim_id", "pdk", (n % 7 != 0).alias("ok"), F.when(n % 5 == 0, "REFUTED").otherwise(F.col("verdict")).alias("verdict"), (n * 1.5).alias("scalar"))


def _old(s, d):
    a = V.agreement(view(s, d, "runs")).filter("pdk <> 'AFRICA'")
    n = F.ascii(F.substring("claim_id", -1, 1)) + F.length("pdk")
    return a.select("claim_id", "pdk", "verdict", (n * 1.5 + F.when(n % 2 == 0, 1.0).otherwise(0.1)).alias("scalar"), F.lit(2.0).alias("tolerance"))


_A = ", ag as (select claim_id, topology_class, pdk, arg_max(verdict, seq) verdict from runs where ok group by 1, 2, 3)"
_L = _A + """, lw as (select claim_id, topology_class, count(*) filter (where verdict in ('VERIFIED','VERIFIED_WITH_CAVEAT')) n_agree, count(*) filter (where verdict not in ('VERIFIED','VERIFIED_WITH_CAVEAT')) n_disagree,
  coalesce(list(distinct pdk order by pdk) filter (where verdict in ('VERIFIED','VERIFIED_WITH_CAVEAT')), []) agreeing from ag group by 1, 2),
law as (select *, case when n_agree > 0 and n_disagree > 0 then 'divergent' when n_agree >= 3 then 'law' when n_agree = 2 then 'two_member' when n_disagree = 0 then 'insufficient' else 'unanimous_non_verified' end reason from lw),
laws as (select *, case when reason = 'law' then 'law' else 'process_scoped' end status from law)"""
_ST = """, st as (select claim_id, 'law' status, case when right(claim_id, 1) = '4' then list_sort(list_append(agreeing, 'MARS')) else agreeing end agreeing from laws where right(claim_id, 1) in ('2', '4'))"""
_N = "(ascii(right(claim_id, 1)) + length(pdk))"
_DR = _A + f""", fr as (select claim_id, pdk, {_N} % 7 <> 0 ok, case when {_N} % 5 = 0 then 'REFUTED' else verdict end verdict, {_N} * 1.5e0 scalar from ag),
od as (select claim_id, pdk, verdict v0, {_N} * 1.5e0 + case when {_N} % 2 = 0 then 1e0 else 0.1e0 end s0 from ag where pdk <> 'AFRICA'),
dr as (select fr.claim_id, fr.pdk, case when not ok then 'ERROR' when v0 is null then 'MISSING' when v0 <> verdict then 'DRIFTED' when abs(scalar - s0) > 0.5 then 'VALUE-DRIFT' else 'CONCORDANT' end drift from fr left join od using (claim_id, pdk))"""
_STEP = """, st as (select *, row_number() over w - 1 i, lead(x) over w nx, lead(y) over w ny from series where x is not null and isfinite(y) window w as (partition by series_id order by x, y)),
sp as (select *, ny - y dy, case when x > 0 and y > 0 and nx > 0 and ny > 0 and nx <> x then (ln(ny) - ln(y)) / (ln(nx) - ln(x)) end slope from st)"""


def _claims(s, d):
    return view(s, d, "runs").select("claim_id", "pdk", "verdict", F.when(F.col("seq") % 3 == 0, "because").alias("narrative"), (F.col("seq") % 4 == 0).alias("injected"))


_CL = "(select claim_id, pdk, verdict, case when seq % 3 = 0 then 'because' end narrative, seq % 4 = 0 injected from runs)"


def _models():
    """Closed forms by class and metric; even classes have none for the gain."""
    return {("odd", "gbw"): (V.gain_bandwidth(), 0.25), ("odd", "gain_db"): (V.gain_db(), 0.15), ("even", "gbw"): (V.gain_bandwidth(), 0.15)}


def _ops(s, d):
    p = view(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "gbw").when(F.col("p_partkey") % 3 == 1, "gain_db").otherwise("noise").alias("metric"), F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("topology_class"), (F.col("p_retailprice") / 100).alias("gm"), F.lit(0.5).alias("c"), F.lit(0.2).alias("gds_n"), (F.col("p_size") / 50.0).alias("gds_p"), (F.col("p_retailprice") / 300).alias("measured"))


_OPS = "(select p_partkey id, case p_partkey % 3 when 0 then 'gbw' when 1 then 'gain_db' else 'noise' end metric, case when p_size % 2 = 0 then 'even' else 'odd' end cls, p_retailprice / 100 gm, 0.5e0 c, 0.2e0 gds_n, p_size / 50e0 gds_p, p_retailprice / 300 measured from part)"


def _cards(s, d, new):
    p = view(s, d, "part").filter("p_partkey % 4 <> 1" if new else "p_partkey % 5 <> 2")
    return p.select(F.concat(F.lit("card_"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.lit(new) & (F.col("p_partkey") % 6 == 0), "other").otherwise(F.col("p_brand")).alias("knob"), F.col("p_type").alias("metric"), F.lit("value").alias("kind"), F.lit("VERIFIED" if new else "FLAGGED").alias("verdict"))


_C0 = "(select 'card_' || cast(p_partkey as varchar) id, p_brand knob, p_type metric, 'value' kind, 'FLAGGED' verdict from part where p_partkey % 5 <> 2)"
_C1 = "(select 'card_' || cast(p_partkey as varchar) id, case when p_partkey % 6 = 0 then 'other' else p_brand end knob, p_type metric, 'value' kind, 'VERIFIED' verdict from part where p_partkey % 4 <> 1)"


def _sweeps(s, d):
    return view(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 6).alias("n"), (F.col("s_suppkey") / 10.0).alias("lo"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") * 20.0).otherwise(F.col("s_suppkey") * 1.0).alias("hi"), (F.col("s_suppkey") % 7 == 0).alias("log"))


_SW = """(select s_suppkey id, s_suppkey % 6 n, s_suppkey / 10e0 lo, case when s_suppkey % 2 = 0 then s_suppkey * 20e0 else s_suppkey * 1e0 end hi, s_suppkey % 7 = 0 log from supplier)"""
_PT = f"""(select id, i, case when log or hi / lo >= 100 then lo * pow(hi / lo, i / cast(n - 1 as double)) else lo + (hi - lo) * i / cast(n - 1 as double) end point from (select *, unnest(range(0, n)) i from {_SW} z where n >= 2 and lo > 0 and hi > lo))"""


def _quants(s, d):
    p = view(s, d, "part")
    kinds = ["direction", "elasticity", "value", "corner", "statistical", "direction_to_optimum"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), kind.alias("kind"), F.when(F.col("p_size") % 3 == 0, "+").alias("sign"), F.when(F.col("p_size") % 2 == 0, 0.1).alias("lo"), F.lit(0.5).alias("hi"), F.when(F.col("p_size") % 5 != 0, 1.0).alias("value"), F.lit(0.1).alias("tol"), F.when(F.col("p_size") % 4 == 0, 3.0).alias("bound"))


Q = {
    "evidence_elasticity": (lambda s, d: V.elasticity(ser(s, d), -0.2, 0.3), _STEP + """
        , g as (select series_id, count(*) n, bool_and(x > 0 and y > 0) positive, regr_slope(case when y > 0 then ln(y) end, case when x > 0 then ln(x) end) sl, min(slope) lo, max(slope) hi from sp group by 1)
        select series_id, round(sl, 6) slope, case when n < 2 or not positive or sl is null then 'FLAGGED' when sl < -0.2 or sl > 0.3 then 'REFUTED' when lo >= -0.2 and hi <= 0.3 then 'VERIFIED' else 'VERIFIED_WITH_CAVEAT' end verdict from g"""),
    "evidence_direction": (lambda s, d: V.direction(ser(s, d), "+"), _STEP + """
        , g as (select series_id, count(*) n, arg_min(y, i) f, arg_max(y, i) l, bool_and(dy > 0) mono from sp group by 1)
        select series_id, case when n < 2 or abs(l - f) <= 1e-6 * case when (abs(f) + abs(l)) / 2 = 0 then 1e0 else (abs(f) + abs(l)) / 2 end then 'FLAGGED' when l < f then 'REFUTED' when mono then 'VERIFIED' else 'VERIFIED_WITH_CAVEAT' end verdict from g"""),
    "evidence_optimum": (lambda s, d: V.optimum(ser(s, d), "+"), _STEP + """
        , b as (select series_id, count(*) n, min({'y': -y, 'i': i}).i as top from sp group by 1),
        u as (select b.series_id, n, top, coalesce(bool_and(case when i < top then dy > 0 end), true) rises from sp join b using (series_id) group by 1, 2, 3)
        select series_id, top as "at", case when n < 2 then 'FLAGGED' when not rises then 'REFUTED' when top < n - 1 then 'VERIFIED_WITH_CAVEAT' else 'VERIFIED' end verdict from u"""),
    "evidence_invariance": (lambda s, d: V.invariance(ser(s, d), cov_max=0.6, range_max=1999.0), """
        , g as (select series_id, count(*) n, min(y) filter (where x <= 1999) lo, max(y) filter (where x <= 1999) hi, avg(y) filter (where x <= 1999) mean from series group by 1)
        select series_id, case when n < 2 or lo is null or mean = 0 then 'FLAGGED' when (hi - lo) / mean <= 0.6 then 'VERIFIED' else 'REFUTED' end verdict from g"""),
    "evidence_spread": (lambda s, d: V.invariance(ser(s, d), spread_max=800.0), "select series_id, case when count(*) < 2 then 'FLAGGED' when max(y) - min(y) <= 800 then 'VERIFIED' else 'REFUTED' end verdict from series group by 1"),
    "evidence_value": (lambda s, d: V.value(view(s, d, "supplier").select(F.col("s_name").alias("series_id"), F.lit(5000.0).alias("asserted"), F.col("s_acctbal").alias("measured")), 2500.0), "select s_name series_id, case when abs(5000 - s_acctbal) <= 2500 then 'VERIFIED' else 'REFUTED' end verdict from supplier"),
    "evidence_statistical": (lambda s, d: V.statistical(ser(s, d), 900.0, columns=100), f"""
        select series_id, round({V.probit(100)!r} * stddev_pop(y), 6) stat, case when count(*) < 8 then 'FLAGGED' when {V.probit(100)!r} * stddev_pop(y) <= 900 then 'VERIFIED' else 'REFUTED' end verdict from series group by 1"""),
    "evidence_statistical_relative": (lambda s, d: V.statistical(ser(s, d), 0.9, absolute=False, three_sigma=True), """
        select series_id, round(3e0 * stddev_pop(y) / abs(avg(y)), 6) stat, case when count(*) < 8 then 'FLAGGED' when 3e0 * stddev_pop(y) / abs(avg(y)) <= 0.9 then 'VERIFIED' else 'REFUTED' end verdict from series group by 1"""),
    "evidence_corner": (lambda s, d: V.corner(ser(s, d), 1000.0), "select series_id, count(*) filter (where not y >= 1000) n_failing, case when count(*) < 2 then 'FLAGGED' when count(*) filter (where not y >= 1000) = 0 then 'VERIFIED' else 'REFUTED' end verdict from series group by 1"),
    "evidence_conditions": (lambda s, d: view(s, d, "part").select("p_partkey", V.conditions_complete(F.when(F.col("p_size") % 3 == 0, "digital").otherwise("analog"), F.when(F.col("p_size") % 2 == 0, "tt"), F.col("p_size").cast("double"), F.when(F.col("p_size") % 5 != 0, 1.8)).alias("complete")), """
        select p_partkey, p_size % 3 = 0 or (p_size % 2 = 0 and p_size % 5 <> 0) complete from part"""),
    "evidence_teaching": (lambda s, d: _claims(s, d).select("claim_id", "pdk", V.teaching(F.col("verdict"), F.col("narrative")).alias("teachable")), f"select claim_id, pdk, verdict in ('VERIFIED','VERIFIED_WITH_CAVEAT') and coalesce(narrative, '') = '' teachable from {_CL} c"),
    "evidence_scorecard": (lambda s, d: V.scorecard(_claims(s, d)), f"""
        , c as (select *, verdict in ('VERIFIED','VERIFIED_WITH_CAVEAT') ok, narrative is null bare from {_CL} c)
        select count(*) filter (where injected and ok) leak_naive, count(*) filter (where injected and ok and bare) leak_hardened, count(*) filter (where not injected and ok) usefulness_ok, count(*) filter (where not injected) usefulness_total from c"""),
    "evidence_paired_delta": (lambda s, d: V.paired(ser(s, d), ser(s, d).withColumn("y", F.col("y") * 2 - 1)).select("series_id", "x", F.round("y", 6).alias("y")), "select series_id, x, round(y * 2 - 1 - y, 6) y from series"),
    "evidence_paired_ratio": (lambda s, d: V.paired(ser(s, d), ser(s, d).withColumn("y", F.col("y") + 1), ratio=True).select("series_id", "x", F.round("y", 6).alias("y")), "select series_id, x, round((y + 1) / y, 6) y from series"),
    "evidence_against": (lambda s, d: V.against(ser(s, d), 250.0, True).select("series_id", "x", F.round("y", 6).alias("y")), "select series_id, x, round(y / 250, 6) y from series"),
    "evidence_validity": (lambda s, d: V.validity(ser(s, d).filter("x > 1996"), ser(s, d).select("series_id", F.lit(5).alias("n_points")).distinct()), "select series_id, count(*) filter (where x > 1996) n, count(*) filter (where x > 1996) >= 5 valid from series group by 1"),
    "evidence_area_sigma": (lambda s, d: V.area_sigma(view(s, d, "part").select(F.col("p_brand").alias("series_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))).select("series_id", "x", F.round("y", 6).alias("y")), "select p_brand series_id, cast(p_size as double) x, round(stddev_pop(p_retailprice), 6) y from part group by 1, 2"),
    "evidence_lookup": (lambda s, d: V.lookup(ser(s, d), ser(s, d).select("series_id", F.explode(F.array(F.lit(-5.0), F.lit(7.25), F.lit(1997.5), F.lit(9999.0))).alias("at")).distinct()), """
        , w as (select *, lead(x) over v nx, lead(y) over v ny, row_number() over v = 1 f from series window v as (partition by series_id order by x)), r as (select distinct series_id, unnest([-5e0, 7.25e0, 1997.5e0, 9999e0]) a from series)
        select r.series_id, a as "at", round(case when nx is null or a <= x then y else y + (a - x) / (nx - x) * (ny - y) end, 6) y from r join w on r.series_id = w.series_id and (f or a >= x) and a < coalesce(nx, 'infinity'::double)"""),
    "evidence_sizing": (lambda s, d: V.sizing(ser(s, d).withColumn("at", F.col("x")), 5000.0, 2.0), "select series_id, x as \"at\", round(5000 / y, 6) multiplicity, round(5000 / y * 2, 6) total_width from series"),
    "evidence_envelope": (lambda s, d: V.envelope(_ops(s, d), _models()), f"""
        , o as (select *, case metric when 'gbw' then gm / (2 * pi() * c) when 'gain_db' then case cls when 'odd' then 20 * log10(gm / (gds_n + gds_p)) end end p, case when metric = 'gbw' then case cls when 'odd' then 0.25 else 0.15 end when metric = 'gain_db' then case cls when 'odd' then 0.15 end end band from {_OPS} z),
        r as (select *, case when metric like '%\\_db' escape '\\' then pow(10e0, (measured - p) / 20) else measured / p end ratio from o)
        select id, metric, round(p, 6) predicted, round(ratio, 6) ratio, case when p is null then 'NA' when abs(ratio - 1) <= band then 'CONCUR' else 'VIOLATED' end status from r"""),
    "evidence_nominal": (lambda s, d: V.nominal(ser(s, d), 12.0), "select series_id, y from series where x = 12"),
    "evidence_agreement": (lambda s, d: V.agreement(view(s, d, "runs")), _A + " select * from ag"),
    "evidence_law_status": (lambda s, d: _laws(s, d).withColumn("agreeing", F.array_join("agreeing", ",")), _L + " select claim_id, topology_class, n_agree, n_disagree, array_to_string(agreeing, ',') agreeing, reason, status from laws"),
    "evidence_demotions": (lambda s, d: V.demotions(_laws(s, d), _stored(s, d)), _L + _ST + """ select l.claim_id, case when reason = 'divergent' and st.claim_id is not null then 'demoted' else l.status end status, reason = 'divergent' and st.claim_id is not null newly_demoted from laws l left join st using (claim_id)"""),
    "evidence_law_text": (lambda s, d: V.law_text(_laws(s, d).withColumn("kind", F.lit("direction"))), _L + """ select claim_id, 'For ' || topology_class || ', y increases with x' || case reason when 'divergent' then ' in ' || array_to_string(agreeing, ', ') || ' only; process-dependent.' when 'law' then ', replicated across ' || array_to_string(agreeing, ', ') || '.' when 'two_member' then ', replicated across ' || array_to_string(agreeing, ', ') || ' (candidate).' when 'insufficient' then ': insufficient replication.' else ' does not hold.' end as text from laws"""),
    "evidence_write_plan": (lambda s, d: V.write_plan(_stored(s, d), _laws(s, d).filter("right(claim_id, 1) <> '2' or claim_id > 'claim_brand_3'")), _L + _ST + """, inc as (select * from laws where right(claim_id, 1) <> '2' or claim_id > 'claim_brand_3')
        select coalesce(i.claim_id, st.claim_id) claim_id, case when st.claim_id is null then 'written' when i.claim_id is null then 'kept' when len(list_filter(st.agreeing, lambda x: not list_contains(i.agreeing, x))) > 0 then 'refused_narrowing' when reason = 'divergent' then 'demoted' when i.status = 'law' and i.agreeing = st.agreeing then 'unchanged' else 'updated' end as action from inc i full join st on i.claim_id = st.claim_id"""),
    "evidence_law_ids": (lambda s, d: view(s, d, "part").select(V.law_id(F.col("p_type"), F.col("p_brand"), F.lit("size"), F.lit("value")).alias("law_id"), "p_type", "p_brand").distinct(), "select distinct sha1(p_type || '|' || p_brand || '|size|value') law_id, p_type, p_brand from part"),
    "evidence_content_ids": (lambda s, d: view(s, d, "supplier").select("s_suppkey", V.content_id(F.col("s_name"), F.lit("x")).alias("spec_id")), "select s_suppkey, 'sha256:' || sha256(s_name || chr(0) || 'x') spec_id from supplier"),
    "evidence_drift": (lambda s, d: V.drift(_old(s, d), _fresh(s, d)), _DR + " select * from dr"),
    "evidence_drifted_groups": (lambda s, d: V.drifted_groups(V.drift(_old(s, d), _fresh(s, d)), view(s, d, "runs")), _DR + " select topology_class, pdk, count(*) n, string_agg(claim_id, ',' order by claim_id) claims from (select distinct dr.*, topology_class from dr join ag using (claim_id) where drift in ('DRIFTED','VALUE-DRIFT')) group by 1, 2"),
    "evidence_merge_cards": (lambda s, d: V.merge_cards(_cards(s, d, False), _cards(s, d, True)), f"""
        select coalesce(o.id, n.id) id, case when o.id is null or (n.id is not null and n.knob = o.knob and n.metric = o.metric and n.kind = o.kind) then n.knob else o.knob end knob, coalesce(o.metric, n.metric) metric, 'value' kind,
               case when o.id is null or (n.id is not null and n.knob = o.knob and n.metric = o.metric and n.kind = o.kind) then n.verdict else o.verdict end verdict from {_C0} o full join {_C1} n on o.id = n.id"""),
    "evidence_sweep_points": (lambda s, d: V.sweep_points(_sweeps(s, d)).select("id", "i", F.round("point", 6).alias("point")), f"select id, i, round(point, 6) point from {_PT} z"),
    "evidence_sweep_clamp": (lambda s, d: V.sweep_clamp(V.sweep_points(_sweeps(s, d)), view(s, d, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), F.lit(0.0).alias("min"), F.lit(5.0).alias("max"))), f"select id, count(*) filter (where id % 3 <> 0 or point <= 5) n_kept, count(*) filter (where id % 3 = 0 and point > 5) n_dropped, count(*) filter (where id % 3 <> 0 or point <= 5) > 0 executable from {_PT} z group by 1"),
    "evidence_scope": (lambda s, d: view(s, d, "runs").select("claim_id", "pdk", V.scope(F.col("pdk"), F.lit("tt"), ("statistical", F.col("seq") % 2 == 0), ("envelope", F.col("seq") % 3 == 0)).alias("scope")), "select claim_id, pdk, pdk || '/tt' || case when seq % 2 = 0 then '/statistical' else '' end || case when seq % 3 = 0 then '/envelope' else '' end as scope from runs"),
    "evidence_quant_errors": (lambda s, d: V.quant_errors(_quants(s, d)), """
        , q as (select p_partkey id, ['direction','elasticity','value','corner','statistical','direction_to_optimum'][p_partkey % 6 + 1] kind, p_size % 3 = 0 sgn, p_size % 2 = 0 lo, p_size % 5 <> 0 val, p_size % 4 = 0 bnd from part)
        select id, case when kind in ('direction','direction_to_optimum') and not sgn then kind || ' requires a sign' when kind = 'elasticity' and not lo then 'elasticity requires a band' when kind = 'value' and not val then 'value requires value and tol' when kind = 'corner' and not (sgn and bnd) then 'corner requires a sign and a bound' when kind = 'statistical' and not bnd then 'statistical requires a bound' end error from q"""),
    "evidence_member_cards": (lambda s, d: V.member_cards(view(s, d, "runs")), "select topology_class, pdk, min(claim_id) claim_id, count(distinct claim_id) n from runs group by 1, 2"),
}


def queries() -> dict:
    """Query name -> (spark, sf_dir) -> DataFrame."""
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    """The same in DuckDB's SQL."""
    return {k: with_views("with " + q.strip()[2:] if q.strip().startswith(", ") else q) for k, (_, q) in Q.items() if q}
