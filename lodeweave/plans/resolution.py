"""Entity-resolution and search queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeweave.operators import resolution as R
from lodeweave.operators import vectors as X
from lodeweave.operators.components import connected_components
from lodeweave.sources.views import view, with_views

N = ("name_a", "name_b")
# The vocabulary of these queries, made for the test tables; the SQL below states the same words on its own.
VOCAB = R.Vocabulary(
    abbreviations={"psrr": "power supply rejection", "pm": "phase margin", "sr": "slew rate", "vos": "input offset voltage"},
    aliases={"ringosc": ["ring oscillator", "ring osc"], "curmir": ["current mirror", "mirror bank"], "tia": ["transimpedance amplifier", "tz amp"]},
    stop=("and", "to", "the", "of"),
    short=("ab", "pm"),
    qualifiers=("core", "pair"),
    generic=("buffer", "amplifier", "voltage"),
    discriminators=("pseudo", "fully", "low", "output"),
    projection={"GROUNDS": "SUPPORTS", "REALIZES": "INSTANCE_OF"},
)


def pairs(s, d):
    """(id, name_a, name_b): link texts with the next link's text of the same kind and specimen range, topologies with their aliases."""
    l = view(s, d, "link_requests").filter("match_text is not null").select("link_id", "target_label", "source_id_value", "match_text").distinct()
    w = Window.partitionBy("target_label", F.substring("source_id_value", 1, 7)).orderBy("link_id", "match_text", "source_id_value")
    nxt = l.select(F.col("link_id").alias("id"), F.col("match_text").alias("name_a"), F.lead("match_text").over(w).alias("name_b")).filter("name_b is not null")
    return view(s, d, "topology_nodes").select(F.col("topology_id").alias("id"), F.col("name").alias("name_a"), F.explode("aliases").alias("name_b")).unionByName(nxt).distinct()


def forms(s, d):
    """The pairs with the profiles of both names."""
    return pairs(s, d).withColumn("p", R.profile(F.col("name_a"), VOCAB)).withColumn("q", R.profile(F.col("name_b"), VOCAB))


def P():
    """The profile of a pair's first name."""
    return F.col("p")


def Q_():
    """The profile of its second."""
    return F.col("q")


_MAP = "MAP {'psrr': 'power supply rejection', 'pm': 'phase margin', 'sr': 'slew rate', 'vos': 'input offset voltage'}"
_KEYS, _STOPS, _SHORT = "['ringosc', 'curmir', 'tia']", "['and', 'to', 'the', 'of']", "['ab', 'pm']"
_QUAL, _LOOSE, _DISC = "['core', 'pair']", "['buffer', 'amplifier', 'voltage', 'core', 'pair']", "['pseudo', 'fully', 'low', 'output']"
_FORMS = [("current mirror", "curmir"), ("mirror bank", "curmir"), ("ring osc", "ringosc"), ("ring oscillator", "ringosc"), ("transimpedance amplifier", "tia"), ("tz amp", "tia")]


def _norm(x):
    s = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[-_/]+', ' ', 'g'), '\\([^)]*\\)', '', 'g'), '\\s+', ' ', 'g'))"
    return f"array_to_string(list_transform(string_split({s}, ' '), lambda t: coalesce({_MAP}[t], t)), ' ')"


def _canon(x):
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[\\s_-]+', ' ', 'g'), '[^a-z0-9+/(). ]+', '', 'g'), '\\s+', ' ', 'g'))"


def _toks(x):
    return f"list_filter(list_transform(string_split({_canon(x)}, ' '), lambda t: regexp_replace(t, '^[().]+|[().]+$', '', 'g')), lambda t: t <> '')"


def _key(x):
    e = f"' ' || array_to_string({_toks(x)}, ' ') || ' '"
    for f, k in _FORMS:
        e = f"replace({e}, ' {f} ', ' {k} ')"
    return f"trim({e})"


_TELLS = f"((case when length(t) >= 3 then not regexp_matches(t, '^[0-9]+$') else regexp_matches(t, '[0-9/]') or list_contains({_SHORT}, t) end) and not list_contains({_STOPS}, t))"


def _forms(src, x, s):
    """Columns of one name's profile, as ``profile`` gives them, with the suffix s."""
    return f"""(select *, list_filter(ent{s}, lambda t: list_contains({_KEYS}, t)) ents{s}, list_filter(ent{s}, lambda t: not list_contains({_KEYS}, t) and not list_contains({_QUAL}, t)) rest{s},
      case when len(list_filter(w{s}, lambda t: not list_contains({_LOOSE}, t))) > 0 then list_filter(w{s}, lambda t: not list_contains({_LOOSE}, t)) else w{s} end core{s} from
     (select *, {_norm(x)} n{s}, {_canon(x)} c{s}, {_key(x)} k{s}, list_distinct(list_filter({_toks(x)}, lambda t: {_TELLS})) tok{s},
      list_distinct(list_filter(string_split({_key(x)}, ' '), lambda t: t <> '' and (list_contains({_KEYS}, t) or {_TELLS}))) ent{s},
      list_distinct(regexp_extract_all(coalesce({x}, ''), '\\d+(?:\\.\\d+)?')) num{s}, list_filter(string_split({_canon(x)}, ' '), lambda t: t <> '') w{s} from {src}) z)"""


_MINUS = "list_filter({0}, lambda t: not list_contains({1}, t))"
_SAMESET = "(len(list_intersect({0}, {1})) = len({0}) and len({0}) = len({1}))"


def _rules(src):
    """src (with the profiles a and b) and the rules' outcomes."""
    acro = lambda a, b: f"(len(core{a}) = 1 and regexp_matches(regexp_replace(core{a}[1], '[.\\s_/-]+', '', 'g'), '^[a-z]{{2,}}$') and array_to_string(list_transform(core{b}, lambda t: t[1]), '') = regexp_replace(core{a}[1], '[.\\s_/-]+', '', 'g'))"
    ea, eb = _MINUS.format("enta", "entb"), _MINUS.format("entb", "enta")
    ta, tb = _MINUS.format("toka", "tokb"), _MINUS.format("tokb", "toka")
    short = "case when len(toka) <= len(tokb) then toka else tokb end"
    both_sides = "len(list_intersect(toka, tokb))"
    single = f"(not regexp_matches(({short})[1], '[+-]$') and (regexp_matches(({short})[1], '[0-9/]') or length(({short})[1]) <= 4))"
    return f"""(select *, coalesce(alias_same or (inboth > 0 and ((inboth = len(toka) and inboth = len(tokb)) or
        case when len(list_filter({ta} || {tb}, lambda t: list_contains({_DISC}, t))) > 0 then false when inboth = least(len(toka), len(tokb)) then least(len(toka), len(tokb)) > 1 or {single} else inboth >= 2 end)), false) same,
      case when not alias_same then 'salient_containment' when len(entsa) = len(enta) and len(entsb) = len(entb) then 'alias' else 'generic_qualifier' end rule
     from (select *, not {_SAMESET.format('numa', 'numb')} numeric_conflict, {both_sides} inboth,
      len(enta) > 0 and len(entb) > 0 and (len({ea}) > 0) <> (len({eb}) > 0) and len(list_filter({ea} || {eb}, lambda t: not list_contains({_LOOSE}, t))) > 0 qualifier_conflict,
      len(entsa) > 0 and {_SAMESET.format('entsa', 'entsb')} and len(resta) = 0 and len(restb) = 0 alias_same, {acro('a', 'b')} or {acro('b', 'a')} acronym_same from {src} y) y)"""


def _tier(cos):
    return f"case when qualifier_conflict or numeric_conflict then 'REJECT' when ca = cb or alias_same or acronym_same then 'MERGE' when coalesce({cos} >= 0.82, false) then 'VERIFY' else 'REJECT' end"


_JAC = "(case when na <> '' and nb <> '' then len(list_intersect(string_split(na, ' '), string_split(nb, ' '))) / len(list_distinct(string_split(na, ' ') || string_split(nb, ' '))) else 0 end)"
# Longest common subsequence: row by row, the best up to i is the old one or one more than the old one before the last equal letter.
_LCS = """list_reduce(list_prepend(list_transform(range(length(na) + 1), lambda i: 0::bigint), list_transform(string_split(nb, ''), lambda c: [ord(c)::bigint])),
  lambda r, c: list_transform(range(length(na) + 1), lambda i: case when i = 0 or strpos(reverse(na[1:i]), chr(c[1]::int)) = 0 then r[i + 1] else greatest(r[i + 1], r[i - strpos(reverse(na[1:i]), chr(c[1]::int)) + 1] + 1) end))[length(na) + 1]"""
_SIM = f"(case when na = '' or nb = '' then 0 when na = nb then 1 else greatest({_JAC}, 0.8 * 2 * {_LCS} / (length(na) + length(nb))) end)"
_NP = """(select topology_id id, name name_a, unnest(aliases) name_b from topology_nodes union select id, name_a, name_b from (select link_id id, match_text name_a,
  lead(match_text) over (partition by target_label, substr(source_id_value, 1, 7) order by link_id, match_text, source_id_value) name_b from (select distinct link_id, target_label, source_id_value, match_text from link_requests where match_text is not null)) where name_b is not null)"""
_FX = _forms(_forms(f"{_NP} np", "name_a", "a") + " fa", "name_b", "b")
_RU = f"(select * from {_rules(_FX)} r0)"
# Concepts of the consolidation queries, their blocked pairs, and all pairs above the floors.
_CON = "(select topology_id id, name, aliases, embedding from topology_nodes left join (select 'topo_' || lpad(concept_id::varchar, 4, '0') topology_id, embedding from concept_vectors) v using (topology_id) where name is not null)"
_CF = f""", cf as materialized (select id, name name_a, aliases al, embedding e, na n, ca c, ka k, toka tok, enta ent, numa num, entsa ents, resta rest, corea core from {_forms(_CON + ' con', 'name', 'a')} f),
bk as materialized (select distinct least(x.id, y.id) id_a, greatest(x.id, y.id) id_b from (select id, unnest(list_distinct(tok || ent || case when k <> '' then ['= ' || k] else [] end)) t from cf) x join (select id, unnest(list_distinct(tok || ent || case when k <> '' then ['= ' || k] else [] end)) t from cf) y on x.t = y.t and x.id < y.id),
ap as (select a.id id_a, b.id id_b, a.name_a, b.name_a name_b, """ + ", ".join(f"{s}.{c} {c}{s}" for s in "ab" for c in ("e", "n", "c", "tok", "ent", "num", "ents", "rest", "core", "al")) + """ from cf a join cf b on a.id < b.id)"""
_CP = _CF + f""", cp as materialized (select *, {_tier('cos')} tier from (select *, case when ea is not null and eb is not null then list_cosine_similarity(ea::double[], eb::double[]) end cos, {_SIM} sim from {_rules('ap')} z)),
cl as materialized (select cp.id_a, cp.id_b, name_a, name_b, round(cos, 6) cos, round(sim, 6) sim, tier, case when qualifier_conflict or numeric_conflict then case when coalesce(cos, -1) >= 0.6 or sim >= 0.85 or alias_same then 'review' else 'drop' end when tier = 'MERGE' or alias_same then 'auto' when tier = 'VERIFY' then 'verify' when sim >= 0.7 then 'review' else 'drop' end band
 from cp left join bk on bk.id_a = cp.id_a and bk.id_b = cp.id_b where bk.id_a is not null or coalesce(cos >= 0.6, false) or sim >= 0.7)"""


def vecs(s, d):
    """Concepts with vectors."""
    return view(s, d, "concept_vectors").select(F.col("concept_id").alias("id"), F.col("embedding").alias("v"), "name", "source_id")


def _asked(s, d):
    return vecs(s, d).filter("id % 100 = 0").select(F.col("id").alias("query_id"), "v")


_KNN = """, k as (select q.concept_id query_id, b.concept_id id, list_cosine_similarity(q.embedding::double[], b.embedding::double[]) s, b.source_id sb, q.source_id sa from concept_vectors q join concept_vectors b on q.concept_id % 100 = 0 and b.concept_id <> q.concept_id),
kr as (select *, row_number() over (partition by query_id order by round(s, 9) desc, id) r from k)"""


def _knn(s, d, k=5):
    return X.nearest_exact(vecs(s, d).select("id", "v"), _asked(s, d), k, 64)


def _mentions(s, d):
    l = view(s, d, "link_requests").filter("target_label = 'Parameter'").select(F.col("link_id").alias("mention_id"), F.col("match_text").alias("name")).distinct()
    return l.withColumn("units", F.when(F.col("mention_id") < "link_8", "V"))


def _eqs(s, d):
    p = view(s, d, "part")
    return p.select(F.concat(F.lit("eq_"), F.col("p_partkey").cast("string")).alias("equation_id"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "$").otherwise(""), F.lit("V_{"), F.col("p_size").cast("string"), F.lit("} = \\left( x^{2} \\right)"), F.when(F.col("p_partkey") % 2 == 0, "$").otherwise("")).alias("latex"))


_EQ = "(select 'eq_' || cast(p_partkey as varchar) equation_id, 'V_' || case when p_size < 10 then cast(p_size as varchar) else '{' || cast(p_size as varchar) || '}' end || '=(x^2)' k from part)"


def _best(s, d):
    c = _knn(s, d, 5)
    return c.select(F.concat_ws("-", "query_id", "id").alias("mention_id"), (F.col("query_id") % 100).alias("chunk_id"), (F.col("id") % 9 == 0).alias("exact"), F.round("similarity", 6).alias("cos"), F.lit(0.3).alias("sim"), (F.col("id") % 2 == 0).alias("conflict"), F.when(F.col("id") % 3 == 0, "SAME").when(F.col("id") % 3 == 1, "DIFFERENT").alias("verdict"))


def _concepts(s, d):
    t = view(s, d, "topology_nodes").filter("name is not null")
    v = view(s, d, "concept_vectors").select(F.concat(F.lit("topo_"), F.lpad(F.col("concept_id").cast("string"), 4, "0")).alias("id"), "embedding")
    return t.select(F.col("topology_id").alias("id"), "name", "aliases").join(v, "id", "left")


def _hits(s, d):
    n = view(s, d, "nodes").filter("label = 'Parameter'")
    q = s.createDataFrame([("azure",), ("blue",), ("almond",)], "query_id string")
    t = n.join(q, F.lower("name").contains(F.col("query_id"))).select("query_id", F.col("node_id").alias("id"), F.col("name").alias("o"))
    w = Window.partitionBy("query_id").orderBy("o", "id")
    return t.withColumn("ord", F.row_number().over(w)).select("query_id", "id", "ord")


_HIT = "(select q query_id, node_id id, row_number() over (partition by q order by name, node_id) ord from nodes join (select unnest(['azure','blue','almond']) q) on contains(lower(name), q) where label = 'Parameter')"


def _cands(s, d):
    k = _knn(s, d, 5)
    kind = F.when(F.col("id") % 4 == 0, "exact").when(F.col("id") % 4 == 1, "text").otherwise("vector")
    return k.select("query_id", "id", kind.alias("kind"), (F.col("id") % 3).alias("phrase_order"), (F.col("id") % 5).alias("name_length"), F.round("similarity", 6).alias("cos"))


def _relink(s, d):
    k = _knn(s, d, 12)
    v = vecs(s, d).select("id", "source_id")
    j = k.join(v.select(F.col("id").alias("query_id"), F.col("source_id").alias("source_a")), "query_id").join(v.withColumnRenamed("source_id", "source_b"), "id")
    return j.select(F.col("query_id").alias("concept_id"), "id", "source_a", "source_b", F.round("similarity", 6).alias("score"))


def _classified(s, d):
    return R.classified_pairs(_concepts(s, d), VOCAB)


Q = {
    "er_normalize_name": (lambda s, d: view(s, d, "link_requests").select("match_text", R.normalize_name(F.col("match_text"), VOCAB).alias("norm")).distinct(), f"select distinct match_text, {_norm('match_text')} norm from link_requests"),
    "er_canonicalize_name": (lambda s, d: view(s, d, "link_requests").select("match_text", R.canonicalize_name(F.col("match_text")).alias("canon")).distinct(), f"select distinct match_text, {_canon('match_text')} canon from link_requests"),
    "er_salient_tokens": (lambda s, d: forms(s, d).select("id", *N, F.array_join(F.array_sort("q.entity"), " ").alias("tokens")), f"select id, name_a, name_b, array_to_string(list_sort(entb), ' ') tokens from {_FX} f"),
    "er_token_jaccard": (lambda s, d: forms(s, d).select("id", *N, F.round(R.token_jaccard(P()["norm"], Q_()["norm"]), 6).alias("j")), f"select id, name_a, name_b, round({_JAC}, 6) j from {_FX} f"),
    "er_name_similarity": (lambda s, d: forms(s, d).select("id", *N, F.round(R.name_similarity(P()["norm"], Q_()["norm"]), 6).alias("sim")), f"select id, name_a, name_b, round({_SIM}, 6) sim from {_FX} f"),
    "er_names_conflict": (lambda s, d: forms(s, d).withColumn("j", R.token_jaccard(P()["norm"], Q_()["norm"])).select("id", *N, R.names_conflict(P(), F.when(F.col("id") < "link_8", F.concat_ws(" near ", "name_b", "id")), Q_(), F.when(F.col("id") > "link_4", F.col("name_a")), F.col("j")).alias("conflict")), f"""
        , t as (select *, {_JAC} j, list_distinct(list_filter(string_split(na, ' '), lambda q: regexp_matches(q, '[0-9]'))) x, list_distinct(list_filter(string_split(nb, ' '), lambda q: regexp_matches(q, '[0-9]'))) y from {_FX} f)
        select id, name_a, name_b, (len(x) > 0 and len(y) > 0 and not {_SAMESET.format('x', 'y')}) or (j < 0.15 and not ((nb <> '' and coalesce(case when id < 'link_8' then contains(lower(name_b || ' near ' || id), nb) end, false)) or (na <> '' and coalesce(case when id > 'link_4' then contains(lower(name_a), na) end, false)))) conflict from t"""),
    "er_numeric_conflict": (lambda s, d: forms(s, d).select("id", *N, R.numeric_conflict(P(), Q_()).alias("conflict")), f"select id, name_a, name_b, numeric_conflict conflict from {_RU} r"),
    "er_qualifier_conflict": (lambda s, d: forms(s, d).select("id", *N, R.qualifier_conflict(P(), Q_(), VOCAB).alias("conflict")), f"select id, name_a, name_b, qualifier_conflict conflict from {_RU} r"),
    "er_acronym_same": (lambda s, d: forms(s, d).select("id", *N, R.acronym_same(P(), Q_()).alias("same")), f"select id, name_a, name_b, acronym_same same from {_RU} r"),
    "er_alias_same": (lambda s, d: forms(s, d).select("id", *N, R.alias_same(P(), Q_()).alias("same")), f"select id, name_a, name_b, alias_same same from {_RU} r"),
    "er_same_entity": (lambda s, d: forms(s, d).select("id", *N, R.same_entity(P(), Q_(), VOCAB).alias("same")), f"select id, name_a, name_b, same from {_RU} r"),
    "er_merge_tier": (lambda s, d: forms(s, d).select("id", *N, R.merge_tier(P(), Q_(), F.when(F.length("name_a") % 2 == 0, 0.9), VOCAB).alias("tier")), f"select id, name_a, name_b, {_tier('(case when length(name_a) % 2 = 0 then 0.9 end)')} tier from {_RU} r"),
    "er_shadow_rule": (lambda s, d: forms(s, d).select("id", *N, R.shadow_rule(P(), Q_(), VOCAB).alias("rule")), f"select id, name_a, name_b, rule from {_RU} r"),
    "er_blocked_pairs": (lambda s, d: R.blocked_pairs(_concepts(s, d), VOCAB), _CF + " select * from bk"),
    "er_classified_pairs": (lambda s, d: _classified(s, d).withColumn("cos", F.round("cos", 6)).withColumn("sim", F.round("sim", 6)), _CP + " select * from cl"),
    "er_verifier_drain": (lambda s, d: R.drained(_classified(s, d).select("id_a", "id_b", "band"), R.blocked_pairs(_concepts(s, d), VOCAB).select("id_a", "id_b", F.when(F.col("id_a") < "topo_0080", "SAME").otherwise("DIFFERENT").alias("verdict"))), _CP + """
        select cl.id_a, cl.id_b, case when band <> 'verify' then band when bk.id_a is null then 'review' when bk.id_a < 'topo_0080' then 'auto' else 'drop' end band from cl left join bk on bk.id_a = cl.id_a and bk.id_b = cl.id_b"""),
    "er_merge_components": (lambda s, d: connected_components(_classified(s, d).filter("band in ('auto', 'review')"), "id_a", "id_b"), _CP.replace(", cf as", ", recursive cf as", 0) + """, g as materialized (select id_a a, id_b b from cl where band in ('auto', 'review') union select id_b, id_a from cl where band in ('auto', 'review')),
        w(node, component) as (select a, a from g union select g.b, w.component from w join g on g.a = w.node) select node, min(component) component from w group by 1"""),
    "er_capped_clusters": (lambda s, d: R.capped_clusters(_classified(s, d).filter("band <> 'drop'").select("id_a", "id_b"), _concepts(s, d).select("id", "embedding")), None),
    "er_tiered_match": (lambda s, d: R.tiered_match(_best(s, d), low=0.2), _KNN + """
        , b as (select query_id || '-' || id mention_id, query_id % 100 chunk_id, id, round(s, 6) cos from kr where r <= 5),
        t as (select *, case when id % 9 = 0 then 'T0' when cos >= 0.85 and id % 2 <> 0 then 'T1' when cos >= 0.2 or 0.3 >= 0.2 then 'T2' else 'T3' end tier from b),
        n as (select *, row_number() over (partition by chunk_id, tier order by mention_id) turn from t)
        select mention_id, chunk_id, tier, case when tier in ('T0','T1') then 'matched' when tier = 'T3' then 'new' when turn <= 8 and id % 3 = 0 then 'matched' when turn <= 8 and id % 3 = 1 then 'new' else 'ambiguous' end outcome from n"""),
    "er_banded_match": (lambda s, d: _knn(s, d).select("query_id", "id", R.banded_match(F.round("similarity", 6) * 2).alias("outcome")), _KNN + " select query_id, id, case when round(s, 6) * 2 >= 0.85 then 'matched' when round(s, 6) * 2 >= 0.6 then 'ambiguous' else 'new' end outcome from kr where r <= 5"),
    "er_equation_match": (lambda s, d: R.equation_match(_eqs(s, d).select(F.col("equation_id").alias("mention_id"), "latex"), _eqs(s, d).filter("equation_id > 'eq_15'")), f"select a.equation_id mention_id, min(b.equation_id) equation_id from {_EQ} a left join (select * from {_EQ} z where equation_id > 'eq_15') b on a.k = b.k group by 1"),
    "er_parameter_match": (lambda s, d: R.parameter_match(_mentions(s, d), view(s, d, "parameter_nodes")), r"""
        , m as (select distinct link_id mention_id, trim(regexp_replace(lower(coalesce(match_text, '')), '\s+', ' ', 'g')) k, case when link_id < 'link_8' then 'v' else '' end mu from link_requests where target_label = 'Parameter'),
        p as (select trim(regexp_replace(lower(coalesce(name, '')), '\s+', ' ', 'g')) k, trim(lower(coalesce(units, ''))) pu, parameter_id from parameter_nodes where trim(coalesce(name, '')) <> ''),
        j as (select m.mention_id, parameter_id, case when parameter_id is null or (mu <> '' and pu <> '' and mu <> pu) then 0 when mu <> '' and mu = pu then 2 else 1 end sc from m left join p using (k))
        select mention_id, arg_min(case when sc > 0 then parameter_id end, (case when sc > 0 then -sc else 9 end, parameter_id)) parameter_id from j group by 1"""),
    "er_match_candidates": (lambda s, d: R.match_candidates(_knn(s, d, 8).select(F.col("query_id").cast("string").alias("query_id"), F.col("id").cast("string").alias("id"), F.round("similarity", 6).alias("cos")), _knn(s, d, 8).filter("id % 3 = 0").select(F.col("query_id").cast("string").alias("query_id"), F.concat("id", F.when(F.col("id") % 2 == 0, "t").otherwise("")).alias("id")), 4), _KNN + """
        , v as (select query_id::varchar query_id, id::varchar id, round(s, 6) cos from kr where r <= 8), t as (select query_id::varchar query_id, id::varchar || case when id % 2 = 0 then 't' else '' end id from kr where r <= 8 and id % 3 = 0),
        j as (select coalesce(v.query_id, t.query_id) query_id, coalesce(v.id, t.id) id, cos, t.id is not null text_hit from v full join t on v.query_id = t.query_id and v.id = t.id)
        select * exclude r from (select *, row_number() over (partition by query_id order by coalesce(cos, -2) desc, id) r from j) where r <= 8"""),
    "er_hybrid_search": (lambda s, d: R.hybrid_search(_hits(s, d).filter("ord <= 4"), _hits(s, d).filter("ord between 3 and 8"), _hits(s, d).filter("ord % 5 = 0"), 9), f"""
        , h as (select * from {_HIT} z), u as (select query_id, id, 0 src, ord from h where ord <= 4 union all select query_id, id, 1, ord from h where ord between 3 and 8 union all select query_id, id, 2, ord from h where ord % 5 = 0),
        f as (select *, row_number() over (partition by query_id, id order by src, ord) f from u), g as (select query_id, id, src source, row_number() over (partition by query_id order by src, ord, id) as rank from f where f = 1)
        select * from g where rank <= 9"""),
    "er_resolve_reference": (lambda s, d: R.resolve_reference(_cands(s, d), 0.2, 0.01), _KNN + """
        , c as (select query_id, id, case id % 4 when 0 then 'exact' when 1 then 'text' else 'vector' end kind, id % 3 po, id % 5 nl, round(s, 6) cos from kr where r <= 5),
        e as (select query_id, arg_min(id, (po, nl, id)) e from c where kind = 'exact' group by 1), t as (select query_id, arg_min(id, (-cos, id)) t from c where kind = 'text' and cos >= 0.2 group by 1),
        v as (select query_id, id v from (select *, lead(cos) over w nx, row_number() over w r from c where kind = 'vector' window w as (partition by query_id order by cos desc, id)) where r = 1 and cos >= 0.2 and (nx is null or cos - nx >= 0.01))
        select q.query_id, coalesce(e, t, v) id from (select distinct query_id from c) q left join e using (query_id) left join t using (query_id) left join v using (query_id)"""),
    "er_cross_source_pairs": (lambda s, d: R.cross_source_pairs(_relink(s, d), _relink(s, d).filter("id % 5 = 0").select(F.col("concept_id").alias("a"), F.col("id").alias("b")), 3, 0.1).select("concept_id", "id", "rank"), _KNN + """
        , f as (select query_id concept_id, id, row_number() over (partition by query_id order by round(s, 6) desc, id) as rank from kr where r <= 12 and sa <> sb and round(s, 6) >= 0.1 and id % 5 <> 0) select * from f where rank <= 3"""),
    "er_novelty": (lambda s, d: R.novelty([f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)], [f"T{i}" for i in range(8)] + ["ECONOMY", "STANDARD"], view(s, d, "part").select(F.col("p_brand").alias("metric"), F.col("p_type").alias("knob"))), """
        select 'Brand#' || i || j metric, k knob from range(1, 6) a(i), range(1, 6) b(j), (select unnest(['T0','T1','T2','T3','T4','T5','T6','T7','ECONOMY','STANDARD']) k) where not exists (select 1 from part where p_brand = 'Brand#' || i || j and p_type = k)"""),
    "er_projected_relation": (lambda s, d: view(s, d, "link_requests").select("link_id", "rel_type", R.projected_relation(F.lower("rel_type"), VOCAB).alias("core")).distinct(), "select distinct link_id, rel_type, case upper(rel_type) when 'GROUNDS' then 'SUPPORTS' when 'REALIZES' then 'INSTANCE_OF' else upper(rel_type) end core from link_requests"),
    "vector_nearest": (lambda s, d: _knn(s, d).select("query_id", "id", "rank"), _KNN + " select query_id, id, r as rank from kr where r <= 5"),
    "vector_cosine": (lambda s, d: view(s, d, "embeddings").select("vec_id", F.round(X.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("cos")), "select vec_id, round(list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]), 6) cos from embeddings"),
    "vector_truncated": (lambda s, d: view(s, d, "embeddings").select("vec_id", F.round(F.aggregate(X.truncated(F.col("embedding"), 16), F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size(X.truncated(F.col("embedding"), 16)).cast("long").alias("n")), "select vec_id, round(list_sum(embedding[1:16]::double[]) / sqrt(list_inner_product(embedding[1:16]::double[], embedding[1:16]::double[])), 5) total, 16::bigint n from embeddings"),
}


def queries() -> dict:
    """Query name -> (spark, sf_dir) -> DataFrame."""
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    """The same in DuckDB's SQL."""
    return {k: with_views(("with recursive " if "w(node" in q else "with ") + q.strip()[2:] if q.strip().startswith(", ") else q) for k, (_, q) in Q.items() if q}
