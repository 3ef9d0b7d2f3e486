"""Text operators against plain Python."""

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import audit as A
from lodeweave.operators import resolution as R
from lodeweave.operators import text as T
from lodeweave.sources import io as I


def pack(text, limit, overlap, sep):
    done, cur = [], ""
    for p in text.split(sep):
        if cur and len(cur) + len(p) + len(sep) > limit:
            done.append(cur)
            cur = cur[-overlap:] + sep + p if overlap and len(cur) > overlap else p
        else:
            cur = cur + sep + p if cur else p
    return done + [cur] if cur.strip() else done


@pytest.mark.parametrize("limit, overlap, sep", [(20, 0, "\n\n"), (20, 5, "\n\n"), (9, 3, "\n")])
def test_packing(spark, limit, overlap, sep):
    texts = ["", "short", sep.join(["alpha beta", "gamma", "delta epsilon zeta eta", "x"]), sep.join("abcdefgh" * 3), "y" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.packed(F.col("t"), limit, overlap, sep).alias("p"))
    assert [r.p for r in df.collect()] == [pack(t, limit, overlap, sep) for t in texts]


def lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


@pytest.mark.parametrize("a, b", [("kitten", "sitting"), ("", "x"), ("abc", "abc"), ("phase margin", "margin phase"), ("aaaa", "aa")])
def test_subsequence(a, b):
    assert R._lcs(a, b) == lcs(a, b)


def test_common_substring():
    assert T._common("vgs2ox", "aagso2ox") == "2ox"
    rng = __import__("random").Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab1") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        want = max((b[i:j] for i in range(len(b)) for j in range(i + 1, len(b) + 1) if b[i:j] in a), key=len, default="")
        assert len(T._common(a, b)) == len(want) and T._common(a, b) in a
    assert T._common("abc", "xyz") == ""


V = R.Vocabulary(aliases={"ring": ["ring oscillator", "ring osc"]}, qualifiers=("cell",), generic=("amplifier",), discriminators=("pseudo",), stop=("of",))


@pytest.mark.parametrize(
    "a, b, tier",
    [("Loop Gain", "loop-gain", "MERGE"), ("Slew Rate Limit", "SRL", "MERGE"), ("3T pixel", "4T pixel", "REJECT"), ("offset voltage", "offset voltage drift", "REJECT"), ("ring osc", "ring oscillator cell", "MERGE"), ("slew rate", "settling time", "VERIFY"), ("offset", "offset amplifier", "VERIFY"), (None, "x", "VERIFY")],
)
def test_merge_tier(spark, a, b, tier):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(R.merge_tier(R.profile(F.col("a"), V), R.profile(F.col("b"), V), F.lit(0.9), V).alias("t"))
    assert df.first().t == tier


@pytest.mark.parametrize(
    "a, b, same, rule",
    [("ring osc", "ring oscillator", True, "alias"), ("ring osc", "ring oscillator cell", True, "generic_qualifier"), ("current mirror", "mirror current", True, "salient_containment"), ("pseudo current mirror", "current mirror", False, "salient_containment"), ("fast current mirror", "current mirror", True, "salient_containment"), ("mirror", "current mirror", False, "salient_containment"), ("ota", "cascode ota", True, "salient_containment"), ("", "x", False, "salient_containment"), (None, None, False, "salient_containment")],
)
def test_same_entity_and_rule(spark, a, b, same, rule):
    p, q = R.profile(F.col("a"), V), R.profile(F.col("b"), V)
    r = spark.createDataFrame([(a, b)], "a string, b string").select(R.same_entity(p, q, V).alias("s"), R.shadow_rule(p, q, V).alias("r")).first()
    assert (r.s, r.r) == (same, rule)


WORDS = A.Wording(trust=("certif", "verified"), negations=("not", "no", "without", "nobody", "cannot"), processes={"fastp": "fast", "fast": "fast", "slow-x": "slow", "slow": "slow"}, copulas=("is", "remains"), states=("tested", "verified"))


@pytest.mark.parametrize(
    "text, trusts",
    [("This is not yet certified.", False), ("An unverified claim", False), (None, False), ("", False), ("It does not help. The gain is verified.", True), ("A non-verified claim", False), ("It isn't something we would ever call certified", False), ("It isn't one of those that we would ever call certified", True), ("Not 0.5 but certified", False), ("certification stands", True)],
)
def test_negation(text, trusts):
    assert A.affirmed(text, WORDS) is trusts


@pytest.mark.parametrize(
    "text, stated",
    [("Works on fastp, not on slow [certified: slow]", ["fast"]), ("slow-x remains still untested", []), ("fast is not yet verified. Here slow is fine", ["slow"]), ("fast but not on slow", ["fast"]), ("unslow", []), (None, [])],
)
def test_stated_processes(text, stated):
    assert A.stated_processes(text, WORDS) == stated


def test_scope_overstatement(spark):
    answers = spark.createDataFrame([("d1", "Holds in fast and slow. [cite: a]"), ("d2", "Holds in fast. [ cite : a; b ]"), ("d3", "Holds in slow. [cite: b]"), ("d4", None)], "doc_id string, text string")
    nodes = spark.createDataFrame([("a", "ClaimCard", "VERIFIED", None, ["fast"]), ("b", "ClaimCard", "VERIFIED", None, None)], "node_id string, label string, verdict string, status string, scope array<string>")
    got = {(r.doc_id, r.kind) for r in A.answer_findings(answers, nodes, WORDS).collect()}
    assert got == {("d1", "scope_overstatement")}


def test_json_recovery():
    assert T.first_object('Sure:\n```json\n{"b": 1, "a": [2]}\n```') == '{"a":[2],"b":1}'
    assert T.first_object("{broken") is None and T.first_object(None) is None


def test_html():
    assert I.parse_html("<script>x</script><h1>A &amp; B</h1><p>v<sub>gs</sub></p>") == ("A & B", "# A & B\nv_gs")
    assert I.parse_html(None) == ("", "")


def test_export_round_trip(spark, tmp_path):
    n = spark.createDataFrame([("Concept", "1", 'q"uote\n', None, 0.5, False), ("Memory", "2", "m", "d", 0.5, None), ("Concept", "3", "gone", "d", 0.5, True)], "label string, node_id string, name string, domain string, confidence double, retracted boolean")
    e = spark.createDataFrame([("1", "R", "1", 0.1, 1), ("1", "R", "2", 0.1, 1)], "src_id string, rel_type string, dst_id string, confidence double, reinforcement_count bigint")
    I.write_export(I.export_lines(n, e), str(tmp_path / "x"))
    back = I.read_lines(spark, str(tmp_path / "x" / "*"))
    I.check_header(back)
    assert [tuple(r) for r in I.import_nodes(back).collect()] == [("Concept", "1", 'q"uote\n', None, 0.5)]
    assert I.import_edges(back).count() == 1
    with pytest.raises(ValueError):
        I.check_header(back.limit(0))
