"""Scanned text: page numbers, running lines, breaks, misreadings, and what is none of these."""

from collections import Counter

import pytest

from lodeweave.llm import scanrepair as R

CLEAN = ["the reference voltage of the output stage settled near the corner and the margin stays thin",
         "keep the clock tree away from the input pair before any post-layout fix of the output stage",
         "nobody has explained why the common mode loop needs more margin in the output stage"]


NOISE = ["the c1ock tree", "the 0utput stage", "the ontput stage", "the comer before", "the margin stay5 thin", "more margiri in", "before any fix 0f the", "the refercnce voltage", "tbe output stage"]


@pytest.fixture(scope="module")
def channel():
    """A collection of clean lines, a few misread ones that tell the noise, and running lines."""
    counts = Counter()
    for t in CLEAN:
        for _ in range(200):
            counts.update(R.grams(t))
    for t in NOISE:
        counts.update(R.grams(t))
    for x in "abcdef":
        counts.update(R.grams(f"Reprint copy, not for release {x}\nChapter notes {x}"))
    return R.Model.of(counts)


@pytest.mark.parametrize("line", ["p. 359", "- 72 -", "— 460 —", "[387]", "~254~", "977", "vi", "Page 12 of 90", "   213 "])
def test_page_numbers(line):
    assert R.is_page_number(line)


@pytest.mark.parametrize("line", ["", "mV.", "12.4", "7.2 mV", "a page", "corner."])
def test_no_page_numbers(line):
    assert not R.is_page_number(line)


@pytest.mark.parametrize("line", ["CHAPTER 2  LOOP STABILITY", "465  BIAS NETWORKS", "Chapter 3  Loop stability", "chaptcr notes k", "A Guide to Regulator Notes   12", "A GUIDE T0 REGULATOR NOTES", "Reprint copy, not for release B"])
def test_headers(channel, line):
    assert R.is_header(line, channel, "A Guide to Regulator Notes", "Loop stability")


@pytest.mark.parametrize("line", ["The bench session stopped at point", "corner.", "MHz/V, as sheet 29742 lists.", "LSB."])
def test_no_headers(channel, line):
    assert not R.is_header(line, channel, "A Guide to Regulator Notes", "Loop stability")


def test_repair(channel):
    text = "keep the c1ock tree away from the in-\n- 72 -\nput pair before any post-\nlayout fix of the ontput\nstage\n\nthe comer and the margiri"
    out, kinds = R.repair(text, channel)
    assert out == "keep the clock tree away from the input pair before any post-layout fix of the output stage\n\nthe corner and the margin"
    assert kinds == ["hyphen", "misread", "page_no"]


@pytest.mark.parametrize("text", ["keep the clock\ntree away from\nthe input pair", "Net 0ut60 and vb1as10 of the output stage", "one line only", CLEAN[0]])
def test_clean_texts_have_no_kinds(channel, text):
    out, kinds = R.repair(text, channel)
    assert kinds == [] and out == text.replace("\n", " ")


@pytest.mark.parametrize("text", ["he had a bad file on the tile", "the bead on her hut", "a modem in the corner of the stage"])
def test_words_that_only_look_alike_stay(channel, text):
    assert R.repair(text, channel) == (text, [])


def test_confusions_are_estimated(channel):
    """Each confusion has a rate of its own, and a collection without noise has none."""
    counts = Counter({"house": 5000, "hause": 4, "h0use": 15, "those": 4000, "tbose": 2})
    classes = [[("house", 5000), ("h0use", 15)], [("those", 4000), ("tbose", 2)]]
    found = Counter()
    for c in classes:
        found.update(R.noise_counts(c))
    p = dict(zip(R.CONFUSIONS, R.confusion_probabilities(found)))
    assert 0.001 < p["o", "0"] < 0.01 and 0 < p["h", "b"] < p["o", "0"]
    assert set(R.confusion_probabilities({})) == {0.0} and not R.Model.of(Counter({"had": 5000, "bad": 3})).doubt
    assert counts and R.confused("corner", "comer") and not R.confused("corner", "carpet")


def test_frequent_words_do_not_vanish_with_the_collection():
    """A rare word stays what it is however much else is counted."""
    counts = Counter({"had": 10**9, "h0d": 1000, "bad": 40, "that": 10**9, "tha7": 5})
    m = R.Model.of(counts)
    assert R.repair("a rare quokka", m) == ("a rare quokka", [])


def test_nothing(channel):
    assert R.repair(None, channel) == (None, []) and R.repair("", channel) == ("", []) and R.repair(" \n ", channel) == (" \n ", [])
    assert R.repair("", R.Model.of({})) == ("", [])
    assert R.repair("some words\nhere", R.Model.of({}))[0] == "some words here"


def test_partitions_know_what_the_whole_collection_tells(spark, sf_dir):
    """Spark's result equals the repair with the counts of all texts in one place."""
    from lodeweave.session import table

    chunks, sources = table(spark, sf_dir, "source_chunks"), table(spark, sf_dir, "source_nodes")
    rows = chunks.select("chunk_id", "source_id", "section_title", "text_preview").collect()
    titles: dict = {}
    for r in sources.collect():
        titles[r.source_id] = max(filter(None, [titles.get(r.source_id), r.title]), default=None)
    counts = Counter()
    for r in rows:
        counts.update(R.grams(r.text_preview) if r.text_preview else [])
    model = R.Model.of(counts)
    want = {(r.chunk_id, r.source_id, r.section_title, r.text_preview) for r in rows}
    want = sorted((str(c), *map(str, R.repair(t, model, titles.get(s), h))) for c, s, h, t in want)
    got = sorted((str(r.chunk_id), str(r.repaired), str(r.kinds)) for r in R.repaired(chunks, sources).collect())
    assert got == want and any("misread" in g[2] for g in got)


def test_operator(spark):
    schema = "chunk_id string, source_id string, section_title string, text_preview string, title string, kinds int"
    rows = [(f"c{i}", None if i % 5 == 0 else "hot", None, CLEAN[i % 3], "clash", 1) for i in range(60)]
    rows += [("n1", "hot", None, "- 4 -\nkeep the clock tree", "x", 1), ("n1", "hot", None, "- 4 -\nkeep the clock tree", "x", 1), ("n2", None, None, None, None, None), (None, None, None, "vi\nthe corner", None, None)]
    chunks = spark.createDataFrame(rows, schema)
    sources = spark.createDataFrame([("hot", "A Title"), ("hot", "A Title"), (None, "B")], "source_id string, title string")
    got = {tuple(r) for r in R.noise(chunks, sources).collect()}
    assert got == {("n1", "page_no"), (None, "page_no")}
    assert R.noise(chunks.limit(0), sources).count() == 0 and R.noise(chunks, sources.limit(0)).count() == 2
