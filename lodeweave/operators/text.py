"""Text and document operators: sections, packing, grounding, evidence selection, formats.

Everything is an expression or a window per document; Arrow UDFs serve only the longest
common substring, negation windows and JSON recovery. Null texts behave as empty ones.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STOP = "a an and are as at be by for from in is it its of on or that the this to was were with".split()
# The decimal powers of SI suffixes.
SI = {"T": 1e12, "G": 1e9, "MEG": 1e6, "K": 1e3, "M": 1e-3, "U": 1e-6, "N": 1e-9, "P": 1e-12, "F": 1e-15}


def lines(documents: DataFrame, sep: str = r"\r?\n") -> DataFrame:
    """(doc_id, pos, line)."""
    return documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), sep)).alias("pos", "line"))


def sections(blocks: DataFrame, heading: Column | None = None) -> DataFrame:
    """(doc_id, section, title, first_pos, n_lines, n_chars): a new section at each heading, the part before is 'Untitled'."""
    h = heading if heading is not None else F.col("line").rlike(r"^#+ ")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.withColumn("h", h).withColumn("section", F.sum(F.col("h").cast("int")).over(w))
    g = b.groupBy("doc_id", "section").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max(F.when(F.col("h"), F.col("line"))).alias("t"))
    return g.select("doc_id", "section", F.coalesce(F.trim(F.regexp_replace("t", r"^#+ ", "")), F.lit("Untitled")).alias("title"), "first_pos", "n_lines", "n_chars")


def page_bounds(pages: Column) -> tuple[Column, Column]:
    """First and last page of 'a' or 'a-b'; null if it is neither."""
    m = F.regexp_extract(F.coalesce(pages, F.lit("")), r"^(\d+)(?:-(\d+))?$", 1)
    n = F.regexp_extract(F.coalesce(pages, F.lit("")), r"^(\d+)(?:-(\d+))?$", 2)
    first = F.when(m != "", m.try_cast("int"))
    return first, F.when(n != "", n.try_cast("int")).otherwise(first)


def page_range(chunks: DataFrame) -> DataFrame:
    """(source_id, pages): the range that a source's chunks span; null without any page."""
    a, b = page_bounds(F.col("pages"))
    g = chunks.groupBy("source_id").agg(F.min(a).alias("a"), F.max(b).alias("b"))
    return g.select("source_id", F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"))).alias("pages"))


def page_at(positions: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc_id, pos, page): the last page that starts at or before each position (as-of), the first page before all.

    Positions and starts are merged in one window per document; no pairs are formed."""
    u = positions.select("doc_id", "pos", F.lit(None).cast("int").alias("page"), F.lit(1).alias("k")).unionByName(starts.select("doc_id", F.col("start").alias("pos"), "page", F.lit(0).alias("k")))
    w = Window.partitionBy("doc_id").orderBy("pos", "k", "page").rowsBetween(Window.unboundedPreceding, 0)
    f = u.withColumn("p", F.last("page", True).over(w)).withColumn("first", F.min(F.struct("pos", "page")).over(Window.partitionBy("doc_id")))
    first = starts.groupBy("doc_id").agg(F.min_by("page", "start").alias("p0"))
    return f.filter("k = 1").join(first, "doc_id", "left").select("doc_id", "pos", F.coalesce("p", "p0").alias("page"))


def packed(text: Column, limit: int, overlap: int = 0, sep: str = "\n\n") -> Column:
    """Array of chunks: paragraphs packed greedily up to ``limit`` characters, each chunk led by the last ``overlap``
    characters of the one before; a longer paragraph stays whole."""
    paras = F.split(F.coalesce(text, F.lit("")), re.escape(sep) if sep != "\n" else "\n")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    n = len(sep)

    def step(s, p):
        full = (F.length(s["cur"]) + F.length(p) + n > limit) & (s["cur"] != "")
        tail = F.when((F.lit(overlap) > 0) & (F.length(s["cur"]) > overlap), F.concat(F.substring(s["cur"], -max(overlap, 1), max(overlap, 1)), F.lit(sep), p)).otherwise(p)
        grown = F.when(s["cur"] == "", p).otherwise(F.concat(s["cur"], F.lit(sep), p))
        return F.struct(F.when(full, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]).alias("done"), F.when(full, tail).otherwise(grown).alias("cur"))

    return F.aggregate(paras, empty, step, lambda s: F.when(F.trim(s["cur"]) == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))))


def chunked(documents: DataFrame, limit: int, overlap: int = 0, sep: str = "\n\n") -> DataFrame:
    """(chunk_id, doc_id, chunk_index, text, token_estimate): four characters a token."""
    c = documents.select("doc_id", F.posexplode(packed(F.col("text"), limit, overlap, sep)).alias("chunk_index", "text"))
    return c.select(F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index", "text", F.floor(F.length("text") / 4).alias("token_estimate"))


def heading_kind(line: Column) -> Column:
    """numbered, roman, chapter, academic or caps heading; null for none."""
    s = F.trim(line)
    return F.when(F.length(s) > 80, None).when(s.rlike(r"^\d+(\.\d+)*\.? [A-Z]"), "numbered").when(s.rlike(r"^[IVXLC]+\. "), "roman").when(s.rlike(r"(?i)^(chapter|section|part) \d+"), "chapter").when(s.rlike(r"(?i)^(abstract|introduction|conclusions?|references|appendix)\b"), "academic").when(s.rlike(r"^[A-Z][A-Z ]{5,}$"), "caps")


def caption_kind(c: Column, kinds: list[tuple[str, str]], other: str = "other") -> Column:
    """The first of the ordered (kind, pattern) whose pattern the caption holds, whatever the case; null and unknown ones are ``other``."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(other)
    for kind, rx in reversed(kinds):
        out = F.when(low.rlike(rx), kind).otherwise(out)
    return out


# Fixed value: how the grounding rule splits a name into words, in ``grounded`` below.
def grounded(name: Column, text: Column) -> Column:
    """The name occurs in the text, or half of its words of three letters do; a name without such words counts as grounded."""
    n, t = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    ws = F.filter(F.split(n, r"[\s\-_/]+"), lambda w: F.length(w) >= 3)
    hit = F.size(F.filter(ws, lambda w: t.contains(w)))
    return t.contains(n) | (F.size(ws) == 0) | (hit >= 0.5 * F.size(ws))


def parameter_grounded(symbol: Column, name: Column, text: Column) -> Column:
    """The symbol (also without underscores), the name, or half of its longer words occur."""
    t, s, n = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.regexp_replace(F.coalesce(symbol, F.lit("")), r"\\", "")), F.lower(F.coalesce(name, F.lit("")))
    flat = F.regexp_replace(s, "_", "")
    ws = F.filter(F.split(n, r"\s+"), lambda w: F.length(w) >= 3)
    by_words = (F.size(ws) > 0) & (F.size(F.filter(ws, lambda w: t.contains(w))) >= 0.5 * F.size(ws))
    return ((s != "") & t.contains(s)) | ((F.length(flat) >= 2) & t.contains(flat)) | ((n != "") & (t.contains(n) | by_words))


def _greek() -> dict[str, str]:
    """Small Greek letters by name, from the character database."""
    named = ((chr(c), unicodedata.name(chr(c), "")) for c in range(0x3B1, 0x3CA))
    return {c: n.split()[-1].lower().replace("lamda", "lambda") for c, n in named if n.startswith("GREEK SMALL LETTER ") and "FINAL" not in n} | {"µ": "mu"}


def equation_key(c: Column) -> Column:
    """Lower case letters and digits; Greek letters and their commands by name, other commands dropped."""
    s = F.lower(F.coalesce(c, F.lit("")))
    names = _greek()
    for g, n in names.items():
        s = F.replace(s, F.lit(g), F.lit(n))
    s = F.regexp_replace(s, r"\\(" + "|".join(sorted(set(names.values()), key=lambda n: (-len(n), n))) + ")(?![a-z])", "$1")
    return F.regexp_replace(F.regexp_replace(s, r"\\[a-z]+", " "), "[^a-z0-9]+", "")


def _common(a: str, b: str) -> str:
    """Longest common substring, the first in b of several: b is read through a suffix automaton of a, whose size is linear in a."""
    to: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in a:
        cur = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in to[p]:
            to[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = to[p][ch]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(ch) == q:
                    to[p][ch] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    state = size = best = end = 0
    for i, ch in enumerate(b):
        while state and ch not in to[state]:
            state = link[state]
            size = length[state]
        if ch in to[state]:
            state, size = to[state][ch], size + 1
        if size > best:
            best, end = size, i + 1
    return b[end - best : end]


def common_substring(a: Column, b: Column) -> Column:
    """The longest common substring, the first in b of several; '' for none."""

    @F.pandas_udf("string")
    def common(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([_common(x, y) if x and y else "" for x, y in zip(xs, ys)])

    return common(a, b)


def equation_grounded(latex: Column, variables: Column, text: Column) -> Column:
    """Four characters in common with the text; without a digit they must not lie inside a variable's name.
    An equation without variables or without a key counts as grounded."""
    k = equation_key(latex)
    s = common_substring(k, equation_key(text))
    heads = F.transform(variables, lambda v: equation_key(F.regexp_extract(v, r"^[^:(]*", 0)))  # what a note or unit adds is no name
    inside = F.array_join(heads, "|").contains(s)  # keys hold no bar, so no match crosses two
    return (F.size(variables) <= 0) | (k == "") | ((F.length(s) >= 4) & (s.rlike("[0-9]") | ~F.coalesce(inside, F.lit(False))))


def scope_widened(description: Column, text: Column, directional: tuple[str, ...], universal: tuple[str, ...]) -> Column:
    """A description with a directional word (a stem) uses a universal word that the text does not; both lists are inputs."""
    every = r"\b(" + "|".join(map(re.escape, universal)) + r")\b"
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(every), F.lit(1))
    tends = F.coalesce(F.lower(description).rlike(r"\b(" + "|".join(map(re.escape, directional)) + ")"), F.lit(False))
    return tends & (F.size(F.array_except(words(description), words(text))) > 0)


def edges_grounded(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges (chunk_id, source_name, target_name) with both names among the chunk's names(chunk_id, name), whatever the case."""
    n = names.select("chunk_id", F.lower("name").alias("n")).distinct()
    e = edges.withColumn("s", F.lower("source_name")).withColumn("t", F.lower("target_name"))
    return e.join(n.withColumnRenamed("n", "s"), ["chunk_id", "s"], "left_semi").join(n.withColumnRenamed("n", "t"), ["chunk_id", "t"], "left_semi").drop("s", "t")


def quality_gate(mentions: DataFrame, chunks: DataFrame, min_entities: int = 1, min_ratio: float = 0.5, min_length: int = 10) -> DataFrame:
    """(chunk_id, n_entities, reasons): too few entities, few descriptions, mostly snake_case names, low density; '' passes.

    mentions: chunk_id, name, description; chunks without mentions have 0."""
    snake = F.col("name").contains("_") & ~F.col("name").contains(" ")
    g = mentions.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(F.coalesce("description", F.lit(""))) >= min_length).alias("filled"), F.count_if(snake).alias("snake"))
    j = chunks.select("chunk_id", F.length(F.coalesce("text_preview", F.lit(""))).alias("len")).join(g, "chunk_id", "left").fillna(0, ["n", "filled", "snake"])
    n = F.col("n")
    why = F.concat_ws(";", F.when(n < min_entities, "entities"), F.when((n > 0) & (F.col("filled") < min_ratio * n), "descriptions"), F.when((n > 0) & (F.col("snake") > 0.5 * n), "snake_case"), F.when(n < F.greatest(F.lit(1), F.floor(F.col("len") / 2000)), "density"))
    return j.select("chunk_id", F.col("n").alias("n_entities"), why.alias("reasons"))


def secrets_redacted(c: Column) -> Column:
    """Header values, bearer tokens and key assignments replaced; the name stays."""
    for rx, to in ((r"(?i)(authorization: )\S+( \S+)?", "$1[redacted]"), (r"(?i)\bbearer [A-Za-z0-9._-]+", "[redacted]"), (r"(?i)\b(api[_-]?key|token|password|secret)(\s*[=:]\s*)\S+", "$1$2[redacted]")):
        c = F.regexp_replace(c, rx, to)
    return c


def si_number(c: Column) -> Column:
    """'250f', '8k', '1.5meg' as a number; null if it is none."""
    m = F.regexp_extract(F.trim(c), r"^([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)([a-zA-Z]*)$", 1)
    u = F.upper(F.regexp_extract(F.trim(c), r"^([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)([a-zA-Z]*)$", 2))
    f = F.lit(1.0)
    for s, v in SI.items():
        f = F.when(u.startswith(s) & (F.lit(s == "MEG") | ~u.startswith("MEG")), v).otherwise(f)
    return m.try_cast("double") * f


def series_lines(text: DataFrame) -> DataFrame:
    """(id, series, x, y) of 'RDATA series x y' lines; x may bear a suffix, a non-finite y is dropped."""
    rx = r"^RDATA (\S+) (\S+) (\S+)$"
    p = text.select("id", *(F.regexp_extract("line", rx, i).alias(n) for i, n in ((1, "series"), (2, "a"), (3, "b")))).filter("series <> ''")
    y = F.col("b").try_cast("double")
    return p.select("id", "series", si_number(F.col("a")).alias("x"), y.alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") != float("inf")))


def device_lines(text: DataFrame) -> DataFrame:
    """(id, vg, idd, gm, gds, cgg) of 'GMID vg= id= gm= gds= cgg=' lines; lines with a bad number are skipped."""
    rx = r"GMID vg=(\S+) id=(\S+) gm=(\S+) gds=(\S+) cgg=(\S+)"
    names = ("vg", "idd", "gm", "gds", "cgg")
    return text.select("id", *(F.regexp_extract("line", rx, i + 1).try_cast("double").alias(n) for i, n in enumerate(names))).dropna(subset=list(names))


def table_rows(text: DataFrame) -> DataFrame:
    """(id, number, code, title, done) of numbered Markdown table rows '| 1 | `code` | title |'."""
    rx = r"^\|\s*(\d+)\s*\|\s*`([^`]+)`\s*\|\s*(.*?)\s*\|\s*$"
    p = text.select("id", *(F.regexp_extract("line", rx, i).alias(n) for i, n in ((1, "number"), (2, "code"), (3, "title")))).filter("number <> ''")
    return p.select("id", F.col("number").cast("int").alias("number"), "code", F.trim(F.regexp_replace("title", r"\[done\]", "")).alias("title"), F.col("title").contains("[done]").alias("done"))


def markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): blocks(doc_id, pos, type, text, level) as Markdown, joined by blank lines."""
    b = F.when((F.col("type") == "text") & (F.col("level") > 0), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).when(F.col("type") == "code", F.concat(F.lit("```\n"), "text", F.lit("\n```"))).when(F.col("type") == "image", F.concat(F.lit("[Figure: "), "text", F.lit("]"))).otherwise(F.col("text"))
    g = blocks.withColumn("md", b).filter("md is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "md"))).alias("x"))
    return g.select("doc_id", F.array_join(F.transform("x", lambda s: s["md"]), "\n\n").alias("text"))


def tokens(c: Column) -> Column:
    """Distinct lower-case words of letters and digits without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))), F.array(*map(F.lit, STOP)))


def select_evidence(items: DataFrame, chunks: DataFrame, top: int = 2) -> DataFrame:
    """(item_id, chunk_id, overlap, rank): the chunks of an item that share most tokens with its description, ties by input order.

    items: item_id, description, chunk_ids; chunks: chunk_id, section_title, text_preview. Only
    the listed chunks are joined, tokens are made once per side."""
    i = items.select("item_id", tokens(F.col("description")).alias("t"), F.posexplode("chunk_ids").alias("pos", "chunk_id")).filter("chunk_id is not null")
    c = chunks.select("chunk_id", tokens(F.concat_ws(" ", "section_title", "text_preview")).alias("u"))
    j = i.join(c, "chunk_id").withColumn("overlap", F.size(F.array_intersect("t", "u"))).groupBy("item_id", "chunk_id").agg(F.max("overlap").alias("overlap"), F.min("pos").alias("pos"))
    w = Window.partitionBy("item_id").orderBy(F.desc("overlap"), "pos")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("item_id", "chunk_id", "overlap", "rank")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash of the key (all if n is negative); the same at any partitioning."""
    if n < 0:
        return df
    return df.orderBy(F.md5(F.concat_ws("#", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def query_terms(c: Column, abbreviations: dict[str, str] | None = None, translations: dict[str, str] | None = None) -> Column:
    """Search terms: a short query whole; else word pairs, translations of the phrases it holds, then words of two letters,
    each followed by what it abbreviates, each once; else its first 40 characters. Both tables are inputs."""
    q = F.trim(F.coalesce(c, F.lit("")))
    ws = F.filter(F.transform(F.regexp_extract_all(q, F.lit(r"[A-Za-z][A-Za-z0-9.\-]+"), F.lit(0)), lambda w: F.regexp_replace(w, r"^[.\-]+|[.\-]+$", "")), lambda w: F.length(w) >= 2)
    pairs = F.filter(F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.when(F.lower(F.get(ws, i)) != F.lower(F.get(ws, i + 1)), F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1)))), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    other = F.filter(F.array(*(F.when(q.contains(k), v) for k, v in translations.items())), lambda x: x.isNotNull()) if translations else none
    if abbreviations:
        full = F.create_map(*(F.lit(x) for kv in abbreviations.items() for x in kv))
        ws2 = F.flatten(F.transform(ws, lambda w: F.filter(F.array(w, full[F.lower(w)]), lambda x: x.isNotNull())))
    else:
        ws2 = ws
    every = F.array_distinct(F.concat(F.when(F.size(ws) > 1, pairs).otherwise(none), other, ws2))
    return F.when(F.length(q) <= 40, F.array(q)).when(F.size(every) > 0, every).otherwise(F.array(F.substring(q, 1, 40)))


def file_names(names: DataFrame) -> DataFrame:
    """(id, file_name): reserved characters replaced, 200 characters, a digest of the id where two names fall together in lower case."""
    base = F.substring(F.trim(F.regexp_replace(F.coalesce("name", F.lit("")), r'[\\/:*?"<>|#^\[\]]', "_")), 1, 200)
    b = names.withColumn("base", F.when(base == "", "untitled").otherwise(base))
    clash = b.groupBy(F.lower("base").alias("low")).agg(F.count(F.lit(1)).alias("n"))
    j = b.withColumn("low", F.lower("base")).join(clash, "low")
    return j.select("id", F.when(F.col("n") > 1, F.concat("base", F.lit(" "), F.substring(F.sha1("id"), 1, 8))).otherwise(F.col("base")).alias("file_name"))


def first_object(text: str | None) -> str | None:
    """The first JSON object inside fences or prose, as compact JSON; null if there is none."""
    if not text:
        return None
    body = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", text)
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", body):
        try:
            found, _ = decoder.raw_decode(body, m.start())
        except ValueError:
            continue
        return json.dumps(found, separators=(",", ":"), sort_keys=True)
    return None


def recovered_json(c: Column) -> Column:
    """first_object of each text."""

    @F.pandas_udf("string")
    def recover(s: pd.Series) -> pd.Series:
        return s.map(first_object)

    return recover(c)


def paragraphs(documents: DataFrame, sep: str = r"\r?\n\s*\r?\n") -> DataFrame:
    """(doc_id, para, text): blank-line blocks; blocks of headings only are joined to the block that follows."""
    b = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), sep)).alias("pos", "block"))
    b = b.withColumn("h", F.col("block").rlike(r"^\s*(#+ [^\n]*\s*)+$"))
    back = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    g = b.withColumn("para", F.sum((~F.col("h")).cast("int")).over(back))
    out = g.groupBy("doc_id", "para").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("x"))
    return out.select("doc_id", F.col("pos").alias("para"), F.array_join(F.transform("x", lambda s: s["block"]), "\n").alias("text"))


def leading_text(rows: DataFrame, key: str, order: list[Column], line: Column, limit: int, marker: str = "") -> DataFrame:
    """(key, text): the lines of a key in order, joined by line ends and cut at ``limit`` characters, with ``marker`` where cut.

    Each line takes at least the one character of its line end, so only the first limit + 1 lines can
    show: these are kept by a ranked filter that works before the shuffle, and of them the lines that
    begin within the limit by the running sum of lengths. Nothing that shows is left out."""
    w = Window.partitionBy(key).orderBy(*order)
    top = rows.withColumn("l", F.coalesce(line, F.lit(""))).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit + 1)
    before = F.sum(F.length("l") + 1).over(Window.partitionBy(key).orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    kept = top.withColumn("b", F.coalesce(before, F.lit(0))).filter(F.col("b") <= limit)
    g = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "l"))).alias("x"))
    full = F.array_join(F.transform("x", lambda s: s["l"]), "\n")
    return g.select(key, F.when(F.length(full) > limit, F.concat(F.substring(full, 1, limit), F.lit(marker))).otherwise(full).alias("text"))


def context_text(rows: DataFrame, key: str, order: str, line: Column, budget: int) -> DataFrame:
    """(key, text): a key's lines in order, cut at four characters a token with a marker."""
    return leading_text(rows, key, [F.col(order)], line, 4 * budget, " [...]")


def content_blocks(items: DataFrame, schema: str | None = None) -> DataFrame:
    """(doc_id, pos, type, text, html, caption, footnote, img_path, page, level, language) of items(doc_id, pos, item), item the JSON of a parsed page element.

    Text, equation, table, code and image elements; others are dropped, as is what is no JSON. An image keeps its place among the blocks; captions given as lists are joined."""
    kind = schema or "type string, text string, page_idx int, text_level int, table_body string, table_caption array<string>, code_body string, code_caption array<string>, guess_lang string, image_caption array<string>, image_footnote array<string>, img_path string"
    p = items.select("doc_id", "pos", F.when(F.try_parse_json("item").isNotNull(), F.from_json("item", kind)).alias("i")).filter("i is not null").select("doc_id", "pos", "i.*").withColumn("type", F.coalesce("type", F.lit("text")))
    joined = lambda c: F.trim(F.array_join(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()), " "))
    is_ = lambda t: F.col("type") == t
    caption = F.when(is_("table"), joined("table_caption")).when(is_("code"), joined("code_caption")).when(is_("image"), joined("image_caption")).otherwise("")
    text = F.when(is_("code"), F.coalesce("code_body", F.lit(""))).when(is_("text") | is_("equation"), F.coalesce("text", F.lit(""))).otherwise("")
    return p.filter(F.col("type").isin("text", "equation", "table", "code", "image")).select(
        "doc_id", "pos", "type", text.alias("text"), F.when(is_("table"), F.coalesce("table_body", F.lit(""))).otherwise("").alias("html"), caption.alias("caption"), F.when(is_("image"), joined("image_footnote")).otherwise("").alias("footnote"),
        F.coalesce("img_path", F.lit("")).alias("img_path"), F.coalesce("page_idx", F.lit(0)).alias("page"), F.when(is_("text"), F.coalesce("text_level", F.lit(0))).otherwise(0).alias("level"), F.when(is_("code"), F.coalesce("guess_lang", F.lit(""))).otherwise("").alias("language"),
    )


def document_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, total_pages, n_blocks, n_figures) of content blocks."""
    return blocks.groupBy("doc_id").agg((F.max("page") + 1).alias("total_pages"), F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("type") == "image").alias("n_figures"))


FIGURE_OPEN, FIGURE_CLOSE = "<<figure>>", "<</figure>>"  # a described figure is no evidence for what is drawn from it


def section_texts(blocks: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """(doc_id, section, title, first_page, last_page, text): blocks as Markdown by section, a text block with a level opening one.

    figures(doc_id, page, kind, caption, footnote, description) come at the end of the first section that covers their
    page, each once, the description between marks."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("type") == "text") & (F.col("level") > 0)
    b = blocks.withColumn("section", F.sum(opens.cast("int")).over(w))
    heads = b.groupBy("doc_id", "section").agg(F.max(F.when(opens, F.col("text"))).alias("title"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    body = markdown(b.select(F.struct("doc_id", "section").alias("doc_id"), "pos", "type", F.when(F.col("type") == "image", F.col("caption")).when(F.col("type") == "table", F.col("html")).otherwise(F.col("text")).alias("text"), "level"))
    s = heads.join(body.select("doc_id.doc_id", "doc_id.section", "text"), ["doc_id", "section"])
    if figures is not None:
        head = F.concat(F.lit("[Figure ("), "kind", F.lit(")"), F.when(F.coalesce(F.trim("caption"), F.lit("")) != "", F.concat(F.lit(": "), "caption")).otherwise(""), F.lit("]"))
        note = F.when(F.coalesce(F.trim("footnote"), F.lit("")) != "", F.concat(F.lit("\n[Figure note: "), "footnote", F.lit("]"))).otherwise("")
        f = figures.select("doc_id", F.col("page").alias("p"), F.concat(head, note, F.lit("\n" + FIGURE_OPEN), F.coalesce("description", F.lit("")), F.lit(FIGURE_CLOSE)).alias("fig"))
        covers = f.join(heads.select("doc_id", "section", "first_page", "last_page"), "doc_id").filter("p between first_page and last_page")
        place = covers.groupBy("doc_id", "p", "fig").agg(F.min("section").alias("section"))
        g = place.groupBy("doc_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "fig"))), lambda x: x["fig"]), "\n\n").alias("figs"))
        s = s.join(g, ["doc_id", "section"], "left").withColumn("text", F.concat_ws("\n\n", "text", "figs")).drop("figs")
    return s.select("doc_id", "section", F.coalesce("title", F.lit("Untitled")).alias("title"), "first_page", "last_page", "text")


def structured_chunks(sections_: DataFrame, max_tokens: int = 1500, overlap_tokens: int = 100, per_token: int = 4) -> DataFrame:
    """(doc_id, section, title, pages, part, text, token_estimate): a section whole where it fits, else packed by paragraphs; blank sections are none."""
    s = sections_.filter("trim(text) <> ''")
    limit = max_tokens * per_token
    parts = F.when(F.length("text") <= limit, F.array(F.trim("text"))).otherwise(packed(F.col("text"), limit, overlap_tokens * per_token, "\n\n"))
    pages = F.when(F.col("first_page") == F.col("last_page"), F.col("first_page").cast("string")).otherwise(F.concat_ws("-", "first_page", "last_page"))
    x = s.select("doc_id", "section", "title", pages.alias("pages"), F.posexplode(parts).alias("part", "text"))
    return x.select("doc_id", "section", "title", "pages", "part", F.trim("text").alias("text"), F.floor(F.length("text") / per_token).cast("int").alias("token_estimate"))


def page_chunks(pages: DataFrame, max_tokens: int = 1500, overlap_tokens: int = 100) -> DataFrame:
    """Chunks of pages(doc_id, page, text): a line that is a heading opens a section; a document without headings has a section per page."""
    l = pages.select("doc_id", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("k", "line"))
    l = l.withColumn("h", heading_kind(F.col("line")).isNotNull()).withColumn("pos", F.struct("page", "k"))
    w = Window.partitionBy("doc_id").orderBy("page", "k").rowsBetween(Window.unboundedPreceding, 0)
    with_any = l.groupBy("doc_id").agg(F.bool_or("h").alias("any"))
    s = l.join(with_any, "doc_id").withColumn("section", F.when(F.col("any"), F.sum(F.col("h").cast("int")).over(w)).otherwise(F.col("page")).cast("int"))
    g = s.groupBy("doc_id", "section").agg(F.max(F.when(F.col("h"), F.trim("line"))).alias("title"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "k", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return structured_chunks(g.withColumn("title", F.coalesce("title", F.lit("Untitled"))), max_tokens, overlap_tokens)
