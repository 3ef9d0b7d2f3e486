"""Readers and writers: graph exports, run rows, journals, vaults, pages.

Formatting and parsing are separate from files, so both can be checked on rows; files are
written by Spark to the folder given, one part per task.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.operators.graph import PRIVATE_LABELS, live

VERSION = 1
NODE = "struct<kind:string,label:string,node_id:string,name:string,domain:string,confidence:double>"
EDGE = "struct<kind:string,rel_type:string,src_id:string,dst_id:string,confidence:double,reinforcement_count:bigint>"
RUN = "topology_class string, pdk string, ok boolean, verdicts map<string,string>"


def export_lines(nodes: DataFrame, edges: DataFrame, exclude: tuple = PRIVATE_LABELS) -> DataFrame:
    """(ord, line): header with counts, nodes, edges, as JSON lines; private labels and retracted nodes stay out, with their edges."""
    n = live(nodes).filter(~F.col("label").isin(*exclude))
    ids = n.select("node_id").distinct()
    e = edges.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    head = n.agg(F.count(F.lit(1)).alias("nodes")).select(F.lit(0).alias("ord"), F.to_json(F.struct(F.lit("header").alias("kind"), F.lit(VERSION).alias("format_version"), F.col("nodes"), e.agg(F.count(F.lit(1))).scalar().alias("edges"))).alias("line"))
    nl = n.select(F.lit(1).alias("ord"), F.to_json(F.struct(F.lit("node").alias("kind"), "label", "node_id", "name", "domain", "confidence")).alias("line"))
    el = e.select(F.lit(2).alias("ord"), F.to_json(F.struct(F.lit("edge").alias("kind"), "rel_type", "src_id", "dst_id", "confidence", "reinforcement_count")).alias("line"))
    return head.unionByName(nl).unionByName(el)


def write_export(lines: DataFrame, path: str) -> None:
    """The lines as text files, one folder per kind."""
    lines.write.mode("overwrite").partitionBy("ord").text(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line) of a written export; a reader of one kind touches that folder only."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def _of_kind(lines: DataFrame, ord_: int) -> DataFrame:
    """Lines of one kind, where the export tells them apart."""
    return lines.filter(F.col("ord") == ord_) if "ord" in lines.columns else lines


def import_nodes(lines: DataFrame) -> DataFrame:
    """Nodes of export lines; malformed lines and lines without label or id are skipped."""
    p = _of_kind(lines, 1).select(F.from_json("line", NODE).alias("r")).select("r.*")
    return p.filter("kind = 'node' and label is not null and node_id is not null").drop("kind")


def import_edges(lines: DataFrame) -> DataFrame:
    """Edges of export lines."""
    p = _of_kind(lines, 2).select(F.from_json("line", EDGE).alias("r")).select("r.*")
    return p.filter("kind = 'edge' and src_id is not null and dst_id is not null and rel_type is not null").drop("kind")


def skipped(lines: DataFrame) -> DataFrame:
    """(reason, n): lines an import would skip."""
    k = F.get_json_object("line", "$.kind")
    why = F.when(k.isNull(), "malformed").when(~k.isin("header", "node", "edge"), "unknown kind").when((k == "node") & F.get_json_object("line", "$.node_id").isNull(), "no id")
    return lines.select(why.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def check_header(lines: DataFrame) -> None:
    """Raise on another format version."""
    v = lines.filter(F.get_json_object("line", "$.kind") == "header").select(F.get_json_object("line", "$.format_version").alias("v")).first()
    if v is None or v.v != str(VERSION):
        raise ValueError("format version")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, line) of text files, n the line's number in its file.

    A text split knows its place in the file but not how many lines lie before it: lines are counted per
    split, the counts are summed over the earlier splits of a file, and numbers inside a split follow its order."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    per = raw.groupBy("path", "at").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("first"))
    before = F.sum("k").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return raw.join(F.broadcast(per.withColumn("before", F.coalesce(before, F.lit(0)))), ["path", "at"]).select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("n"), "line")


def run_rows(lines: DataFrame) -> DataFrame:
    """(path, n, error, topology_class, pdk, ok, verdicts): each non-blank line (path, n, line) parsed; what is wrong is told, nothing is raised."""
    t = F.trim("line")
    j = lines.filter(t != "").withColumn("r", F.from_json(t, RUN)).withColumn("raw", F.try_parse_json(t))
    err = F.when(F.col("raw").isNull(), "malformed").when(~t.startswith("{"), "not an object").when(F.col("r.topology_class").isNull(), "missing topology_class").when(F.col("r.pdk").isNull(), "missing pdk").when(F.col("r.ok").isNull(), "missing ok")
    return j.select("path", "n", err.alias("error"), *(F.when(err.isNull(), F.col(f"r.{c}")).alias(c) for c in ("topology_class", "pdk", "ok", "verdicts")))


def vault(texts: DataFrame) -> DataFrame:
    """(sha, text): content-addressed, each text once; null texts are not stored."""
    return texts.filter("text is not null").groupBy(F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"))


def evidence_text(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """(chunk_id, text, verbatim): the stored text where the hash is known, else the preview."""
    j = chunks.join(stored.select(F.col("sha").alias("raw_text_hash"), F.col("text").alias("full")), "raw_text_hash", "left")
    return j.select("chunk_id", F.coalesce("full", "text_preview", F.lit("")).alias("text"), F.col("full").isNotNull().alias("verbatim"))


def evidence_for(requests: DataFrame, chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """(chunk_id, found, text, verbatim) of requests(chunk_id): every id asked for gives a row, unknown ones an empty text."""
    e = evidence_text(chunks, stored).withColumn("known", F.lit(True))
    j = requests.select("chunk_id").distinct().join(e, "chunk_id", "left")
    return j.select("chunk_id", F.coalesce("known", F.lit(False)).alias("found"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("verbatim", F.lit(False)).alias("verbatim"))


def journal_append(entries: DataFrame, path: str, day: Column) -> None:
    """Append entries to a journal of JSON lines, a folder a day, so that old days can be rotated out whole."""
    entries.withColumn("day", day).write.mode("append").partitionBy("day").json(path)


def journal_rotate(spark: SparkSession, path: str, keep_from: str) -> int:
    """Drop the journal's folders of days before ``keep_from`` (yyyy-MM-dd); how many were dropped."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("day=") and f.getPath().getName()[4:] < keep_from]
    for f in old:
        fs.delete(f, True)
    return len(old)


def journal_tail(journal: DataFrame, n: int) -> DataFrame:
    """The last n entries of (ts, event_id, op)."""
    return journal.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def latest_status(queue: DataFrame, key: str, order: Column) -> DataFrame:
    """(key, status): an append-only queue folded to the latest status."""
    return queue.groupBy(key).agg(F.max_by("status", order).alias("status"))


def pending(queue: DataFrame, key: str, order: Column) -> DataFrame:
    """Keys whose latest status is pending."""
    return latest_status(queue, key, order).filter("status = 'pending'").select(key)


def checkpoint_totals(done: DataFrame) -> DataFrame:
    """(source_id, n_chunks, n_tokens, n_errors) of finished chunks, each chunk once by its latest row."""
    once = done.groupBy("source_id", "chunk_index").agg(F.max_by(F.struct("tokens", "failed"), "at").alias("r"))
    return once.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("r.tokens").alias("n_tokens"), F.count_if("r.failed").alias("n_errors"))


def note(nodes: DataFrame, names: DataFrame, edges: DataFrame, per_part: int = 1000) -> DataFrame:
    """(path, part, content): a Markdown note per live node: front matter, title, all its typed links.

    Part 0 holds front matter and title; the links of a node with more than ``per_part`` are spread over so
    many parts by a hash of their target, so that no row gathers a hub. Parts follow one another in the file."""
    f = names.select(F.col("id").alias("node_id"), "file_name")
    links = edges.join(f.withColumnRenamed("node_id", "dst_id"), "dst_id").select(F.col("src_id").alias("node_id"), "rel_type", "dst_id", F.concat(F.lit("- "), "rel_type", F.lit(" [["), "file_name", F.lit("]]")).alias("l"))
    many = links.groupBy("node_id").agg(F.ceil(F.count(F.lit(1)) / per_part).cast("int").alias("parts"))
    parted = links.join(many, "node_id").withColumn("part", F.pmod(F.xxhash64("dst_id", "rel_type"), F.col("parts")).cast("int"))
    g = parted.groupBy("node_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel_type", "dst_id", "l"))), lambda s: s["l"]), "\n").alias("links"))
    j = live(nodes).join(f, "node_id")
    head = j.select("node_id", F.concat("label", F.lit("/"), "file_name", F.lit(".md")).alias("path"), F.concat(F.lit("---\nid: "), F.to_json(F.struct(F.col("node_id").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("node_id").alias("v")))) - 6), F.lit("\n---\n# "), F.coalesce("name", "node_id"), F.lit("\n\n")).alias("head"))
    parts = head.join(g, "node_id", "left").select("path", F.coalesce("part", F.lit(0)).alias("part"), "head", "links")
    return parts.select("path", "part", F.concat(F.when(F.col("part") == 0, F.col("head")).otherwise(F.lit("\n")), F.coalesce("links", F.lit(""))).alias("content"))


class _Page(HTMLParser):
    """Collects headings and text; scripts, styles and hidden parts are left out."""

    SKIP = {"script", "style", "nav", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self.depth, self.heading = None, [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.depth += 1
        elif tag in ("h1", "h2", "h3"):
            self.heading = []
        elif tag in ("sub", "sup"):
            self.parts.append("_" if tag == "sub" else "^")
        elif tag in ("p", "li", "tr", "div", "section", "br"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.depth = max(0, self.depth - 1)
        elif tag in ("h1", "h2", "h3") and self.heading is not None:
            text = "".join(self.heading).strip()
            self.title = self.title or text
            self.parts.append(f"\n# {text}\n")
            self.heading = None

    def handle_data(self, data):
        if not self.depth:
            (self.parts if self.heading is None else self.heading).append(data)


def parse_html(html: str | None) -> tuple[str, str]:
    """Title (first heading) and text of a page."""
    p = _Page()
    p.feed(html or "")
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return p.title or "", "\n".join(x for x in lines if x)


def pages(html: Column) -> Column:
    """struct(title, text) of HTML pages."""

    @F.pandas_udf("title string, text string")
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_html(x) for x in s], columns=["title", "text"])

    return parse(html)


def write_corpus(specimens: DataFrame, path: str) -> None:
    """Specimens partitioned by class, so that a class is read alone."""
    specimens.write.mode("overwrite").partitionBy("topology_class").parquet(path)
