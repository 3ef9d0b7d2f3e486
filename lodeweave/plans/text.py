"""Text and document queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.operators import text as T
from lodeweave.sources.views import view, with_views


def docs(s, d):
    """The documents."""
    return view(s, d, "documents")


_STOP = "[" + ",".join(f"'{w}'" for w in T.STOP) + "]"
_TOK = "list_filter(list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')), lambda q: not list_contains(" + _STOP + ", q))"
_LINES = ", ln as (select doc_id, unnest(l) line, generate_subscripts(l, 1) - 1 pos from (select doc_id, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) l from documents))"
CAPTIONS = [("layout", "device|matching"), ("curve", "noise|stability|result"), ("list", "point|review")]  # made for these tables
DIRECTIONAL, UNIVERSAL = ("rise", "fall", "improve", "flatten", "higher", "pull"), ("always", "all", "never", "most")  # made for these tables
_UNI = r"\b(always|all|never|most)\b"
_PAGES = """, pg as (select source_id, nullif(regexp_extract(coalesce(pages, ''), '^(\\d+)(?:-(\\d+))?$', 1), '')::int a, coalesce(nullif(regexp_extract(coalesce(pages, ''), '^(\\d+)(?:-(\\d+))?$', 2), '')::int, nullif(regexp_extract(coalesce(pages, ''), '^(\\d+)(?:-(\\d+))?$', 1), '')::int) b from chunks)"""


def _evidence(s, d):
    i = view(s, d, "insights")
    return i.select("insight_id", "statement", F.explode("evidence_chunk_ids").alias("chunk_id")).join(view(s, d, "chunks").select("chunk_id", "section_title", "text_preview"), "chunk_id").distinct()


_EV = ", ev as (select distinct insight_id, statement, chunk_id, section_title, text_preview from (select insight_id, statement, unnest(evidence_chunk_ids) chunk_id from insights) join chunks using (chunk_id))"


def _params(s, d):
    p = view(s, d, "parameter_nodes").select(F.substring("parameter_id", -1, 1).alias("k"), "parameter_id", "symbol", "name")
    return view(s, d, "chunks").withColumn("k", F.translate(F.substring("chunk_id", -1, 1), "abcdef", "012345")).join(p, "k")


def _mentions(s, d):
    return _evidence(s, d).select("chunk_id", F.when(F.col("insight_id") < "insight_8", F.lower(F.regexp_replace("section_title", " ", "_"))).otherwise(F.col("section_title")).alias("name"), F.when(F.col("insight_id") > "insight_4", F.col("statement")).alias("description"))


def _rdata(s, d):
    p = view(s, d, "part")
    line = F.concat_ws(" ", F.when(F.col("p_partkey") % 9 == 0, "XDATA").otherwise("RDATA"), "p_brand", F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ["k", "meg", "u", "", "f"])), (F.col("p_partkey") % 5 + 1).cast("int"))), F.when(F.col("p_partkey") % 7 == 0, "nan").when(F.col("p_partkey") % 11 == 0, "oops").otherwise(F.col("p_size").cast("string")))
    return p.select(F.col("p_partkey").alias("id"), line.alias("line"))


def _answers(s, d):
    i = view(s, d, "insights").filter("size(evidence_chunk_ids) > 0")
    return i.select(F.col("insight_id").alias("doc_id"), F.concat(F.lit("# Finding\n\n"), F.col("statement"), F.lit("\n\n## More\n\nVerified"), F.when(F.col("insight_id") > "insight_4", " in the fast and slow corner").otherwise(""), F.lit(". [ cite : "), F.concat_ws("; ", "evidence_chunk_ids"), F.lit("]")).alias("text"))


Q = {
    "text_sections": (lambda s, d: T.sections(T.lines(docs(s, d))), _LINES + r"""
        , b as (select *, regexp_matches(line, '^#+ ') h from ln), g as (select *, sum(h::int) over (partition by doc_id order by pos rows unbounded preceding) section from b)
        select doc_id, section, coalesce(trim(regexp_replace(max(case when h then line end), '^#+ ', '')), 'Untitled') title, min(pos) first_pos, count(*) n_lines, sum(length(line)) n_chars from g group by 1, 2"""),
    "text_page_bounds": (lambda s, d: view(s, d, "chunks").select("chunk_id", T.page_bounds(F.col("pages"))[0].alias("first_page"), T.page_bounds(F.col("pages"))[1].alias("last_page")), _PAGES.replace("source_id,", "chunk_id,") + " select chunk_id, a first_page, b last_page from pg"),
    "text_page_range": (lambda s, d: T.page_range(view(s, d, "chunks")), _PAGES + " select source_id, case when min(a) = max(b) then min(a)::varchar else min(a)::varchar || '-' || max(b)::varchar end pages from pg group by 1"),
    "text_page_at": (lambda s, d: T.page_at(T.lines(docs(s, d)).select("doc_id", "pos"), T.lines(docs(s, d)).filter("pos > 0 and pos % 5 = 2").select("doc_id", F.col("pos").alias("start"), (F.col("pos") + 100).cast("int").alias("page"))), _LINES + """
        , st as (select doc_id, pos st, pos + 100 page from ln where pos > 0 and pos % 5 = 2)
        select l.doc_id, l.pos, coalesce(arg_max(page, st) filter (where st <= l.pos), arg_min(page, st)) page from ln l left join st using (doc_id) group by 1, 2"""),
    "text_chunked": (lambda s, d: T.chunked(docs(s, d), 800, 0, "\n").select("chunk_id", "doc_id", F.length("text").alias("n"), "token_estimate"), None),
    "text_chunked_overlap": (lambda s, d: T.chunked(docs(s, d), 900, 60), None),
    "text_heading_kinds": (lambda s, d: T.lines(docs(s, d)).select(T.heading_kind(F.col("line")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), _LINES + r"""
        , k as (select case when length(trim(line)) > 80 then null when regexp_matches(trim(line), '^\d+(\.\d+)*\.? [A-Z]') then 'numbered' when regexp_matches(trim(line), '^[IVXLC]+\. ') then 'roman' when regexp_matches(trim(line), '(?i)^(chapter|section|part) \d+') then 'chapter'
        when regexp_matches(trim(line), '(?i)^(abstract|introduction|conclusions?|references|appendix)\b') then 'academic' when regexp_matches(trim(line), '^[A-Z][A-Z ]{5,}$') then 'caps' end kind from ln) select kind, count(*) n from k group by 1"""),
    "text_caption_kinds": (lambda s, d: view(s, d, "chunks").select("chunk_id", T.caption_kind(F.col("section_title"), CAPTIONS).alias("kind")), "select chunk_id, case when regexp_matches(lower(coalesce(section_title, '')), 'device|matching') then 'layout' when regexp_matches(lower(coalesce(section_title, '')), 'noise|stability|result') then 'curve' when regexp_matches(lower(coalesce(section_title, '')), 'point|review') then 'list' else 'other' end kind from chunks"),
    "text_grounded": (lambda s, d: _evidence(s, d).select("insight_id", "chunk_id", T.grounded(F.col("section_title"), F.col("text_preview")).alias("grounded")), _EV + r"""
        , g as (select *, lower(coalesce(section_title, '')) n, lower(coalesce(text_preview, '')) t, list_filter(regexp_split_to_array(lower(coalesce(section_title, '')), '[\s\-_/]+'), lambda w: length(w) >= 3) ws from ev)
        select insight_id, chunk_id, contains(t, n) or len(ws) = 0 or len(list_filter(ws, lambda w: contains(t, w))) >= 0.5 * len(ws) grounded from g"""),
    "text_parameter_grounded": (lambda s, d: _params(s, d).select("chunk_id", "parameter_id", T.parameter_grounded(F.col("symbol"), F.col("name"), F.col("text_preview")).alias("grounded")), r"""
        , g as (select chunk_id, parameter_id, lower(coalesce(text_preview, '')) t, lower(coalesce(symbol, '')) s, lower(coalesce(name, '')) n, replace(lower(coalesce(symbol, '')), '_', '') f, list_filter(regexp_split_to_array(lower(coalesce(name, '')), '\s+'), lambda w: length(w) >= 3) ws
           from chunks join parameter_nodes on right(parameter_id, 1) = translate(right(chunk_id, 1), 'abcdef', '012345'))
        select chunk_id, parameter_id, (s <> '' and contains(t, s)) or (length(f) >= 2 and contains(t, f)) or (n <> '' and (contains(t, n) or (len(ws) > 0 and len(list_filter(ws, lambda w: contains(t, w))) >= 0.5 * len(ws)))) grounded from g"""),
    "text_equation_grounded": (lambda s, d: _params(s, d).select("chunk_id", "parameter_id", T.equation_grounded(F.concat(F.lit(r"\frac{"), "symbol", F.lit("}{"), "name", F.lit("}")), F.array("symbol"), F.col("text_preview")).alias("grounded")), None),
    "text_scope_widened": (lambda s, d: _evidence(s, d).select("insight_id", "chunk_id", T.scope_widened(F.concat(F.col("statement"), F.when(F.col("chunk_id") < "chunk_8", " It always improves.").otherwise(" All higher.")), F.col("text_preview"), DIRECTIONAL, UNIVERSAL).alias("widened")), _EV + rf"""
        , w as (select insight_id, chunk_id, lower(statement || case when chunk_id < 'chunk_8' then ' It always improves.' else ' All higher.' end) de, lower(coalesce(text_preview, '')) t from ev)
        select insight_id, chunk_id, coalesce(regexp_matches(de, '\b(rise|fall|improve|flatten|higher|pull)'), false) and len(list_filter(regexp_extract_all(coalesce(de, ''), '{_UNI}'), lambda q: not list_contains(regexp_extract_all(t, '{_UNI}'), q))) > 0 widened from w"""),
    "text_edges_grounded": (lambda s, d: T.edges_grounded(_evidence(s, d).select("chunk_id", F.upper("section_title").alias("source_name"), F.when(F.col("insight_id") < "insight_8", F.col("section_title")).otherwise("Nowhere").alias("target_name")), _mentions(s, d).select("chunk_id", "name")), _EV + """
        , mn as (select distinct chunk_id, lower(case when insight_id < 'insight_8' then replace(section_title, ' ', '_') else section_title end) n from ev),
        e as (select chunk_id, upper(section_title) source_name, case when insight_id < 'insight_8' then section_title else 'Nowhere' end target_name from ev)
        select * from e where exists (select 1 from mn where mn.chunk_id = e.chunk_id and n = lower(source_name)) and exists (select 1 from mn where mn.chunk_id = e.chunk_id and n = lower(target_name))"""),
    "text_quality_gate": (lambda s, d: T.quality_gate(_mentions(s, d).filter("name is not null"), view(s, d, "chunks")), _EV + """
        , mn as (select chunk_id, case when insight_id < 'insight_8' then lower(replace(section_title, ' ', '_')) else section_title end as name, case when insight_id > 'insight_4' then statement end description from ev),
        g as (select chunk_id, count(*) n, count(*) filter (where length(coalesce(description, '')) >= 10) f, count(*) filter (where contains(name, '_') and not contains(name, ' ')) sn from mn where name is not null group by 1),
        j as (select c.chunk_id, length(coalesce(text_preview, '')) ln, coalesce(n, 0) n, coalesce(f, 0) f, coalesce(sn, 0) sn from chunks c left join g using (chunk_id))
        select chunk_id, n n_entities, concat_ws(';', case when n < 1 then 'entities' end, case when n > 0 and f < 0.5 * n then 'descriptions' end, case when n > 0 and sn > 0.5 * n then 'snake_case' end, case when n < greatest(1, ln // 2000) then 'density' end) reasons from j"""),
    "text_secrets_redacted": (lambda s, d: view(s, d, "supplier").select("s_suppkey", T.secrets_redacted(F.concat(F.lit("authorization: Basic abc"), "s_suppkey", F.lit("\napi_key="), "s_name", F.lit(" token: x9 ok bearer q."), "s_suppkey")).alias("clean")), "select s_suppkey, 'authorization: [redacted]' || chr(10) || 'api_key=[redacted] token: [redacted] ok [redacted]' clean from supplier"),
    "text_si_numbers": (lambda s, d: _rdata(s, d).select("id", F.split("line", " ")[2].alias("raw")).select("id", T.si_number(F.col("raw")).alias("x")), """
        select p_partkey id, cast(p_size as double) * [1e3, 1e6, 1e-6, 1e0, 1e-15][p_partkey % 5 + 1] x from part"""),
    "text_series_lines": (lambda s, d: T.series_lines(_rdata(s, d)), """
        select p_partkey id, p_brand series, cast(p_size as double) * [1e3, 1e6, 1e-6, 1e0, 1e-15][p_partkey % 5 + 1] x, cast(p_size as double) y from part where p_partkey % 9 <> 0 and p_partkey % 7 <> 0 and p_partkey % 11 <> 0"""),
    "text_device_lines": (lambda s, d: T.device_lines(view(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("GMID vg="), F.when(F.col("p_partkey") % 6 == 0, "bad").otherwise("0.5"), F.lit(" id="), "p_size", F.lit(" gm=2e-3 gds=1e-5 cgg=3e-15")).alias("line"))), "select p_partkey id, 0.5e0 vg, cast(p_size as double) idd, 2e-3 gm, 1e-5 gds, 3e-15 cgg from part where p_partkey % 6 <> 0"),
    "text_table_rows": (lambda s, d: T.table_rows(view(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("| "), "s_suppkey", F.lit(" | `"), F.col("s_nationkey").cast("string"), F.lit("` | Build "), "s_name", F.when(F.col("s_suppkey") % 3 == 0, " [done]").otherwise(""), F.lit(" |")).alias("line"))), "select s_suppkey id, s_suppkey::int number, s_nationkey::varchar code, 'Build ' || s_name title, s_suppkey % 3 = 0 done from supplier"),
    "text_markdown": (lambda s, d: T.markdown(T.lines(docs(s, d)).select("doc_id", "pos", F.when(F.col("pos") % 4 == 0, "text").when(F.col("pos") % 4 == 1, "code").when(F.col("pos") % 4 == 2, "image").otherwise("list").alias("type"), F.col("line").alias("text"), (F.col("pos") % 3).alias("level"))), _LINES + """
        , b as (select *, case when pos % 4 = 0 and pos % 3 > 0 then repeat('#', (pos % 3)::int) || ' ' || line when pos % 4 = 1 then '```' || chr(10) || line || chr(10) || '```' when pos % 4 = 2 then '[Figure: ' || line || ']' else line end md from ln)
        select doc_id, string_agg(md, chr(10) || chr(10) order by pos) as text from b group by 1"""),
    "text_select_evidence": (lambda s, d: T.select_evidence(view(s, d, "insights").select(F.col("insight_id").alias("item_id"), F.col("statement").alias("description"), F.col("evidence_chunk_ids").alias("chunk_ids")), view(s, d, "chunks")), f"""
        , i as (select insight_id item_id, {_TOK.format('statement')} t, unnest(evidence_chunk_ids) chunk_id, generate_subscripts(evidence_chunk_ids, 1) pos from insights),
        j as (select item_id, i.chunk_id, max(len(list_intersect(t, {_TOK.format("concat_ws(' ', section_title, text_preview)")}))) overlap, min(pos) pos from i join chunks c on c.chunk_id = i.chunk_id group by 1, 2)
        select item_id, chunk_id, overlap, r as rank from (select *, row_number() over (partition by item_id order by overlap desc, pos) r from j) where r <= 2"""),
    "text_seeded_sample": (lambda s, d: T.seeded_sample(view(s, d, "chunks").select("chunk_id"), "chunk_id", 50, 7), "select chunk_id from chunks order by md5('7#' || chunk_id), chunk_id limit 50"),
    "text_query_terms": (lambda s, d: view(s, d, "insights").select("insight_id", F.array_join(T.query_terms(F.col("statement")), "|").alias("terms")), r"""
        , w as (select insight_id, trim(coalesce(statement, '')) q, regexp_extract_all(trim(coalesce(statement, '')), '[A-Za-z][A-Za-z0-9]+') ws from insights),
        p as (select *, list_filter([case when lower(ws[i]) <> lower(ws[i + 1]) then ws[i] || ' ' || ws[i + 1] end for i in range(1, len(ws))], lambda x: x is not null) || ws al from w),
        d as (select *, list_distinct(al) ds from p)
        select insight_id, case when length(q) <= 40 then q when len(al) > 0 then array_to_string(list_transform(list_sort(list_transform(ds, lambda x: {'i': list_position(al, x), 'x': x})), lambda z: z.x), '|') else substr(q, 1, 40) end terms from d"""),
    "text_file_names": (lambda s, d: T.file_names(view(s, d, "nodes").select(F.col("node_id").alias("id"), "name")), r"""
        , b as (select node_id id, case when trim(regexp_replace(coalesce(name, ''), '[\\/:*?"<>|#^\[\]]', '_', 'g')) = '' then 'untitled' else substr(trim(regexp_replace(coalesce(name, ''), '[\\/:*?"<>|#^\[\]]', '_', 'g')), 1, 200) end base from nodes)
        select id, case when count(*) over (partition by lower(base)) > 1 then base || ' ' || substr(sha1(id), 1, 8) else base end file_name from b"""),
    "text_recovered_json": (lambda s, d: view(s, d, "events").select("event_id", T.recovered_json(F.concat(F.lit("Sure: ```json\n"), "props", F.lit("\n``` done"))).alias("found")), None),
    "text_paragraphs": (lambda s, d: T.paragraphs(_answers(s, d)), """
        , a as (select insight_id doc_id, evidence_chunk_ids c, statement from insights where len(evidence_chunk_ids) > 0 and statement is not null)
        select doc_id, 0 para, '# Finding' || chr(10) || statement as text from a union all select doc_id, 2, '## More' || chr(10) || 'Verified' || case when doc_id > 'insight_4' then ' in the fast and slow corner' else '' end || '. [ cite : ' || array_to_string(list_filter(c, lambda x: x is not null), '; ') || ']' from a"""),
    "text_context": (lambda s, d: T.context_text(view(s, d, "chunks").filter("text_preview is not null and source_id is not null"), "source_id", "chunk_id", F.concat("chunk_id", F.lit(": "), "text_preview"), 500), """
        , t as (select source_id, chunk_id || ': ' || text_preview l, row_number() over (partition by source_id order by chunk_id) r from chunks where text_preview is not null and source_id is not null),
        g as (select source_id, string_agg(l, chr(10) order by r) f from t group by 1)
        select source_id, case when length(f) > 2000 then substr(f, 1, 2000) || ' [...]' else f end as text from g"""),
}


def queries() -> dict:
    """Query name -> (spark, sf_dir) -> DataFrame."""
    return {k: f for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    """The same in DuckDB's SQL."""
    return {k: with_views("with " + q.strip()[2:] if q.strip().startswith(", ") else q) for k, (_, q) in Q.items() if q}
