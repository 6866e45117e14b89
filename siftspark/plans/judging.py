"""Queries over evaluation, evidence, contexts and conversations.

Questions are benchmark items; what BM25 finds for them stands for what a system retrieves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark import shared
from siftspark.functions import text as T
from siftspark.operators import context, evaluation, indexing, intervals, retrieval
from siftspark.plans import search
from siftspark.plans.queries import ASKED, GOLD, POSTINGS, STORE, _bm25_sql, docs, items, query, rounded, store, table
from siftspark.plans.structure import ELEMENTS, elements, longs

FOUND = f"{POSTINGS}, {ASKED}, {_bm25_sql('found', 30)}, {GOLD}"


def found(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    return search.corpus_index(spark, d).search(items(spark, d), k)


def gold(spark: SparkSession, d: str) -> DataFrame:
    return search.gold(items(spark, d), docs(spark, d))


# groups of evidence: the documents of a question by their rest


GROUPS = "grouped as (select qid, (id % 2)::bigint as grp, id from gold)"
EACH = "need as (select g.qid, g.grp, g.id, f.rank from grouped g left join found f using (qid, id)), each as (select qid, grp, case when count(rank) = count(*) then max(rank) end as last_rank from need group by 1, 2), per as (select qid, " + ", ".join(f"avg(coalesce((last_rank <= {k})::int::double, 0)) as group_recall_{k}" for k in (1, 3, 5, 10)) + ", coalesce(1.0::double / min(last_rank), 0) as group_mrr from each group by 1)"


def groups(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("qid", (F.col("id") % 2).alias("grp"), "id")


@query(f"with {FOUND}, {GROUPS}, {EACH} select qid, {', '.join(f'round({c}, 6) as {c}' for c in (*(f'group_recall_{k}' for k in (1, 3, 5, 10)), 'group_mrr'))} from per")
def split_group_scores(spark, d):
    """Questions whose documents are two groups, each hit where its last document stands."""
    return rounded(evaluation.group_scores(found(spark, d), groups(spark, d)))


@query(f"with {GOLD}, n as (select qid, list(id order by id) as ids from gold group by 1) select qid, unnest(case when qid % 3 = 0 then [0::bigint] else range(len(ids)) end) as grp, unnest(case when qid % 3 = 0 then ids[1:1] else ids end) as id from n")
def evidence_groups(spark, d):
    """Resolved groups of some questions (the first of two; the other wasn't resolved), one group per label of the rest."""
    listed = gold(spark, d).groupBy("qid").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    given = F.array(F.struct(F.lit("resolved").alias("status"), F.slice("ids", 1, 1).alias("ids")), F.struct(F.lit("unresolved").alias("status"), F.col("ids").alias("ids")))
    return longs(evaluation.groups_of(listed.select("qid", F.when(F.col("qid") % 3 == 0, given).alias("groups"), F.col("ids").alias("relevant"))))


@query(
    f"""with {FOUND}, {GROUPS}, {EACH}, cited as (select qid, id from found where rank <= 2), s as (select g.qid, count(*) as n from (select distinct qid, id from grouped) g group by 1),
 gains as (select f.qid, sum(1 / log2(f.rank + 1)) filter (where f.rank <= 5) as g5, sum(1 / log2(f.rank + 1)) filter (where f.rank <= 10) as g10 from found f join gold using (qid, id) group by 1),
 nd as (select s.qid, coalesce(g5 / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 0) as ndcg_5, coalesce(g10 / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0) as ndcg_10 from s left join gains using (qid)),
 own as (select * from cited where qid in (select qid from grouped)), whole as (select qid, grp, count(o.id) = count(*) as ok from grouped g left join own o using (qid, id) group by 1, 2)
 select count(*) as n, {', '.join(f'round(avg({c}), 6) as {c}' for c in (*(f'group_recall_{k}' for k in (1, 3, 5, 10)), 'group_mrr', 'ndcg_5', 'ndcg_10'))}, round((select count(*) from own join gold using (qid, id)) / (select count(*) from own)::double, 6) as citation_precision, round((select avg(ok::int::double) from whole), 6) as citation_recall from per join nd using (qid)"""
)
def gold_reports(spark, d):
    hits = found(spark, d)
    return rounded(evaluation.gold_report(hits, groups(spark, d), hits.filter("rank <= 2").select("qid", "id")))


@query(f"with {GOLD} select item_id as qid, 'PREDICTION_MISSING' as code from benchmark where item_id % 4 = 0 union all select -1, 'QUESTION_UNKNOWN' union all select item_id, 'PREDICTION_DUPLICATE' from benchmark where item_id % 4 = 1 union all select item_id, 'EVIDENCE_MISSING' from benchmark where item_id % 2 = 0 and item_id not in (select qid from gold)")
def prediction_faults(spark, d):
    """Predictions that are missing, foreign or repeated; answerable questions without evidence."""
    q = items(spark, d)
    made = q.filter("qid % 4 <> 0").select("qid")
    made = made.unionByName(made.filter("qid % 4 = 1")).unionByName(spark.createDataFrame([(-1,)], "qid long"))
    return evaluation.prediction_problems(q.withColumn("answerable", F.col("qid") % 2 == 0), made, gold(spark, d))


@query(f"with {FOUND}, n as (select qid, count(*) as n from gold group by 1), h as (select f.qid, count(*) filter (where rank <= 10) as h, count(*) as every, min(rank) filter (where rank <= 10) as first from found f join gold using (qid, id) group by 1) select qid, round(coalesce(h / n::double, 0), 6) as recall_10, round(coalesce(1 / first::double, 0), 6) as mrr_10, round(coalesce(every / n::double, 0), 6) as pool_recall from n left join h using (qid)")
def pool_recalls(spark, d):
    return rounded(evaluation.candidate_recall(found(spark, d), gold(spark, d)))


RUNS = f"{FOUND}, runs as (select case when rank % 2 = 0 then 'even' else 'odd' end as config, qid, id, (rank + 1) // 2 as rank, (10 + qid % 7)::double as latency_ms from found)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).select(F.when(F.col("rank") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("config"), "qid", "id", F.floor((F.col("rank") + 1) / 2).cast("int").alias("rank"), (F.lit(10) + F.col("qid") % 7).cast("double").alias("latency_ms"))


@query(
    f"""with {RUNS}, base as (select distinct config, qid from runs), s as (select b.config, g.qid, count(*) as n from base b join gold g using (qid) group by 1, 2),
 h as (select r.config, r.qid, min(rank) as first, {", ".join(f"count(*) filter (where rank <= {k}) as h{k}" for k in (1, 3, 5, 10))} from runs r join gold using (qid, id) group by 1, 2),
 t as (select config, avg(latency_ms) as latency_ms from (select distinct config, qid, latency_ms from runs) group by 1),
 c as (select config, count(*) as c, count(g.id) as hit from (select distinct config, qid, id from runs where rank <= 2) x left join gold g using (qid, id) group by 1), need as (select config, count(*) as r from base join gold using (qid) group by 1)
 select config, count(*) as n, {", ".join(f"round(avg(coalesce(h{k} / n::double, 0)), 6) as recall_{k}" for k in (1, 3, 5, 10))}, round(avg(coalesce(1 / first::double, 0)), 6) as mrr, round(any_value(latency_ms), 6) as latency_ms, round(any_value(hit / c::double), 6) as citation_precision, round(any_value(hit / r::double), 6) as citation_recall
 from s left join h using (config, qid) join t using (config) join c using (config) join need using (config) group by 1"""
)
def ablations(spark, d):
    """Two configurations: the odd and the even ranks of one search."""
    r = runs(spark, d)
    out = evaluation.ablation(r, gold(spark, d), r.filter("rank <= 2").select("config", "qid", "id"), gold(spark, d))
    return rounded(out.drop("ndcg_5", "ndcg_10"))


ROWS = "rows as (select event_id as qid, event_type as variant, case when event_id % 2 = 0 then 'fact' else 'table' end as question_type, value / 100 as recall_10, value / 200 as mrr_10, event_id % 3 + 1 as searches, event_id % 4 = 0 as refined, event_id % 5 = 0 as rejected, value as latency_ms from events)"


def run_rows(spark: SparkSession, d: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    return table(spark, d, "events").select(i.alias("qid"), F.col("event_type").alias("variant"), F.when(i % 2 == 0, F.lit("fact")).otherwise(F.lit("table")).alias("question_type"), (v / 100).alias("recall_10"), (v / 200).alias("mrr_10"), (i % 3 + 1).alias("searches"), (i % 4 == 0).alias("refined"), (i % 5 == 0).alias("rejected"), v.alias("latency_ms"), F.when(i % 6 == 0, F.array(F.lit("LOW"), F.lit("LATE"))).when(i % 6 == 1, F.array(F.lit("LATE"))).otherwise(F.array().cast("array<string>")).alias("reasons"))


@query(f"with {ROWS} select variant, count(*) as n, round(avg(recall_10), 6) as recall_10, round(avg(mrr_10), 6) as mrr_10, round(avg(searches), 6) as searches, sum(searches)::bigint as calls, round(avg(refined::int), 6) as refined_rate, round(avg(rejected::int), 6) as rejected_rate, round(avg(latency_ms), 6) as latency_ms from rows group by 1")
def run_summaries(spark, d):
    return rounded(evaluation.run_summary(run_rows(spark, d)))


@query(f"with {ROWS} select variant, reason, count(*) as n from (select variant, unnest(case qid % 6 when 0 then ['LOW', 'LATE'] when 1 then ['LATE'] else [] end) as reason from rows) group by 1, 2")
def reasons(spark, d):
    return evaluation.reason_counts(run_rows(spark, d))


@query(f"with {ROWS} select variant, question_type, count(*) as n, round(avg(recall_10), 6) as recall_10 from rows group by rollup (variant, question_type)")
def recall_by_type(spark, d):
    return rounded(evaluation.by_type(run_rows(spark, d)))


@query("select item_id as qid, unnest(['small', 'large']) as variant, unnest([30, 100])::bigint as pool, unnest(['legacy', 'cell_coverage']) as policy from benchmark")
def variants(spark, d):
    return longs(evaluation.with_variants(items(spark, d).select("qid"), {"small": (30, "legacy"), "large": (100, "cell_coverage")}))


@query("select 'COUNT' as code, abs(count(*) - 7) as n from benchmark union all select 'ANSWERABLE_COUNT', abs(count(*) filter (where item_id % 3 = 0) - 2) from benchmark union all select 'DUPLICATE_ID', count(*) - count(distinct item_id // 2) from benchmark union all select 'LABEL_MISSING', count(*) filter (where item_id % 6 = 0) from benchmark union all select 'SNAPSHOT_MISMATCH', count(*) filter (where item_id % 5 = 0) from benchmark")
def dataset_faults(spark, d):
    """A set of questions with wrong counts, repeated ids, missing labels and a foreign snapshot."""
    i = F.col("qid")
    q = items(spark, d).select(F.floor(i / 2).alias("half"), (i % 3 == 0).alias("answerable"), F.when(i % 2 == 0, F.array().cast("array<bigint>")).otherwise(F.array(i)).alias("relevant"), F.when(i % 5 == 0, F.lit("s2")).otherwise(F.lit("s1")).alias("snapshot_id")).withColumnRenamed("half", "qid")
    return evaluation.dataset_problems(q, 7, 2, "s1")


LEAKS = "e as (select doc_id as chunk, n_chars % 50 as page, source as anchor, case when doc_id % 2 = 0 then 'dev' else 'test' end as split from documents)"


@query(f"with {LEAKS} " + " union all ".join(f"select {k}::varchar as key, string_agg(distinct split, ',' order by split) as splits, '{k}' as kind from e group by {k} having count(distinct split) > 1" for k in ("chunk", "page", "anchor")))
def split_audits(spark, d):
    """Pages and anchors that stand in both splits."""
    e = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk"), (F.col("n_chars") % 50).cast("string").alias("page"), F.col("source").alias("anchor"), F.when(F.col("doc_id") % 2 == 0, F.lit("dev")).otherwise(F.lit("test")).alias("split"))
    return evaluation.split_audit(e, ["chunk", "page", "anchor"])


@query("select user_id as qid, case min(case event_type when 'error' then 1 when 'click' then 2 when 'view' then 3 when 'signup' then 4 else 5 end) when 1 then 'parser_issue' when 2 then 'unresolved' when 3 then 'manual_review' when 4 then 'multi_chunk' else 'resolved' end as status from events where value > 40 group by 1")
def question_statuses(spark, d):
    """The worst status of each user's events, as anchors of a question."""
    kind = F.when(F.col("event_type") == "error", F.lit("parser_issue")).when(F.col("event_type") == "click", F.lit("unresolved")).when(F.col("event_type") == "view", F.lit("manual_review")).when(F.col("event_type") == "signup", F.lit("multi_chunk")).otherwise(F.lit("resolved"))
    return evaluation.question_status(table(spark, d, "events").filter("value > 40").select(F.col("user_id").alias("qid"), kind.alias("status")))


@query("""select item_id as qid, sha256('{"answer":"a' || item_id || '","id":' || item_id || ',"points":["p","q"],"question":"Q?"}') as digest from benchmark""")
def question_digests(spark, d):
    q = items(spark, d).select("qid", F.concat(F.lit("a"), F.col("qid").cast("string")).alias("answer"), F.array(F.lit("p"), F.lit("q")).alias("points"), F.lit("Q?").alias("question"))
    return q.select("qid", evaluation.question_digest().alias("digest"))


# evidence: a quote of each document among the lines of the same page of its source


LINE = "l as (select doc_id, source, i, x, i // 5 as page from (select doc_id, source, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as i from documents) where x <> '')"
ANCHOR = f"{LINE}, first as (select * from (select *, row_number() over (partition by doc_id order by i) as n from l) where n = 1 and length(x) between 30 and 2000), a as (select doc_id, page, case doc_id % 4 when 0 then substr(x, 1, 25) when 1 then x when 2 then 'zq' || substr(x, 1, 25) || 'qz' else substr(x, 1, 20) end as quote, doc_id % 4 = 3 as wrong from first)"


@query(
    f"""with {ANCHOR}, hit as (select a.doc_id, list(distinct l.doc_id || '/' || l.i order by l.doc_id || '/' || l.i) as ids, bool_and(contains(l.x, a.quote)) as exact from a join l on l.doc_id = a.doc_id and l.page = a.page and contains(l.x, a.quote) where not wrong group by 1)
 select a.doc_id as anchor_id, case when wrong then 'manual_review' when ids is null then 'unresolved' when len(ids) = 1 then 'resolved' else 'manual_review' end as status, case when wrong then 'none' when ids is null then 'none' else 'exact' end as method, case when not wrong and len(ids) = 1 then ids[1] else '' end as chunk, case when wrong then 'QUOTE_HASH_MISMATCH' when ids is null then 'NO_SOURCE_MATCH' when len(ids) = 1 then 'UNIQUE_MATCH' else 'MULTIPLE_MATCHES' end as reason from a left join hit using (doc_id)"""
)
def resolved_evidence(spark, d):
    """Quotes of first lines looked for on their page: found once, several times, not at all, or with a hash that doesn't fit."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).filter("x <> ''").withColumn("page", F.floor(F.col("i") / 5).cast("int"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))).filter((F.col("n") == 1) & F.length("x").between(30, 2000))
    key = F.col("doc_id") % 4
    quote = F.when(key == 0, F.substring("x", 1, 25)).when(key == 1, F.col("x")).when(key == 2, F.concat(F.lit("zq"), F.substring("x", 1, 25), F.lit("qz"))).otherwise(F.substring("x", 1, 20))
    none = F.array().cast("array<string>")
    anchors = first.select(F.col("doc_id").alias("anchor_id"), F.col("doc_id").alias("document_key"), "page", none.alias("section_path"), quote.alias("quote"), F.when(key == 3, F.lit("0")).alias("quote_hash"))
    chunks = rows.select(F.col("doc_id").alias("document_key"), F.concat_ws("/", "doc_id", "i").alias("chunk_id"), F.col("i").alias("chunk_index"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), none.alias("section_path"), F.lit(None).cast("string").alias("subtype"), F.lit(True).alias("indexed"), F.col("x").alias("raw_content"), F.col("x").alias("retrieval_content"))
    out = evaluation.resolve_evidence(anchors, chunks, fuzzy=1.01, widest=2)
    return out.select("anchor_id", "status", "method", F.coalesce(F.get("chunk_ids", 0), F.lit("")).alias("chunk"), "reason")


QUOTED = """w as materialized (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as ws from documents),
 c as materialized (select *, raw || ' sum' || case when kind = 'table_row' then ' row total zzr' || doc_id else '' end as ret from (select doc_id, i, doc_id || '/' || i as id, array_to_string(ws[6 * i + 1:6 * i + 6], ' ') as raw, i // 4 as ps, i // 4 + (i % 4 = 3)::int as pe, 'part ' || i % 3 as sec, case i % 5 when 0 then 'table_row' when 1 then 'table_raw_text' else 'text' end as kind from (select *, unnest(range(0, (len(ws) + 5) // 6)) as i from w))),
 a as materialized (select doc_id, doc_id || '/' || k as anchor_id, m // 4 as page, case when k = 0 and doc_id % 2 = 0 then 'part ' || m % 3 end as want, case k when 0 then array_to_string(ws[6 * m + 2:6 * m + 5], ' ') when 1 then array_to_string(ws[6 * m + 4:6 * m + 9], ' ') when 2 then array_to_string(ws[6 * m + 4:6 * m + 15], ' ') when 3 then array_to_string(ws[6 * m + 1:6 * m + 5], ' ') || ' zzq' when 4 then 'total zzr' || doc_id when 5 then 'row total zzr' || doc_id else 'zzz qqq vvv' end as quote from (select *, doc_id % 5 + 2 as m, unnest(range(0, 7)) as k from w where len(ws) >= 60))"""


@query(
    f"""with {QUOTED}, p as materialized (select a.anchor_id, a.quote, string_split(a.quote, ' ') as qs, a.want is null or contains(c.sec, a.want) as fits, c.* from a join c on c.doc_id = a.doc_id and a.page between c.ps and c.pe),
 s1 as (select *, case when contains(raw, quote) then 1 when kind = 'table_row' and contains(ret, quote) then 2 end as way from p qualify way = min(way) over (partition by anchor_id)),
 s2 as (select * from s1 qualify fits or not max(fits) over (partition by anchor_id)),
 s3 as (select * from s2 qualify kind = 'table_row' or not max(kind = 'table_row') over (partition by anchor_id)),
 s4 as (select * from s3 qualify kind <> 'table_raw_text' or not max(kind <> 'table_raw_text') over (partition by anchor_id)),
 found as (select anchor_id, list(distinct id order by id) as ids, min(contains(raw, quote)::int) as exact from s4 group by 1),
 rest as materialized (select * from p anti join found using (anchor_id)),
 l as (select *, len(list_intersect(string_split(raw, ' '), qs)) > 0 as has, lead(i, 1) over w as i2, lead(i, 2) over w as i3, lead(raw, 1) over w as raw2, lead(raw, 2) over w as raw3, lead(id, 1) over w as id2, lead(id, 2) over w as id3, lead(fits, 1) over w as fits2, lead(fits, 2) over w as fits3 from rest window w as (partition by anchor_id order by i)),
 l2 as (select *, len(list_intersect(string_split(raw2, ' '), qs)) > 0 as has2, len(list_intersect(string_split(raw3, ' '), qs)) > 0 as has3 from l),
 wide as (select anchor_id, 2 as n, [id, id2] as ids, fits and fits2 as ok from l2 where i2 = i + 1 and has and has2 and contains(raw || ' ' || raw2, quote) union all select anchor_id, 3, [id, id2, id3], fits and fits2 and fits3 from l2 where i2 = i + 1 and i3 = i + 2 and has and has2 and has3 and contains(raw || ' ' || raw2 || ' ' || raw3, quote)),
 least as (select * from wide qualify n = min(n) over (partition by anchor_id)), best as (select * from least qualify ok or not max(ok) over (partition by anchor_id)),
 near as (select anchor_id, count(*) as n, min(ids) as ids from best group by 1),
 alike as (select distinct anchor_id from rest anti join near using (anchor_id) where len(list_intersect(list_distinct(qs), string_split(raw || ' ' || ret, ' '))) / len(list_distinct(qs))::double >= 0.8)
 select a.anchor_id, case when f.ids is not null then case when len(f.ids) = 1 then 'resolved' else 'manual_review' end when n.n is not null then case when n.n = 1 then 'multi_chunk' else 'manual_review' end when l.anchor_id is not null then 'manual_review' else 'unresolved' end as status,
 case when f.ids is not null then case when exact = 1 then 'exact' else 'normalized_exact' end when n.n is not null then 'adjacent_chunks' when l.anchor_id is not null then 'fuzzy_candidate' else 'none' end as method,
 case when len(f.ids) = 1 then f.ids[1] when f.ids is null and n.n = 1 then array_to_string(n.ids, ',') else '' end as chunks,
 case when f.ids is not null then case when len(f.ids) = 1 then 'UNIQUE_MATCH' else 'MULTIPLE_MATCHES' end when n.n is not null then case when n.n = 1 then 'UNIQUE_ADJACENT_WINDOW' else 'MULTIPLE_ADJACENT_WINDOWS' end when l.anchor_id is not null then 'FUZZY_CANDIDATES_REQUIRE_REVIEW' else 'NO_SOURCE_MATCH' end as reason
 from a left join found f using (anchor_id) left join near n using (anchor_id) left join alike l using (anchor_id)"""
)
def resolved_quotes(spark, d):
    """Every way of finding a quote: in a chunk of its section, in a table row's indexed form, over two and three neighbours, by most of its words, or not at all."""
    i = F.col("i")
    w = table(spark, d, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("ws"))
    part = lambda start, n: F.array_join(F.slice("ws", start, n), " ")
    c = w.filter("size(ws) > 0").select("*", F.explode(F.sequence(F.lit(0), F.floor((F.size("ws") + 5) / 6).cast("int") - 1)).alias("i"))
    kind = F.when(i % 5 == 0, F.lit("table_row")).when(i % 5 == 1, F.lit("table_raw_text")).otherwise(F.lit("text"))
    page = F.floor(i / 4).cast("int")
    tail = F.when(i % 5 == 0, F.concat(F.lit(" row total zzr"), "doc_id")).otherwise(F.lit(""))
    chunks = c.select(F.col("doc_id").alias("document_key"), F.concat_ws("/", "doc_id", "i").alias("chunk_id"), i.alias("chunk_index"), page.alias("page_start"), (page + (i % 4 == 3).cast("int")).alias("page_end"), F.array(F.concat(F.lit("Part "), i % 3)).alias("section_path"), kind.alias("subtype"), F.lit(True).alias("indexed"), part(6 * i + 1, F.lit(6)).alias("raw_content"), F.concat(part(6 * i + 1, F.lit(6)), F.lit(" sum"), tail).alias("retrieval_content"))
    k, m = F.col("k"), F.col("m")
    a = w.filter("size(ws) >= 60").select("*", (F.col("doc_id") % 5 + 2).cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
    total = F.concat(F.lit("total zzr"), "doc_id")
    quote = F.when(k == 0, part(6 * m + 2, F.lit(4))).when(k == 1, part(6 * m + 4, F.lit(6))).when(k == 2, part(6 * m + 4, F.lit(12))).when(k == 3, F.concat(part(6 * m + 1, F.lit(5)), F.lit(" zzq"))).when(k == 4, total).when(k == 5, F.concat(F.lit("row "), total)).otherwise(F.lit("zzz qqq vvv"))
    want = F.when((k == 0) & (F.col("doc_id") % 2 == 0), F.array(F.concat(F.lit("PART "), m % 3))).otherwise(F.array().cast("array<string>"))
    anchors = a.select(F.concat_ws("/", "doc_id", "k").alias("anchor_id"), F.col("doc_id").alias("document_key"), F.floor(m / 4).cast("int").alias("page"), want.alias("section_path"), quote.alias("quote"), F.lit(None).cast("string").alias("quote_hash"))
    return evaluation.resolve_evidence(anchors, chunks, fuzzy=0.8, widest=3).select("anchor_id", "status", "method", F.array_join("chunk_ids", ",").alias("chunks"), "reason")


@query("select l.doc_id, count(*) as n, sum(d.doc_id)::bigint as total from labels l join documents d on 2 * l.doc_id <= 3 * d.doc_id + d.n_chars % 3000 and 3 * d.doc_id <= 2 * l.doc_id + 40 * l.quality group by 1")
def overlapping_pages(spark, d):
    """Page ranges of one large document: those of labelled rows against those of all documents, of lengths from one page to thousands."""
    one = F.lit(1).alias("key")
    left = table(spark, d, "labels").select(one, "doc_id", (2 * F.col("doc_id")).alias("a0"), (2 * F.col("doc_id") + 40 * F.col("quality")).alias("a1"))
    right = table(spark, d, "documents").select(one, F.col("doc_id").alias("other"), (3 * F.col("doc_id")).alias("b0"), (3 * F.col("doc_id") + F.col("n_chars") % 3000).alias("b1"))
    met = intervals.overlapping(left, right, ["key"], ("a0", "a1"), ("b0", "b1"))
    return met.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("other").alias("total"))


@query("select doc_id as anchor_id, case when n = 1 then chunk_id end as chunk_id, case when doc_id % 5 = 0 then 'PIN_MISMATCH' when n > 1 then 'AMBIGUOUS' end as problem from (select d.doc_id, case when d.doc_id % 5 <> 0 then count(*) end as n, min(c.doc_id::varchar) as chunk_id from documents d join documents c on c.source = d.source and md5(c.text) = md5(d.text) group by d.doc_id) x")
def rebound_decisions(spark, d):
    """Review decisions bound again by content: pins of an old snapshot don't hold, copies in one source are ambiguous."""
    i = F.col("doc_id")
    t = table(spark, d, "documents")
    anchors = t.select(i.alias("anchor_id"), F.col("source").alias("document_key"), F.lit(1).alias("page"), F.lit("q").alias("quote"))
    decisions = t.select(i.alias("anchor_id"), F.md5("text").alias("content_hash"), F.lit(1).alias("page"), T.quote_hash(F.lit("q")).alias("quote_hash"), F.when(i % 5 == 0, F.lit("s0")).otherwise(F.lit("s1")).alias("snapshot_id"))
    chunks = t.select(F.col("source").alias("document_key"), F.md5("text").alias("content_hash"), i.cast("string").alias("chunk_id"))
    return evaluation.rebound(decisions, anchors, chunks, "s1")


# parsers


@query(f"with {ELEMENTS} select d as document_id, page, md5(string_agg(t, ' ' order by o)) as text_md5 from (select distinct d, page, o + (d % 11 = 5)::int as o, raw || case when d % 29 = 9 and o = 0 then chr(0) else '' end as t from e where placed) group by 1, 2")
def page_texts(spark, d):
    return longs(evaluation.page_texts(elements(spark, d)).select("document_id", "page", F.md5("text").alias("text_md5")))


@query("select conv_id, turn, (case when turn % 2 = 0 then 1 else 0 end + case when turn % 3 = 0 then 1 else 0 end)::bigint as n from conversations")
def orphan_numbers(spark, d):
    """Numbers without a word near them: 12.5 and 7 among signs; a labelled one isn't counted."""
    sign = F.lit(" " + "- " * 20)
    said = F.concat(F.lit("count 3"), F.when(F.col("turn") % 2 == 0, F.concat(sign, F.lit("12.5"), sign)).otherwise(F.lit("")), F.when(F.col("turn") % 3 == 0, F.concat(sign, F.lit("7"), sign)).otherwise(F.lit("")))
    rows = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), said.alias("text"))
    return evaluation.orphan_numbers(rows).select("id.conv_id", "id.turn", "n")


@query("select conv_id as document_id, round(greatest(0, case when bool_and(turn % 3 <> 1) then 1.0::double else 0.7 end - 0.1 * count(*) filter (where turn % 3 = 1 and length(text) % 5 > 2)), 6) as confidence from conversations group by 1")
def order_confidences(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), (F.length("text") % 5).alias("n"), (F.col("turn") % 3 != 1).alias("ordered"))
    return rounded(evaluation.order_confidence(rows))


@query("select doc_id as case_id, (1 + (contains(lower(text), 'the'))::int)::bigint as found, 3::bigint as wanted from documents where text <> ''")
def anchor_checks(spark, d):
    t = table(spark, d, "documents").filter("text <> ''")
    anchors = t.select(F.col("doc_id").alias("case_id"), F.explode(F.array(F.upper(F.left("text", F.lit(1))), F.lit("THE"), F.lit("\x01none"))).alias("anchor"))
    return evaluation.anchor_check(t.select(F.col("doc_id").alias("case_id"), "text"), anchors)


@query("select user_id as case_id, bool_and(event_type <> 'error') as ok from events group by 1")
def header_bindings(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").cast("string").alias("cell"), F.col("event_type").alias("path"))
    return evaluation.header_binding(e.filter("path <> 'error'"), e)


@query("select doc_id as case_id, error is null as passed, error from (select doc_id, case when doc_id % 7 = 0 then 'NOT_PARSED' when doc_id % 7 = 1 then 'PAGE_COUNT' when doc_id % 7 = 2 then 'TABLE_COUNT' when doc_id % 7 = 3 then 'ANCHOR_MISSING' when doc_id % 7 = 4 then 'HEADER_BINDING' when doc_id % 7 = 5 then 'BROKEN_UNICODE' end as error from documents)")
def hard_case_gates(spark, d):
    """Cases that fail one check each, and some that pass."""
    i = F.col("doc_id")
    key = i % 7
    c = table(spark, d, "documents").select(i.alias("case_id"), F.lit(2).alias("expected_pages"), F.lit(1).alias("expected_tables"), F.lit(None).cast("int").alias("max_replacements"))
    m = table(spark, d, "documents").filter(key != 0).select(i.alias("case_id"), F.when(key == 1, 3).otherwise(2).alias("pages"), F.when(key == 2, 0).otherwise(1).alias("tables"), F.when(key == 3, 0).otherwise(1).alias("anchors_found"), F.lit(1).alias("anchors_wanted"), (key != 4).alias("header_ok"), F.when(key == 5, 1).otherwise(0).alias("replacements"))
    return evaluation.hard_cases(c, m)


@query("select doc_id as document_id, case when doc_id % 6 = 0 then 'missing' when doc_id % 6 = 1 then 'worse' when doc_id % 6 = 2 then 'better' when doc_id % 6 = 3 then 'worse' when doc_id % 6 = 4 then 'better' else 'equal' end as verdict, case when doc_id % 6 = 0 then 0.0 else 1.5 end::double as char_ratio from documents")
def parser_verdicts(spark, d):
    """One parser against another: missing output, failures, anchors, tables."""
    i = F.col("doc_id")
    key = i % 6
    a = table(spark, d, "documents").select(i.alias("document_id"), F.lit(100).alias("chars"), F.lit(1).alias("tables"), F.lit(2).alias("anchors"), F.lit(0).alias("failures"))
    b = table(spark, d, "documents").filter(key != 0).select(i.alias("document_id"), F.lit(150).alias("chars"), F.when(key == 4, 2).otherwise(1).alias("tables"), F.when(key == 2, 3).when(key == 3, 1).otherwise(2).alias("anchors"), F.when(key == 1, 1).otherwise(0).alias("failures"))
    return evaluation.parser_comparison(a, b)


@query("select item_id as qid, case when item_id % 3 = 0 then 'TIMEOUT' when item_id % 3 = 1 then 'MISSING' end as error, item_id % 3 = 2 as rejected from benchmark")
def predictions(spark, d):
    """A row per question: its answer, or an error category where there is none."""
    q = items(spark, d).select("qid")
    i = F.col("qid")
    answers = q.filter(i % 3 != 1).select("qid", F.when(i % 3 == 2, F.lit("Not enough evidence.")).alias("answer"), F.when(i % 3 == 0, F.lit("TIMEOUT")).alias("error"), F.array().cast("array<string>").alias("citations"))
    return evaluation.predictions_of(q, answers).select("qid", "error", "rejected")


@query(f"with {ROWS} select 'rejection' as metric, round(avg(case when qid % 3 = 0 then (qid % 6 = 0)::int end), 6) as value from rows union all select 'latency_ms', round(avg(latency_ms), 6) from rows union all select 'errors', count(*) filter (where qid % 7 = 0)::double from rows union all select 'recall@10/dev', round(avg(recall_10), 6) from rows where qid % 2 = 0 union all select 'recall@10/test', round(avg(recall_10), 6) from rows where qid % 2 = 1 union all select 'recall@10', round(avg(recall_10), 6) from rows")
def release_metrics(spark, d):
    r = run_rows(spark, d)
    i = F.col("qid")
    p = r.select("qid", "latency_ms", (i % 3 != 0).alias("answerable"), (i % 6 == 0).alias("rejected"), F.when(i % 7 == 0, F.lit("E")).alias("error"))
    return rounded(evaluation.release_metrics(p, r.withColumn("split", F.when(i % 2 == 0, F.lit("dev")).otherwise(F.lit("test")))))


# selection and contexts


@query(
    f"""with {POSTINGS}, {ASKED}, {_bm25_sql('found', 12)}, c as (select qid, id, rank, length(text) % 4 as tab, case length(text) % 3 when 0 then [] when 1 then ['a'] else ['a', 'b'] end as cells, row_number() over (partition by qid, sha256(text) order by rank) as m from found join documents d on d.doc_id = id),
 s as (select *, bool_or(len(cells) >= 1) over w as a_seen, bool_or(len(cells) = 2) over w as b_seen from c where m = 1 window w as (partition by qid, tab order by rank rows between unbounded preceding and 1 preceding)),
 k as (select * from s where not (len(cells) = 1 and coalesce(a_seen, false)) and not (len(cells) = 2 and coalesce(b_seen, false)))
 select qid, position, doc_id from (select qid, id as doc_id, row_number() over (partition by qid order by rank) as position from k) where position <= 5"""
)
def covering_selection(spark, d):
    """Hits of four tables: one whose cells are all there already is left out."""
    n = F.length("text")
    cells = F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    hits = found(spark, d, 12).join(docs(spark, d), "id").select("qid", "id", F.col("rank").cast("int"), F.sha2("text", 256).alias("content_hash"), F.lit("d").alias("document_id"), (n % 4).cast("string").alias("table_id"), cells.alias("cell_ids"))
    return longs(retrieval.select_covering(hits, 5).select("qid", "position", F.col("id").alias("doc_id")))


@query(f"with {POSTINGS}, {ASKED}, {_bm25_sql('found', 10)} select qid, id as doc_id, case when bad then rank else n + 1 - rank end as rank, case when bad then 'RERANK_UNAVAILABLE' else '' end as reasons from (select *, count(*) over (partition by qid) as n, qid % 2 = 0 and max(rank) over (partition by qid) >= 3 as bad from found)")
def degraded_rerankings(spark, d):
    """A reranker that turns every list round, but fails for one item of every second question."""
    hits = found(spark, d, 10)
    scored = hits.select("qid", "id", F.when((F.col("qid") % 2 == 0) & (F.col("rank") == 3), F.lit(float("nan"))).otherwise(F.col("rank").cast("double")).alias("score"))
    return longs(retrieval.reranked_or_fused(hits, scored).select("qid", F.col("id").alias("doc_id"), "rank", F.array_join("degraded_reasons", ",").alias("reasons")))


@query(f"with {POSTINGS}, {ASKED}, {_bm25_sql('found', 10)} select qid, id as doc_id, 'SCORE' as code from found where rank = 3")
def bad_scores(spark, d):
    scored = found(spark, d, 10).withColumn("score", F.when(F.col("rank") == 3, F.when(F.col("qid") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(None).cast("double"))).otherwise(F.col("score")))
    return retrieval.bad_scores(scored).select("qid", F.col("id").alias("doc_id"), F.lit("SCORE").alias("code"))


@query("select item_id as qid, case when item_id % 3 = 0 then text else text || chr(10) || 'more' end as query from benchmark")
def sparse_queries(spark, d):
    q = items(spark, d)
    new = F.when(F.col("qid") % 3 == 0, F.col("text")).otherwise(F.lit("more"))
    return q.select("qid", retrieval.sparse_query(F.col("text"), new).alias("query"))


@query("select doc_id, case when doc_id % 3 = 0 then 'p' else 'e' end as table_id, (case when doc_id % 4 = 0 then 2 when doc_id % 4 = 1 then 2 else 0 end)::bigint as n_cells, case when doc_id % 4 = 2 then 'table_raw_text' else 'table' end as kind from documents")
def evidence_kinds(spark, d):
    """Table id and cells of chunks by their subtype, and how they are cited."""
    i = F.col("doc_id")
    subtype = F.when(i % 4 == 0, F.lit("table_row")).when(i % 4 == 1, F.lit("table_group")).when(i % 4 == 2, F.lit("table_raw_text")).otherwise(F.lit("table_parent"))
    chunks = table(spark, d, "documents").select("doc_id", subtype.alias("chunk_subtype"), F.when(i % 3 == 0, F.lit("p")).alias("parent_chunk_id"), F.lit("e").alias("element_id"), F.array(F.lit("a"), F.lit("b")).alias("cell_ids"))
    out = retrieval.evidence_candidates(chunks)
    return longs(out.select("doc_id", "table_id", F.size("cell_ids").alias("n_cells"), retrieval.citation_kind(F.lit("table"), F.col("chunk_subtype"), F.col("cell_ids")).alias("kind")))


@query("select doc_id from documents where doc_id % 6 in (0, 1, 2, 3)")
def incomplete_sources(spark, d):
    """Cited tables that lack their element, cells, boxes or pages."""
    key = F.col("doc_id") % 6
    s = table(spark, d, "documents").select("doc_id", F.when(key == 5, F.lit("text")).otherwise(F.lit("table")).alias("element_kind"), F.when(key != 0, F.lit("e")).alias("element_id"), F.when(key == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("c"))).alias("cell_ids"), F.when(key == 2, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("bboxes"), F.when(key != 3, F.lit(1)).alias("page_start"), F.lit(1).alias("page_end"))
    return retrieval.incomplete_table_sources(s).select("doc_id")


RESULTS = f"{POSTINGS}, {ASKED}, {_bm25_sql('found', 10)}, res as (select f.qid, f.rank, case when f.rank = 4 then 2 else f.rank end as chunk, f.id, d.source, d.text, case when f.rank % 2 = 0 then md5(d.text) else '' end as h from found f join documents d on d.doc_id = f.id)"


def results(spark: SparkSession, d: str) -> DataFrame:
    """Ten results of each question; the fourth repeats the second's chunk, and copies repeat texts."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    rank = F.col("rank")
    return found(spark, d, 10).join(t, "id").select("qid", rank.cast("int").alias("rank"), F.when(rank == 4, 2).otherwise(rank).cast("string").alias("chunk_id"), "id", F.col("source").alias("document_id"), F.col("text").alias("raw_content"), F.when(rank % 2 == 0, F.md5("text")).otherwise(F.lit("")).alias("content_hash"))


@query(f"with {RESULTS}, one as (select * from (select *, row_number() over (partition by qid, chunk order by rank) as n from res) where n = 1), two as (select *, row_number() over (partition by qid, coalesce(nullif(h, ''), text) order by rank) as m from one) select qid, rank, id as doc_id from two where m = 1")
def context_repeats(spark, d):
    return longs(context.without_repeats(results(spark, d)).select("qid", "rank", F.col("id").alias("doc_id")))


@query(f"with {RESULTS} select qid, rank, md5('[Source ' || rank || ']' || chr(10) || 'Document: ' || source || chr(10) || 'Section: ' || case when rank % 3 = 0 then 'Unknown' else 'A > B' end || chr(10) || 'Page: ' || case when rank % 2 = 0 then rank::varchar else 'unknown' end || chr(10) || 'Chunk-ID: ' || chunk || chr(10) || 'Content:' || chr(10) || text || case when rank = 10 then ' [truncated]' else '' end) as block_md5, md5(substr(text, 1, 600)) as excerpt_md5 from res where rank <= 6")
def source_blocks(spark, d):
    """Blocks as a prompt shows them, and the beginnings that a planner sees."""
    r = results(spark, d)
    rank = F.col("rank")
    block = context.source_text(rank, F.col("document_id"), F.when(rank % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("A"), F.lit("B"))), F.when(rank % 2 == 0, rank), F.col("chunk_id"), F.col("raw_content"), rank == 10)
    own = context.excerpts(r).select("qid", "rank", F.md5("excerpt").alias("excerpt_md5"))
    return longs(r.select("qid", "rank", F.md5(block).alias("block_md5")).join(own, ["qid", "rank"]))


@query(f"with {RESULTS} select qid, string_agg(rank || '=' || chunk, ',' order by rank) as citations from res group by 1")
def citation_maps(spark, d):
    made = context.citation_maps(results(spark, d).withColumnRenamed("rank", "block"))
    return made.select("qid", F.array_join(F.transform(F.map_entries("citations"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",").alias("citations"))


@query(f"with {STORE} select document_id, case when document_id % 2 = 0 then source else 'file' || document_id end as title from store where status = 'READY' and document_id in (select doc_id from labels where toxic = 0)")
def routing_documents(spark, d):
    s = store(spark, d).select("document_id", "status", F.when(F.col("document_id") % 2 == 0, F.col("source")).otherwise(F.lit("")).alias("title"), F.concat(F.lit("file"), F.col("document_id").cast("string")).alias("filename"))
    return context.routing_documents(s, table(spark, d, "labels").filter("toxic = 0").select(F.col("doc_id").alias("document_id")))


@query("select item_id as qid, case item_id % 5 when 0 then 'TOO_MANY_ROUTES' when 1 then 'ROUTES_REPEAT' when 2 then 'FOREIGN_DOCUMENT' else 'LOW_CONFIDENCE' end as code from benchmark where item_id % 5 <> 4")
def route_faults(spark, d):
    key = F.col("qid") % 5
    routes = F.when(key == 0, F.array().cast("array<string>")).when(key == 1, F.array(F.lit("1"), F.lit("1"))).when(key == 2, F.array(F.lit("x"))).otherwise(F.array(F.lit("1"), F.lit("2")))
    plans = items(spark, d).select("qid", F.when(key == 3, 0.2).otherwise(0.9).alias("confidence"), routes.alias("routes"))
    return context.route_problems(plans, table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id")))


@query("select item_id as qid, 'EVIDENCE_PLAN_FAILED' as code from benchmark where item_id % 4 in (1, 2)")
def refinement_faults(spark, d):
    key = F.col("qid") % 4
    return context.refinement_problems(items(spark, d).select("qid", (key >= 2).alias("sufficient"), F.when(key % 2 == 0, F.lit(" more ")).when(key == 1, F.lit(" \n")).alias("subquery")))


# one search for each route, in its document: here a source


ROUTE_TERMS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+(?:[-/][a-z0-9]+)*'))"


def source_search(spark: SparkSession, d: str):
    """A search by shared words in the documents of a scope's sources: its callers get five rows of each query."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("document_id"), F.col("text").alias("raw_content"))
    words = lambda text: F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(T.TOKEN), F.lit(0)))

    def run(queries: DataFrame, scope: DataFrame | None) -> DataFrame:
        asked = shared.stored(queries.select("qid", F.explode(words(F.col("text"))).alias("term")), "asked")
        own = rows
        if scope is not None:
            # a query meets the documents of its scope only, so the scope goes to its terms
            asked = asked.join(scope.select("qid", "document_id").distinct(), "qid")
            own = rows.join(shared.few(asked.select("document_id").distinct()), "document_id", "left_semi")
        terms = own.select("id", "document_id", F.explode(words(F.col("raw_content"))).alias("term"))
        hits = terms.join(shared.few(asked), ["term"] if scope is None else ["term", "document_id"]).groupBy("qid", "id").agg(F.count("*").cast("double").alias("score"))
        best = rows.join(shared.few(shared.stored(retrieval.ranked(hits, 5), "best")), "id")
        return best.select("qid", F.lpad(F.col("id").cast("string"), 12, "0").alias("chunk_id"), "rank", "document_id", F.lit(None).cast("string").alias("element_id"), "raw_content", F.array().cast("array<string>").alias("cell_ids"))

    return run


@query(
    f"""with asked as (select item_id as qid, 0 as search, null as source, text as t from benchmark union all select item_id, 1, 'src' || (item_id % 3), left(text, 60) from benchmark where item_id % 4 <> 3 union all select item_id, 2, 'src' || (item_id % 3 + 3), right(text, 60) from benchmark where item_id % 4 <> 3 union all select item_id, 1, null, left(text, 40) from benchmark where item_id % 4 = 3),
 terms as (select qid, search, source, unnest({ROUTE_TERMS.format("t")}) as term from asked), words as (select doc_id, source, unnest({ROUTE_TERMS.format("text")}) as term from documents),
 hits as (select a.qid, a.search, w.doc_id, count(*) as score from terms a join words w using (term) where a.source is null or a.source = w.source group by 1, 2, 3),
 best as (select * from (select *, row_number() over (partition by qid, search order by score desc, doc_id) as rank from hits) where rank <= 5),
 f as (select qid, doc_id, sum(1.0::double / (60 + rank)) as score, min(rank) as best, min(search) as first from best group by 1, 2),
 o as (select f.*, d.source, md5(d.text) as h, row_number() over (partition by f.qid order by round(score, 9) desc, best, first, lpad(f.doc_id::varchar, 12, '0')) as place from f join documents d using (doc_id)),
 u as (select *, row_number() over (partition by qid order by place) as n from (select *, row_number() over (partition by qid, h order by place) as m from o) where m = 1),
 r as (select u.*, a.source is not null as wanted, n <= 4 as taken, row_number() over (partition by u.qid, u.source order by n) as own from u left join (select distinct qid, source from asked where source is not null) a on a.qid = u.qid and a.source = u.source),
 must as (select *, wanted and own = 1 as must from r), c as (select *, sum((must and not taken)::int) over (partition by qid) as lost, row_number() over (partition by qid, taken and not must order by n desc) as spare from must)
 select qid, doc_id, row_number() over (partition by qid order by place) as rank from c where (taken and not (not must and spare <= lost)) or (must and not taken)"""
)
def routed_evidence(spark, d):
    """A first search, one for each of two routes in its own source, fused; low confidence asks once more instead."""
    q = items(spark, d)
    i = F.col("qid")
    part = lambda text, source: F.struct(text.alias("subquery"), F.concat(F.lit("src"), source.cast("string")).alias("document_id"))
    routes = q.select("qid", F.when(i % 4 == 3, 0.1).otherwise(0.9).alias("confidence"), F.inline(F.array(part(F.left("text", F.lit(60)), i % 3), part(F.right("text", F.lit(60)), i % 3 + 3))))
    refined = q.select("qid", F.left("text", F.lit(40)).alias("subquery"))
    out = context.gather(q, source_search(spark, d), "routed_multi_search", routes, top_k=4, refinements=refined)
    return longs(out.select("qid", F.col("chunk_id").cast("long").alias("doc_id"), "rank"))


@query("select item_id as qid, case when item_id % 2 = 1 then text when item_id % 4 = 0 then text || ' again' else text end as rewritten, case when item_id % 4 = 2 then 'REWRITE_FAILED' else '' end as reasons from benchmark")
def rewritten_queries(spark, d):
    """Questions with a history are rewritten; where that fails they stay."""
    q = items(spark, d)
    history = q.filter("qid % 2 = 0").select(F.col("qid").alias("conv_id"), F.when(F.col("qid") % 4 == 0, F.lit("said")).otherwise(F.lit("")).alias("history"))
    model = lambda text, said: F.when(said == "said", F.concat(text, F.lit(" again")))
    return context.rewritten(q, history, model).select("qid", "rewritten", F.array_join("degraded_reasons", ",").alias("reasons"))
