"""The engine's queries over the supplied tables, each with the DuckDB SQL that must agree with it.

documents stand for chunks, benchmark items for questions, lines of documents for the chunks of
one document, labels for collections and statuses, events for jobs, conversations for sessions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark import shared
from siftspark.functions import text as T
from siftspark.operators import chunking, context, evaluation, indexing, lifecycle, retrieval
from siftspark.operators.balls import Balls
from siftspark.operators.segments import Index
from siftspark.plans import search
from siftspark.sources import loaders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as it is read; texts in a single file's row group would else be one core's work."""
    found = spark.read.parquet(f"{d}/{name}.parquet")
    return shared.spread(found) if name in ("documents", "pages") else found


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def store(spark: SparkSession, d: str) -> DataFrame:
    """A document store: labelled documents of quality 0 failed, the others are ready."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    both = table(spark, d, "documents").join(labels, "doc_id", "left")
    return both.select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 0, F.lit("FAILED")).otherwise(F.lit("READY")).alias("status"), F.col("n_chars").alias("created_at"), "source", F.sha2("text", 256).alias("file_sha256"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """Collections quality and toxic of labelled documents."""
    labels = table(spark, d, "labels")
    return labels.filter("quality = 1").select(F.lit("quality").alias("collection_id"), F.col("doc_id").alias("document_id")).unionByName(labels.filter("toxic = 1").select(F.lit("toxic").alias("collection_id"), F.col("doc_id").alias("document_id")))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that aren't empty, as chunks (document_id, chunk_index, raw_content)."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "raw_content")).filter("raw_content <> ''")


# SQL parts
TOKENS = r"regexp_extract_all(lower(text), '[a-z0-9]+(?:[-/][a-z0-9]+)*|[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]')"
STORE = "store as (select d.doc_id as document_id, case when l.quality = 0 then 'FAILED' else 'READY' end as status, d.n_chars as created_at, d.source, sha256(d.text) as file_sha256 from documents d left join (select doc_id, min(quality) as quality from labels group by 1) l using (doc_id))"
MEMBERS = "members as (select 'quality' as collection_id, doc_id as document_id from labels where quality = 1 union all select 'toxic', doc_id from labels where toxic = 1)"
POSTINGS = f"posted as (select id, term, count(*) as tf from (select doc_id as id, unnest({TOKENS}) as term from documents) group by 1, 2), lengths as (select doc_id as id, len({TOKENS}) as dl from documents), corpus as (select count(*) as n_docs, avg(dl) as avgdl from lengths), terms as (select term, count(*) as df, ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5) + 1) as idf from posted, corpus group by 1)"
ASKED = f"asked as (select qid, unnest(ts) as term, len(ts) as n_terms from (select item_id as qid, list_distinct({TOKENS}) as ts from benchmark))"


def _bm25_sql(name: str, k: int | None, minimum: int = 1, scope: str = "") -> str:
    top = f"where rank <= {k}" if k else ""
    return f"{name} as (select * from (select qid, id, score, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from (select a.qid, p.id, sum(t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.dl / c.avgdl))) as score, count(*) as hits, max(a.n_terms) as n_terms from posted p join asked a using (term) join terms t using (term) join lengths l using (id) cross join corpus c {scope} group by 1, 2) where hits >= least({minimum}, n_terms)) {top})"


EMBED = "emb as (select tab, id, bucket, n / sqrt(sum(n * n) over (partition by tab, id)) as weight from (select tab, id, (('0x' || right(md5(w), 2))::int & 63) as bucket, count(*) as n from (select tab, id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as w from (select 'd' as tab, doc_id as id, text from documents union all select 'q', item_id, text from benchmark)) group by 1, 2, 3))"


def _ranked_sql(name: str, source: str, k: int | None = None) -> str:
    top = f"where rank <= {k}" if k else ""
    return f"{name} as (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as rank from ({source})) {top})"


DENSE = _ranked_sql("dense", "select q.id as qid, d.id, sum(q.weight * d.weight) as score from emb q join emb d using (bucket) where q.tab = 'q' and d.tab = 'd' group by 1, 2", 30)
FUSED = "fused as (select * from (select *, row_number() over (partition by qid order by round(score, 9) desc, best_rank, id) as rank from (select qid, id, sum(1.0::double / (60 + rank)) as score, min(rank) as best_rank, arg_min(source, rank * 2 + n) as source from (select qid, id, rank, 'dense' as source, 0 as n from dense union all select qid, id, rank, 'bm25', 1 from sparse) group by 1, 2)) where rank <= 30)"
WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''))"
RERANK = _ranked_sql("reranked", f"select f.qid, f.id, case when len({WORDS.format('b.text')}) > 0 and len({WORDS.format('d.text')}) > 0 then len(list_intersect({WORDS.format('b.text')}, {WORDS.format('d.text')})) / len({WORDS.format('b.text')})::double else 0.0 end as score from fused f join benchmark b on b.item_id = f.qid join documents d on d.doc_id = f.id")
SELECTED = "selected as (select qid, id, score, rank, row_number() over (partition by qid order by rank) as position from (select *, row_number() over (partition by qid order by rank) as n from (select r.*, row_number() over (partition by r.qid, sha256(d.text) order by r.rank) as m from reranked r join documents d on d.doc_id = r.id) where m = 1) where n <= 8)"
HYBRID = f"with {POSTINGS}, {ASKED}, {EMBED}, {DENSE}, {_bm25_sql('sparse', 30)}, {FUSED}, {RERANK}, {SELECTED}"
GOLD = "gold as (select item_id as qid, doc_id as id from benchmark b, documents d where contains(d.text, b.text))"
SCORES = """scores as (select g.qid, {cols} from (select qid, count(*) as n from gold group by 1) g left join (select s.qid, min(s.rank) as first, {hits} from {ranked} s join gold using (qid, id) group by 1) h using (qid))"""


def _scores_sql(ranked: str, name: str = "scores") -> str:
    ideal = "list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1 / log2(i + 1)))"
    cols = ", ".join([*(f"coalesce(h{k} / n::double, 0) as recall_{k}" for k in (1, 3, 5, 10)), "coalesce(1 / first::double, 0) as mrr", *(f"coalesce(g{k} / {ideal.format(k=k)}, 0) as ndcg_{k}" for k in (5, 10))])
    hits = ", ".join([*(f"count(*) filter (where s.rank <= {k}) as h{k}" for k in (1, 3, 5, 10)), *(f"sum(1 / log2(s.rank + 1)) filter (where s.rank <= {k}) as g{k}" for k in (5, 10))])
    return SCORES.format(cols=cols, hits=hits, ranked=ranked).replace("scores as", f"{name} as", 1)


METRICS = [*(f"recall_{k}" for k in (1, 3, 5, 10)), "mrr", "ndcg_5", "ndcg_10"]
ROUNDED = ", ".join(f"round({m}, 6) as {m}" for m in METRICS)
MEANS = ", ".join(f"round(avg({m}), 6) as {m}" for m in METRICS)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


# text


@query(f"select doc_id, len({TOKENS})::bigint as n_tokens, md5(array_to_string({TOKENS}, ' ')) as tokens_md5 from documents")
def tokens(spark, d):
    found = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n_tokens"), F.md5(F.array_join(found, " ")).alias("tokens_md5"))


@query("select doc_id, md5(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(0), '')) as text_md5, length(text) - length(replace(text, chr(65533), '')) as replacements from documents")
def normalised_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.line_feeds(F.col("text"))).alias("text_md5"), T.replacement_count(F.col("text")).cast("long").alias("replacements"))


RETRIEVAL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '(['||l||'])-\\n(['||l||'])', '\\1\\2', 'g'), '([0-9])-\\n([0-9])', '\\1-\\2', 'g'), '[−‐‑‒–—―]', '-', 'g'), '\\s+', ' ', 'g'))"


@query(f"select doc_id, length({RETRIEVAL}) as n_chars, md5({RETRIEVAL}) as text_md5 from documents, (select 'A-Za-z\\x{{00c0}}-\\x{{024f}}\\x{{0370}}-\\x{{03ff}}' as l)")
def retrieval_text(spark, d):
    """The tables' texts are in composed forms already, so SQL needs no Unicode forms; a test holds others against literals."""
    t = T.for_retrieval(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("text_md5"))


@query("select doc_id, array_to_string(list_sort(list_filter([case when contains(text, 'ε') then 'epsilon' end, case when contains(text, 'θ') then 'theta' end, case when contains(text, 'Σ') then 'sigma' end, case when contains(text, 'μ') then 'mu' end], lambda x: x is not null)), ',') as aliases from documents")
def formula_aliases(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.formula_aliases(F.col("text")), ",").alias("aliases"))


@query("select doc_id, len(range(0, length(text), 500))::bigint as n_parts, md5(array_to_string(list_transform(range(0, length(text), 500), lambda i: substr(text, i + 1, 500)), '|')) as parts_md5 from documents")
def hard_cuts(spark, d):
    parts = T.hard_cut(F.col("text"), 500)
    return table(spark, d, "documents").select("doc_id", F.size(parts).cast("long").alias("n_parts"), F.md5(F.array_join(parts, "|")).alias("parts_md5"))


@query("select doc_id, coalesce(nullif(length(regexp_extract(substr(text, 1, 400), '(?s)^.+[.!?。！？]', 0)), 0), 400) as cut from documents")
def sentence_boundaries(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sentence_boundary(F.col("text"), 400).cast("long").alias("cut"))


@query("select doc_id, md5(substr(concat_ws(chr(10), nullif(source, ''), nullif(lang || ' > ' || source, ''), nullif(text, '')), 1, 30000)) as content_md5 from documents")
def retrieval_contents(spark, d):
    content = T.retrieval_content(F.col("source"), F.array("lang", "source"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(content).alias("content_md5"))


@query("select doc_id, regexp_replace(source || '/' || lang || '?', '[^A-Za-z0-9._-]+', '_', 'g') as name, sha256(text) as content_hash, strlen(text) as n_bytes from documents")
def upload_facts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.file_name(F.concat("source", F.lit("/"), "lang", F.lit("?"))).alias("name"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("n_bytes"))


# citations and conversations: every message gets marks of its turn and of the turn after


CITED = "said as (select conv_id, turn, text || ' [' || turn || '] see [' || (turn + 1) || '] and [' || turn || ']' as answer from conversations)"


@query(f"with {CITED}, n as (select *, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), lambda x: x::bigint))) as ns from said) select conv_id, turn, array_to_string(list_filter(ns, lambda x: x <= 3), ',') as valid, array_to_string(list_filter(ns, lambda x: x > 3), ',') as invalid from n")
def citations(spark, d):
    answer = F.concat("text", F.lit(" ["), "turn", F.lit("] see ["), F.col("turn") + 1, F.lit("] and ["), "turn", F.lit("]"))
    allowed = F.array(*[F.lit(k).cast("bigint") for k in range(4)])
    a = table(spark, d, "conversations").select("conv_id", "turn", answer.alias("answer"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return a.select("conv_id", "turn", join(T.valid_citations(F.col("answer"), allowed)).alias("valid"), join(T.invalid_citations(F.col("answer"), allowed)).alias("invalid"))


@query(f"with {CITED} select conv_id, turn, md5(case when turn > 3 then replace(replace(answer, '[' || turn || ']', ''), '[' || (turn + 1) || ']', '') when turn = 3 then replace(answer, '[4]', '') else answer end) as answer_md5 from said")
def final_answers(spark, d):
    """Messages with marks of numbers above 3, which are none of the blocks, removed."""
    answer = F.concat("text", F.lit(" ["), "turn", F.lit("] see ["), F.col("turn") + 1, F.lit("] and ["), "turn", F.lit("]"))
    allowed = F.array(*[F.lit(k).cast("bigint") for k in range(4)])
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.final_answer(answer, allowed)["answer"]).alias("answer_md5"))


@query("select conv_id, turn, role, position from (select *, row_number() over (partition by conv_id order by turn) as position from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 4)")
def last_messages(spark, d):
    return lifecycle.last_messages(table(spark, d, "conversations"), 4).select("conv_id", "turn", "role", F.col("position").cast("long"))


@query("select conv_id, md5(string_agg(role || ': ' || text, chr(10) order by turn)) as history_md5 from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 8 group by 1")
def histories(spark, d):
    return context.sessions_text(table(spark, d, "conversations"), 8).select("conv_id", F.md5("history").alias("history_md5"))


@query("select conv_id, md5(string_agg(text, chr(10) order by turn)) as query_md5 from conversations where role = 'user' group by 1")
def user_queries(spark, d):
    return context.user_queries(table(spark, d, "conversations")).select("conv_id", F.md5("query").alias("query_md5"))


@query("select conv_id, sum(length(text) // 4)::bigint as tokens from conversations group by 1")
def token_estimates(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(context.token_estimate(F.col("text"))).cast("long").alias("tokens"))


# chunks


@query("with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') as xs from documents) select doc_id, sha256(array_to_string(xs, chr(10) || chr(10))) as content_hash, length(array_to_string(xs, chr(10) || chr(10))) as character_count from l where len(xs) > 0 and list_sum(list_transform(xs, lambda x: length(x))) <= 2048")
def small_documents(spark, d):
    return chunking.small_documents(table(spark, d, "documents")).select("doc_id", "content_hash", "character_count")


@query()
def markdown_paragraphs(spark, d):
    return loaders.load_markdown(table(spark, d, "documents")).select("doc_id", "pos", "type", "line_start", "line_end", "heading_level", F.md5("content").alias("content_md5"))


# indexes


@query(f"with {POSTINGS} select id as doc_id, term, tf from posted")
def postings(spark, d):
    return indexing.postings(docs(spark, d)).select(F.col("id").alias("doc_id"), "term", "tf")


@query(f"with {POSTINGS} select id as doc_id, dl::bigint as dl from lengths")
def document_stats(spark, d):
    return indexing.document_stats(docs(spark, d)).withColumnRenamed("id", "doc_id")


@query(f"with {POSTINGS} select term, df, round(idf, 6) as idf from terms")
def term_stats(spark, d):
    return rounded(indexing.build_sparse(docs(spark, d)).terms)


@query(f"with {POSTINGS} select n_docs, round(avgdl, 6) as avgdl from corpus")
def corpus_stats(spark, d):
    return rounded(indexing.corpus_stats(indexing.document_stats(docs(spark, d))))


@query(f"with {EMBED} select id as doc_id, bucket, round(weight, 6) as weight from emb where tab = 'd'")
def hashed_embeddings(spark, d):
    return rounded(indexing.hashed_embeddings(docs(spark, d))).withColumnRenamed("id", "doc_id")


@query("select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as length, round(embedding[1]::double / sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as first from embeddings where list_inner_product(embedding::double[], embedding::double[]) > 0")
def unit_vectors(spark, d):
    e = table(spark, d, "embeddings")
    unit = indexing.l2_normalised(e, "vec_id", "embedding")
    return rounded(unit.join(e.select(F.col("vec_id").alias("id"), indexing.norm(F.col("embedding")).alias("length")), "id").select(F.col("id").alias("vec_id"), "length", F.get("vector", 0).alias("first")))


@query("select vec_id as id, case when len(embedding) <> 64 then 'DIMENSION_MISMATCH' else 'ZERO_VECTOR' end as code from embeddings where len(embedding) <> 64 or list_inner_product(embedding::double[], embedding::double[]) = 0")
def vector_problems(spark, d):
    return indexing.zero_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", 64)


@query("select doc_id, case when doc_id % 3 = 0 then doc_id else (select max(doc_id) from documents where doc_id % 3 = 0) + row_number() over (partition by doc_id % 3 = 0 order by source, doc_id) end as index_id from documents")
def allocated_ids(spark, d):
    """Rows whose id isn't divisible by 3 are new here and get ids in order of source and id."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("index_id"))
    return indexing.allocate_ids(rows, ["source", "doc_id"]).select("doc_id", "index_id")


# retrieval


@query(f"with {POSTINGS}, {ASKED}, {_bm25_sql('found', 10)} select qid, id as doc_id, round(score, 6) as score, rank from found")
def bm25_topk(spark, d):
    found = search.corpus_index(spark, d).search(items(spark, d), 10)
    return rounded(found).select("qid", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long"))


@query(f"with {POSTINGS}, {ASKED}, {_bm25_sql('found', None, 5)} select qid, id as doc_id, round(score, 6) as score, rank from found where rank <= 50")
def bm25_minimum(spark, d):
    """At least five of a question's terms."""
    found = search.corpus_index(spark, d).search(items(spark, d), 50, minimum=5)
    return rounded(found).select("qid", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long"))


@query(f"with {POSTINGS}, {ASKED}, {_bm25_sql('found', 10, 1, 'join (select doc_id from labels where quality = 1) s on s.doc_id = p.id')} select qid, id as doc_id, round(score, 6) as score, rank from found")
def bm25_scope(spark, d):
    """Only documents of quality 1; term weights stay the corpus's."""
    scope = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    found = search.corpus_index(spark, d).search(items(spark, d), 10, scope=scope)
    return rounded(found).select("qid", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long"))


CHANGED = POSTINGS.replace("from documents)", "from docs)").replace("from documents", "from docs")


@query(f"with docs as (select doc_id, case when doc_id % 5 = 1 then lang || ' ' || source || ' ' || text else text end as text from documents where doc_id % 7 <> 3), {CHANGED}, {ASKED}, {_bm25_sql('top', 10)} select qid, id as doc_id, round(score, 6) as score, rank from top")
def changed_index(spark, d):
    """A search after batches came, some documents came again with another text, others were deleted, and segments were merged."""
    t = table(spark, d, "documents")
    index = Index(spark, f"{shared.shared_dir(spark)}/changed-{uuid.uuid4().hex}")
    i = F.col("doc_id")
    rows = t.select(i.alias("id"), "text")
    index.add(rows.filter(i % 2 == 0), "even").add(rows.filter(i % 2 == 1), "odd").add(rows.filter(i % 2 == 1), "odd")
    again = t.filter(i % 5 == 1).select(i.alias("id"), F.concat_ws(" ", "lang", "source", "text").alias("text"))
    index.add(again, "again").delete(rows.filter(i % 7 == 3).select("id"), "gone")
    index.merge(most_docs=index.statistics()[0] // 3)
    found = index.search(items(spark, d), 10)
    return rounded(found).select("qid", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long"))


@query(f"with {POSTINGS}, {ASKED} select qid, sum(df)::bigint as postings, true as bounded from asked join terms using (term) group by 1")
def postings_read(spark, d):
    """Postings of each question's terms; its search reads each of them twice at most, once a pass."""
    read = search.corpus_index(spark, d).postings_read(items(spark, d), 10)
    return read.filter("postings > 0").select("qid", "postings", (F.col("read") <= 2 * F.col("postings")).alias("bounded"))


UNIT = "unit as (select vec_id as id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_inner_product(embedding::double[], embedding::double[]))) as v from embeddings)"
NEAREST = _ranked_sql("near", "select q.id as qid, u.id, list_inner_product(q.v, u.v) as score from unit q, unit u where q.id % 20 = 0", 10)


@query(f"with {UNIT}, {NEAREST} select qid, id, round(score, 6) as score, rank from near")
def dense_topk(spark, d):
    """Every vector whose id is divisible by 20 is a query, against all."""
    unit = indexing.l2_normalised(table(spark, d, "embeddings"), "vec_id", "embedding")
    found = retrieval.dense(unit.filter("id % 20 = 0").withColumnRenamed("id", "qid"), unit, 10)
    return rounded(found).select("qid", "id", "score", F.col("rank").cast("long"))


@query(f"with {UNIT}, {NEAREST}, n as (select count(*) as n from unit) select qid, id, round(score, 6) as score, rank, true as bounded from near")
def bounded_topk(spark, d):
    """The neighbours of dense_topk by balls and rings, visited while their bounds say so; no distance is computed twice."""
    unit = indexing.l2_normalised(table(spark, d, "embeddings"), "vec_id", "embedding")
    found, share = Balls.build(unit).nearest(unit.filter("id % 20 = 0").withColumnRenamed("id", "qid"), 10)
    both = found.join(share.select("qid", (F.col("computed") <= F.col("n")).alias("bounded")), "qid")
    return rounded(both).select("qid", "id", "score", F.col("rank").cast("long"), "bounded")


@query(f"with {UNIT}, {_ranked_sql('near', 'select q.id as qid, u.id, list_inner_product(q.v, u.v) as score from unit q, unit u where q.id % 20 = 0 and u.label < 5', 10)} select qid, id, round(score, 6) as score, rank from near")
def dense_scope(spark, d):
    e = table(spark, d, "embeddings")
    unit = indexing.l2_normalised(e, "vec_id", "embedding")
    scope = e.filter("label < 5").select(F.col("vec_id").alias("id"))
    found = retrieval.dense(unit.filter("id % 20 = 0").withColumnRenamed("id", "qid"), unit, 10, scope)
    return rounded(found).select("qid", "id", "score", F.col("rank").cast("long"))


@query(f"with {EMBED}, {DENSE} select qid, id as doc_id, round(score, 6) as score, rank from dense")
def hashed_dense_topk(spark, d):
    found = search.hashed_dense(items(spark, d), docs(spark, d), 30)
    return rounded(found).select("qid", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long"))


@query(f"{HYBRID} select qid, id as doc_id, round(score, 6) as score, rank, source from fused")
def rrf(spark, d):
    found = search.stages(items(spark, d), docs(spark, d), search.corpus_index(spark, d))["fused"]
    return rounded(found).select("qid", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long"), "source")


@query(f"{HYBRID} select qid, id as doc_id, round(score, 6) as score, rank from reranked")
def rerank(spark, d):
    found = search.stages(items(spark, d), docs(spark, d), search.corpus_index(spark, d))["reranked"]
    return rounded(found).select("qid", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long"))


@query(f"{HYBRID} select qid, position, id as doc_id, round(score, 6) as score from selected")
def hybrid_search(spark, d):
    """The flagship: dense and sparse search, fusion, reranking and selection of evidence."""
    found = search.search(items(spark, d), docs(spark, d), search.corpus_index(spark, d))
    return rounded(found).select("qid", F.col("position").cast("long"), F.col("id").alias("doc_id"), "score")


@query(f"{HYBRID} select qid, 'dense' as stage, rank, id, round(score, 6) as score from dense union all select qid, 'bm25', rank, id, round(score, 6) from sparse union all select qid, 'fused', rank, id, round(score, 6) from fused union all select qid, 'reranked', rank, id, round(score, 6) from reranked union all select qid, 'selected', position, id, round(score, 6) from selected")
def search_trace(spark, d):
    s = search.stages(items(spark, d), docs(spark, d), search.corpus_index(spark, d))
    s["selected"] = s["selected"].drop("rank").withColumnRenamed("position", "rank")
    return rounded(retrieval.trace(**s)).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {POSTINGS}, {ASKED}, {_bm25_sql('found', None)}, p as (select f.*, d.source, row_number() over (partition by f.qid, d.source order by f.rank) as n from found f join documents d on d.doc_id = f.id) select qid, id as doc_id, rank from p where rank <= 5 or (n = 1 and source in ('src0', 'src1', 'src2'))")
def document_firsts(spark, d):
    """The first five hits and the first of each of three sources."""
    found = search.corpus_index(spark, d).search(items(spark, d), None)
    hits = found.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("document_id")), "id")
    balance = items(spark, d).select("qid", F.explode(F.array(*[F.lit(f"src{k}") for k in range(3)])).alias("document_id"))
    return retrieval.with_document_firsts(hits, 5, balance).select("qid", F.col("id").alias("doc_id"), F.col("rank").cast("long"))


@query(f"with {POSTINGS}, {ASKED}, {_bm25_sql('found', 30)} select qid, id as doc_id, case when m > 1 then 'duplicate_hash' end as reason, case when m > 1 then owner end as owner from (select f.*, row_number() over w as m, first_value(f.id) over w as owner from found f join documents d on d.doc_id = f.id window w as (partition by f.qid, sha256(d.text) order by f.rank))")
def repeats(spark, d):
    found = search.corpus_index(spark, d).search(items(spark, d), 30)
    hits = found.join(docs(spark, d).select("id", F.sha2("text", 256).alias("content_hash")), "id")
    return retrieval.without_repeats(hits).select("qid", F.col("id").alias("doc_id"), "reason", "owner")


@query(f"with {POSTINGS}, {ASKED}, {_bm25_sql('found', 30)}, k as (select f.*, d.source, row_number() over (partition by f.qid, d.source, sha256(d.text) order by f.rank) as m from found f join documents d on d.doc_id = f.id), l as (select *, (row_number() over (partition by qid, source order by rank) > 1)::int as late from k where m = 1), t as (select *, row_number() over (partition by qid order by late, rank) as fill from l) select qid, id as doc_id, row_number() over (partition by qid order by rank) as position from t where fill <= 8")
def balanced_selection(spark, d):
    found = search.corpus_index(spark, d).search(items(spark, d), 30)
    info = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"), F.col("source").alias("document_id"), F.lit("").alias("version_id"), F.lit("").alias("table_id"))
    out = retrieval.select_evidence(found.join(info, "id"), 8, items(spark, d))
    return out.select("qid", F.col("id").alias("doc_id"), F.col("position").cast("long"))


@query(f"with {POSTINGS}, {ASKED}, {_bm25_sql('found', 20)}, two as (select qid, 0 as search, id, rank from found where rank <= 10 union all select qid, 1, id, rank - 5 from found where rank > 5), f as (select qid, id, sum(1.0::double / (60 + rank)) as score, min(rank) as best, min(search) as first from two group by 1, 2), o as (select f.*, row_number() over (partition by qid order by round(score, 9) desc, best, first, lpad(id::varchar, 12, '0')) as place from f), h as (select o.*, row_number() over (partition by o.qid, sha256(d.text) order by place) as m from o join documents d on d.doc_id = o.id), n as (select *, row_number() over (partition by qid order by place) as rank from h where m = 1) select qid, id as doc_id, round(score, 6) as score, rank from n where rank <= 8")
def merged_searches(spark, d):
    """Two overlapping searches of each question, fused."""
    found = search.corpus_index(spark, d).search(items(spark, d), 20)
    both = found.filter("rank <= 10").withColumn("search", F.lit(0)).unionByName(found.filter("rank > 5").withColumn("rank", F.col("rank") - 5).withColumn("search", F.lit(1)))
    rows = both.join(docs(spark, d), "id").select("qid", "search", "rank", F.lpad(F.col("id").cast("string"), 12, "0").alias("chunk_id"), F.col("id").cast("string").alias("document_id"), F.lit(None).cast("string").alias("element_id"), F.col("text").alias("raw_content"), F.array().cast("array<string>").alias("cell_ids"))
    return rounded(context.merged(rows, 8)).select("qid", F.col("document_id").cast("long").alias("doc_id"), "score", F.col("rank").cast("long"))


# scopes


@query(f"with {STORE}, {MEMBERS} select 'all' as scope, count(*) as n from store where status = 'READY' union all select collection_id, count(*) from members join store using (document_id) where status = 'READY' group by 1")
def scopes(spark, d):
    s, m = store(spark, d), members(spark, d)
    every = retrieval.ready_scope(s).agg(F.count("*").alias("n")).select(F.lit("all").alias("scope"), "n")
    parts = [retrieval.ready_scope(s, members=m.filter(F.col("collection_id") == c)).agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(c).alias("scope"), "n") for c in ("quality", "toxic")]
    return every.unionByName(parts[0]).unionByName(parts[1])


@query(f"with {STORE}, {MEMBERS} select distinct document_id from members where document_id not in (select document_id from store where status = 'READY')")
def missing_documents(spark, d):
    return retrieval.missing_from_scope(store(spark, d), members(spark, d))


# context


LINES = "lines as (select doc_id as document_id, chunk_index, raw_content from (select doc_id, unnest(string_split(text, chr(10))) as raw_content, unnest(range(len(string_split(text, chr(10))))) as chunk_index from documents) where raw_content <> '')"
LINE_HITS = "hits as (select qid, document_id, chunk_index, raw_content, row_number() over (partition by qid order by document_id, chunk_index) as rank from (select i.item_id as qid, l.* from benchmark i join lines l on contains(l.raw_content, i.text)))"


def line_hits(spark, d):
    """Lines that hold a whole benchmark item, ranked by place. Candidates share a word window."""
    rows = lines(spark, d).withColumn("id", F.struct("document_id", "chunk_index")).withColumnRenamed("raw_content", "text")
    found = search.gold(items(spark, d), rows)
    hits = found.join(rows, "id").select("qid", "document_id", "chunk_index", F.col("text").alias("raw_content"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("document_id", "chunk_index")))


def chunk_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunk_id", F.concat_ws("/", "document_id", "chunk_index")).withColumn("section_path", F.array().cast("array<string>"))


NEIGHBOURS = "near as (select h.qid, h.document_id, h.chunk_index as owner_index, h.rank, l.chunk_index, l.raw_content, l.chunk_index - h.chunk_index as off from hits h join lines l on l.document_id = h.document_id and abs(l.chunk_index - h.chunk_index) = 1 where not exists (select 1 from hits x where x.qid = h.qid and x.document_id = l.document_id and x.chunk_index = l.chunk_index)), one as (select * from (select *, row_number() over (partition by qid, document_id, chunk_index order by rank, off) as n from near) where n = 1), every as (select qid, document_id, chunk_index, raw_content, rank, -1000000 as off, 'retrieved' as source from hits union all select qid, document_id, chunk_index, raw_content, rank, off, 'expanded' from one), placed as (select *, row_number() over (partition by qid order by rank, off) as position from every)"


@query(f"with {LINES}, {LINE_HITS}, {NEIGHBOURS} select qid, position, document_id, chunk_index::int as chunk_index, source from placed")
def neighbours(spark, d):
    out = context.with_neighbours(chunk_rows(line_hits(spark, d)), chunk_rows(lines(spark, d)))
    return out.select("qid", F.col("position").cast("long"), "document_id", "chunk_index", "source")


@query(f"with {LINES}, {LINE_HITS}, {NEIGHBOURS}, r as (select *, sum(case when source = 'expanded' and lag_doc = document_id then 0 else 1 end) over (partition by qid order by position) as run from (select *, lag(document_id) over (partition by qid order by position) as lag_doc from placed)), b as (select qid, run, string_agg(raw_content, chr(10) order by position) as content from r group by 1, 2), u as (select *, 4000 - coalesce(sum(length(content)) over (partition by qid order by run rows between unbounded preceding and 1 preceding), 0) as room from b) select qid, row_number() over (partition by qid order by run) as block, room < length(content) as truncated, case when room >= length(content) then length(content) end as whole_length from u where room > 0")
def packed_context(spark, d):
    """Blocks within 1000 tokens; the length of cut blocks is left to tests."""
    results = context.with_neighbours(chunk_rows(line_hits(spark, d)), chunk_rows(lines(spark, d)))
    out = context.packed(results, 1000)
    return out.select("qid", F.col("block").cast("long"), "truncated", F.when(~F.col("truncated"), F.length("content")).cast("long").alias("whole_length"))


# evaluation


@query(f"with {GOLD} select qid, id as doc_id from gold")
def gold_pairs(spark, d):
    return search.gold(items(spark, d), docs(spark, d)).select("qid", F.col("id").alias("doc_id"))


@query(f"with {POSTINGS}, {ASKED}, {_bm25_sql('found', 30)}, {GOLD}, {_scores_sql('found')} select qid, {ROUNDED} from scores")
def query_scores(spark, d):
    found = search.corpus_index(spark, d).search(items(spark, d), 30)
    return rounded(evaluation.per_query(found, search.gold(items(spark, d), docs(spark, d))))


@query(f"{HYBRID}, {GOLD}, " + ", ".join(_scores_sql(s, f"s_{s}") for s in ("dense", "sparse", "fused", "reranked")) + " " + " union all ".join(f"select '{n}' as stage, count(*) as n, {MEANS} from s_{s}" for n, s in (("dense", "dense"), ("bm25", "sparse"), ("fused", "fused"), ("reranked", "reranked"))))
def stage_ablation(spark, d):
    s = search.stages(items(spark, d), docs(spark, d), search.corpus_index(spark, d))
    names = ["dense", "bm25", "fused", "reranked"]
    trace = retrieval.trace(**{n: s[n] for n in names})
    return rounded(evaluation.stage_report(trace, search.gold(items(spark, d), docs(spark, d)), names))


@query(f"with {POSTINGS}, {ASKED}, {_bm25_sql('found', 30)}, {GOLD}, need as (select g.qid, g.id, f.rank from gold g left join found f using (qid, id)), each as (select qid, 0 as grp, case when count(rank) = count(*) then max(rank) end as last_rank from need group by 1) select qid, " + ", ".join(f"coalesce((last_rank <= {k})::int::double, 0) as group_recall_{k}" for k in (1, 3, 5, 10)) + ", round(coalesce(1.0 / last_rank, 0), 6) as group_mrr from each")
def group_scores(spark, d):
    """All documents of a question are one group."""
    found = search.corpus_index(spark, d).search(items(spark, d), 30)
    groups = search.gold(items(spark, d), docs(spark, d)).withColumn("grp", F.lit(0))
    return rounded(evaluation.group_scores(found, groups))


@query(f"with {POSTINGS}, {ASKED}, {_bm25_sql('found', 3)}, {GOLD}, j as (select f.qid as a, g.qid as b from found f full join gold g using (qid, id)) select round(count(*) filter (where a is not null and b is not null) / count(a)::double, 6) as citation_precision, round(count(*) filter (where a is not null and b is not null) / count(b)::double, 6) as citation_recall from j")
def citation_scores(spark, d):
    found = search.corpus_index(spark, d).search(items(spark, d), 3)
    return rounded(evaluation.citation_scores(found, search.gold(items(spark, d), docs(spark, d))))


@query(f"with {GOLD}, e as (select id, case when qid % 2 = 0 then 'dev' else 'test' end as split from gold) select id as key, string_agg(distinct split, ',' order by split) as splits from e group by 1 having count(distinct split) > 1")
def split_leakage(spark, d):
    e = search.gold(items(spark, d), docs(spark, d)).withColumn("split", F.when(F.col("qid") % 2 == 0, F.lit("dev")).otherwise(F.lit("test")))
    return evaluation.leakage(e, "id")


@query(f"with {POSTINGS}, {ASKED}, {_bm25_sql('found', 30)}, {GOLD}, {_scores_sql('found')}, m as (select 'recall@10' as metric, avg(recall_10) as value from scores union all select 'mrr', avg(mrr) from scores) select t.metric, round(value, 6) as value, threshold, coalesce(value >= threshold, false) as passed from (values ('recall@10', 0.85::double), ('mrr', 0.5::double), ('rejection', 0.8::double)) t(metric, threshold) left join m using (metric)")
def gates(spark, d):
    scores = evaluation.means(evaluation.per_query(search.corpus_index(spark, d).search(items(spark, d), 30), search.gold(items(spark, d), docs(spark, d))))
    metrics = scores.select(F.expr("stack(2, 'recall@10', recall_10, 'mrr', mrr) as (metric, value)"))
    return rounded(evaluation.gates(metrics, {"recall@10": 0.85, "mrr": 0.5, "rejection": 0.8}))


# lifecycle


@query(f"with {STORE} select document_id, status, created_at from store where status = 'READY' order by created_at desc, document_id desc limit 21")
def document_page(spark, d):
    """A page of 20 and the row that tells of more: paging is the feature."""
    return lifecycle.listed_documents(store(spark, d), 20, "READY").select("document_id", "status", "created_at")


@query(f"with {MEMBERS} select c.collection_id, count(m.document_id) as n_documents from (values ('quality'), ('toxic'), ('empty')) c(collection_id) left join members m using (collection_id) group by 1")
def collection_counts(spark, d):
    names = spark.createDataFrame([("quality",), ("toxic",), ("empty",)], "collection_id string")
    return lifecycle.collection_counts(names, members(spark, d))


@query(f"with {STORE} select file_sha256, document_id from (select *, row_number() over (partition by file_sha256 order by created_at desc, document_id desc) as n from store) where n = 1")
def documents_by_hash(spark, d):
    return lifecycle.documents_by_hash(store(spark, d))


@query("select user_id as document_id, event_id as job_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where event_type in ('click', 'view')) where n = 1")
def latest_events(spark, d):
    """The latest active job of each document, with users' clicks and views as jobs."""
    jobs = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type").isin("click", "view"), F.lit("running")).otherwise(F.lit("done")).alias("status"))
    return lifecycle.active_jobs(jobs)


@query("select event_id, user_id as job_id, max(least(greatest(floor(value)::int, 0), 100)) over (partition by user_id order by event_id) as shown from events")
def monotone_progress(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"), F.floor("value").cast("int").alias("progress"))
    return lifecycle.monotone_progress(e).select("event_id", "job_id", "shown")


@query("select user_id as job_id, max(floor(value)::int) as progress, arg_max(event_type, event_id) as stage, min(ts) as started_at from events group by 1")
def job_states(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"), F.floor("value").cast("int").alias("progress"), F.col("event_type").alias("stage"), "ts")
    return lifecycle.job_states(e).select("job_id", "progress", "stage", "started_at")


@query(f"with {STORE} select document_id, 'MISSING' as version_status from store where status = 'READY' and document_id not in (select doc_id from labels)")
def inconsistent_documents(spark, d):
    """Documents whose version, here a label row, is missing."""
    versions = table(spark, d, "labels").select(F.col("doc_id").alias("version_id"), F.lit("READY").alias("status")).distinct()
    return lifecycle.inconsistent_documents(store(spark, d).withColumn("active_version_id", F.col("document_id")), versions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


