"""Evaluation as aggregations. ranked: (qid, id, rank); relevant: (qid, id); groups: (qid, grp, id).

Every mean is over all questions, so a question without a hit counts 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions import text as T
from siftspark.operators.evidence import page_overlaps, preferring, resolve_evidence, section_matches, token_coverage

RECALL_AT, NDCG_AT = (1, 3, 5, 10), (5, 10)
THRESHOLDS = {"recall@10": 0.85, "citation_precision": 0.95, "citation_recall": 0.85, "rejection": 0.80}


def ideal_dcg(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))


def per_query(ranked: DataFrame, relevant: DataFrame, queries: DataFrame | None = None, recall_at=RECALL_AT, ndcg_at=NDCG_AT) -> DataFrame:
    """Recall, MRR and nDCG of each question with relevant ids (of all of queries, if given)."""
    gold = relevant.select("qid", "id").distinct()
    hits = ranked.join(gold, ["qid", "id"], "left_semi")
    counts = [F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in recall_at]
    gains = [F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))).alias(f"g{k}") for k in ndcg_at]
    found = hits.groupBy("qid").agg(F.min("rank").alias("first"), *counts, *gains)
    sizes = gold.groupBy("qid").agg(F.count("*").alias("n"))
    out = (queries.select("qid").distinct().join(sizes, "qid", "left") if queries is not None else sizes).join(found, "qid", "left")
    n = F.coalesce("n", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("qid", *[zero(F.when(n > 0, F.col(f"h{k}") / n)).alias(f"recall_{k}") for k in recall_at], zero(1 / F.col("first")).alias("mrr"), *[zero(F.when(n > 0, F.col(f"g{k}") / ideal_dcg(F.least(n, F.lit(k))))).alias(f"ndcg_{k}") for k in ndcg_at])


def means(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    names = [c for c, t in scores.dtypes if t == "double"]
    return scores.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names])


def retrieval_report(ranked: DataFrame, relevant: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    return means(per_query(ranked, relevant, queries))


def stage_report(trace: DataFrame, relevant: DataFrame, stages: list[str]) -> DataFrame:
    """Means for each stage of a trace (qid, stage, rank, id), by one aggregation: the ablation. A stage without a hit has zeros."""
    names = trace.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    gold = relevant.select("qid", "id").distinct().join(F.broadcast(names)).select(F.struct("stage", "qid").alias("qid"), "id")
    scores = per_query(trace.select(F.struct("stage", "qid").alias("qid"), "id", "rank"), gold)
    return means(scores.withColumn("stage", F.col("qid.stage")).drop("qid"), ["stage"])


def ablation(runs: DataFrame, relevant: DataFrame, cited: DataFrame | None = None, required: DataFrame | None = None) -> DataFrame:
    """Means for each config of runs (config, qid, id, rank, latency_ms), with pooled citation precision and recall."""
    base = runs.select("config", "qid").distinct()
    gold = base.join(relevant, "qid").select(F.struct("config", "qid").alias("qid"), "id")
    scores = per_query(runs.select(F.struct("config", "qid").alias("qid"), "id", "rank"), gold).withColumn("config", F.col("qid.config"))
    out = means(scores.drop("qid"), ["config"])
    times = runs.select("config", "qid", "latency_ms").distinct().groupBy("config").agg(F.avg("latency_ms").alias("latency_ms"))
    out = out.join(times, "config", "left")
    return out.join(citation_scores(cited, base.join(required, "qid"), ["config"]), "config", "left") if cited is not None else out


def candidate_recall(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Recall of a whole candidate pool, recall and MRR within ten: (qid, recall_10, mrr_10, pool_recall)."""
    gold = relevant.select("qid", "id").distinct()
    sizes = gold.groupBy("qid").agg(F.count("*").alias("n"))
    hits = ranked.join(gold, ["qid", "id"], "left_semi").groupBy("qid").agg(F.count_if(F.col("rank") <= 10).alias("h"), F.count("*").alias("all"), F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sizes.join(hits, "qid", "left").select("qid", zero(F.col("h") / F.col("n")).alias("recall_10"), zero(1 / F.col("first")).alias("mrr_10"), zero(F.col("all") / F.col("n")).alias("pool_recall"))


def citation_scores(cited: DataFrame, required: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro precision and recall of distinct citations (qid, id); (1, 1) if there are none at all."""
    by = by or []
    key = [*by, "qid", "id"]
    both = cited.select(key).distinct().withColumn("c", F.lit(1)).join(required.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    n = both.groupBy(*by).agg(F.count("c").alias("c"), F.count("r").alias("r"), F.count_if(F.col("c").isNotNull() & F.col("r").isNotNull()).alias("h"))
    none = (F.col("c") == 0) & (F.col("r") == 0)
    rate = lambda d: F.when(none, F.lit(1.0)).otherwise(F.coalesce(F.col("h") / F.nullif(F.col(d), F.lit(0)), F.lit(0.0)))
    return n.select(*by, rate("c").alias("citation_precision"), rate("r").alias("citation_recall"))


# groups: units of evidence that need all their chunks


def groups_of(items: DataFrame) -> DataFrame:
    """(qid, grp, id) of items (qid, groups array<struct<status, ids>>, relevant array): resolved groups, else one per label."""
    given = items.filter("groups is not null").select("qid", F.posexplode("groups").alias("grp", "g")).filter(F.col("g.status").isin("resolved", "multi_chunk")).select("qid", "grp", F.explode("g.ids").alias("id"))
    plain = items.filter("groups is null").select("qid", F.posexplode("relevant").alias("grp", "id"))
    return given.unionByName(plain)


def group_scores(ranked: DataFrame, groups: DataFrame, recall_at=RECALL_AT) -> DataFrame:
    """Group recall and MRR per question: a group is hit where its last chunk stands; one that lacks a chunk never."""
    need = groups.select("qid", "grp", "id").distinct().join(ranked.select("qid", "id", "rank"), ["qid", "id"], "left")
    each = need.groupBy("qid", "grp").agg(F.when(F.count("rank") == F.count("*"), F.max("rank")).alias("at"))
    return each.groupBy("qid").agg(*[F.avg(F.coalesce((F.col("at") <= k).cast("double"), F.lit(0.0))).alias(f"group_recall_{k}") for k in recall_at], F.coalesce(1 / F.min("at"), F.lit(0.0)).alias("group_mrr"))


def gold_report(ranked: DataFrame, groups: DataFrame, cited: DataFrame) -> DataFrame:
    """One row: macro group metrics and nDCG, micro citation precision (by chunk) and recall (by group)."""
    chunks = groups.select("qid", "id").distinct()
    ndcg = per_query(ranked, chunks).select("qid", *[f"ndcg_{k}" for k in NDCG_AT])
    macro = means(group_scores(ranked, groups).join(ndcg, "qid"))
    own = cited.join(groups.select("qid").distinct(), "qid", "left_semi").select("qid", "id").distinct()
    hit = own.join(chunks, ["qid", "id"], "left_semi").agg(F.count("*").alias("h")).join(own.agg(F.count("*").alias("c")))
    whole = groups.select("qid", "grp", "id").distinct().join(own.withColumn("ok", F.lit(1)), ["qid", "id"], "left").groupBy("qid", "grp").agg((F.count("ok") == F.count("*")).alias("all"))
    recall = whole.agg(F.coalesce(F.avg(F.col("all").cast("double")), F.lit(0.0)).alias("citation_recall"))
    return macro.join(hit.select(F.coalesce(F.col("h") / F.nullif("c", F.lit(0)), F.lit(0.0)).alias("citation_precision"))).join(recall)


def prediction_problems(questions: DataFrame, predictions: DataFrame, groups: DataFrame) -> DataFrame:
    """Ids on one side only, repeated ids, and answerable questions without evidence: (qid, code)."""
    q, p = questions.select("qid"), predictions.select("qid")
    parts = [(q.join(p, "qid", "left_anti"), "PREDICTION_MISSING"), (p.join(q, "qid", "left_anti"), "QUESTION_UNKNOWN"), (p.groupBy("qid").count().filter("count > 1").select("qid"), "PREDICTION_DUPLICATE"), (questions.filter("answerable").select("qid").join(groups.select("qid"), "qid", "left_anti"), "EVIDENCE_MISSING")]
    return reduce(DataFrame.unionByName, [d.select("qid", F.lit(code).alias("code")) for d, code in parts])


def unmapped(trace: DataFrame, mapping: DataFrame, k: int = 10) -> DataFrame:
    """Stage rows within the first k whose id has no chunk."""
    return trace.filter(F.col("rank") <= k).join(mapping.select("id"), "id", "left_anti")


# runs, gates, datasets


def run_summary(rows: DataFrame) -> DataFrame:
    """Means, call counts and rates of a run: rows (variant, recall_10, mrr_10, searches, refined, rejected, latency_ms)."""
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.avg("recall_10").alias("recall_10"), F.avg("mrr_10").alias("mrr_10"), F.avg("searches").alias("searches"), F.sum("searches").alias("calls"), F.avg(F.col("refined").cast("double")).alias("refined_rate"), F.avg(F.col("rejected").cast("double")).alias("rejected_rate"), F.avg("latency_ms").alias("latency_ms"))


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.select("variant", F.explode("reasons").alias("reason")).groupBy("variant", "reason").agg(F.count("*").alias("n"))


def by_type(scores: DataFrame) -> DataFrame:
    """Mean recall by variant and question type, with subtotals."""
    return scores.rollup("variant", "question_type").agg(F.count("*").alias("n"), F.avg("recall_10").alias("recall_10"))


def with_variants(queries: DataFrame, variants: dict[str, tuple[int, str]]) -> DataFrame:
    """Every query under every variant (name: pool size, policy): a handful of rows each, so no join."""
    rows = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(k).alias("pool"), F.lit(p).alias("policy")) for n, (k, p) in variants.items()])
    return queries.select("*", F.inline(rows))


def gates(metrics: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(metric, value, threshold, passed) of metrics (metric, value); a metric that is missing fails."""
    spark = metrics.sparkSession
    wanted = spark.createDataFrame(list((thresholds or THRESHOLDS).items()), "metric string, threshold double")
    return wanted.join(metrics, "metric", "left").select("metric", "value", "threshold", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)).alias("passed"))


def release_metrics(predictions: DataFrame, scores: DataFrame) -> DataFrame:
    """Rejection rate of unanswerable questions, recall by split, mean latency and errors, in long form."""
    p = predictions.agg(F.avg(F.when(~F.col("answerable"), F.col("rejected").cast("double"))).alias("rejection"), F.avg("latency_ms").alias("latency_ms"), F.count_if(F.col("error").isNotNull()).cast("double").alias("errors"))
    one = p.select(F.expr("stack(3, 'rejection', rejection, 'latency_ms', latency_ms, 'errors', errors) as (metric, value)"))
    split = scores.groupBy("split").agg(F.avg("recall_10").alias("value")).select(F.concat(F.lit("recall@10/"), "split").alias("metric"), "value")
    return one.unionByName(split).unionByName(scores.agg(F.avg("recall_10").alias("value")).select(F.lit("recall@10").alias("metric"), "value"))


def predictions_of(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per question: its answer, or an error category where there is none."""
    return questions.join(answers, "qid", "left").withColumn("error", F.when(F.col("answer").isNull(), F.coalesce("error", F.lit("MISSING")))).withColumn("rejected", F.coalesce(T.is_rejection(F.col("answer"), F.coalesce("citations", F.array().cast("array<string>"))), F.lit(False)))


def dataset_problems(questions: DataFrame, expected: int, answerable: int, snapshot: str) -> DataFrame:
    """(code, n): wrong counts, repeated ids, unlabelled answerable questions, foreign snapshots."""
    n = questions.agg(F.count("*").alias("n"), F.count_if("answerable").alias("a"), F.count_distinct("qid").alias("d"), F.count_if(F.col("answerable") & (F.size("relevant") <= 0)).alias("u"), F.count_if(F.col("snapshot_id") != snapshot).alias("s"))
    rows = F.array(*[F.struct(F.lit(c).alias("code"), v.cast("long").alias("n")) for c, v in (("COUNT", F.abs(F.col("n") - expected)), ("ANSWERABLE_COUNT", F.abs(F.col("a") - answerable)), ("DUPLICATE_ID", F.col("n") - F.col("d")), ("LABEL_MISSING", F.col("u")), ("SNAPSHOT_MISMATCH", F.col("s")))])
    return n.select(F.inline(rows)).filter("n > 0")


def leakage(evidence: DataFrame, key: str) -> DataFrame:
    """Values of a key (an anchor, page or chunk) that stand in more than one split: (key, splits)."""
    return evidence.groupBy(F.col(key).alias("key")).agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count_distinct("split").alias("n")).filter("n > 1").select("key", "splits")


def split_audit(evidence: DataFrame, keys: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [leakage(evidence, k).withColumn("kind", F.lit(k)) for k in keys])


def question_digest() -> Column:
    """SHA-256 of a question's id, text, answer and points, as canonical JSON."""
    return F.sha2(F.to_json(F.struct(F.col("answer"), F.col("qid").alias("id"), F.col("points"), F.col("question"))), 256)


def question_status(evidence: DataFrame) -> DataFrame:
    """The worst status of each question's anchors."""
    worst = ("parser_issue", "unresolved", "manual_review", "multi_chunk", "resolved")
    place = F.array_position(F.array(*[F.lit(s) for s in worst]), F.col("status"))
    return evidence.groupBy("qid").agg(F.min_by("status", place).alias("status"))


def markdown_report(rows: DataFrame, columns: list[str]) -> str:
    """A small table (one row per metric, stage or split) as Markdown."""
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join(["---"] * len(columns)) + " |"]
    for r in rows.select(columns).toLocalIterator():
        lines.append("| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines)


# evidence bound again


def rebound(decisions: DataFrame, anchors: DataFrame, chunks: DataFrame, snapshot: str) -> DataFrame:
    """Review decisions (anchor_id, content_hash, page, quote_hash, snapshot_id) bound to chunks again.

    A decision holds if its snapshot, page and quote are still those, and its content hash names exactly one chunk.
    """
    same = decisions.join(anchors.select("anchor_id", "document_key", F.col("page").alias("a_page"), T.quote_hash(F.col("quote")).alias("a_hash")), "anchor_id").filter((F.col("snapshot_id") == snapshot) & (F.col("page") == F.col("a_page")) & (F.col("quote_hash") == F.col("a_hash")))
    found = same.join(chunks.select("document_key", "content_hash", "chunk_id"), ["document_key", "content_hash"]).groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id"))
    return decisions.select("anchor_id").join(found, "anchor_id", "left").select("anchor_id", F.when(F.col("n") == 1, F.col("chunk_id")).alias("chunk_id"), F.when(F.col("n").isNull(), F.lit("PIN_MISMATCH")).when(F.col("n") > 1, F.lit("AMBIGUOUS")).alias("problem"))


def repaired_labels(questions: DataFrame, anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions with statuses, relevant chunks and whether their texts' digest is unchanged: (qid, status, relevant, unchanged)."""
    found = resolve_evidence(anchors, chunks).join(anchors.select("anchor_id", "qid"), "anchor_id")
    labels = found.groupBy("qid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("relevant"))
    return questions.join(question_status(found), "qid", "left").join(labels, "qid", "left").select("qid", "status", F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"), (question_digest() == F.col("digest")).alias("unchanged"))


# parser quality


def page_texts(elements: DataFrame, joint: str = " ") -> DataFrame:
    """(document_id, page, text): the normalised texts of a page's elements in reading order."""
    rows = elements.select("document_id", "reading_order", "normalized_text", F.explode("provenance").alias("p")).select("document_id", F.col("p.page").alias("page"), "reading_order", "normalized_text").distinct()
    return rows.groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "normalized_text"))), lambda x: x["normalized_text"]), joint).alias("text"))


def orphan_numbers(texts: DataFrame, reach: int = 30) -> DataFrame:
    """(id, n): numbers with no word of two letters within ``reach`` characters."""
    marked = F.regexp_replace(F.col("text"), r"(?<![\w.])([0-9]+(?:\.[0-9]+)?)(?![\w])", "\u0001$1\u0001")
    parts = texts.select("id", F.split(marked, "\u0001").alias("p"))
    label = lambda s: s.rlike(r"(?U)\p{L}{2,}")
    lone = lambda k: ~label(F.coalesce(F.right(F.get("p", k - 1), F.lit(reach)), F.lit(""))) & ~label(F.coalesce(F.substring(F.get("p", k + 1), 1, reach), F.lit("")))
    odd = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda k: (k % 2 == 1) & lone(k))
    return parts.select("id", F.size(odd).cast("long").alias("n"))


def order_confidence(paragraphs_per_page: DataFrame) -> DataFrame:
    """(document_id, confidence) of pages (document_id, n, ordered): 1.0, or 0.7 out of order, less 0.1 for each page with more than two paragraphs out of order."""
    return paragraphs_per_page.groupBy("document_id").agg(F.greatest(F.lit(0.0), F.when(F.bool_and("ordered"), F.lit(1.0)).otherwise(F.lit(0.7)) - 0.1 * F.count_if(~F.col("ordered") & (F.col("n") > 2))).alias("confidence"))


def anchor_check(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(case_id, found, wanted): how many expected anchors a case's text holds, in any case of letters."""
    # some letters agree in one case only: ß has no capital of its own, and its pair SS is no ß when lowered
    held = F.contains(F.lower("text"), F.lower(F.col("anchor"))) | F.contains(F.upper("text"), F.upper(F.col("anchor")))
    return anchors.join(texts, "case_id", "left").groupBy("case_id").agg(F.count_if(held).alias("found"), F.count("*").alias("wanted"))


def header_binding(bound: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, ok): null where nothing is expected, else whether every expected header path is bound."""
    hit = expected.join(bound.withColumn("have", F.lit(True)), ["case_id", "cell", "path"], "left")
    return hit.groupBy("case_id").agg(F.when(F.count("path") > 0, F.bool_and(F.coalesce("have", F.lit(False)))).alias("ok"))


def hard_cases(cases: DataFrame, measured: DataFrame) -> DataFrame:
    """Every check of each hard case: (case_id, passed, error), the first failing check naming the error."""
    both = cases.join(measured, "case_id", "left")
    error = (
        F.when(F.col("pages").isNull(), F.lit("NOT_PARSED"))
        .when(F.col("pages") != F.coalesce("expected_pages", "pages"), F.lit("PAGE_COUNT"))
        .when(F.col("tables") < F.coalesce("expected_tables", F.lit(0)), F.lit("TABLE_COUNT"))
        .when(F.col("anchors_found") < F.col("anchors_wanted"), F.lit("ANCHOR_MISSING"))
        .when(F.col("header_ok") == False, F.lit("HEADER_BINDING"))  # noqa: E712
        .when(F.col("replacements") > F.coalesce("max_replacements", F.lit(0)), F.lit("BROKEN_UNICODE"))
    )
    return both.select("case_id", error.isNull().alias("passed"), error.alias("error"))


def parser_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """(document_id, verdict) of two parsers' statistics (document_id, chars, tables, anchors, failures): b challenges a."""
    both = a.alias("a").join(b.alias("b"), "document_id", "full")
    verdict = F.when(F.col("b.failures") > F.coalesce("a.failures", F.lit(0)), F.lit("worse")).when(F.col("b.anchors") > F.col("a.anchors"), F.lit("better")).when(F.col("b.anchors") < F.col("a.anchors"), F.lit("worse")).when((F.col("b.tables") > F.col("a.tables")) & (F.col("b.chars") >= F.col("a.chars")), F.lit("better")).otherwise(F.lit("equal"))
    return both.select("document_id", F.when(F.col("a.chars").isNull() | F.col("b.chars").isNull(), F.lit("missing")).otherwise(verdict).alias("verdict"), F.coalesce(F.col("b.chars") / F.nullif(F.col("a.chars"), F.lit(0)), F.lit(0.0)).alias("char_ratio"))
