"""Context of an answer: repeats, neighbours, packing, and fusion of several searches.

results: (qid, chunk_id, rank, document_id, section_path, chunk_index, raw_content,
content_hash, page_start), one row per result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions import text as T


def first_of(results: DataFrame, key: Column) -> DataFrame:
    """The best-ranked row for each value of a key, per query."""
    n = F.row_number().over(Window.partitionBy("qid", key).orderBy("rank"))
    return results.withColumn("_n", n).filter("_n = 1").drop("_n")


def without_repeats(results: DataFrame) -> DataFrame:
    """First by chunk, then by content hash (the text itself where there is none)."""
    return first_of(first_of(results, F.col("chunk_id")), F.coalesce(F.nullif("content_hash", F.lit("")), F.col("raw_content")))


def with_neighbours(results: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Adds the chunks within ``window`` places of a result in its document and section.

    They have score 0, source expanded and the result they come from; a chunk that several
    results reach goes to the best-ranked one. position orders results and what follows each.
    """
    # each result asks for the places around it, so that the join is by equal keys
    places = F.explode(F.array(*[F.lit(k) for k in range(-window, window + 1) if k]))
    around = results.withColumn("offset", places).withColumn("wanted", F.col("chunk_index") + F.col("offset"))
    near = around.alias("r").join(chunks.alias("n"), (F.col("r.document_id") == F.col("n.document_id")) & (F.col("r.wanted") == F.col("n.chunk_index")) & F.col("r.section_path").eqNullSafe(F.col("n.section_path")))
    found = near.select("r.qid", F.col("r.chunk_id").alias("owner"), "r.rank", "r.offset", *[F.col(f"n.{c}") for c in ("chunk_id", "document_id", "section_path", "chunk_index", "raw_content")])
    new = found.join(results.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    w = Window.partitionBy("qid", "chunk_id").orderBy("rank", "offset")
    new = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").withColumn("source", F.lit("expanded"))
    own = results.select("qid", F.lit(None).cast("string").alias("owner"), "rank", F.lit(None).cast("int").alias("offset"), "chunk_id", "document_id", "section_path", "chunk_index", "raw_content", F.lit("retrieved").alias("source"))
    both = own.unionByName(new.withColumn("owner", F.col("owner").cast("string")).withColumn("offset", F.col("offset").cast("int")))
    return both.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("rank", F.coalesce("offset", F.lit(-1_000_000)))))


def packed(results: DataFrame, budget_tokens: int = 4292, tokens_per_char: float = 0.25) -> DataFrame:
    """Source blocks within a budget of characters: (qid, block, chunk_id, content, truncated).

    results come with position and source (see with_neighbours). Expanded rows that follow a row
    of the same document and section join its block. The block that exceeds the budget is cut
    at a sentence end, and what comes after it is left out.
    """
    budget = int(budget_tokens / tokens_per_char)
    w = Window.partitionBy("qid").orderBy("position")
    same = F.lag("document_id").over(w).eqNullSafe(F.col("document_id")) & F.lag("section_path").over(w).eqNullSafe(F.col("section_path"))
    starts = ~(same & (F.col("source") == "expanded"))
    runs = results.withColumn("_run", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.array_sort(F.collect_list(F.struct("position", "raw_content", "chunk_id")))
    blocks = runs.groupBy("qid", "_run").agg(part.alias("parts"), F.first("document_id").alias("document_id"), F.first("section_path").alias("section_path"))
    blocks = blocks.select("qid", "_run", "document_id", "section_path", F.get("parts", 0)["chunk_id"].alias("chunk_id"), F.array_join(F.transform("parts", lambda p: p["raw_content"]), "\n").alias("content"))
    before = F.coalesce(F.sum(F.length("content")).over(Window.partitionBy("qid").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # once a block is cut the budget may have a rest, but blocks before it are whole
    blocks = blocks.withColumn("_left", F.lit(budget) - before).filter("_left > 0")
    cut = F.col("_left") < F.length("content")
    head = F.regexp_extract(F.expr("substring(content, 1, _left)"), "(?s)^.+[.!?。！？]", 0)
    short = F.when(head != "", head).otherwise(F.expr("substring(content, 1, _left)"))
    text = F.when(cut, F.regexp_replace(short, r"(?U)\s+$", "")).otherwise(F.col("content"))
    return blocks.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("_run")).alias("block"), "chunk_id", "document_id", "section_path", text.alias("content"), cut.alias("truncated"))


def source_text(block: Column, title: Column, path: Column, page: Column, chunk_id: Column, content: Column, truncated: Column) -> Column:
    """A block as a prompt shows it."""
    section = F.coalesce(F.nullif(F.array_join(path, " > "), F.lit("")), F.lit("Unknown"))
    lines = [F.concat(F.lit("[Source "), block.cast("string"), F.lit("]"))]
    lines += [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in (("Document", title), ("Section", section), ("Page", F.coalesce(page.cast("string"), F.lit("unknown"))), ("Chunk-ID", chunk_id))]
    return F.concat(F.concat_ws("\n", *lines, F.lit("Content:")), F.lit("\n"), content, F.when(truncated, F.lit(" [truncated]")).otherwise(F.lit("")))


def citation_maps(blocks: DataFrame) -> DataFrame:
    """(qid, citations): block numbers to chunk ids."""
    return blocks.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("block", "chunk_id")))).alias("citations"))


def excerpts(results: DataFrame, most: int = 6, chars: int = 600) -> DataFrame:
    """The beginnings of the best results, for a planner."""
    return results.filter(F.col("rank") <= most).select("qid", "rank", "chunk_id", F.substring("raw_content", 1, chars).alias("excerpt"))


def dedup_key(strategy: str) -> Column:
    digest = F.sha2("raw_content", 256)
    if strategy == "cell_coverage":
        return F.concat_ws("|", F.col("document_id").cast("string"), F.coalesce(F.col("element_id"), F.lit("")), digest)
    return digest


def merged(responses: DataFrame, top_k: int, strategy: str = "legacy", k: int = 60, preserve: DataFrame | None = None) -> DataFrame:
    """Several searches of one question fused by their ranks: (qid, chunk_id, score, rank).

    responses: (qid, search, chunk_id, rank, document_id, element_id, raw_content, cell_ids).
    Ties go by best rank, first search, id. Repeats are dropped; with cell_coverage also what
    cells already taken of the same table cover. With preserve (qid, document_id), each of its
    documents keeps its best row: rows that can go, from the end, make room.
    """
    if top_k < 1 or strategy not in ("legacy", "cell_coverage"):
        raise ValueError("top_k is positive and strategy legacy or cell_coverage")
    info = F.min_by(F.struct("document_id", "element_id", "raw_content", "cell_ids"), F.struct("search", "rank"))
    fused = responses.groupBy("qid", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"), F.min("search").alias("first_search"), info.alias("i"))
    order = [F.round("score", 9).desc(), F.col("best_rank"), F.col("first_search"), F.col("chunk_id")]
    rows = fused.select("qid", "chunk_id", "score", "best_rank", "first_search", "i.*").withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    rows = rows.withColumn("key", dedup_key(strategy))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "key").orderBy("place"))).filter("_n = 1")
    if strategy == "cell_coverage":
        rows = _uncovered(rows)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("place")))
    chosen = rows.withColumn("taken", F.col("n") <= top_k)
    if preserve is not None:
        chosen = _preserving(chosen, preserve, top_k)
    return chosen.filter("taken").select("qid", "chunk_id", "document_id", "score", F.row_number().over(Window.partitionBy("qid").orderBy("place")).cast("int").alias("rank"))


def _uncovered(rows: DataFrame) -> DataFrame:
    """Drops rows whose table cells earlier kept rows hold. A fold, as it depends on what was kept."""
    item = F.struct("place", "chunk_id", "document_id", "element_id", "cell_ids")
    kind = rows.select(F.array(item).alias("x")).schema["x"].dataType
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("cells"))

    def step(s: Column, r: Column) -> Column:
        cells = F.transform(F.coalesce(r["cell_ids"], F.array().cast("array<string>")), lambda c: F.concat_ws("/", r["document_id"].cast("string"), r["element_id"], c))
        gone = r["element_id"].isNotNull() & (F.size(cells) > 0) & (F.size(F.array_except(cells, s["cells"])) == 0)
        return F.when(gone, s).otherwise(F.struct(F.concat(s["kept"], F.array(r["chunk_id"])).alias("kept"), F.when(r["element_id"].isNotNull(), F.concat(s["cells"], cells)).otherwise(s["cells"]).alias("cells")))

    kept = lists.select("qid", F.explode(F.aggregate(F.col("xs").cast(kind), start, step, lambda s: s["kept"])).alias("chunk_id"))
    return rows.join(kept, ["qid", "chunk_id"], "left_semi")


def _preserving(rows: DataFrame, preserve: DataFrame, top_k: int) -> DataFrame:
    """Rows that may go are, from the end, those of other documents and those that aren't their document's first.

    As many go as documents of preserve have no row among the first top_k.
    """
    wanted = preserve.select("qid", "document_id").distinct()
    enough = wanted.groupBy("qid").agg(F.count("*").alias("n_wanted"))
    own = Window.partitionBy("qid", "document_id").orderBy("n")
    out = rows.join(wanted.withColumn("wanted", F.lit(True)), ["qid", "document_id"], "left").join(enough, "qid", "left")
    active = F.coalesce(F.col("n_wanted") <= top_k, F.lit(False))
    first = F.row_number().over(own) == 1
    out = out.withColumn("_must", active & F.coalesce("wanted", F.lit(False)) & first)
    missing = F.sum((F.col("_must") & ~F.col("taken")).cast("int")).over(Window.partitionBy("qid"))
    spare = F.row_number().over(Window.partitionBy("qid", F.col("taken") & ~F.col("_must")).orderBy(F.col("n").desc()))
    out = out.withColumn("_missing", missing).withColumn("_spare", spare)
    free = F.sum((F.col("taken") & ~F.col("_must")).cast("int")).over(Window.partitionBy("qid"))
    late = F.row_number().over(Window.partitionBy("qid", F.col("_must") & ~F.col("taken")).orderBy("n"))
    out = out.withColumn("_free", free).withColumn("_late", late)
    enters = F.col("_must") & ~F.col("taken") & (F.col("_late") <= F.col("_free"))
    leaves = F.col("taken") & ~F.col("_must") & (F.col("_spare") <= F.col("_missing"))
    return out.withColumn("taken", (F.col("taken") & ~leaves) | enters)


def routing_documents(documents: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Ready documents that a router may choose from, by id, with a title or else a file name."""
    ready = documents.filter(F.col("status") == "READY")
    if scope is not None:
        ready = ready.join(scope.select("document_id"), "document_id", "left_semi")
    return ready.select("document_id", F.coalesce(F.nullif("title", F.lit("")), F.col("filename")).alias("title")).orderBy("document_id")


def route_problems(plans: DataFrame, documents: DataFrame, max_routes: int = 6, least: float = 0.5) -> DataFrame:
    """Why routing plans (qid, confidence, routes array<string>) are refused: (qid, code)."""
    n = F.size("routes")
    foreign = plans.select("qid", F.explode("routes").alias("document_id")).join(documents.select("document_id"), "document_id", "left_anti").select("qid").distinct().withColumn("foreign", F.lit(True))
    code = F.when((n < 1) | (n > max_routes), F.lit("TOO_MANY_ROUTES")).when(n != F.size(F.array_distinct("routes")), F.lit("ROUTES_REPEAT")).when(F.col("foreign"), F.lit("FOREIGN_DOCUMENT")).when(F.col("confidence") < least, F.lit("LOW_CONFIDENCE"))
    return plans.join(foreign, "qid", "left").select("qid", code.alias("code")).filter("code is not null")


def refinement_problems(plans: DataFrame) -> DataFrame:
    """A plan (qid, sufficient, subquery) is sufficient exactly if it has no further query."""
    query = F.nullif(F.trim(F.regexp_replace(F.coalesce("subquery", F.lit("")), r"(?U)\s+", " ")), F.lit(""))
    return plans.filter(F.col("sufficient") == query.isNotNull()).select("qid", F.lit("EVIDENCE_PLAN_FAILED").alias("code"))


def gather(queries: DataFrame, search, mode: str, plans: DataFrame | None = None, top_k: int = 8, strategy: str = "legacy", refinements: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """Evidence of a batch of questions: one search, one more with a plan's query, or one more for each planned route.

    search: (queries (qid, text), scope (qid, document_id) or None) -> responses without the
    search number. plans: (qid, subquery), or routes (qid, confidence, subquery, document_id).
    A route is a search of its own in its document alone, under the qid struct (qid, route), so
    terms and documents of different routes never mix; searches are numbered 1, 2, ... by document
    and query. Questions with less than ``least`` confidence get the one search of their
    refinement (qid, subquery) instead, if there is one. Documents of routes keep their best row.
    """
    first = search(queries, None).withColumn("search", F.lit(0))
    if mode == "single_pass" or plans is None:
        return merged(first, top_k, strategy)
    if mode not in ("bounded_refinement", "routed_multi_search"):
        raise ValueError(f"unknown mode {mode}")
    asked = plans.filter("subquery is not null and trim(subquery) <> ''")
    if mode == "bounded_refinement":
        return merged(first.unionByName(_refined(asked, search)), top_k, strategy)
    sure = asked.filter(F.col("confidence") >= least)
    route = F.row_number().over(Window.partitionBy("qid").orderBy("document_id", "subquery"))
    routes = sure.select(F.struct("qid", route.alias("search")).alias("qid"), F.col("subquery").alias("text"), "document_id")
    more = search(routes.select("qid", "text"), routes.select("qid", "document_id"))
    more = more.withColumns({"search": F.col("qid.search"), "qid": F.col("qid.qid")})
    responses = first.unionByName(more)
    if refinements is not None:
        unsure = refinements.join(plans.filter(F.col("confidence") < least).select("qid"), "qid", "left_semi")
        responses = responses.unionByName(_refined(unsure.filter("subquery is not null and trim(subquery) <> ''"), search))
    return merged(responses, top_k, strategy, preserve=sure.select("qid", "document_id"))


def _refined(asked: DataFrame, search) -> DataFrame:
    return search(asked.select("qid", F.col("subquery").alias("text")).distinct(), None).withColumn("search", F.lit(1))


# conversations


def sessions_text(messages: DataFrame, last: int) -> DataFrame:
    """(conv_id, history): the last messages of each conversation as role: text lines, in order."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last)
    line = F.concat_ws(": ", "role", "text")
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


def user_queries(messages: DataFrame) -> DataFrame:
    """(conv_id, query): the user's turns, one per line."""
    own = messages.filter(F.col("role") == "user")
    return own.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("query"))


def rewritten(queries: DataFrame, history: DataFrame, model=None, strategy: str = "preserve") -> DataFrame:
    """(qid, text, rewritten, degraded_reasons). Without history, and with no need of English, a query stays.

    model: a function Column, Column -> Column (a pandas UDF that may return null on failure).
    """
    both = queries.join(history.select(F.col("conv_id").alias("qid"), "history"), "qid", "left")
    need = F.col("history").isNotNull() | T.needs_english(F.col("text"), strategy)
    made = model(F.col("text"), F.coalesce("history", F.lit(""))) if model else F.lit(None).cast("string")
    new = F.when(need, made).otherwise(F.col("text"))
    return both.select("qid", "text", F.coalesce(new, F.col("text")).alias("rewritten"), F.when(new.isNull(), F.array(F.lit("REWRITE_FAILED"))).otherwise(F.array().cast("array<string>")).alias("degraded_reasons"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)
