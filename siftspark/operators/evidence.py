"""Where quotes stand in chunks: candidates by equi-joins on rare words, then the exact ways.

A quote that a chunk's text holds brings all its inner words along, those that neither begin nor
end it: the rarest of them in the document names the chunks to look at. A quote that runs over
neighbouring chunks has that word in one of them. A chunk with a share of the quote's words
lacks some of them at most, so it has one of that many rarest and one more. Quotes of
one or two words have no inner one and meet the chunks whose page range holds their page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark import shared
from siftspark.functions import text as T
from siftspark.operators import intervals


def page_overlaps(start: Column, end: Column, page: Column) -> Column:
    """A page is in a range; one open end takes the other's value, and no range holds every page."""
    lo, hi = F.coalesce(start, end), F.coalesce(end, start)
    return lo.isNull() | page.between(lo, hi)


def section_matches(actual: Column, expected: Column) -> Column:
    """Every expected section equals, holds or is held by an actual one; both are normalised already."""
    some = F.filter(actual, lambda a: a != "")
    return (F.size(expected) == 0) | ((F.size(some) > 0) & F.forall(expected, lambda e: F.exists(some, lambda a: (a == e) | F.contains(a, e) | F.contains(e, a))))


def preferring(rows: DataFrame, flag: Column, by: list[str]) -> DataFrame:
    """Rows with a flag where a group has any, else all of the group."""
    marked = rows.withColumn("_f", F.coalesce(flag, F.lit(False)))
    return marked.withColumn("_any", F.max("_f").over(Window.partitionBy(*by))).filter(F.col("_f") | ~F.col("_any")).drop("_f", "_any")


def token_coverage(quote: Column, text: Column) -> Column:
    q = T.evidence_tokens(quote)
    return F.coalesce(F.size(F.array_intersect(q, T.evidence_tokens(text))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def _runs(aligned: Column) -> Column:
    """Letters and digits between other characters of an aligned text."""
    return F.regexp_extract_all(aligned, F.lit(r"(?U)[^\W_]+"), F.lit(0))


def _rarest(asked: DataFrame, held: DataFrame, most: Column) -> DataFrame:
    """(anchor_id, document_key, token) of the rarest ``most`` tokens of each anchor (anchor_id, document_key, tokens).

    held: (document_key, chunk_id, token), counted by chunk so that what brings its rows here also brings them to the join. A token that no chunk of the document has counts as rarest: it names none.
    """
    wanted = asked.select("anchor_id", "document_key", most.alias("most"), F.explode("tokens").alias("token"))
    counts = held.join(wanted.select("document_key", "token").distinct(), ["document_key", "token"], "left_semi").groupBy("document_key", "token").agg(F.count("chunk_id").alias("df"))
    ranked = wanted.join(counts, ["document_key", "token"], "left").withColumn("n", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.coalesce("df", F.lit(0)), "token")))
    return ranked.filter("n <= most").select("anchor_id", "document_key", "token")


#: Chunks that a page has at most where all of them meet its quotes, without a look at rare words.
PAGE_CHUNKS = 64


def asked_pages(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_key, chunk_id, on_page): the chunks on each page of an anchor of their document; those that have no page once, with null."""
    lo, hi = F.coalesce("page_start", "page_end"), F.coalesce("page_end", "page_start")
    ranged = chunks.select("document_key", "chunk_id", lo.alias("lo"), hi.alias("hi"))
    asked = anchors.select("document_key", "page", F.col("page").alias("to")).distinct()
    met = intervals.overlapping(asked, ranged.filter("lo is not null"), ["document_key"], ("page", "to"), ("lo", "hi")).select("document_key", "chunk_id", F.col("page").alias("on_page"))
    everywhere = ranged.filter("lo is null").join(asked.select("document_key"), "document_key", "left_semi").select("document_key", "chunk_id", F.lit(None).cast(met.schema["on_page"].dataType).alias("on_page"))
    return met.unionByName(everywhere)


def _between(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that aren't wholly before the first or after the last page of all anchors: two numbers, so none of the others is dealt out."""
    low, high = anchors.agg(F.min("page"), F.max("page")).first()
    lo, hi = F.coalesce("page_start", "page_end"), F.coalesce("page_end", "page_start")
    return chunks.filter(lo.isNull() if low is None else lo.isNull() | ((lo <= high) & (hi >= low)))


def on_asked_pages(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks whose page range holds the page of an anchor of their document, or that have none: no others can meet one."""
    return chunks.join(asked_pages(anchors, chunks), ["document_key", "chunk_id"], "left_semi")


def _met(a: DataFrame, c: DataFrame, fuzzy: float, widest: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of anchors and chunks to look at, and what is stored for them.

    Anchors whose page has few chunks meet them all, by document and page; those on crowded pages meet the ones that ``candidates`` names.
    """
    crowd = c.groupBy("document_key", "on_page").agg(F.count("*").alias("n"))
    loose = crowd.filter("on_page is null").select("document_key", F.col("n").alias("loose"))
    some = bool(loose.head(1))
    pages = crowd.filter("on_page is not null")
    n = F.col("n") + F.coalesce("loose", F.lit(0)) if some else F.col("n")
    crowded = shared.stored((pages.join(loose, "document_key", "left") if some else pages).filter(n > PAGE_CHUNKS).select("document_key", F.col("on_page").alias("page")), "crowded")
    if some:
        # anchors without a page, or on one that no chunk has, meet the chunks without one alone
        bare = loose.filter(F.col("loose") > PAGE_CHUNKS).select("document_key")
        at = a.join(pages.select("document_key", F.col("on_page").alias("page")), ["document_key", "page"], "left_anti").join(bare, "document_key", "left_semi").select("document_key", "page").distinct()
        crowded = shared.stored(crowded.unionByName(at), "crowded")
    full = crowded.select(F.col("document_key").alias("_key"), F.col("page").alias("_page"))
    same = (F.col("document_key") == F.col("_key")) & F.col("page").eqNullSafe(F.col("_page"))
    hot = bool(crowded.head(1))
    light = a.join(full, same, "left_anti") if hot else a
    parts = [light.join(c.withColumnRenamed("on_page", "page"), ["document_key", "page"])]
    if some:
        parts.append(light.join(c.filter("on_page is null").drop("on_page"), "document_key"))
    kept = [crowded]
    if hot:
        heavy = a.join(full, same, "left_semi")
        near = c.join(shared.few(crowded.select("document_key").distinct()), "document_key", "left_semi")
        able = shared.stored(candidates(heavy, near.drop("on_page").dropDuplicates(["document_key", "chunk_id"]), fuzzy, widest), "candidates")
        kept.append(able)
        met = heavy.join(able.select("anchor_id", "chunk_id"), "anchor_id").join(near, ["document_key", "chunk_id"])
        parts.append(met.filter(F.col("on_page").isNull() | (F.col("on_page") == F.col("page"))).drop("on_page"))
    return reduce(DataFrame.unionByName, parts), kept


def candidates(anchors: DataFrame, chunks: DataFrame, fuzzy: float, widest: int) -> DataFrame:
    """(anchor_id, document_key, chunk_id): every chunk in which, or in whose neighbourhood, a quote may stand, or which may have its words.

    anchors and chunks as ``resolve_evidence`` prepares them, with aligned texts and tokens.
    """
    runs = chunks.select("document_key", "chunk_id", F.explode(F.array_distinct(F.concat(_runs(F.col("c_align")), _runs(F.coalesce("r_align", F.lit("")))))).alias("token"))
    words = chunks.select("document_key", "chunk_id", F.explode("r_tokens").alias("token"))
    own = anchors.select("anchor_id", "document_key", "page", _runs(F.col("q_align")).alias("runs"), F.col("q_tokens").alias("words"))
    inner = own.filter("size(runs) > 2").select("anchor_id", "document_key", F.array_distinct(F.slice("runs", 2, F.size("runs") - 2)).alias("tokens"))
    holding = _rarest(inner, runs, F.lit(1)).join(runs, ["document_key", "token"]).select("anchor_id", "document_key", "chunk_id").distinct()
    # neighbours of those that hold the rarest word
    order = chunks.select("document_key", "chunk_id", "chunk_index")
    around = F.sequence(F.col("chunk_index") - (widest - 1), F.col("chunk_index") + (widest - 1))
    spots = holding.join(order, ["document_key", "chunk_id"]).select("anchor_id", "document_key", F.explode(around).alias("chunk_index")).distinct()
    near = spots.join(order, ["document_key", "chunk_index"]).select("anchor_id", "document_key", "chunk_id")
    # enough words: of n, n - need may be missing
    need = F.ceil(F.round(F.lit(fuzzy) * F.size("words"), 9))
    alike = own.filter((F.size("words") > 0) & (need <= F.size("words"))).select("anchor_id", "document_key", F.col("words").alias("tokens"), (F.size("words") - need + 1).alias("most"))
    # no share of words is more than all of them
    similar = [_rarest(alike, words, F.col("most")).join(words, ["document_key", "token"]).select("anchor_id", "document_key", "chunk_id")] if fuzzy < 1.001 else []
    short = own.filter("size(runs) <= 2").select("anchor_id", "document_key", "page", F.col("page").alias("to"))
    lo, hi = F.coalesce("page_start", "page_end"), F.coalesce("page_end", "page_start")
    ranged = chunks.select("document_key", "chunk_id", lo.alias("lo"), hi.alias("hi"))
    paged = intervals.overlapping(short, ranged.filter("lo is not null"), ["document_key"], ("page", "to"), ("lo", "hi")).select("anchor_id", "document_key", "chunk_id")
    everywhere = short.join(ranged.filter("lo is null").select("document_key", "chunk_id"), "document_key").select("anchor_id", "document_key", "chunk_id")
    return reduce(DataFrame.unionByName, [near, *similar, paged, everywhere]).distinct()


def resolve_evidence(anchors: DataFrame, chunks: DataFrame, fuzzy: float = 0.8, widest: int = 3, pages: DataFrame | None = None) -> DataFrame:
    """(anchor_id, status, method, chunk_ids, reason): where a quote stands, by the first way that finds it.

    anchors: (anchor_id, document_key, page, section_path, quote, quote_hash). chunks:
    (document_key, chunk_id, chunk_index, page_start, page_end, section_path, subtype, indexed,
    raw_content, retrieval_content). pages: (document_key, page, source_text, parsed_text).
    Ways: a hash that doesn't fit ends it; the quote or its aligned form in a chunk's text; in a
    table chunk's indexed text; over 2 to ``widest`` neighbouring chunks that all share words with it;
    enough of its words (candidates for review only). A wanted section and the most specific
    kind of chunk are preferred. Anchors meet only chunks of their document and page, those that
    ``candidates`` names; chunks on other pages are left before their texts are looked at.
    """
    if not fuzzy > 0:
        raise ValueError("a chunk without any of the words is no candidate")
    section = lambda: F.transform("section_path", lambda s: F.lower(F.trim(s)))
    # texts are brought into their forms once; a pair of quote and chunk leaves what is found, and its text where neighbours may go on
    a = shared.stored(anchors.withColumn("q_align", T.for_alignment(F.col("quote"))).withColumn("q_tokens", T.evidence_tokens(F.col("quote"))).withColumn("q_section", section()).drop("section_path"), "anchors", "zstd")
    bad = a.filter(F.col("quote_hash").isNotNull() & (T.quote_hash(F.col("quote")) != F.col("quote_hash"))).select("anchor_id")
    indexed = _between(a, chunks.filter("indexed"))
    c = asked_pages(a, indexed).join(indexed, ["document_key", "chunk_id"]).withColumn("c_align", T.for_alignment(F.col("raw_content"))).withColumn("c_tokens", T.evidence_tokens(F.col("raw_content"))).withColumn("c_section", section())
    c = c.withColumn("r_align", T.for_alignment(F.col("retrieval_content"))).withColumn("r_tokens", T.evidence_tokens(F.concat_ws(" ", "raw_content", "retrieval_content")))
    c = shared.stored(c.select("document_key", "chunk_id", "on_page", "chunk_index", "page_start", "page_end", "subtype", "raw_content", "c_align", "c_tokens", "c_section", "r_align", "r_tokens"), "chunks", "zstd")
    met, kept = _met(a.join(bad, "anchor_id", "left_anti").drop("quote_hash"), c, fuzzy, widest)
    pairs = met.filter(page_overlaps(F.col("page_start"), F.col("page_end"), F.col("page")))
    exact, aligned = F.contains("raw_content", F.col("quote")), F.contains("c_align", F.col("q_align"))
    table = F.col("subtype").isin("table_row", "table_group") & F.contains("r_align", F.col("q_align"))
    # ways 1 and 2 look at one chunk
    way = F.when(exact | aligned, F.lit(1)).when(table, F.lit(2))
    fits = section_matches(F.col("c_section"), F.col("q_section"))
    has = F.coalesce(F.arrays_overlap("c_tokens", "q_tokens"), F.lit(False))
    share = F.coalesce(F.size(F.array_intersect("q_tokens", "r_tokens")) / F.nullif(F.size("q_tokens"), F.lit(0)), F.lit(0.0))
    goes_on = lambda x: F.when(F.col("has") & F.col("way").isNull(), F.col(x)).alias(x)
    pairs = pairs.select("anchor_id", "chunk_id", "chunk_index", "subtype", way.alias("way"), exact.cast("int").alias("exact"), fits.alias("fits"), has.alias("has"), (share >= fuzzy).alias("alike"), "raw_content", "q_align")
    pairs = shared.stored(pairs.select("anchor_id", "chunk_id", "chunk_index", "subtype", "way", "exact", "fits", "has", "alike", goes_on("raw_content"), goes_on("q_align")), "pairs", "zstd")
    shared.drop(c, *kept)
    single = pairs.filter("way is not null").select("anchor_id", "chunk_id", "subtype", "way", "fits", "exact")
    single = single.withColumn("best", F.min("way").over(Window.partitionBy("anchor_id"))).filter("way = best")
    single = preferring(single, F.col("fits"), ["anchor_id"])
    single = preferring(single, F.col("subtype") == "table_row", ["anchor_id"])
    single = preferring(single, ~F.coalesce(F.col("subtype") == "table_raw_text", F.lit(False)), ["anchor_id"])
    found = single.groupBy("anchor_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("ids"), F.min("exact").alias("exact"))
    one = F.size("ids") == 1
    method = F.when(F.col("exact") == 1, F.lit("exact")).otherwise(F.lit("normalized_exact"))
    resolved = found.select("anchor_id", F.when(one, F.lit("resolved")).otherwise(F.lit("manual_review")).alias("status"), method.alias("method"), F.when(one, F.col("ids")).otherwise(F.array().cast("array<string>")).alias("chunk_ids"), F.when(one, F.lit("UNIQUE_MATCH")).otherwise(F.lit("MULTIPLE_MATCHES")).alias("reason"))
    rest = pairs.join(found.select("anchor_id"), "anchor_id", "left_anti")
    # way 3: neighbours. Each chunk looks at those after it
    w = Window.partitionBy("anchor_id").orderBy("chunk_index", "chunk_id")
    step = rest.withColumnRenamed("fits", "ok")
    sized = None
    for n in range(2, widest + 1):
        ahead = lambda name, n=n: F.array(F.col(name), *[F.lead(name, k).over(w) for k in range(1, n)])
        row = step.select("anchor_id", "q_align", ahead("chunk_id").alias("ids"), ahead("chunk_index").alias("at"), ahead("raw_content").alias("texts"), ahead("has").alias("has"), ahead("ok").alias("oks"))
        whole = F.forall(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: F.get("at", k) == F.get("at", k - 1) + 1)
        row = row.filter(whole & F.forall("has", lambda x: x))
        row = row.filter(F.contains(T.for_alignment(F.array_join("texts", " ")), F.col("q_align")))
        part = row.select("anchor_id", "ids", F.forall("oks", lambda x: x).alias("ok"), F.lit(n).alias("n"))
        sized = part if sized is None else sized.unionByName(part)
    sized = sized.withColumn("least", F.min("n").over(Window.partitionBy("anchor_id"))).filter("n = least")
    near = preferring(sized, F.col("ok"), ["anchor_id"]).groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    only = F.col("n") == 1
    windows = near.select("anchor_id", F.when(only, F.lit("multi_chunk")).otherwise(F.lit("manual_review")).alias("status"), F.lit("adjacent_chunks").alias("method"), F.when(only, F.col("ids")).otherwise(F.array().cast("array<string>")).alias("chunk_ids"), F.when(only, F.lit("UNIQUE_ADJACENT_WINDOW")).otherwise(F.lit("MULTIPLE_ADJACENT_WINDOWS")).alias("reason"))
    # way 4: words
    similar = rest.join(near.select("anchor_id"), "anchor_id", "left_anti").filter("alike").select("anchor_id").distinct().withColumn("similar", F.lit(True))
    last = a.join(bad, "anchor_id", "left_anti").join(found.select("anchor_id"), "anchor_id", "left_anti").join(near.select("anchor_id"), "anchor_id", "left_anti").join(similar, "anchor_id", "left")
    if pages is not None:
        last = last.join(pages.select("document_key", "page", "source_text", "parsed_text"), ["document_key", "page"], "left")
        lost = F.coalesce(F.contains(T.for_alignment(F.col("source_text")), F.col("q_align")), F.lit(False)) & ~F.coalesce(F.contains(T.for_alignment(F.col("parsed_text")), F.col("q_align")), F.lit(False))
    else:
        lost = F.lit(False)
    none = F.array().cast("array<string>").alias("chunk_ids")
    few = F.coalesce("similar", F.lit(False))
    others = last.select("anchor_id", F.when(lost, F.lit("parser_issue")).when(few, F.lit("manual_review")).otherwise(F.lit("unresolved")).alias("status"), F.when(few, F.lit("fuzzy_candidate")).otherwise(F.lit("none")).alias("method"), none, F.when(lost, F.lit("SOURCE_PRESENT_PARSER_OUTPUT_MISSING")).when(few, F.lit("FUZZY_CANDIDATES_REQUIRE_REVIEW")).otherwise(F.lit("NO_SOURCE_MATCH")).alias("reason"))
    wrong = bad.select("anchor_id", F.lit("manual_review").alias("status"), F.lit("none").alias("method"), none, F.lit("QUOTE_HASH_MISMATCH").alias("reason"))
    return reduce(DataFrame.unionByName, [resolved, windows, others, wrong])
