"""Reading order of an export's reference graph, of any depth and width.

Documents of at most SMALL nodes and references are walked one after the other where their rows
meet, after one shuffle. A larger document's graph is cut where a node is referenced more than once: such a node starts a
fragment of its own, and its references are leaves of the fragments that they stand in. So
fragments are trees. Each is walked as a list of events, entering and leaving each node, whose
successors are known from siblings and parents alone; ranking that list by pointer doubling gives
every node its place, in a number of rounds that grows with the logarithm of the list. What hangs
on a cycle without a root never comes to an end, so a round that finishes nothing ends the
ranking. Fragments are then put in where they are referenced, one level of such references a
round, until nothing is left to put in; a reference to a fragment that is being walked closes
a cycle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark import shared

#: What a reference that dangles or closes a cycle costs.
COST = 0.02
ROOTS = ("#furniture", "#body")
_TOP = "#"
#: Nodes and references of a document that a task may hold.
SMALL = 10_000
#: Rows of a batch that a walk gives out.
BATCH = 1 << 14


def _apart(df: DataFrame) -> DataFrame:
    """A table that grows with the input: joins shuffle it, small or not, so that no round sends it through the driver."""
    return df.hint("merge")


def ranked_lists(events: DataFrame) -> DataFrame:
    """document_id, event, rank, end of (document_id, event, next, weight): the weights from an event to the end of its list, and that end.

    Lists that never end are left out.
    """
    # far: the sum of weights before ``next``; an event without a next one is the end of its list
    now = shared.stored(events.select("document_id", "event", "next", F.col("weight").cast("long").alias("far"), F.when(F.col("next").isNull(), F.col("event")).alias("end")), "lists")
    open_ = now.filter("next is not null").count()
    while open_:
        done, rest = now.filter("next is null"), now.filter("next is not null")
        ahead = now.select("document_id", F.col("event").alias("next"), F.col("next").alias("then"), F.col("far").alias("more"), F.col("end").alias("last"))
        moved = rest.join(_apart(ahead), ["document_id", "next"]).select("document_id", "event", F.col("then").alias("next"), (F.col("far") + F.col("more")).alias("far"), F.col("last").alias("end"))
        after = shared.stored(done.unionByName(moved), "lists")
        left = after.filter("next is not null").count()
        now = after
        if left == open_:
            break
        open_ = left
    return now.filter("next is null").select("document_id", "event", F.col("far").alias("rank"), "end")


def _node(ref: Column) -> Column:
    return F.concat(F.lit("n"), ref)


def vertices(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(document_id, vertex, parent, place, ref, target): the fragments as trees.

    A vertex without a parent is a fragment's root: the document's own, or a node that is
    referenced several times. target names the node of a reference that is a leaf: one to such
    a fragment, or (lost) to a node that doesn't exist.
    """
    known = nodes.select("document_id", F.col("ref").alias("child")).distinct().withColumn("known", F.lit(True))
    # a reference under a root stands under the document's own vertex, furniture first
    top = F.col("parent").isin(*ROOTS)
    order = F.struct(F.when(F.col("parent") == ROOTS[1], 1).otherwise(0).alias("root"), F.col("place"), F.col("child"))
    own = refs.select("document_id", "parent", "child", "place").withColumn("order", order).withColumn("parent", F.when(top, F.lit(_TOP)).otherwise(_node(F.col("parent"))))
    times = Window.partitionBy("document_id", "child")
    own = own.withColumn("times", F.count("*").over(times)).join(_apart(known), ["document_id", "child"], "left")
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("document_id", "parent").orderBy("order")))
    single = F.col("known").isNotNull() & (F.col("times") == 1)
    leaf = F.concat(F.lit("r"), "place", F.lit("/"), "parent")
    inner = own.select("document_id", F.when(single, _node(F.col("child"))).otherwise(leaf).alias("vertex"), "parent", "place", F.when(single, F.col("child")).alias("ref"), F.when(~single, F.when(F.col("known"), F.col("child")).otherwise(F.lit(""))).alias("target"))
    none = F.lit(None).cast("string")
    start = lambda df, vertex, ref: df.select("document_id", vertex.alias("vertex"), none.alias("parent"), F.lit(None).cast("int").alias("place"), ref.alias("ref"), none.alias("target"))
    several = own.filter("known and times > 1").select("document_id", "child").distinct()
    return start(nodes.select("document_id").distinct(), F.lit(_TOP), none).unionByName(start(several, _node(F.col("child")), F.col("child"))).unionByName(inner)


def walked(tree: DataFrame) -> DataFrame:
    """(document_id, vertex, root, at): each vertex's fragment and its place in the walk, 0 for the root."""
    enter, leave = (lambda c: F.concat(F.lit("+"), F.col(c))), (lambda c: F.concat(F.lit("-"), F.col(c)))
    first = tree.filter("parent is not null").groupBy("document_id", F.col("parent").alias("vertex")).agg(F.min_by("vertex", "place").alias("first"))
    placed = tree.withColumn("sibling", F.lead("vertex").over(Window.partitionBy("document_id", "parent").orderBy("place")))
    placed = placed.withColumn("sibling", F.when(F.col("parent").isNotNull(), F.col("sibling")))
    placed = placed.join(_apart(first), ["document_id", "vertex"], "left")
    after = F.when(F.col("sibling").isNotNull(), enter("sibling")).when(F.col("parent").isNotNull(), leave("parent"))
    inside = F.coalesce(enter("first"), leave("vertex"))
    both = F.array(F.struct(enter("vertex").alias("event"), inside.alias("next"), F.lit(1).alias("weight")), F.struct(leave("vertex").alias("event"), after.alias("next"), F.lit(0).alias("weight")))
    found = ranked_lists(placed.select("document_id", F.inline(both)))
    entered = found.filter(F.startswith("event", F.lit("+"))).select("document_id", F.substring("event", 2, 1 << 30).alias("vertex"), F.substring("end", 2, 1 << 30).alias("root"), "rank")
    whole = entered.filter("vertex = root").select("document_id", "root", F.col("rank").alias("total"))
    return entered.join(_apart(whole), ["document_id", "root"]).select("document_id", "vertex", "root", (F.col("total") - F.col("rank")).alias("at"))


def _walk(known: set, children: dict[str, list]) -> Iterator[str | None]:
    """References in reading order; None for each that dangles or closes a cycle."""
    on, path, open_ = set(), [], [chain.from_iterable([children.pop(root, ()) for root in ROOTS])]
    while open_:
        for ref in open_[-1]:
            if ref not in known or ref in on:
                yield None
                continue
            yield ref
            on.add(ref)
            path.append(ref)
            open_.append(iter(children.get(ref, ())))
            break
        else:
            open_.pop()
            if path:
                on.discard(path.pop())


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(document, nodes, children by parent) of rows in order of document, kind, parent and place."""
    own, known, children = None, set(), {}
    for b in batches:
        for document, kind, parent, child in zip(*(b.column(c).to_pylist() for c in ("document_id", "kind", "parent", "child"))):
            if document != own:
                if known:
                    yield own, known, children
                own, known, children = document, set(), {}
            if kind:
                children.setdefault(parent, []).append(child)
            else:
                known.add(child)
    if known:
        yield own, known, children


def small_orders(rows: DataFrame) -> DataFrame:
    """(document_id, ref, reading_order, confidence) of documents of a bounded size: a row per place, and one without a ref that has the confidence.

    rows: (document_id, kind, parent, place, child), kind 0 for a node (child), 1 for a reference.
    """
    document = rows.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def out() -> pa.RecordBatch:
            made = [pa.array(c, t) for c, t in zip((documents, refs, places, sure), (kind, pa.string(), pa.int32(), pa.float64()))]
            for c in (documents, refs, places, sure):
                c.clear()
            return pa.RecordBatch.from_arrays(made, names=["document_id", "ref", "reading_order", "confidence"])

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field("document_id").type
                yield b

        documents, refs, places, sure = [], [], [], []
        for own, known, children in _documents(seen()):
            n = lost = 0
            for ref in _walk(known, children):
                if ref is None:
                    lost += 1
                    continue
                documents.append(own)
                refs.append(ref)
                places.append(n)
                sure.append(None)
                n += 1
                if len(refs) >= BATCH:
                    yield out()
            documents.append(own)
            refs.append(None)
            places.append(None)
            sure.append(max(0.0, 1.0 - COST * lost))
        if refs:
            yield out()

    placed = rows.repartition("document_id").sortWithinPartitions("document_id", "kind", "parent", "place", "child")
    return placed.select("document_id", "kind", "parent", "child").mapInArrow(run, f"document_id {document}, ref string, reading_order int, confidence double")


def export_order(nodes: DataFrame, refs: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Reading order of an export's reference graph: (document_id, ref, reading_order), and the confidence per document.

    nodes: (document_id, ref); refs: (document_id, parent, child, place), roots having parent
    '#furniture' or '#body'. Furniture comes first, children in order of their places. A node
    that is referenced several times is walked each time. A reference that dangles or closes a
    cycle costs 0.02 confidence each time it is met, and is not followed.
    """
    none = F.lit(None)
    rows = nodes.select("document_id", F.lit(0).alias("kind"), none.cast("string").alias("parent"), none.cast(refs.schema["place"].dataType).alias("place"), F.col("ref").alias("child"))
    rows = rows.unionByName(refs.select("document_id", F.lit(1).alias("kind"), "parent", "place", "child"))
    sizes = rows.groupBy("document_id").agg(F.count("*").alias("n"))
    large = shared.stored(sizes.filter(F.col("n") > small).select("document_id"), "large")
    own = lambda df, how: df.join(shared.few(large), "document_id", how)
    if not large.head(1):
        return _parts(shared.stored(small_orders(rows), "orders"))
    order, sure = large_orders(own(nodes, "left_semi"), own(refs, "left_semi"))
    some, of_some = _parts(shared.stored(small_orders(own(rows, "left_anti")), "orders"))
    return order.unionByName(some), sure.unionByName(of_some)


def _parts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    return found.filter("ref is not null").select("document_id", "ref", "reading_order"), found.filter("ref is null").select("document_id", "confidence")


def large_orders(nodes: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``export_order`` gives, for documents of any size."""
    tree = shared.stored(vertices(nodes, refs), "vertices")
    flat = shared.stored(tree.join(_apart(walked(tree)), ["document_id", "vertex"]).select("document_id", "root", "at", "ref", "target"), "walked")
    links = flat.filter("target is not null").select("document_id", "root", "at", "target")
    # instances of fragments: where they stand, and the fragments they stand in
    fresh = nodes.select("document_id").distinct().select("document_id", F.lit(_TOP).alias("root"), F.array().cast("array<long>").alias("path"), F.array().cast("array<string>").alias("seen"))
    every, lost = fresh, None
    while True:
        met = shared.stored(fresh.join(_apart(links), ["document_id", "root"]), "instances")
        follow = (F.col("target") != "") & ~F.array_contains("seen", F.col("target"))
        bad = met.filter(~follow).select("document_id")
        lost = bad if lost is None else lost.unionByName(bad)
        good = met.filter(follow)
        if not good.head(1):
            break
        fresh = good.select("document_id", _node(F.col("target")).alias("root"), F.concat("path", F.array("at")).alias("path"), F.concat("seen", F.array("target")).alias("seen"))
        every = every.unionByName(fresh)
    places = every.join(_apart(flat.filter("ref is not null")), ["document_id", "root"]).select("document_id", "ref", F.concat("path", F.array("at")).alias("path"))
    order = places.select("document_id", "ref", (F.row_number().over(Window.partitionBy("document_id").orderBy("path")) - 1).alias("reading_order"))
    count = lost.groupBy("document_id").agg(F.count("*").alias("n"))
    sure = nodes.select("document_id").distinct().join(count, "document_id", "left").select("document_id", F.greatest(F.lit(0.0), 1.0 - COST * F.coalesce("n", F.lit(0))).alias("confidence"))
    return order, sure
