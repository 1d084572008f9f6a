"""Walks, closures and checks of document trees (in practice graphs with repeats and cycles).

Tables: nodes(doc, node, ...), edges(doc, parent, child, ordinal). Children go in the order of ordinal, then child.

A walk numbers its visits without following them one by one. Nodes with one parent make trees; by path doubling each
node knows after k rounds what stands 2**k above it, so the sizes of subtrees, and from those the places in the walk,
take as many rounds as the logarithm of the depth. Nodes that several others name are settled on the graph of such
trees. A node's place and the size of what is below it are an interval, which tells ancestors from others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import hashes
from quire.operators.numbering import running_sum
from quire.scratch import moved, written
from quire.schema import NOT_IN_DOCUMENT

#: Environments that rules name by themselves.
OWN_RULES = ("E_document", "E_thebibliography")
PATH = "array<struct<ordinal:bigint,child:bigint>>"


def roots_of(nodes: DataFrame) -> DataFrame:
    """(doc, root): the least node of each document."""
    return nodes.groupBy("doc").agg(F.min("node").alias("root"))


def min_paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc, node, path): for every node that a root reaches, the least path to it, an array of (ordinal, child).

    A node's least path is the one by which a depth-first walk meets it first, because every beginning of a least path
    is a least path itself. Each round relaxes the edges that leave nodes whose path has just shrunk, and writes the
    paths that it has found or shortened alone; a cycle only yields longer paths, which lose. Rounds are as many as the
    graph is deep: ``walk`` calls it on the graph of trees alone.
    """
    e = edges.select("doc", "parent", F.col("child").cast("long").alias("child"), F.col("ordinal").cast("long").alias("ordinal"))
    front = written(roots.select("doc", F.col("root").cast("long").alias("node"), F.array().cast(PATH).alias("path")), "paths")
    best = front
    while True:
        up = front.select("doc", F.col("node").alias("parent"), F.col("path").alias("up"))
        reach = up.join(moved(e), ["doc", "parent"]).groupBy("doc", F.col("child").alias("node")).agg(F.min(F.concat("up", F.array(F.struct("ordinal", "child"))).cast(PATH)).alias("path"))
        known = best.select("doc", "node", F.col("path").alias("old"))
        front = written(reach.join(moved(known), ["doc", "node"], "left").where("old is null or path < old").select("doc", "node", "path"), "paths")
        if front.isEmpty():
            return best
        best = written(best.unionByName(front).groupBy("doc", "node").agg(F.min("path").alias("path")), "paths")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc, node): the nodes that a root reaches, roots included."""
    return walk(edges, roots).where("is_first").select("doc", "node")


def _doubled(vertices: DataFrame) -> tuple[DataFrame, int]:
    """(doc, node, top, dist, size) of vertices(doc, node, up, weight): the highest node above, how far it is, and the
    weight of the node and all below it; and the number of rounds that took. Nodes on or below a cycle without a top are
    left out: their way up is longer than there are nodes."""
    now = written(vertices.select("doc", "node", F.col("up").alias("anc"), F.col("node").alias("top"), F.lit(0).cast("long").alias("dist"), F.col("weight").cast("long").alias("size")), "doubled")
    step = 1
    while not now.where("anc is not null").isEmpty():
        if step >= 64 and step > 2 * now.count():
            break
        far = now.select("doc", F.col("node").alias("anc"), F.col("anc").alias("a2"), F.col("top").alias("t2"), F.col("dist").alias("d2"))
        more = now.where("anc is not null").groupBy("doc", F.col("anc").alias("node")).agg(F.sum("size").alias("more"))
        joined = now.join(moved(far), ["doc", "anc"], "left").join(moved(more), ["doc", "node"], "left")
        dist = F.when(F.col("anc").isNotNull(), F.col("d2") + step).otherwise(F.col("dist"))
        now = written(joined.select("doc", "node", F.col("a2").alias("anc"), F.coalesce("t2", "top").alias("top"), dist.alias("dist"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "doubled")
        step *= 2
    return now.where("anc is null").drop("anc"), step.bit_length() - 1


def _summed(vertices: DataFrame, rounds: int) -> DataFrame:
    """(doc, node, pos) of vertices(doc, node, up, off): the sum of ``off`` from the top down to the node, which doubling
    reaches in so many rounds."""
    now = written(vertices.select("doc", "node", F.col("up").alias("anc"), F.col("off").alias("pos")), "doubled")
    for _ in range(rounds):
        far = now.select("doc", F.col("node").alias("anc"), F.col("anc").alias("a2"), F.col("pos").alias("p2"))
        now = written(now.join(moved(far), ["doc", "anc"], "left").select("doc", "node", F.col("a2").alias("anc"), (F.col("pos") + F.coalesce("p2", F.lit(0))).alias("pos")), "doubled")
    return now.drop("anc")


def _preorder(own: DataFrame, leaves: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places within trees: of their nodes (doc, node, parent, ordinal, top, depth, size, place) and of further edges, which
    are visited and not entered (doc, node, parent, ordinal, top, depth, place). ``own`` are edges to nodes with one parent."""
    up = own.select("doc", F.col("child").alias("node"), F.col("parent").alias("up"), "ordinal")
    extra = leaves.groupBy("doc", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("extra"))
    ends = roots.unionByName(own.select("doc", F.col("parent").alias("node"))).unionByName(leaves.select("doc", F.col("parent").alias("node"))).unionByName(up.select("doc", "node")).distinct()
    vertices = ends.join(moved(up), ["doc", "node"], "left").join(moved(extra), ["doc", "node"], "left")
    sizes, rounds = _doubled(vertices.withColumn("weight", F.coalesce("extra", F.lit(0)) + 1))
    both = own.join(moved(sizes.select("doc", F.col("node").alias("child"), "size")), ["doc", "child"]).withColumn("own", F.lit(True)).unionByName(leaves.withColumns({"size": F.lit(1).cast("long"), "own": F.lit(False)}))
    placed = written(running_sum(both, ["doc", "parent"], ["ordinal", "child"], "size").withColumn("off", F.col("before") + 1), "offsets")
    into = placed.where("own").select("doc", F.col("child").alias("node"), F.col("parent").alias("up"), "ordinal", "off")
    named = sizes.join(moved(into), ["doc", "node"], "left").withColumn("off", F.coalesce("off", F.lit(0)))
    nodes = named.join(moved(_summed(named, rounds)), ["doc", "node"]).select("doc", "node", F.col("up").alias("parent"), "ordinal", "top", F.col("dist").alias("depth"), "size", F.col("pos").alias("place"))
    nodes = written(nodes, "places")
    above = nodes.select("doc", F.col("node").alias("parent"), "top", (F.col("depth") + 1).alias("depth"), F.col("place").alias("from"))
    visits = placed.where("not own").join(moved(above), ["doc", "parent"]).select("doc", F.col("child").alias("node"), "parent", "ordinal", "top", "depth", (F.col("from") + F.col("off")).alias("place"))
    return nodes, visits


def walk(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc, node, parent, ordinal, place, size, depth, is_first): the visits of a depth-first walk, one for the root and one
    for each edge that leaves a reached node; a node seen before is visited again but not entered again. ``place`` numbers
    a document's visits from 0, and a first visit's ``size`` is the number of visits from it to the last one below it.
    Edges that repeat wholly count once.

    Edges to nodes that nothing else points at make trees, whose inner order doubling finds. What is left is the graph of
    these trees: an edge from one to the top of another, numbered by its place in the first. A top's least path there tells
    which edge a walk takes to it first; with those edges all is one tree, numbered in the same way."""
    long = lambda c: F.col(c).cast("long").alias(c)
    e = written(edges.select("doc", long("parent"), long("child"), long("ordinal")).distinct(), "edges")
    # read by each of the steps below: roots are asked for once, whatever they come from
    top = written(roots.select("doc", F.col("root").cast("long").alias("node")).distinct(), "roots")
    once = e.groupBy("doc", "child").agg(F.count(F.lit(1)).alias("n")).where("n = 1").join(moved(top.withColumnRenamed("node", "child")), ["doc", "child"], "left_anti")
    e = written(e.join(moved(once), ["doc", "child"], "left").select(*e.columns, F.col("n").isNotNull().alias("single")), "edges")
    own, others = (e.where(c).drop("single") for c in ("single", "not single"))
    nodes, visits = _preorder(own, others, top)
    if not others.isEmpty():
        links = written(visits.select("doc", F.col("top").alias("parent"), F.col("node").alias("child"), F.col("place").alias("ordinal"), F.col("parent").alias("from"), F.col("ordinal").alias("nth")), "links")
        paths = min_paths(links.select("doc", "parent", "child", "ordinal"), top.withColumnRenamed("node", "root"))
        last = paths.where(F.size("path") > 0).select("doc", F.element_at("path", -1).alias("x"), F.when(F.size("path") > 1, F.try_element_at("path", F.lit(-2))["child"]).alias("before"))
        last = last.join(moved(top.withColumnRenamed("node", "root")), "doc").select("doc", F.coalesce("before", "root").alias("parent"), F.col("x.child").alias("child"), F.col("x.ordinal").alias("ordinal"))
        taken = written(links.join(moved(last), ["doc", "parent", "child", "ordinal"], "left_semi").select("doc", F.col("from").alias("parent"), "child", F.col("nth").alias("ordinal")), "taken")
        reached = nodes.join(moved(paths.select("doc", F.col("node").alias("top"))), ["doc", "top"], "left_semi").select("doc", F.col("node").alias("parent"))
        rest = others.join(moved(reached), ["doc", "parent"], "left_semi").join(moved(taken), ["doc", "parent", "child", "ordinal"], "left_anti")
        nodes, visits = _preorder(own.join(moved(reached), ["doc", "parent"], "left_semi").unionByName(taken), rest, top)
    found = nodes.withColumn("is_first", F.lit(True)).unionByName(visits.withColumns({"size": F.lit(1).cast("long"), "is_first": F.lit(False)}))
    shown = found.join(moved(top.withColumnRenamed("node", "top")), ["doc", "top"], "left_semi")
    return shown.select("doc", "node", "parent", "ordinal", "place", "size", "depth", "is_first")


#: Places of an interval that are written out at a time.
STRETCH = 4096


def below(marks: DataFrame, visits: DataFrame) -> DataFrame:
    """(doc, node, descendant): all other nodes that the nodes of marks(doc, node) lead to. What a walk has entered below a
    node is an interval of places; where it holds a visit to a node that was entered elsewhere, that one's interval
    belongs to it too, and so on. The work grows with what comes out, whatever the size of the tree."""
    v = visits.select("doc", "node", "place", "size", "is_first")
    first = v.where("is_first").select("doc", F.col("node").alias("at"), F.col("place").alias("low"), "size")
    front = marks.select("doc", "node").distinct().withColumn("at", F.col("node"))
    found = entered = None
    while True:
        spans = front.join(moved(first), ["doc", "at"]).select("doc", "node", F.col("low").alias("a"), (F.col("low") + F.col("size") - 1).alias("b"))
        blocks = spans.select("doc", "node", "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a")) / STRETCH))).alias("k"))
        low = F.col("a") + F.col("k") * STRETCH
        places = blocks.select("doc", F.col("node").alias("mark"), F.explode(F.sequence(low, F.least(low + STRETCH - 1, F.col("b")))).alias("place"))
        met = written(places.join(moved(v), ["doc", "place"]).select("doc", F.col("mark").alias("node"), F.col("node").alias("descendant"), "is_first").distinct(), "below")
        new, inside = met.drop("is_first").distinct(), met.where("is_first").drop("is_first")
        found = new if found is None else written(found.unionByName(new).distinct(), "below")
        entered = inside if entered is None else written(entered.unionByName(inside).distinct(), "below")
        again = met.where("not is_first").drop("is_first").join(moved(entered), ["doc", "node", "descendant"], "left_anti")
        front = written(again.select("doc", "node", F.col("descendant").alias("at")), "below")
        if front.isEmpty():
            return found.where("node <> descendant")


def nearest(visits: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc, node, at): for each node that a walk enters, the nearest of marked(doc, node) on the way up from it, itself
    included; null if there is none. Each round doubles how far nodes look up."""
    own = marked.select("doc", "node").distinct().withColumn("m", F.lit(True))
    first = visits.where("is_first").select("doc", "node", "parent").join(moved(own), ["doc", "node"], "left")
    done = F.col("m").isNotNull() | F.col("parent").isNull()
    now = written(first.select("doc", "node", F.when(F.col("m"), F.col("node")).otherwise(F.col("parent")).alias("at"), done.alias("done")), "nearest")
    while not now.where("not done").isEmpty():
        up = now.select("doc", F.col("node").alias("at"), F.col("at").alias("a2"), F.col("done").alias("d2"))
        open_ = now.where("not done").join(moved(up), ["doc", "at"]).select("doc", "node", F.col("a2").alias("at"), F.col("d2").alias("done"))
        now = written(now.where("done").unionByName(open_), "nearest")
    return now.drop("done")


def order_in_document(nodes: DataFrame, visits: DataFrame) -> DataFrame:
    """(doc, node, order_in_document): the place of the last visit; nodes out of reach get 2147483647."""
    last = visits.groupBy("doc", "node").agg(F.max("place").alias("p"))
    return nodes.select("doc", "node").join(moved(last), ["doc", "node"], "left").select("doc", "node", F.coalesce("p", F.lit(NOT_IN_DOCUMENT)).alias("order_in_document"))


def closure(edges: DataFrame) -> DataFrame:
    """(doc, ancestor, descendant): all pairs joined by one edge or more, in as many rounds as the logarithm of the depth:
    pairs at most 2**k edges apart are joined with themselves. Only pairs that the last round found can make new ones.
    The result grows with depth times nodes, as asked for; ``below`` gives the part of it that starts at given nodes."""
    pairs = written(edges.select("doc", F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct(), "closure")
    new = pairs
    while True:
        # a longer way begins with as many edges as the last round's pairs are apart at most
        head = new.select("doc", "ancestor", F.col("descendant").alias("m")).join(moved(pairs.select("doc", F.col("ancestor").alias("m"), "descendant")), ["doc", "m"])
        more = head.select("doc", "ancestor", "descendant").distinct()
        new = written(more.join(moved(pairs), ["doc", "ancestor", "descendant"], "left_anti"), "closure")
        if new.isEmpty():
            return pairs
        pairs = written(pairs.unionByName(new), "closure")


def append_children(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges for new(doc, parent, child) that don't exist yet, with ordinals after the parent's greatest."""
    fresh = new.distinct().join(edges, ["doc", "parent", "child"], "left_anti")
    top = edges.groupBy("doc", "parent").agg(F.max("ordinal").alias("top"))
    n = F.row_number().over(Window.partitionBy("doc", "parent").orderBy("child"))
    return fresh.withColumn("n", n).join(top, ["doc", "parent"], "left").select("doc", "parent", "child", (F.coalesce("top", F.lit(0)) + F.col("n")).cast("long").alias("ordinal"))


def children(edges: DataFrame) -> DataFrame:
    """(doc, parent, children): ordered list of children."""
    pairs = F.sort_array(F.collect_list(F.struct("ordinal", "child")))
    return edges.groupBy("doc", "parent").agg(F.transform(pairs, lambda x: x["child"]).alias("children"))


def parents(edges: DataFrame) -> DataFrame:
    """(doc, child, parents): parents in ascending order."""
    return edges.groupBy("doc", "child").agg(F.sort_array(F.collect_set("parent")).alias("parents"))


def loops(visits: DataFrame) -> DataFrame:
    """Visits to a node that is on its own branch: again, from a node within the interval of its first visit."""
    first = visits.where("is_first").select("doc", F.col("node").alias("at"), F.col("place").alias("from"), "size")
    again = visits.where("not is_first").select("doc", "node", "parent", "depth")
    entered = again.join(moved(first.select("doc", F.col("at").alias("node"), F.col("from").alias("low"), "size")), ["doc", "node"])
    entered = entered.join(moved(first.select("doc", F.col("at").alias("parent"), F.col("from").alias("here"))), ["doc", "parent"])
    return entered.where("here >= low and here < low + size").select("doc", "node", "parent", "depth")


def duplicates(visits: DataFrame) -> DataFrame:
    """Visits to a node that was visited before."""
    return visits.where("not is_first").select("doc", "node", "parent", "depth")


def missing_children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to nodes that don't exist."""
    return edges.join(moved(nodes.select("doc", F.col("node").alias("child"))), ["doc", "child"], "left_anti").select("doc", "parent", "child")


def disconnected(nodes: DataFrame, reached: DataFrame, replaced: DataFrame) -> DataFrame:
    """(doc, node, replaced_by): nodes that aren't among reached(doc, node); replaced(doc, node, by) tells what took their place."""
    gone = nodes.select("doc", "node").join(moved(reached.select("doc", "node")), ["doc", "node"], "left_anti")
    by = replaced.groupBy("doc", "node").agg(F.min("by").alias("replaced_by"))
    return gone.join(moved(by), ["doc", "node"], "left")


def kind(environ: Column) -> Column:
    """An environ as the rules name it: E_* for any environment without rules of its own."""
    return F.when(environ.startswith("E_") & ~environ.isin(*OWN_RULES), "E_*").otherwise(environ)


def check_links(nodes: DataFrame, edges: DataFrame, rules: DataFrame, extensions: DataFrame) -> DataFrame:
    """(doc, parent, child, parent_environ, child_environ): edges that the rules don't allow. A child's kind must stand
    under its parent's in rules(parent, child) and belong to its extension in extensions(ext, child); a child with
    several extensions or one that isn't in the table has to be a graphic_file. nodes(doc, node, environ, exts), exts
    joined by commas. Every edge is tested once, leaves too."""
    p = nodes.select("doc", F.col("node").alias("parent"), F.col("environ").alias("parent_environ"))
    c = nodes.select("doc", F.col("node").alias("child"), F.col("environ").alias("child_environ"), "exts")
    linked = edges.join(moved(p), ["doc", "parent"]).join(moved(c), ["doc", "child"])
    allowed = F.broadcast(rules.select(F.col("parent").alias("rp"), F.col("child").alias("rc"), F.lit(True).alias("by_rule")))
    fitting = F.broadcast(extensions.select(F.col("ext").alias("exts"), F.col("child").alias("xc"), F.lit(True).alias("by_ext")))
    known = F.broadcast(extensions.select(F.col("ext").alias("exts"), F.lit(True).alias("known")).distinct())
    child = kind(F.col("child_environ"))
    judged = linked.join(known, "exts", "left").join(allowed, (kind(F.col("parent_environ")) == F.col("rp")) & (child == F.col("rc")), "left")
    judged = judged.join(fitting.withColumnRenamed("exts", "fe"), (F.col("exts") == F.col("fe")) & (child == F.col("xc")), "left")
    ok = F.when(F.coalesce("known", F.lit(False)), F.coalesce(F.col("by_rule") & F.col("by_ext"), F.lit(False))).otherwise(F.col("child_environ") == "graphic_file")
    return judged.where(~ok).select("doc", "parent", "child", "parent_environ", "child_environ")


def allowed_children(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc, node, allowed): the environs that may stand under each node, sorted and joined by commas; E_* stands for
    the environments that the document has."""
    has = nodes.where(kind(F.col("environ")) == "E_*").select("doc", F.lit("E_*").alias("child"), F.col("environ").alias("own")).distinct()
    docs = nodes.select("doc", kind(F.col("environ")).alias("parent")).distinct()
    per = docs.join(F.broadcast(rules), "parent").join(has, ["doc", "child"], "left").where("child <> 'E_*' or own is not null")
    per = per.groupBy("doc", "parent").agg(F.concat_ws(",", F.sort_array(F.collect_set(F.coalesce("own", "child")))).alias("allowed"))
    return nodes.select("doc", "node", kind(F.col("environ")).alias("parent")).join(per, ["doc", "parent"], "left").select("doc", "node", F.coalesce("allowed", F.lit("")).alias("allowed"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(doc, node, up, left, right, first_child) of every child, for moving about."""
    w = Window.partitionBy("doc", "parent").orderBy("ordinal", "child")
    first = edges.groupBy("doc", "parent").agg(F.min(F.struct("ordinal", "child")).alias("f")).select("doc", F.col("parent").alias("child"), F.col("f.child").alias("first_child"))
    sides = edges.select("doc", "child", F.col("parent").alias("up"), F.lag("child").over(w).alias("left"), F.lead("child").over(w).alias("right"))
    return sides.join(first, ["doc", "child"], "left").withColumnRenamed("child", "node")


def subtree_hash(nodes: DataFrame, edges: DataFrame, visits: DataFrame, content: str = "text") -> DataFrame:
    """(doc, node, hash): md5 over a node's own text hash and its children's hashes in order, bottom-up by depth over
    the tree of first visits; ``hashes.Hashes`` keeps them up when nodes change."""
    return hashes.subtree_hashes(hashes.tree_of(nodes, visits, content)).select("doc", "node", "hash")


def dedup_content(files: DataFrame, key: str, text: str, name: str | None = None) -> DataFrame:
    """(key, hash, canonical[, stored]): equal contents share the least key as canonical member. The bytes are compared
    inside a hash: contents that only have their hash in common stay apart. With a file name column, ``stored`` is the
    name under which the content is kept, `name--hash.ext` of the canonical member."""
    own = [F.col(name).alias("name")] if name else []
    hashed = files.select(F.col(key).alias("key"), F.md5(text).alias("hash"), F.sha2(text, 512).alias("sha"), *own)
    pairs = files.select(F.col(key).alias("key"), F.md5(text).alias("hash"), F.col(text).alias("text"), *own)
    least = pairs.groupBy("hash", "text").agg(F.min(F.struct("key", *(["name"] if name else []))).alias("c"))
    least = least.select("hash", F.sha2("text", 512).alias("sha"), F.col("c.key").alias("canonical"), *([F.col("c.name").alias("kept_name")] if name else []))
    found = hashed.join(least, (hashed["hash"] == least["hash"]) & hashed["sha"].eqNullSafe(least["sha"]))
    stored = F.concat(F.regexp_replace("kept_name", r"\.[^./]*$", ""), F.lit("--"), hashed["hash"], F.regexp_extract("kept_name", r"(\.[^./]*)$", 1)) if name else None
    return found.select("key", hashed["hash"].alias("hash"), "canonical", *([F.col("name"), stored.alias("stored")] if name else []))


def rewrite_references(pages: DataFrame, aliases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): pages in which src="name" points at what aliases(name, stored) say is stored for that name; other names
    stay. A page is split at its references, so only names and places go through the join."""
    parts = pages.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r'(?<=src=")(?=[^"]*")', -1)).alias("pos", "part"))
    one = aliases.groupBy("name").agg(F.min("stored").alias("stored"))
    named = parts.where("pos > 0").withColumn("name", F.substring_index("part", '"', 1)).join(one, "name", "left")
    named = named.select("id", "pos", F.concat(F.coalesce("stored", "name"), F.substr("part", F.length("name") + 1)).alias("part"))
    # what stands before a page's first reference has no name, and takes no part in the join
    both = parts.where("pos = 0").unionByName(named)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "")
    return both.groupBy("id").agg(whole.alias("text"))


def orphans(store: DataFrame, aliases: DataFrame) -> DataFrame:
    """Stored copies(hash) that no alias(hash) refers to."""
    return store.join(aliases.select("hash").distinct(), "hash", "left_anti")
