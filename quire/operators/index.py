"""The back-of-book index, catalogs and search."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.ids import id_to_int, strip_delims
from quire.functions.text import dedollarize, symbols_to_unicode
from quire.operators import tree
from quire.operators.numbering import number_within
from quire.scratch import written


#: What a quote protects, hidden under control characters while an argument is taken apart.
_HIDDEN = {'"!': "\x01", '"@': "\x02", '"|': "\x03"}


def entries(attrs: DataFrame) -> DataFrame:
    """(doc, node, lang, sortkey, key, see, value, text_class) of all index attributes; lang is '' for plain ones. Arguments
    are `a!b`, `sort@key`, `key|see{x}`, `key|textbf`, `key|(` and `key|)`; a quote protects ! @ and |. Formulas in keys
    are told by \\( and \\), and macros of symbols become the symbols."""
    rows = attrs.where(F.col("key").rlike("M_index(L[a-z]{3})?$"))
    s = strip_delims(F.col("value"))
    s = F.when(s.contains("$"), dedollarize(s)).otherwise(s)
    for a, b in _HIDDEN.items():
        s = F.replace(s, F.lit(a), F.lit(b))

    def show(c: Column) -> Column:
        for a, b in _HIDDEN.items():
            c = F.replace(c, F.lit(b), F.lit(a[1]))
        return c

    # one step after the other, so that no expression is repeated in the next
    rows = rows.select("doc", "node", F.regexp_extract("key", "M_index(?:L([a-z]{3}))?$", 1).alias("lang"), F.split(s, r"\|", 2).alias("p"))
    rows = rows.select("doc", "node", "lang", F.split(F.get("p", F.lit(0)), "@", 2).alias("e"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("suffix"))
    shown = lambda c: show(F.regexp_replace(c, "!", ", "))
    rows = rows.select("doc", "node", "lang", "suffix", shown(F.get("e", F.lit(0))).alias("sortkey"), shown(F.get("e", F.lit(1))).alias("key"))
    named = lambda c: F.when(F.contains(c, F.lit("\\")), symbols_to_unicode(F.col(c))).otherwise(F.col(c))
    rows = rows.select("doc", "node", "lang", "suffix", named("sortkey").alias("sortkey"), named("key").alias("key"))
    suffix = F.col("suffix")
    mark = F.when(suffix.isin("(", ")"), suffix).otherwise("")
    style = F.when(suffix == "textbf", "font-weight-bold").when(suffix.isin("emph", "textit", "textsl"), "font-italic").otherwise("")
    see = show(F.regexp_extract("suffix", r"^see(?:also)?\{(.*)\}$", 1))
    return rows.select("doc", "node", "lang", "sortkey", F.coalesce("key", "sortkey").alias("key"), see.alias("see"), mark.alias("value"), style.alias("text_class"))


def ranges(entry: DataFrame, visits: DataFrame) -> DataFrame:
    """(doc, node, lang, key): nodes below one that opens and closes a range of a key, by the visits of a walk."""
    k = ["doc", "node", "lang", "key"]
    marks = entry.where("value in ('(', ')')").groupBy(*k).agg(F.countDistinct("value").alias("n"))
    both = written(marks.where("n = 2").drop("n"), "ranges")
    return both.join(tree.below(both, visits), ["doc", "node"]).select("doc", F.col("descendant").alias("node"), "lang", "key").distinct()


def unpaired(entry: DataFrame) -> DataFrame:
    """(doc, node, lang, key, value): range marks without a partner in their node."""
    k = ["doc", "node", "lang", "key"]
    marks = entry.where("value <> ''").select(*k, "value").distinct()
    lone = marks.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value")).where("n = 1")
    return lone.drop("n")


def range_attrs(attrs: DataFrame, visits: DataFrame) -> DataFrame:
    """``attrs`` with range marks made anew: old rangeindex rows go, and every node below one that opens and closes a range
    of a key gets (rangeindex[Lxxx], key)."""
    below = ranges(entries(attrs), visits)
    key = F.concat(F.lit("rangeindex"), F.when(F.col("lang") == "", "").otherwise(F.concat(F.lit("L"), F.col("lang"))))
    return attrs.where(~F.col("key").startswith("rangeindex")).select("doc", "node", "key", "value").unionByName(below.select("doc", "node", key.alias("key"), F.col("key").alias("value")))


def range_entries(below: DataFrame) -> DataFrame:
    """Entries like those of ``entries`` for the nodes within a range, as ``ranges`` gives them, with a dash for value."""
    none = F.lit("")
    return below.select("doc", "node", "lang", F.col("key").alias("sortkey"), "key", none.alias("see"), F.lit("\u2014").alias("value"), none.alias("text_class"))


def book_index(entry: DataFrame, visible: DataFrame, lang: str | None = None) -> DataFrame:
    """(user_id, doc, lang, sortkey, key, place, node, marker): each entry's places in document order, a row for each,
    since a key may have any number. visible(user_id, is_editor, doc, node, order_in_document) are the nodes that users
    may view. Markers: `see x`, the node, a dash within a range, `n and following` where one begins, and, for editors
    alone, `up to n` where it ends. With a language, its entries and those of any."""
    rows = entry if lang is None else entry.where(F.col("lang").isin("", lang))
    node = F.col("node").cast("string")
    marker = F.when(F.col("see") != "", F.concat(F.lit("see "), "see")).when(F.col("value") == "(", F.concat(node, F.lit(" and following"))).when(F.col("value") == ")", F.concat(F.lit("up to "), node)).when(F.col("value") != "", F.col("value")).otherwise(node)
    placed = rows.withColumn("marker", marker).join(visible, ["doc", "node"]).where("value <> ')' or is_editor")
    placed = placed.select("user_id", "doc", "lang", "sortkey", "key", "order_in_document", "node", "marker").distinct()
    keys = ["user_id", "doc", "lang", "sortkey", "key"]
    return number_within(placed, keys, ["order_in_document", "node", "marker"], "place").drop("order_in_document")


def merge_index(index: DataFrame, lang: str) -> DataFrame:
    """(doc, lang, sortkey, key, note): plain entries join a language that the document's index has; with a note where
    the entry is sorted as something else."""
    has = index.where(F.col("lang") == lang).select("doc").distinct().withColumn("has", F.lit(True))
    new = F.when((F.col("lang") == "") & F.col("has"), F.lit(lang)).otherwise(F.col("lang"))
    merged = index.join(has, "doc", "left").select("doc", new.alias("lang"), "sortkey", "key").distinct()
    return merged.withColumn("note", F.when(F.col("sortkey") != F.col("key"), F.concat(F.lit("sorted as "), F.col("sortkey"))))


def node_index(entry: DataFrame) -> DataFrame:
    """(doc, node, lang, key): each node's entries once."""
    return entry.select("doc", "node", "lang", "key").distinct()


def node_bibliography(citations: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, node, value, item, number): citations joined to items(doc, value, item, number)."""
    return citations.where("key = 'M_cite'").select("doc", "node", "value").distinct().join(items, ["doc", "value"])


def anchor_map(pages: DataFrame, id_col: str, html_col: str, placeholder: str) -> DataFrame:
    """(id, target, anchor): where in the pages the nodes stand that links to the placeholder name: the last name= or id=
    before the first link to each, null if there is none."""
    pattern = r'(?s)<[A-Za-z][^>]*?\s(?:name|id|href)="[^"]*"'
    tags = pages.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(html_col, F.lit(pattern), 0)).alias("pos", "tag"))
    name = F.regexp_extract("tag", r'\s(?:name|id)="([^"]*)"$', 1)
    last = F.last(F.when(name != "", name), True).over(Window.partitionBy("id").orderBy("pos"))
    target = F.regexp_extract("tag", r'href="' + re.escape(placeholder) + r'([^"/#?]*)', 1)
    return tags.select("id", "pos", last.alias("anchor"), target.alias("target")).where("target <> ''").groupBy("id", "target").agg(F.min_by("anchor", "pos").alias("anchor"))


def languages_of_catalog(segments: DataFrame, languages: DataFrame) -> DataFrame:
    """Segments to be put in a catalog: mixed ones count for each of their document's languages(doc, lang)."""
    each = languages.where("lang not in ('mul', 'und', 'zxx')").select("doc", F.col("lang").alias("__lang")).distinct()
    mixed = segments.where("lang = 'mul'").join(each, "doc").withColumn("lang", F.col("__lang")).drop("__lang")
    return segments.where("lang <> 'mul'").unionByName(mixed.select(*segments.columns))


def replace_lines(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """A catalog in which the lines of each (doc, node, lang) of ``new`` are those of ``new``."""
    return catalog.join(new.select("doc", "node", "lang").distinct(), ["doc", "node", "lang"], "left_anti").unionByName(new)


def build_catalog(segments: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """(ids..., line, text): every line of a text that isn't blank, numbered from 0 with blank ones counted."""
    return segments.select(*id_cols, F.posexplode(F.split(text_col, "\n", -1)).alias("line", "text")).where(F.trim("text") != "")


#: Terms of at most so many characters in all go to each task at once; more are matched in blocks of that size.
TERM_BLOCK = 4 << 20


def find_terms(rows: DataFrame, text: Column, terms: DataFrame) -> DataFrame:
    """``rows`` with ``term``, a row for each distinct term(term) that ``text`` contains. All terms are looked for in one
    pass over a text, by an automaton that is built once in each task; terms are a stated query set, and if there are more
    than fit a block, the rows are read once for each block. Null and empty terms are found nowhere."""
    import ahocorasick  # noqa: F401  (a missing matcher shows here, not in a task)

    wanted = terms.select("term").where("term <> ''").distinct()
    size = wanted.agg(F.sum(F.length("term"))).first()[0] or 0
    blocks = size // TERM_BLOCK + 1
    names = [*rows.columns, "__terms"]
    fields = ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, ("__terms", "array<string>")])
    out = None
    for k in range(blocks):
        own = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k)
        shared = rows.sparkSession.sparkContext.broadcast(sorted(r.term for r in own.collect()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for t in shared.value:
                automaton.add_word(t, t)
            if shared.value:
                automaton.make_automaton()
            for batch in batches if shared.value else ():
                found = [sorted({t for _, t in automaton.iter(x)}) if x else [] for x in batch.column(batch.num_columns - 1).to_pylist()]
                hits = batch.take(pa.array([i for i, own in enumerate(found) if own], pa.int64()))
                yield pa.RecordBatch.from_arrays([*hits.columns[:-1], pa.array([own for own in found if own], pa.list_(pa.string()))], names)

        # a row goes back once, however many terms it has
        part = rows.withColumn("__text", text).mapInArrow(run, fields).select(*rows.columns, F.explode("__terms").alias("term"))
        out = part if out is None else out.unionByName(part)
    return out


def search_catalog(catalog: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Catalog rows that contain a term(term) without regard to case and number of spaces, with the term as it was."""
    plain = terms.select("term", F.regexp_replace(F.lower("term"), r"\s+", " ").alias("__low")).distinct()
    hits = find_terms(catalog, F.lower(F.col(text)), plain.select(F.col("__low").alias("term"))).withColumnRenamed("term", "__low")
    return hits.join(plain, "__low").drop("__low")


def search_ids(nodes: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, doc, node): tokens of 3 to 8 characters that are an existing node's id."""
    able = tokens.where(F.length("token").between(3, 8)).select("token", id_to_int(F.col("token")).alias("node")).where("node is not null")
    return nodes.select("doc", "node").join(able, "node").select("token", "doc", "node")


def search_attrs(attrs: DataFrame, tokens: DataFrame, suffixes: tuple) -> DataFrame:
    """(token, doc, node, key, value): attributes whose key ends so and whose value contains the token, case and all."""
    kinds = F.lit(False)
    for x in suffixes:
        kinds = kinds | F.col("key").endswith(x)
    hits = find_terms(attrs.where(kinds), F.col("value"), tokens.select(F.col("token").alias("term")))
    return hits.select(F.col("term").alias("token"), "doc", "node", "key", "value")


def search_index(entry: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, doc, node, lang, key): index entries whose key contains the token."""
    hits = find_terms(entry.select("doc", "node", "lang", "key"), F.col("key"), tokens.select(F.col("token").alias("term")))
    return hits.select(F.col("term").alias("token"), "doc", "node", "lang", "key").distinct()


#: A function from requests(user_id, perm, doc, node) to the same with ``ok``, such as ``access.allowed`` of a corpus.
Rights = Callable[[DataFrame], DataFrame]


def _seen(hits: DataFrame, rights: Rights) -> DataFrame:
    """The rows of hits(user_id, perm, doc, node, ...) whose user has the right."""
    k = ["user_id", "perm", "doc", "node"]
    return hits.join(rights(hits.select(*k).distinct()).where("ok").select(*k), k, "left_semi").drop("perm")


def _forms(tokens: DataFrame) -> DataFrame:
    """(token, term, lines): what a token is looked for by in catalog lines, without regard to case and number of spaces, and
    in keys and values, as it is."""
    low = F.regexp_replace(F.lower("token"), r"\s+", " ")
    return tokens.select("token", low.alias("term"), F.lit(True).alias("lines")).unionByName(tokens.select("token", F.col("token").alias("term"), F.lit(False).alias("lines")))


def search_text(catalog: DataFrame, entry: DataFrame, asked: DataFrame, rights: Rights) -> DataFrame:
    """(user_id, token, doc, node, lang, line, text): what users find of asked(user_id, token) in catalog(doc, node, lang,
    line, text), in nodes that they may view; and, once for each node and language with a hit, a line -1 for each key
    under which the token also stands in the node's index (keys of no language count for every one).

    Lines and keys go through the matcher together, each in the form that it is compared in. Rights are asked once for
    each user and node with a hit."""
    asked = asked.select("user_id", "token").distinct()
    tokens = asked.select("token").distinct()
    forms = _forms(tokens)
    lines = catalog.select("doc", "node", "lang", F.col("line").cast("long").alias("line"), "text", F.lit(True).alias("lines"))
    keys = entry.select("doc", "node", "lang", F.lit(-1).cast("long").alias("line"), F.col("key").alias("text"), F.lit(False).alias("lines")).distinct()
    shown = F.when(F.col("lines"), F.lower("text")).otherwise(F.col("text"))
    hits = find_terms(lines.unionByName(keys), shown, forms.select("term")).join(forms, ["term", "lines"]).drop("term")
    hits = written(hits.join(asked, "token"), "hits")
    found = hits.where("lines").drop("lines")
    may = rights(found.select("user_id", F.lit("view_view").alias("perm"), "doc", "node").distinct()).where("ok").select("user_id", "doc", "node")
    seen = found.join(may, ["user_id", "doc", "node"], "left_semi").select("user_id", "token", "doc", "node", "lang", "line", "text")
    also = seen.select("user_id", "token", "doc", "node", "lang").distinct()
    also = also.join(hits.where("not lines").select("user_id", "token", "doc", "node", F.col("lang").alias("key_lang"), F.col("text").alias("key")), ["user_id", "token", "doc", "node"]).where("key_lang = '' or key_lang = lang")
    also = also.select("user_id", "token", "doc", "node", "lang", F.lit(-1).cast("long").alias("line"), F.concat(F.lit("also indexed by key: "), "key").alias("text")).distinct()
    return seen.unionByName(also)


def search(nodes: DataFrame, attrs: DataFrame, catalog: DataFrame, asked: DataFrame, users: DataFrame, rights: Rights) -> DataFrame:
    """(user_id, token, kind, doc, node, jump): hits of all kinds for asked(user_id, token); tokens of one character are
    refused. Ids are shown to all; index entries and text with the right to view_view; labels, references and other
    metadata with view_blob, to those of users(user_id, logged_in) who are logged in. ``jump`` tells that a user's token
    has one hit alone, which is an id."""
    asked = asked.where(F.length("token") > 1).select("user_id", "token").distinct()
    tokens = asked.select("token").distinct()
    ends = lambda *x: F.col("key").rlike(f"M_({'|'.join(x)})$")
    kind = F.when(ends("label"), "label").when(ends("ref", "eqref", "pageref"), "ref").when(F.col("key").contains("M_") & ~ends("index(L[a-z]{3})?"), "meta")
    rows = attrs.select("doc", "node", kind.alias("kind"), F.col("value").alias("shown")).where("kind is not null")
    rows = rows.unionByName(entries(attrs).select("doc", "node", F.lit("index").alias("kind"), F.col("key").alias("shown")).distinct())
    rows = rows.unionByName(catalog.select("doc", "node", F.lit("text").alias("kind"), F.lower("text").alias("shown")))
    hits = find_terms(rows, F.col("shown"), _forms(tokens).select("term")).withColumn("lines", F.col("kind") == "text")
    found = hits.join(_forms(tokens), ["term", "lines"]).select("token", "kind", "doc", "node").distinct()
    perm = F.when(F.col("kind").isin("index", "text"), "view_view").otherwise("view_blob")
    wanted = found.withColumn("perm", perm).join(asked, "token").join(users.select("user_id", "logged_in"), "user_id").where("perm = 'view_view' or logged_in").drop("logged_in")
    ids = search_ids(nodes, tokens).select("token", F.lit("id").alias("kind"), "doc", "node").distinct().join(asked, "token")
    hits = written(_seen(wanted, rights).select("user_id", "token", "kind", "doc", "node").unionByName(ids.select("user_id", "token", "kind", "doc", "node")), "hits")
    per = hits.groupBy("user_id", "token").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("kind") == "id").alias("id"))
    return hits.join(per, ["user_id", "token"]).select("user_id", "token", "kind", "doc", "node", (F.col("id") & (F.col("n") == 1)).alias("jump"))


def resolve_refs(attrs: DataFrame, printed: DataFrame) -> DataFrame:
    """(doc, node, key, value, target, shown): references and what is shown in their place.

    A value {UUID:x} is the node x. Else the least other node of the document that has the label is the target; null
    where there is none, and labels of the same node are no targets. A label of a whole node shows the node; one within
    an environment its printed number by printed(doc, node, label, number), the target's own if it has one; eqref puts it
    in parentheses."""
    kinds = F.col("key").endswith("M_ref") | F.col("key").endswith("M_eqref") | F.col("key").endswith("M_pageref")
    refs = attrs.where(kinds).select("doc", "node", "key", "value").distinct()
    labels = attrs.where(F.col("key").endswith("M_label")).select("doc", F.col("node").alias("at"), "value", F.col("key").alias("label_key"))
    best = refs.join(labels, ["doc", "value"]).where("at <> node").groupBy("doc", "node", "key", "value").agg(F.min(F.struct("at", "label_key")).alias("b"))
    found = refs.join(best, ["doc", "node", "key", "value"], "left")
    own = printed.select("doc", F.col("node").alias("at"), F.col("label").alias("value"), "number").groupBy("doc", "at", "value").agg(F.min("number").alias("own"))
    any_ = printed.groupBy("doc", F.col("label").alias("value")).agg(F.min("number").alias("any"))
    found = found.select("*", F.col("b.at").alias("at"), F.col("b.label_key").alias("label_key")).drop("b").join(own, ["doc", "at", "value"], "left").join(any_, ["doc", "value"], "left")
    number = F.coalesce("own", "any")
    number = F.when(F.col("key").endswith("M_eqref"), F.concat(F.lit("("), number, F.lit(")"))).otherwise(number)
    told = F.regexp_extract("value", r"^\{UUID:\s*([^{}]*?)\s*\}$", 1)
    target = F.when(told != "", told).otherwise(F.col("at").cast("string"))
    shown = F.when(told != "", told).when(F.col("label_key") == "M_label", F.col("at").cast("string")).otherwise(F.coalesce(number, F.col("at").cast("string")))
    return found.select("doc", "node", "key", "value", target.alias("target"), shown.alias("shown"))


def bibliography_nodes(nodes: DataFrame, staff: DataFrame) -> DataFrame:
    """(user_id, doc, node): bibliographies of a document, all for editors and the first for others;
    staff(user_id, doc, is_editor)."""
    rows = nodes.where(F.col("environ").contains("bibliography")).select("doc", "node")
    first = rows.groupBy("doc").agg(F.min("node").alias("first"))
    return staff.join(rows.join(first, "doc"), "doc").where("is_editor or node = first").select("user_id", "doc", "node")
