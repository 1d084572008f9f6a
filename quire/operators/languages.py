"""Language versions of segments: derivation from mixed texts, line maps, merging, choice, and what is left to do."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.protect import protect, protected_length, restore, tokens
from quire.operators.segment import NO_ID, TEXTS

HEADER = "\\CDL"


#: What a line gets at its end that has a header elsewhere than at its beginning.
MISPLACED = "%misplaced language header"
#: Languages of nodes that aren't in one language of people.
NEUTRAL = ("mul", "und", "zxx")


def language_lines(text: Column, lang: Column) -> Column:
    """The lines of one language of a mixed text: its own without their header, and those without any, marked where a
    header stands within them; a newline at the end."""
    mine = F.concat(F.lit(HEADER), lang, F.lit(" "))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.ltrim(x).startswith(mine) | ~F.ltrim(x).startswith(HEADER))
    plain = lambda x: F.when(x.contains(HEADER), F.concat(x, F.lit(MISPLACED))).otherwise(x)
    bare = F.transform(lines, lambda x: F.when(F.ltrim(x).startswith(mine), F.substr(F.ltrim(x), F.length(mine) + 1)).otherwise(plain(x)))
    return F.concat(F.regexp_replace(F.array_join(bare, "\n"), r"\n\z", ""), F.lit("\n"))


def retarget_inputs(text: Column, old: Column, new: Column) -> Column:
    """Input paths of one language version pointed at another's."""
    return F.regexp_replace(text, F.concat(F.lit(r"((?:UUID|SEC)/[^{}]*/blob)_"), old, F.lit(r"(\.tex)?\}")), F.concat(F.lit("$1_"), new, F.lit("$2}")))


def derive(segments: DataFrame, languages: DataFrame) -> DataFrame:
    """(doc, node, lang, text): mixed segments in every language of their document, by languages(doc, lang), with two
    lines that say so on top. One scan, whatever the number of languages."""
    each = languages.where(~F.col("lang").isin(*NEUTRAL)).select("doc", "lang").distinct()
    head = F.concat(F.lit("%% -*- lang: "), F.col("lang"), F.lit(" -*-\n%% generated file, edits are lost\n"))
    rows = segments.where("lang = 'mul'").select("doc", "node", "text").join(each, "doc")
    return rows.select("doc", "node", "lang", F.concat(head, retarget_inputs(language_lines(F.col("text"), F.col("lang")), F.lit("mul"), F.col("lang"))).alias("text"))


def map_lines(segments: DataFrame, lang: str) -> DataFrame:
    """(doc, node, line, to): where each line of a mixed text stands in a language's text, both from 1; null where it
    isn't in it."""
    rows = segments.select("doc", "node", F.posexplode(F.split("text", "\n", -1)).alias("i", "x"))
    mine = F.ltrim("x").startswith(HEADER + lang) | ~F.ltrim("x").startswith(HEADER)
    w = Window.partitionBy("doc", "node").orderBy("i")
    n = F.sum(mine.cast("long")).over(w)
    return rows.select("doc", "node", (F.col("i") + 1).cast("long").alias("line"), F.when(mine, n).alias("to"))


def map_lines_back(mapped: DataFrame) -> DataFrame:
    """(doc, node, line, to): the reverse of map_lines: where each line of a language's text stands in the mixed one."""
    return mapped.where("to is not null").select("doc", "node", F.col("to").alias("line"), F.col("line").alias("to"))


def multimerge(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., place, lang, text): lines(keys..., source, lang, pos, text) of several versions merged in turn, the
    first of each, then the second of each."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "source"))
    return lines.select(*keys, place.cast("long").alias("place"), "lang", "text")


def lookahead(sources: list[list[str]], depth: int = 32, names: list[str] | None = None, together: bool = False) -> list[tuple[list[int], str]]:
    """Lines of several versions merged. When all versions that go on have the same next line, it comes once, with the
    numbers of them all. Otherwise one version gives its line alone: the one whose lines ahead hold the nearest copy of
    another version's next line, so that the copy comes nearer; ties go by the versions' names. With ``together`` all
    versions that have that line next give it, so that each line comes with the set of its owners."""
    names = names or [f"{k:06d}" for k in range(len(sources))]
    at, out = [0] * len(sources), []
    live = [k for k, s in enumerate(sources) if s]
    places: list[dict[str, list[int]]] = [{} for _ in sources]
    for s, own in zip(sources, places, strict=True):
        for i, line in enumerate(s):
            own.setdefault(line, []).append(i)
    while live:
        heads = {k: sources[k][at[k]] for k in live}
        if len(live) == 1 or len(set(heads.values())) > 1:
            gives = live[0]
            if len(live) > 1:
                gives = min((_distance(places[z], at[z], heads[k], depth), names[z], names[k], z) for k in live for z in live if z != k)[3]
            owners = [k for k in live if heads[k] == heads[gives]] if together else [gives]
        else:
            owners = live
        out.append((owners, heads[owners[0]]))
        for k in owners:
            at[k] += 1
        live = [k for k in live if at[k] < len(sources[k])]
    return out


def _distance(places: dict[str, list[int]], at: int, wanted: str, depth: int) -> int:
    """How many lines stand before a copy of ``wanted`` after the next line; more than the depth if there is none. The
    lines' places are known, in order."""
    own = places.get(wanted)
    if own is None or own[-1] <= at:
        return depth + 1
    i = own[bisect_right(own, at)]
    return i - at - 1 if i < at + depth else depth + 1


def _by_node(texts: DataFrame) -> DataFrame:
    """(doc, node, langs, texts): the language versions of each node, a few texts of one segment, by language."""
    ordered = F.sort_array(F.collect_list(F.struct("lang", "text")))
    return texts.groupBy("doc", "node").agg(ordered.alias("v")).select("doc", "node", F.transform("v", lambda x: x["lang"]).alias("langs"), F.transform("v", lambda x: x["text"]).alias("texts"))


def _merged(per: DataFrame, of: Callable[[list[str], list[str]], list[tuple]], columns: str) -> DataFrame:
    """(doc, node, columns...): the rows that ``of`` makes of each node's languages and texts, some nodes at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                made = [of(langs, texts) for langs, texts in zip(batch.column("langs").to_pylist(), batch.column("texts").to_pylist(), strict=True)]
                ids = batch.select(["doc", "node"]).take(pa.array([i for i, rows in enumerate(made) for _ in rows], pa.int64()))
                cells = [pa.array([row[k] for rows in made for row in rows], kinds[kind]) for k, kind in enumerate(own.values())]
                yield pa.RecordBatch.from_arrays([*ids.columns, *cells], names=["doc", "node", *own])

    own = dict(x.split() for x in columns.split(","))
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return per.mapInArrow(merge, f"doc {per.schema['doc'].dataType.simpleString()}, node {per.schema['node'].dataType.simpleString()}, {columns}")


def multimerge_lookahead(texts: DataFrame, depth: int = 32, together: bool = False) -> DataFrame:
    """(doc, node, place, langs, text, common) from texts(doc, node, lang, text): the language versions of each node merged
    with common lines once; ``common`` tells that all versions of the node have the line. A node's versions are a few
    texts of one segment; a merge is sequential within a node."""

    def rows(langs: list[str], all_: list[str]) -> list[tuple]:
        merged = lookahead([t.split("\n") for t in all_], depth, langs, together)
        return [(i, ",".join(langs[k] for k in own), line, len(own) == len(langs)) for i, (own, line) in enumerate(merged)]

    return _merged(_by_node(texts), rows, "place long, langs string, text string, common boolean")


def to_mul(segments: DataFrame) -> DataFrame:
    """(doc, node, lang, text): all versions of each node as one mixed text, from which ``from_mul`` gets each version back.
    Of a node in one language, lines that aren't blank get its header; of several, they are merged: lines of all of
    them get no header, others come once with the header of each version that has them. Lines with a header of their own in
    them always get one more. Input paths are pointed at the mixed versions. A node's versions come together once, and
    its merged text is put together where they are merged."""
    own = segments.select("doc", "node", "lang", retarget_inputs(F.col("text"), F.col("lang"), F.lit("mul")).alias("text"))
    per = _by_node(own)
    header = F.concat(F.lit(HEADER), F.get("langs", F.lit(0)), F.lit(" "))
    tagged = F.transform(F.split(F.get("texts", F.lit(0)), "\n", -1), lambda x: F.when(F.trim(x) == "", x).otherwise(F.concat(header, x)))
    one = per.where(F.size("langs") == 1).select("doc", "node", F.array_join(tagged, "\n").alias("text"))

    def whole(langs: list[str], all_: list[str]) -> list[tuple]:
        lines = []
        for own, line in lookahead([t.split("\n") for t in all_], names=langs, together=True):
            common = len(own) == len(langs) and HEADER not in line
            lines += [line] if common else [f"{HEADER}{langs[k]} {line}" for k in own]
        return [("\n".join(lines),)]

    many = _merged(per.where(F.size("langs") > 1), whole, "text string")
    return one.unionByName(many).select("doc", "node", F.lit("mul").alias("lang"), "text")


def from_mul(segments: DataFrame, languages: DataFrame) -> DataFrame:
    """(doc, node, lang, text): mixed segments as versions in each of the document's languages to be kept by hand: what
    ``derive`` makes, without the lines that call it generated."""
    return derive(segments, languages).withColumn("text", F.regexp_replace("text", r"^%% -\*- lang: .* -\*-\n%% generated file.*\n", ""))


def complete(segments: DataFrame, languages: DataFrame) -> DataFrame:
    """(doc, node): nodes that have a version in every language of languages(doc, lang), which is when they can turn into
    mixed ones."""
    wanted = languages.where(~F.col("lang").isin(*NEUTRAL)).select("doc", "lang").distinct()
    n = wanted.groupBy("doc").agg(F.count(F.lit(1)).alias("wanted"))
    have = segments.join(wanted, ["doc", "lang"], "left_semi").groupBy("doc", "node").agg(F.countDistinct("lang").alias("have"))
    return have.join(n, "doc").where("have = wanted").select("doc", "node")


def untranslated_chars(nodes: DataFrame, languages: list[str]) -> DataFrame:
    """(doc, chars): characters to translate of each document: of a node's first version, with its markup as codes of
    private characters, times the languages it lacks."""
    lack = F.size(F.array_except(F.array(*map(F.lit, languages)), "langs"))
    hidden = nodes.where(lack > 0).select("doc", lack.alias("lack"), protected_length(F.col("text"), tokens(F.col("text"))).alias("size"))
    found = hidden.groupBy("doc").agg(F.sum(F.col("size") * F.col("lack")).cast("long").alias("chars"))
    return nodes.select("doc").distinct().join(found, "doc", "left").select("doc", F.coalesce("chars", F.lit(0)).alias("chars"))


def choose_version(requests: DataFrame, segments: DataFrame, weights: DataFrame) -> DataFrame:
    """(request, doc, node, lang, ext): the version of a node that a request gets, null if there is none.

    requests(request, user_id, doc, node, want, want_ext, edit), segments(doc, node, lang, ext), weights(user_id, lang,
    weight). A language or extension that is asked for must be there. Else the language with the most weight for the user
    comes first, then the first by code; of extensions pictures that scale, then pixels, pages and others. To edit a node
    that has a mixed version is to edit that one, whatever language was asked for."""
    versions = segments.select("doc", "node", "lang", "ext")
    mixed = versions.where("lang = 'mul'").select("doc", "node").distinct().withColumn("mixed", F.lit(True))
    asked = requests.join(mixed, ["doc", "node"], "left").withColumn("want", F.when(F.col("edit") & F.col("mixed"), F.lit("mul")).otherwise(F.col("want")))
    fits = (F.col("want").isNull() | (F.col("want") == F.col("lang"))) & (F.col("want_ext").isNull() | (F.col("want_ext") == F.col("ext")))
    able = asked.join(versions, ["doc", "node"]).where(fits).join(weights, ["user_id", "lang"], "left")
    rank = F.when(F.col("ext") == ".svg", 2).when(F.col("ext").isin(".jpg", ".jpeg", ".png", ".tif", ".tiff", ".gif"), 4).when(F.col("ext") == ".pdf", 7).otherwise(10)
    order = F.struct(-F.coalesce("weight", F.lit(0.0)), "lang", rank, "ext")
    best = able.groupBy("request").agg(F.min_by(F.struct("lang", "ext"), order).alias("b"))
    return requests.join(best, "request", "left").select("request", "doc", "node", "b.lang", "b.ext")


def valid_languages(langs: Column) -> Column:
    """A language list without malformed codes."""
    return F.filter(langs, lambda x: x.rlike("^[a-z]{3}$"))


def malformed_languages(rows: DataFrame, langs: str = "langs") -> DataFrame:
    """The rows whose language list has malformed codes, with ``bad``, those codes."""
    return rows.withColumn("bad", F.array_except(langs, valid_languages(F.col(langs)))).where(F.size("bad") > 0)


def prologue_length(lang: Column, environ: Column) -> Column:
    """Lines of a stored segment that editors don't see: two if it is mixed, and one for the id or a heading, which
    environs without an id don't have."""
    return F.when(lang == "mul", 2).otherwise(0) + F.when(environ.isin(*NO_ID), 0).otherwise(1)


def add_language(segments: DataFrame, source: str, new: str) -> DataFrame:
    """Segments with copies of one language's versions under another, where there are none yet."""
    have = segments.where(F.col("lang") == new).select("doc", "node")
    return segments.unionByName(segments.where(F.col("lang") == source).join(have, ["doc", "node"], "left_anti").withColumn("lang", F.lit(new)))


def relabel(segments: DataFrame, old: str, new: str) -> DataFrame:
    return segments.withColumn("lang", F.when(F.col("lang") == old, new).otherwise(F.col("lang")))


def drop_language(segments: DataFrame, lang: str) -> DataFrame:
    """Segments without a language's versions, except where a node has no other."""
    others = segments.where(F.col("lang") != lang).select("doc", "node").distinct().withColumn("o", F.lit(True))
    return segments.join(others, ["doc", "node"], "left").where((F.col("lang") != lang) | F.col("o").isNull()).drop("o")


def translate(segments: DataFrame, translator, old: str, new: str) -> DataFrame:
    """(doc, node, lang, text): versions in a new language by ``translator(text, old, new)``, a function of the caller's
    that works on a worker; markup is protected on the way."""
    rows = segments.where(F.col("lang") == old).withColumn("toks", tokens(F.col("text"))).select("doc", "node", "toks", protect(F.col("text"), F.col("toks")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                text = pa.array([translator(t, old, new) for t in batch.column(at).to_pylist()], whole.schema.field(at).type)
                yield batch.set_column(at, whole.schema.field(at), text)

    done = rows.mapInArrow(run, rows.schema)
    return done.select("doc", "node", F.lit(new).alias("lang"), restore(F.col("text"), F.col("toks")).alias("text"))
