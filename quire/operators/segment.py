"""Segmentation of marked-up files, and putting segments together again.

Markers and braces are found by one regular expression: a sentinel goes before each, the text is split at sentinels, and a
stack in the task that has the text matches its braces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import tree
from quire.operators.numbering import last_before, number_within
from quire.plans.rules import SECTIONS
from quire.scratch import moved, written

COMMANDS = ("label", "ref", "eqref", "pageref", "index", "indexLeng", "indexLita", "cite", "author", "uuid", "replaces")
INPUTS = ("input", "include", "includegraphics", "bibliography", "usepackage")
VERBATIM = ("verbatim", "Filesave")
OPTION = r"\[[^\]]*\]"
BEGIN_OPTION = r"^\\begin\{[A-Za-z*]+\}\[([^\]]*)\]"
BEGIN_HEAD = r"^\\begin\{[A-Za-z*]+\}(?:" + OPTION + ")?"
_NAME = r"^[A-Za-z]+$"
_MACRO, _ENDS, _BEGIN_OPTION = re.compile(r"\\([A-Za-z]+)"), re.compile(r"\\(?:begin|end)\{([A-Za-z*]+)\}"), re.compile(BEGIN_OPTION)
#: Texts whose pieces are in memory together.
TEXTS = 256


def braced(levels: int = 8) -> str:
    """A regular expression of a text in braces, with so many levels of braces in it, for places where a text's beginning is
    told by one expression. Its loops are possessive, so that Java runs them without recursion."""
    inner = "[^{}]*+"
    for _ in range(levels):
        inner = rf"[^{{}}]*+(?:\{{{inner}\}}[^{{}}]*+)*+"
    return rf"\{{({inner})\}}"


def marker_pattern(commands: tuple | Column = COMMANDS, sections: tuple = SECTIONS, inputs: tuple = INPUTS, verbatim: tuple | Column = VERBATIM) -> Column:
    """The regular expression of what texts are cut at: in group 1 verbatim bodies, whole, markers without their arguments,
    and braces; in group 2 a backslash with a character that it takes away the meaning of; else it matches a comment.
    Commands and verbatim bodies may be arrays of names in columns, so that each row has rules of its own."""
    body = r"\\begin\{%s\*?\}(?s:.*?)\\end\{%s\*?\}|"
    if isinstance(verbatim, Column):
        known = F.filter(verbatim, lambda v: v.rlike(_NAME))
        bodies = F.array_join(F.transform(known, lambda v: F.format_string(body, v, v)), "")
    else:
        bodies = F.lit("".join(body % (v, v) for v in verbatim))
    always = "|".join([*sections, *inputs])
    if isinstance(commands, Column):
        with_arg = F.array_join(F.concat(F.array(F.lit(always)), F.filter(commands, lambda v: v.rlike(_NAME))), "|")
    else:
        with_arg = F.lit("|".join([always, *commands]))
    verb = r"\\verb\*?(?:\|[^|\n]*\||\+[^+\n]*\+|![^!\n]*!|/[^/\n]*/)"
    ends = rf"|\\(?:begin|end)\{{[A-Za-z*]+\}}(?:{OPTION})?|\\(?:"
    return F.concat(F.lit("("), bodies, F.lit(verb + ends), with_arg, F.lit(rf")\*?(?:{OPTION})*+(?=\{{)|\\(?:item|par)\b|[{{}}])|(\\[^A-Za-z])|%[^\n]*"))


def drop_comments(c: Column) -> Column:
    """Text without comments: from a percent sign that no backslash precedes to the end of its line."""
    return F.regexp_replace(c, r"(\\[\\%])|%[^\n]*", "$1")


def _pieces(parts: list[str], bodies: list[str]) -> list[tuple]:
    """(pos, macro, arg, opt, raw, size, unclosed, depth, env) of a text that is cut at its markers and braces."""
    ends: dict[int, int] = {}
    opened: list[int] = []
    offset = [0]
    for i, raw in enumerate(parts):
        offset.append(offset[-1] + len(raw))
        if i and raw.startswith("{"):
            opened.append(i)
        elif i and raw.startswith("}") and opened:
            ends[opened.pop()] = i
    # (first part, macro, argument of a begin or end, option, the brace that ends its argument) of pieces
    starts, lost, covered = [(0, "", "", "", None)], [[]], -1
    for i, raw in enumerate(parts):
        found = _MACRO.match(raw) if i else None
        if not found:
            continue
        macro, kind = found[1], _ENDS.match(raw)
        arg = kind[1] if kind else ""
        if macro == "begin" and arg.removesuffix("*") in bodies:
            macro = "verbatim"
        head = macro not in ("begin", "end", "item", "par", "verb", "verbatim")
        end = ends.get(i + 1) if head else None
        if i >= covered:
            if head and end is None:
                lost[-1].append(macro)
            else:
                option = _BEGIN_OPTION.match(raw)
                starts.append((i, macro, arg, option[1] if option else "", end))
                lost.append([])
        covered = max(covered, end or -1)
    out, depth, kinds = [], 0, {}
    for pos, (i, macro, arg, opt, end) in enumerate(starts):
        raw = "".join(parts[i : starts[pos + 1][0] if pos + 1 < len(starts) else len(parts)])
        size = 0
        if end is not None:
            n, inner = len(parts[i]), offset[end] - offset[i + 1] - 1
            arg, size = raw[n + 1 : n + 1 + inner], n + inner + 2
        depth += (macro == "begin") - (macro == "end")
        if macro == "begin":
            kinds[depth] = arg
        out.append((pos, macro, arg, opt, raw, size, ",".join(lost[pos]), depth, kinds.get(depth) if depth > 0 else None))
    return out


def explode_deep(files: DataFrame, keys: tuple = ("doc", "node"), pattern: Column | None = None, verbatim: tuple = VERBATIM, rules: DataFrame | None = None) -> DataFrame:
    """(keys..., pos, macro, arg, opt, raw, size, unclosed, depth, env): the pieces of each text in order, comments left out; piece 0 is
    what stands before the first marker, others begin with theirs, whose length with its argument is ``size``. Verbatim bodies
    are pieces of their own with macro `verbatim`, `\\verb` ones with `verb`; what stands in them is no marker, nor is what
    stands in another marker's argument. A marker whose argument doesn't end isn't one; ``unclosed`` names those in a piece.

    ``pattern`` is one of ``marker_pattern``; or ``rules`` (doc, commands, verbatim), as ``document_rules`` makes them, gives
    each document its own. Arguments may hold any number of braces at any depth: texts are cut at each brace, and a stack
    tells what an opening one ends at. A text is one row, so that nothing is shuffled or sorted. ``depth`` and ``env`` are
    as ``with_depth`` has them for pieces from elsewhere.
    """
    rows = files
    body = F.array(*[F.lit(v) for v in verbatim])
    if rules is not None:
        own = rules.select("doc", F.col("commands").alias("__commands"), F.col("verbatim").alias("__verbatim"))
        rows = files.join(own, "doc", "left")
        body = F.coalesce("__verbatim", body)
        pattern = marker_pattern(F.coalesce("__commands", F.array(*[F.lit(v) for v in COMMANDS])), verbatim=body)
    plain = F.translate(F.col("text"), "\x01\x02", "  ")
    marked = F.replace(F.replace(F.regexp_replace(plain, marker_pattern() if pattern is None else pattern, F.lit("\x01$1\x02$2")), F.lit("\x01\x02"), F.lit("")), F.lit("\x02"), F.lit(""))
    rows = rows.select(*keys, body.alias("__body"), F.split(marked, "\x01", -1).alias("__parts")).where("__parts is not null")
    kinds = pa.schema([pa.field(name, kind) for name, kind in (("pos", pa.int64()), ("macro", pa.string()), ("arg", pa.string()), ("opt", pa.string()), ("raw", pa.string()), ("size", pa.int32()), ("unclosed", pa.string()), ("depth", pa.int64()), ("env", pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                at, out = [], []
                for i, (own, parts) in enumerate(zip(batch.column("__body").to_pylist(), batch.column("__parts").to_pylist(), strict=True)):
                    made = _pieces(parts, own)
                    out += made
                    at += [i] * len(made)
                ids = batch.select(list(keys)).take(pa.array(at, pa.int64()))
                columns = [pa.array([x[k] for x in out], f.type) for k, f in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*ids.columns, *columns], names=[*keys, *kinds.names])

    of_keys = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{of_keys}, pos long, macro string, arg string, opt string, raw string, size int, unclosed string, depth long, env string")


def explode_markers(files: DataFrame, keys: tuple = ("doc", "node"), pattern: Column | None = None, verbatim: tuple = VERBATIM, rules: DataFrame | None = None) -> DataFrame:
    """The pieces of ``explode_deep`` without the environments around them."""
    return explode_deep(files, keys, pattern, verbatim, rules).drop("depth", "env")


def document_rules(rules: DataFrame) -> DataFrame:
    """(doc, commands, verbatim, splits) from rules(doc, name, value): each document's metadata_command names,
    verbatim_environment names and split_environment names; null where it has none, which means the usual ones."""
    named = lambda n: F.collect_set(F.when(F.col("name") == n, F.col("value")))
    per = rules.where(F.col("value").rlike(_NAME)).groupBy("doc").agg(*[named(n).alias(a) for n, a in (("metadata_command", "commands"), ("verbatim_environment", "verbatim"), ("split_environment", "splits"))])
    return per.select("doc", *[F.when(F.size(c) > 0, F.sort_array(c)).alias(c) for c in ("commands", "verbatim", "splits")])


def with_depth(pieces: DataFrame, keys: tuple = ("doc", "node")) -> DataFrame:
    """Pieces with ``depth``, the environments open after the marker, and ``env``, the innermost one."""
    step = F.when(F.col("macro") == "begin", 1).when(F.col("macro") == "end", -1).otherwise(0)
    deep = pieces.withColumn("depth", F.sum(step).over(Window.partitionBy(*keys).orderBy("pos")))
    opened = F.when(F.col("macro") == "begin", F.col("arg"))
    env = F.last(opened, True).over(Window.partitionBy(*keys, "depth").orderBy("pos"))
    return deep.withColumn("env", F.when(F.col("depth") > 0, env))


def attributes(deep: DataFrame, commands: tuple = COMMANDS) -> DataFrame:
    """(doc, node, key, value): metadata commands (SEG-13's scope prefix: the innermost environment in the key)."""
    key = F.concat(F.when(F.col("env").isNotNull(), F.concat(F.lit("S_E_"), "env", F.lit("_"))).otherwise(""), F.lit("M_"), "macro")
    return deep.where(F.col("macro").isin(*commands)).select("doc", "node", key.alias("key"), F.concat(F.lit("{"), F.regexp_replace("arg", "\n", " "), F.lit("}")).alias("value"))


def unbalanced(deep: DataFrame) -> DataFrame:
    """(doc, node, lowest, final): texts that close what isn't open, or leave something open."""
    last = deep.groupBy("doc", "node").agg(F.min("depth").alias("lowest"), F.max_by("depth", "pos").alias("final"))
    return last.where("lowest < 0 or final <> 0").select("doc", "node", F.col("lowest").cast("long").alias("lowest"), F.col("final").cast("long").alias("final"))


def problems(deep: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, node, code, detail): `unbalanced` texts; an `end` of another kind than the begin it closes; markers whose
    argument is `unclosed`; inputs and pictures that are an `absolute` path or an `unknown` file, by files(doc, path)."""
    # read five times below, so the texts are gone through once and only what is asked about markers is kept
    deep = written(deep.select("doc", "node", "pos", "macro", "arg", "unclosed", "depth"), "markers")
    rows = unbalanced(deep).select("doc", "node", F.lit("unbalanced").alias("code"), F.concat_ws(",", F.col("lowest").cast("string"), F.col("final").cast("string")).alias("detail"))
    # the begin that an end closes is the last one at the depth that the end leaves
    opened = F.when(F.col("macro") == "begin", F.col("arg"))
    level = F.col("depth") + F.when(F.col("macro") == "end", 1).otherwise(0)
    kinds = deep.where("macro in ('begin', 'end')").withColumn("level", level).withColumn("kind", F.last(opened, True).over(Window.partitionBy("doc", "node", "level").orderBy("pos")))
    wrong = kinds.where("macro = 'end' and level > 0 and kind <> arg").select("doc", "node", F.lit("end").alias("code"), F.concat_ws(",", "kind", "arg").alias("detail"))
    named = deep.where("macro in ('input', 'include', 'includegraphics')").select("doc", "node", F.trim("arg").alias("detail"), F.regexp_replace(F.trim("arg"), r"\.[A-Za-z]+$", "").alias("path"))
    absolute = named.where("detail like '/%'").select("doc", "node", F.lit("absolute").alias("code"), "detail")
    unknown = named.where("detail not like '/%'").join(files.select("doc", "path").distinct(), ["doc", "path"], "left_anti").select("doc", "node", F.lit("unknown").alias("code"), "detail")
    unclosed = deep.where("unclosed <> ''").select("doc", "node", F.lit("unclosed").alias("code"), F.explode(F.split("unclosed", ",")).alias("detail"))
    return rows.unionByName(wrong).unionByName(unclosed).unionByName(absolute).unionByName(unknown)


def sections(pieces: DataFrame) -> DataFrame:
    """(doc, node, pos, title, rank, parent_node, parent_pos): sections in document order, (node, pos) within a document;
    a section's parent is the nearest one before it of a higher rank, as one closes what is open of its own or a lower
    rank. Documents may have any number of sections."""
    rank = F.coalesce(*[F.when(F.col("macro") == x, i) for i, x in enumerate(SECTIONS)])
    s = pieces.where(F.col("macro").isin(*SECTIONS)).select("doc", "node", "pos", F.col("arg").alias("title"), rank.alias("rank"))
    ranks = range(len(SECTIONS))
    s = s.withColumns({f"at{i}": F.when(F.col("rank") == i, F.struct("node", "pos")) for i in ranks})
    s = last_before(s, ["doc"], ["node", "pos"], [f"at{i}" for i in ranks])
    parent = F.array_max(F.array(*[F.when(F.col("rank") > i, F.col(f"last_at{i}")) for i in ranks]))
    return s.withColumn("p", parent).select("doc", "node", "pos", "title", "rank", F.col("p.node").alias("parent_node"), F.col("p.pos").alias("parent_pos"))


def environments(deep: DataFrame, envs: tuple | DataFrame) -> DataFrame:
    """(doc, node, pos, env, opt, body): bodies of outermost environments of the chosen kinds, markers within included. The
    kinds are names, or a table (doc, env) of those that each document splits."""
    k = ["doc", "node"]
    head = F.when((F.col("macro") == "begin") & (F.col("depth") == 1), F.struct("pos", F.col("arg").alias("kind"), "opt"))
    rows = deep.withColumn("at", F.last(head, True).over(Window.partitionBy(*k).orderBy("pos"))).where("depth > 0")
    if not isinstance(envs, DataFrame):
        rows = rows.where(F.col("at.kind").isin(*envs))
    bare = F.when(F.col("pos") == F.col("at.pos"), F.regexp_replace("raw", BEGIN_HEAD, "")).otherwise(F.col("raw"))
    body = rows.groupBy(*k, "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", bare.alias("t")))), lambda x: x["t"]), "").alias("body"))
    found = body.select(*k, "at.pos", F.col("at.kind").alias("env"), "at.opt", "body")
    return found.join(envs.select("doc", "env").distinct(), ["doc", "env"], "left_semi").select(*found.columns) if isinstance(envs, DataFrame) else found


BLANK = r"\n[ \t]*\n\s*"


def paragraphs(files: DataFrame, shortest: int) -> DataFrame:
    """(doc, node, pos, text, child): the paragraphs of texts, between blank lines; those of at least ``shortest``
    characters become children, shorter ones stay in their node."""
    rows = files.select("doc", "node", F.posexplode(F.split("text", BLANK, -1)).alias("pos", "text"))
    return rows.select("doc", "node", F.col("pos").cast("long").alias("pos"), "text", (F.length("text") >= shortest).alias("child"))


def without_paragraphs(files: DataFrame, shortest: int) -> DataFrame:
    """(doc, node, text): what stays in the nodes: short paragraphs, and an input in the place of each child."""
    stub = lambda x, i: F.when(F.length(x) >= shortest, F.concat(F.lit("\\input{PAR/"), i.cast("string"), F.lit("}%"))).otherwise(x)
    return files.select("doc", "node", F.array_join(F.transform(F.split("text", BLANK, -1), stub), "\n\n").alias("text"))


def discover_environments(files: DataFrame) -> DataFrame:
    """(doc, env): theorem-like environments that the texts declare."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"\\newtheorem\*?\{([A-Za-z]+)\}"), 1))
    return files.select("doc", found.alias("env")).distinct()


def front_matter(files: DataFrame, key: str) -> DataFrame:
    """(key, prologue, preamble, body, epilogue): a whole document's four parts; together they are the text."""
    begin, end = "\\begin{document}", "\\end{document}"
    # a comment's sign is hidden with all that follows it on its line, at equal length
    sign = lambda x: F.regexp_instr(x, F.lit(r"(^|[^\\])%"))
    hidden = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.when(sign(x) > 0, F.rpad(F.substr(x, F.lit(1), sign(x)), F.length(x), " ")).otherwise(x)), "\n")
    a, b, c = F.instr(hidden, "\\documentclass"), F.instr(hidden, begin), F.instr(hidden, end)
    cut = lambda x, y: F.substr(F.col("text"), x, F.greatest(y - x, F.lit(0)))
    one = F.lit(1)
    s, m, e = F.when(a > 0, a).otherwise(one), F.when(b > 0, b).otherwise(one), F.when(c > 0, c).otherwise(F.length("text") + 1)
    return files.select(key, cut(one, s).alias("prologue"), cut(s, m).alias("preamble"), cut(m, e).alias("body"), cut(e, F.length("text") + 1).alias("epilogue"))


def resolve_inputs(pieces: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, node, pos, path, target): inputs joined to files(doc, path, target); null for unknown files."""
    rows = pieces.where("macro in ('input', 'include')").select("doc", "node", "pos", F.regexp_replace("arg", r"\.tex$", "").alias("path"))
    return rows.join(files, ["doc", "path"], "left").select("doc", "node", "pos", "path", "target")


def reparse_inputs(deep: DataFrame, files: DataFrame, macros: tuple = ("input", "include")) -> DataFrame:
    """(doc, node, pos, macro, path, context, target, again, bad): inputs of texts with the environment around them, joined
    to files(doc, path, target); ``again`` tells that the text has input the target before, ``bad`` that there is none."""
    rows = deep.where(F.col("macro").isin(*macros)).select("doc", "node", "pos", "macro", F.regexp_replace("arg", r"\.tex$", "").alias("path"), F.col("env").alias("context"))
    found = rows.join(files.select("doc", "path", "target"), ["doc", "path"], "left")
    before = F.row_number().over(Window.partitionBy("doc", "node", "target").orderBy("pos"))
    return found.select("doc", "node", "pos", "macro", "path", "context", "target", (F.col("target").isNotNull() & (before > 1)).alias("again"), F.col("target").isNull().alias("bad"))


def input_nodes(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc, node, path) of the known files among resolved inputs, once each, and edges (doc, parent, child,
    ordinal) from all that input them."""
    known = resolved.where("target is not null")
    nodes = known.groupBy("doc", F.col("target").alias("node")).agg(F.min("path").alias("path"))
    return nodes, known.groupBy("doc", F.col("node").alias("parent"), F.col("target").alias("child")).agg(F.min("pos").alias("ordinal"))


def graphics(pieces: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, node, path, extensions): referenced pictures with the extensions there are; files(doc, path, ext)."""
    ext = files.groupBy("doc", "path").agg(F.array_join(F.sort_array(F.collect_set("ext")), ",").alias("extensions"))
    rows = pieces.where("macro = 'includegraphics'").select("doc", "node", F.regexp_replace("arg", r"\.[a-z]+$", "").alias("path"))
    return rows.join(ext, ["doc", "path"], "left").select("doc", "node", "path", "extensions")


def graphic_nodes(found: DataFrame, existing: DataFrame) -> DataFrame:
    """(doc, node, environ, path, extensions, parents): a new node for each picture of graphics(doc, node, path,
    extensions) that has a file, numbered after the greatest of existing(doc, node), with the number of its parents."""
    pictures = found.where("extensions is not null").groupBy("doc", "path", "extensions").agg(F.countDistinct("node").alias("parents"))
    top = existing.groupBy("doc").agg(F.max("node").alias("top"))
    numbered = number_within(pictures, ["doc"], ["path"], "n").join(top, "doc", "left")
    return numbered.select("doc", (F.coalesce("top", F.lit(0)) + F.col("n")).alias("node"), F.lit("graphic_file").alias("environ"), "path", "extensions", "parents")


def zip_sections(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, parent, child, ordinal): edges after nodes without text of their own that hold a single child are left out, chains
    of any length of them; nodes(doc, node, text). Each round doubles how far a chain is followed; chains that only lead
    back into themselves have no end and go."""
    single = edges.groupBy("doc", "parent").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("to")).where("n = 1")
    empty = nodes.where(~F.col("text").rlike(r"\S")).select("doc", F.col("node").alias("parent"))
    gone = written(single.join(empty, ["doc", "parent"], "left_semi").select("doc", F.col("parent").alias("mid"), "to"), "chains")
    now, most = gone, gone.count()
    for _ in range(most.bit_length() + 1):
        far = now.select("doc", F.col("mid").alias("to"), F.col("to").alias("further"))
        step = now.join(far, ["doc", "to"], "left")
        if step.where("further is not null").isEmpty():
            break
        now = written(step.select("doc", "mid", F.coalesce("further", "to").alias("to")), "chains")
    ends = now.join(gone.select("doc", F.col("mid").alias("to")), ["doc", "to"], "left_anti")
    kept = edges.join(gone.select("doc", F.col("mid").alias("parent")), ["doc", "parent"], "left_anti")
    found = kept.join(ends.withColumnRenamed("mid", "child"), ["doc", "child"], "left").join(gone.select("doc", F.col("mid").alias("child"), F.lit(True).alias("mid")), ["doc", "child"], "left")
    return found.where("mid is null or to is not null").select("doc", "parent", F.coalesce("to", "child").alias("child"), "ordinal")


#: Environs whose segments have no id on top.
NO_ID = ("E_document", "main_file", "preamble", "input", "include", "input_preamble", "usepackage", "bibliography", "E_thebibliography", "graphic_file")


def stamp(text: Column, id_: Column, environ: Column, excluded: tuple = NO_ID) -> Column:
    """A segment with its id on top, unless its environ has none; blank lines at the end go."""
    bare = F.regexp_replace(text, r"\s+$", "")
    return F.when(environ.isin(*excluded), bare).otherwise(F.concat(F.lit("\\uuid{"), id_, F.lit("}%\n"), bare))


def carve(segments: DataFrame, selections: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc, node, start, child, text, child_text, stub_text): selections(doc, node, start, length, environ), start from
    1, carved out of segments(doc, node, environ, text). Each gets a child id after its document's greatest node, in the
    order of (node, start); ``stub_text`` is the parent's text with an input in the place of every selection of it.
    Refused, with child null and the text as it was: environs that rules(parent, child) don't allow, selections that
    begin before the end of an earlier one of the same node, or that aren't within the text."""
    s = selections.join(segments.select("doc", "node", F.col("environ").alias("parent_environ"), F.length("text").alias("size")), ["doc", "node"])
    ok = s.join(F.broadcast(rules.select(F.col("parent").alias("rp"), F.col("child").alias("rc"))), (tree.kind(F.col("parent_environ")) == F.col("rp")) & (tree.kind(F.col("environ")) == F.col("rc")), "left")
    end = F.max(F.col("start") + F.col("length")).over(Window.partitionBy("doc", "node").orderBy("start", F.desc("length")).rowsBetween(Window.unboundedPreceding, -1))
    fits = F.col("rp").isNotNull() & (F.col("start") >= 1) & (F.col("length") >= 1) & (F.col("start") + F.col("length") <= F.col("size") + 1) & (F.col("start") >= F.coalesce("end", F.lit(1)))
    ok = ok.withColumn("end", end).withColumn("fits", fits)
    top = segments.groupBy("doc").agg(F.max("node").alias("top"))
    new = number_within(ok.where("fits").select("doc", "node", "start", "length"), ["doc"], ["node", "start"], "n").join(top, "doc").withColumn("child", F.col("top") + F.col("n")).drop("top", "n")
    cuts = new.groupBy("doc", "node").agg(F.sort_array(F.collect_list(F.struct("start", "length", "child"))).alias("cuts"))
    rows = segments.select("doc", "node", "text").join(cuts, ["doc", "node"], "left")
    begin = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    stub = lambda x: F.concat(F.lit("\\input{UUID/"), x["child"].cast("string"), F.lit("}"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substr("text", acc["at"], x["start"] - acc["at"]), stub(x)).alias("out"), (x["start"] + x["length"]).cast("int").alias("at"))
    done = F.aggregate("cuts", begin, step, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"])))
    parents = rows.select("doc", "node", "text", F.coalesce(done, F.col("text")).alias("stub_text"))
    wanted = selections.select("doc", "node", F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"))
    return wanted.join(new.select("doc", "node", "start", "child"), ["doc", "node", "start"], "left").join(parents, ["doc", "node"]).select(
        "doc", "node", "start", "child", "text", F.when(F.col("child").isNotNull(), F.substr("text", F.col("start"), F.col("length"))).alias("child_text"), "stub_text"
    )


#: Segments in a part of an assembled document.
PART = 100


def assemble(nodes: DataFrame, visits: DataFrame) -> DataFrame:
    """(doc, part, text): the whole text of each document: the texts of first visits in the order of the walk, in parts
    of 100 segments, numbered from 1, so that no row holds a whole document."""
    first = number_within(visits.where("is_first").select("doc", "node", F.col("place").alias("at")), ["doc"], ["at"], "place")
    return _parts(first.join(nodes.select("doc", "node", "text"), ["doc", "node"]), ["doc"])


def _parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    part = F.floor((F.col("place") - 1) / PART) + 1
    ordered = F.sort_array(F.collect_list(F.struct("place", "text")))
    return rows.groupBy(*keys, part.alias("part")).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def squash(files: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc, node, text): texts without comments, each child input replaced by a placeholder with the child's id and
    name, after the child's sectioning command where it has one. targets(doc, path, target, environ, title) tells what
    the paths stand for; inputs of other paths stay as they are."""
    pieces = explode_markers(files)
    brings = F.col("macro").isin("input", "include", "bibliography")
    # the inputs alone are joined: other pieces have no path, and would all have the same key
    inputs = pieces.where(brings).withColumn("path", F.regexp_replace("arg", r"\.[a-z]+$", ""))
    named = inputs.join(targets.withColumnRenamed("title", "__title"), ["doc", "path"], "left")
    heading = F.when(F.col("environ").isin(*SECTIONS), F.concat(F.lit("\\"), "environ", F.lit("{"), F.coalesce("__title", F.lit("")), F.lit("}"))).otherwise(F.lit(""))
    shown = F.concat(heading, F.lit("\\uuidplaceholder{"), F.col("target").cast("string"), F.lit("}{"), F.col("path"), F.lit("}"), F.substr("raw", F.col("size") + 1))
    done = named.select("doc", "node", "pos", F.when(F.col("target").isNotNull(), shown).otherwise(F.col("raw")).alias("t"))
    rest = pieces.where(~brings).select("doc", "node", "pos", F.col("raw").alias("t"))
    return done.unionByName(rest).groupBy("doc", "node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "").alias("text"))


def mask(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, node, text): open and public texts as they are; private ones as stubs that list their children in order."""
    kids = edges.groupBy("doc", F.col("parent").alias("node")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "child"))), lambda x: F.concat(F.lit("\\input{"), x["child"].cast("string"), F.lit("}"))), "\n").alias("kids"))
    stub = F.concat(F.lit("\\uuidplaceholder\n"), F.coalesce("kids", F.lit("")))
    return nodes.join(moved(kids), ["doc", "node"], "left").select("doc", "node", F.when(F.col("access").isin("open", "public"), F.col("text")).otherwise(stub).alias("text"))


def standalone(text: Column, environ: Column, title: Column, classname: Column | None = None, macros: Column | None = None, lang: Column | None = None) -> Column:
    """A segment wrapped so that it stands by itself: environments between begin and end, items in a list, whole files
    as they are. ``classname`` is the document's class, or else article; book where a chapter or part needs it.
    ``macros`` go before the text, and a switch that tells the language."""
    name = F.regexp_replace(environ, "^E_", "")
    wrapped = (
        F.when(environ.isin("item", "E_item"), F.concat(F.lit("\\begin{itemize}\n"), text, F.lit("\n\\end{itemize}\n")))
        .when(environ.startswith("E_") & ~environ.isin("E_thebibliography", "E_document"), F.concat(F.lit("\\begin{"), name, F.lit("}\n"), text, F.lit("\n\\end{"), name, F.lit("}\n")))
        .otherwise(F.concat(text, F.lit("\n")))
    )
    kind = F.when(environ.isin("chapter", "part"), F.lit("book")).otherwise(F.coalesce(classname, F.lit("article")) if classname is not None else F.lit("article"))
    flag = F.concat(F.lit("\\newif\\ifCDL"), lang, F.lit("\\CDL"), lang, F.lit("true\n")) if lang is not None else F.lit("")
    extra = F.when(macros.isNotNull() & (macros != ""), F.concat(macros, F.lit("\n"))).otherwise(F.lit("")) if macros is not None else F.lit("")
    whole = F.concat(F.lit("\\documentclass{"), kind, F.lit("}\n"), extra, flag, F.lit("\\title{"), title, F.lit("}\n\\begin{document}\n"), wrapped, F.lit("\\end{document}\n"))
    return F.when(environ.isin("main_file", "E_document"), text).otherwise(whole)


def assemble_files(nodes: DataFrame, visits: DataFrame) -> DataFrame:
    """(doc, file, part, text): original files: a node with a filename begins one, which takes all below it up to the
    next; in parts of 100 segments. nodes(doc, node, text, original_filename)."""
    named = nodes.where("original_filename is not null").select("doc", "node", F.col("original_filename").alias("file"))
    owner = tree.nearest(visits, named).where("at is not null").join(named.withColumnRenamed("node", "at"), ["doc", "at"])
    file = visits.where("is_first").select("doc", "node", F.col("place").alias("nth")).join(owner.select("doc", "node", "file"), ["doc", "node"])
    placed = number_within(file, ["doc", "file"], ["nth"], "place")
    return _parts(placed.join(nodes.select("doc", "node", "text"), ["doc", "node"]), ["doc", "file"])


def restore_commands(text: Column, comments: bool = False) -> Column:
    """A stored segment without its id header and checkpoint lines, with pictures and bibliographies under their old
    commands; with ``comments``, between lines that tell where it begins and ends."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\\uuid\{[^}]*\}%\n", ""), r"(?m)^\\[A-Za-z]*UUIDcheckpoint.*\n?", "")
    old = F.regexp_replace(bare, r"\\(includegraphics|bibliography)((?:\[[^\]]*\])*)\{UUID/[^{}]*/([^/{}]*)\}", r"\\$1$2{$3}")
    return F.concat(F.lit("% begin\n"), old, F.lit("\n% end\n")) if comments else old


def mask_tree(nodes: DataFrame, edges: DataFrame, reached: DataFrame, lang: str | None = None, kept: tuple = ("preamble", "usepackage", "bibliography")) -> DataFrame:
    """(doc, node, text): the masked corpus of reached(doc, node); with a language, other versions become stubs too, and
    nodes that are reached but missing are stubs. Environs in ``kept`` are copied whatever their access."""
    rows = reached.select("doc", "node").distinct().join(moved(nodes.select("doc", "node", "environ", "lang", "access", "text")), ["doc", "node"], "left")
    shown = F.col("access").isin("open", "public")
    if lang:
        shown = shown & (F.col("lang") == lang)
    access = F.when(F.coalesce(shown | F.col("environ").isin(*kept), F.lit(False)), F.lit("open")).otherwise("private")
    return mask(rows.withColumn("access", access), edges)


def choose_preamble(candidates: DataFrame) -> DataFrame:
    """(doc, node, preamble) from candidates(doc, node, preamble, rank): the least rank, then the first by name."""
    return candidates.groupBy("doc", "node").agg(F.min(F.struct("rank", "preamble")).alias("c")).select("doc", "node", "c.preamble")


def references(pieces: DataFrame, files: DataFrame, macro: str) -> DataFrame:
    """(doc, node, name, target): each name in a list of bibliographies or packages; null for external ones."""
    rows = pieces.where(F.col("macro") == macro).select("doc", "node", F.explode(F.split("arg", r"\s*,\s*", -1)).alias("name"))
    return rows.join(files, ["doc", "name"], "left").select("doc", "node", "name", "target")


def init_nodes(nodes: DataFrame, private: tuple, authors: list[str], lang: str) -> DataFrame:
    """(doc, node, lang, access, extension, alias, authors): default fields of new nodes(doc, node, environ, path):
    pictures have no language (zxx), bibliographies an undetermined one; a node's file name without its extension and
    folder is an alias; the authors are those of the run."""
    access = F.when(F.col("environ").isin(*private), "private").otherwise("open")
    kind = F.when(F.col("environ") == "graphic_file", "zxx").when(F.col("environ").isin("bibliography", "E_thebibliography"), "und").otherwise(lang)
    ext = F.when(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1) != "", F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1)).otherwise(F.lit(".tex"))
    alias = F.regexp_extract("path", r"([^/]*?)(?:\.[A-Za-z]+)?$", 1)
    return nodes.select("doc", "node", kind.alias("lang"), access.alias("access"), F.coalesce(ext, F.lit(".tex")).alias("extension"), F.when(alias != "", alias).alias("alias"), F.lit(",".join(sorted(authors))).alias("authors"))


def split_header(text: Column, macro: str = "section") -> Column:
    """struct(header, title, body): the hidden lines on top of a segment, its title, and what editors see."""
    pattern = r"(?s)^((?:\\uuid\{[^}]*\}%?\n)?(?:\\" + macro + braced().replace("(", "(?:", 1) + r"\n)?)(.*)$"
    header = F.regexp_extract(text, pattern, 1)
    return F.struct(header.alias("header"), F.regexp_extract(header, r"\\" + macro + braced(), 1).alias("title"), F.regexp_extract(text, pattern, 2).alias("body"))


def join_header(parts: Column) -> Column:
    return F.concat(parts["header"], parts["body"])


def items(deep: DataFrame, lists: tuple = ("itemize", "enumerate", "description")) -> DataFrame:
    """(doc, node, pos, number, text): list items with their number within their list, nested lists counted apart."""
    rows = deep.where(F.col("env").isin(*lists))
    start = F.when(F.col("macro") == "begin", F.col("pos"))
    own = rows.withColumn("at", F.last(start, True).over(Window.partitionBy("doc", "node", "depth").orderBy("pos"))).where("macro = 'item'")
    number = F.row_number().over(Window.partitionBy("doc", "node", "at").orderBy("pos"))
    return own.select("doc", "node", "pos", number.alias("number"), F.trim(F.regexp_replace("raw", r"^\\item\s*", "")).alias("text"))


def recursive_inputs(inputs: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc, node, parent): inputs(doc, node, target) that bring in a file from within itself."""
    edges = inputs.where("target is not null").select("doc", F.col("node").alias("parent"), F.col("target").alias("child"), F.col("target").alias("ordinal")).distinct()
    return tree.loops(tree.walk(edges, roots)).select("doc", "node", "parent")
