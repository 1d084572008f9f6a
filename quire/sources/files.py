"""Readers and writers of corpus files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.ids import id_to_int, id_to_path, int_to_id, path_to_id
from quire.operators import segment
from quire.operators.attrs import flatten
from quire.scratch import written

#: Folders that are enough for tasks to list them, and entries of a folder that are too many to name.
LISTED, MANY = 128, 1000
#: What Spark takes for a pattern in a path.
GLOB = re.compile(r"[*?\[\]{}\\]")
#: Names that Spark takes for hidden ones.
HIDDEN = re.compile(r"^\.|^_[^=]*$|\._COPYING_$")
#: The end of a file's name that says that its text is null, and not empty.
NULL = ".null-text"
#: Files and bytes that a task has in memory together, one file more at most.
FILES, BYTES = 1000, 1 << 23


@lru_cache(8)
def _opened(head: str) -> tuple[fs.FileSystem, str]:
    store, base = (fs.LocalFileSystem(), "/") if head == "file://" else fs.FileSystem.from_uri(f"{head}/")
    return store, base.rstrip("/") + "/"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store that a path with its scheme lies in, and the path there."""
    head, inside = re.match("([^:/]+://[^/]*)/*(.*)", uri, re.S).groups()
    store, base = _opened(head)
    return store, base + inside


def _known(uri: str) -> bool:
    """Whether Arrow opens the store that a path lies in."""
    try:
        _store(uri)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _whole(spark: SparkSession, path: str) -> list[str]:
    """A path with its scheme, or those that a pattern stands for; none if there is nothing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return [re.sub("^file:/+", "file:///", x.getPath().toString()) for x in store.globStatus(hadoop(path)) or []]


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what is in a folder and not hidden; of a local one they come one by one."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            yield from ((x.name, x.is_dir()) for x in found if not HIDDEN.search(x.name))
    else:
        found = store.get_file_info(fs.FileSelector(folder))
        yield from ((x.base_name, x.type == fs.FileType.Directory) for x in found if not HIDDEN.search(x.base_name))


def _below(root: str) -> list[str]:
    """Folders and files that together hold what is below a path, some hundreds if there are. Of a folder with many entries no
    more are looked at: it is one of them."""
    store, top = _store(root)
    head, kept, folders = root.removesuffix(top), [], [top]
    if store.get_file_info(top).type != fs.FileType.Directory:
        return [root]
    while folders and len(folders) < LISTED:
        below = []
        for f in folders:
            found = list(islice(_entries(store, f), MANY + 1))
            if len(found) > MANY:
                kept.append(f)
            else:
                kept += [f"{f}/{name}" for name, inner in found if not inner]
                below += [f"{f}/{name}" for name, inner in found if inner]
        folders = below
    return [head + x for x in folders + kept] or [root]


def _folders(spark: SparkSession, path: str) -> list[str]:
    """What ``_below`` gives for a path; a pattern is given back, and so is what Arrow can't open."""
    roots = [path] if GLOB.search(path) else _whole(spark, path)
    return [path] if roots == [path] or not roots or not _known(roots[0]) else _below(roots[0])


def read_files(spark: SparkSession, path: str, names: str) -> DataFrame:
    """(path, text, modified): a row for each file below ``path`` whose name matches ``names``. Empty files, which Spark's own
    readers leave out, are empty texts, and what ``write_texts`` has written for null is null. Nothing of each file goes
    through the driver: it names some hundreds of folders, tasks list them, the names are dealt out, and some files at a time
    are read. Stores that Arrow can't open are listed and read by Spark."""
    roots = _whole(spark, path)
    if not roots or not all(map(_known, roots)):
        raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        p = F.col("_metadata.file_path")
        return raw.where(F.regexp_extract(p, "([^/]*)$", 1).rlike(names)).select(p.alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))
    wanted = re.compile(names)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri in (x for batch in batches for x in batch.column(0).to_pylist()):
            store, top = _store(uri)
            head, folders = uri.removesuffix(top), []
            if store.get_file_info(top).type == fs.FileType.Directory:
                folders.append(top)
            elif wanted.search(top.rpartition("/")[2].removesuffix(NULL)):
                yield pa.RecordBatch.from_arrays([pa.array([uri])], ["path"])
            while folders:
                folder = folders.pop()
                found = _entries(store, folder)
                while some := list(islice(found, MANY)):
                    folders += [f"{folder}/{name}" for name, inner in some if inner]
                    own = [f"{head}{folder}/{name}" for name, inner in some if not inner and wanted.search(name.removesuffix(NULL))]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], ["path"])

    kinds = pa.schema([("path", pa.string()), ("data", pa.binary()), ("modified", pa.timestamp("us", "UTC"))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for uri in (x for batch in batches for x in batch.column(0).to_pylist()):
            store, at = _store(uri)
            data, time = None, store.get_file_info(at).mtime_ns
            if not at.endswith(NULL):
                with store.open_input_stream(at, compression=None) as f:
                    data = f.read()
            rows.append((uri.removesuffix(NULL), data, time // 1000))
            size += len(data or b"")
            if len(rows) >= FILES or size >= BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    given = [x for root in roots for x in _below(root)]
    width = spark.sparkContext.defaultParallelism
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * width)
    units = spark.createDataFrame([(x,) for x in given], "path string").repartition(min(len(given), 4 * width), "path")
    found = units.mapInArrow(listed, "path string").repartition(tasks, "path").mapInArrow(read, "path string, data binary, modified timestamp")
    return found.select("path", F.col("data").cast("string").alias("text"), "modified")


def read_sources(spark: SparkSession, path: str, exts: tuple = ("tex",)) -> DataFrame:
    """(path, ext, text): one row per file of a folder tree."""
    raw = read_files(spark, path, rf"\.(?:{'|'.join(map(re.escape, exts))})$")
    return raw.select("path", F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ext"), "text")


def _from_path(c: Column) -> list[Column]:
    return [F.regexp_extract(c, r"([^/]+)/UUID/", 1).alias("doc"), id_to_int(path_to_id(c)).alias("node")]


def write_texts(rows: DataFrame, root: str) -> DataFrame:
    """Write rows(path, text), a file each at its path below ``root``; gives (path, bytes). For a null text an empty file is
    written, whose name says so by ``NULL`` at its end. A task that runs again writes the same files again."""
    old = any(map(_known, _whole(rows.sparkSession, root)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            sizes = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8")
                store.create_dir(f"{top}/{path}".rpartition("/")[0], recursive=True)
                own, other = (f"{top}/{path}", f"{top}/{path}{NULL}") if text is not None else (f"{top}/{path}{NULL}", f"{top}/{path}")
                with store.open_output_stream(own, compression=None) as f:
                    f.write(data)
                if old and store.get_file_info(other).type == fs.FileType.File:
                    store.delete_file(other)
                sizes.append(None if text is None else len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return written(rows.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).mapInArrow(run, "path string, bytes long"), "files")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, key, value, value2, bad): key=value lines in order, a second value after a tab; lines without = come in
    ``bad``."""
    files = read_sources(spark, path, ("txt", "metadata")).select("path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where("line <> ''")
    at = F.instr("line", "=")
    both = F.split(F.when(at > 0, F.substr("line", at + 1)), "\t", 2)
    return files.select("path", "pos", F.when(at > 0, F.substr("line", F.lit(1), at - 1)).alias("key"), F.get(both, F.lit(0)).alias("value"), F.get(both, F.lit(1)).alias("value2"), F.when(at == 0, F.col("line")).alias("bad"))


#: What Spark escapes in the names of folders that stand for values.
ESCAPED = "%" + "".join(map(chr, range(1, 32))) + "\"#'*/:=?\\\x7f{[]^"


def _escaped(c: Column) -> Column:
    """A value as Spark names its folder."""
    s = c.cast("string")
    named = reduce(lambda s, x: F.replace(s, F.lit(x), F.lit(f"%{ord(x):02X}")), ESCAPED, s)
    return F.when(s.isNull() | (s == ""), "__HIVE_DEFAULT_PARTITION__").when(s.rlike(r"^[A-Za-z0-9_.-]*$"), s).otherwise(named)


def write_metadata(nodes: DataFrame, edges: DataFrame, attrs: DataFrame, path: str) -> None:
    """All fields, extensions, edges and attributes of nodes as key=value lines, second values of attrs(..., value2) after a tab; a
    folder for each document and node, named as Spark names those of partitions. Tasks write the files in their place: with a
    folder for each node, Spark's own writer would move them there one by one when all are written."""
    if "value2" in attrs.columns:
        attrs = attrs.withColumn("value", F.concat_ws("\t", F.coalesce("value", F.lit("")), "value2"))
    lines = flatten(nodes, edges, attrs).select("doc", "node", F.concat_ws("=", "key", "value").alias("line"))
    own = lines.groupBy("doc", "node").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("value"))
    spark = nodes.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    root = re.sub("^file:/+", "file:///", store.makeQualified(hadoop(path)).toString())
    if not _known(root):
        return own.repartition("doc", "node").write.mode("overwrite").partitionBy("doc", "node").text(path)
    store.delete(hadoop(path), True)  # what is there is replaced
    name = F.concat(F.lit("doc="), _escaped(F.col("doc")), F.lit("/node="), _escaped(F.col("node")), F.lit("/metadata.txt"))
    write_texts(own.select(name.alias("path"), F.concat("value", F.lit("\n")).alias("text")), root)


def read_segments(spark: SparkSession, root: str) -> DataFrame:
    """(doc, node, lang, ext, text) of segments stored as doc/UUID/a/b/rest/blob_LLL.ext."""
    raw, p = read_files(spark, root, "^blob"), F.col("path")
    return raw.select(*_from_path(p), F.regexp_extract(p, r"/blob(?:_([a-z]{3}))?\.[^/]+$", 1).alias("lang"), F.regexp_extract(p, r"(\.[^./]+)$", 1).alias("ext"), "text")


def segment_paths(segments: DataFrame) -> DataFrame:
    """Segments with ``path``, where the layout puts them."""
    return segments.withColumn("path", F.concat(F.col("doc"), F.lit("/"), id_to_path(int_to_id(F.col("node"))), F.lit("/blob_"), "lang", "ext"))


def write_layout(segments: DataFrame, root: str) -> DataFrame:
    """Segments as files in their layout below ``root``; gives (path, bytes)."""
    return write_texts(segment_paths(segments), root)


def write_segments(segments: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Segments as Parquet, a folder for each document; with mode overwrite only the given documents are replaced."""
    segments.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("doc").parquet(path)


def _normal(path: Column) -> Column:
    """A path without . and .. in it."""
    none = F.array().cast("array<string>")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(F.split(path, "/"), none, lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(kept, "/")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    r"""(path, doc, node, lang, key, value, value2) of \newlabel{label}{{a}{b}...} lines of .aux files and of those that
    they \@input, directly or not: key is AUX_label_LLL, value the label in braces, value2 what it stands for, joined by
    tabs. Files are known by their whole path; an input is looked for in the folder of the file that has it."""
    found = written(read_sources(spark, path, ("aux",)).select("path", "text"), "aux")
    braces = segment.braced()
    lines = found.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\\newlabel\s*\{[^}]*\}\s*" + braces), 0)).alias("m"))
    parts = F.regexp_extract_all(F.regexp_extract("m", braces + "$", 1), F.lit(segment.braced()), 1)
    labels = written(lines.select("path", F.concat(F.lit("{"), F.trim(F.regexp_extract("m", r"\{([^}]*)\}", 1)), F.lit("}")).alias("value"), F.array_join(parts, "\t").alias("value2")), "labels")
    folder = F.regexp_replace("path", "[^/]*$", "")
    includes = found.select("path", folder.alias("folder"), F.explode(F.regexp_extract_all("text", F.lit(r"\\@input\{([^}]*)\}"), 1)).alias("next")).where("next like '%.aux'")
    includes = written(includes.select("path", F.when(F.col("next").startswith("/"), F.concat(F.regexp_extract("path", "^([a-z]+:(?://)?)?", 0), "next")).otherwise(_normal(F.concat("folder", "next"))).alias("next")), "includes")
    front, seen = written(found.select(F.col("path").alias("top"), "path"), "reach"), []
    while not front.isEmpty():
        seen.append(front)
        known = reduce(DataFrame.unionByName, seen)
        step = front.join(includes, "path").select("top", F.col("next").alias("path")).distinct()
        front = written(step.join(known, ["top", "path"], "left_anti"), "reach")
    reach = reduce(DataFrame.unionByName, seen) if seen else front
    p = F.col("top")
    lang = F.regexp_extract(p, r"_([a-z]{3})\.aux$", 1)
    rows = reach.join(labels, "path").select("top", "value", "value2").distinct()
    return rows.select(p.alias("path"), *_from_path(p), lang.alias("lang"), F.concat(F.lit("AUX_label_"), lang).alias("key"), "value", "value2")


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """(doc, node, lang, user_id, base_md5, content, ts) of edit states, blob_LLL_USER_editstate.json; ts is the file's
    time."""
    raw, p = read_files(spark, path, r"_editstate\.json$").where(r"text rlike '[^ \\t\\r\\n]'"), F.col("path")
    user = F.regexp_extract(p, r"_(\d+)_editstate", 1).cast("long")
    raw = raw.withColumn("state", F.from_json("text", "base_md5 string, content string"))
    return raw.select(*_from_path(p), F.regexp_extract(p, r"blob_([a-z]{3})_\d+_editstate", 1).alias("lang"), user.alias("user_id"), "state.base_md5", "state.content", F.col("modified").alias("ts"))


def read_symbol_map(spark: SparkSession, path: str) -> DataFrame:
    r"""(macro, symbol): JSON objects of macros and code points; names that aren't \letters are left out."""
    whole = spark.read.text(path, wholetext=True)
    pairs = whole.select(F.explode(F.from_json("value", "map<string,int>")).alias("macro", "code")).where(F.col("macro").rlike(r"^\\[a-zA-Z]+$"))
    return pairs.select("macro", F.decode(F.unhex(F.lpad(F.hex("code"), 8, "0")), "UTF-32").alias("symbol"))


def inverse_symbols(symbols: DataFrame) -> DataFrame:
    """(symbol, macro): the macro of each symbol, the first by name of those that have it."""
    return symbols.groupBy("symbol").agg(F.min("macro").alias("macro"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc, name, value): the rules that documents were segmented with, JSON objects of lists, lists exploded; a file
    is its folder's, which is the document. ``segment.document_rules`` makes them a table that segmentation joins."""
    whole, p = read_files(spark, path, r"\.json$"), F.col("path")
    lists = whole.select(p, F.regexp_extract(p, "([^/]+)/[^/]*$", 1).alias("doc"), F.explode(F.from_json("text", "map<string,array<string>>")).alias("name", "v"))
    return lists.select("path", "doc", "name", F.explode("v").alias("value"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of rendered pages."""
    return read_sources(spark, path, ("html",)).select("path", F.col("text").alias("html"))


def save_corpus(tables: dict[str, DataFrame], path: str) -> None:
    """A corpus as Parquet tables by name, partitioned by document where there is one."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("doc") if "doc" in df.columns and len(df.columns) > 1 else w).parquet(f"{path}/{name}")


def load_corpus(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
