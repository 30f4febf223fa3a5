"""Extraction from source text, dependency edges, cones and what they cost in tokens."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depscope.operators.references import READERS
from depscope.sources.shared import settled, shared_dir

TOKEN = "[A-Za-z0-9_]+|[^A-Za-z0-9_ \\n]"


def detect_language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("ts", "tsx"), "typescript").when(ext == "py", "python").when(ext == "go", "go").when(ext == "rs", "rust")


def count_tokens(text: Column) -> Column:
    """Words and single signs of a text; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


REFERENCES = "repo string, path string, lang string, kind string, pos int, name string"


def extract_references(files: DataFrame) -> DataFrame:
    """(repo, path, lang, kind, pos, name): calls and imports of each file in order, by the rules of its language (references.py).

    One row in, many out, no shuffle, and one pass over each text. Null content and files of other languages have none.
    """
    lang = detect_language(F.col("path"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for repo, path, content, language in f.itertuples(index=False):
                seen: set[str] = set()
                pos = 0
                for kind, name in READERS[language](content.encode().decode("latin-1")):
                    if kind == "call":
                        if name in seen:
                            continue
                        seen.add(name)
                    out.append((repo, path, language, kind, pos, name if name.isascii() else name.encode("latin-1").decode("utf-8", "replace")))
                    pos += kind == "import"
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in REFERENCES.split(", ")])

    known = files.select("repo", "path", "content", lang.alias("lang")).filter(F.col("lang").isNotNull() & F.col("content").isNotNull())
    return known.mapInPandas(run, REFERENCES)


def extract_calls(files: DataFrame) -> DataFrame:
    """(repo, caller_file, called_name): distinct called names of each file: plain ones and the last member of a chain."""
    return extract_references(files).filter("kind = 'call'").select("repo", F.col("path").alias("caller_file"), F.col("name").alias("called_name"))


def extract_imports(files: DataFrame) -> DataFrame:
    """(repo, importer_file, lang, pos, import_path): the imports of each file in order.

    TypeScript: import statements whose path begins with a dot or has a slash (re-exports are none); Python: modules
    of import and from, with their dots; Go: quoted paths; Rust: first segments of use, and mod x;.
    """
    return extract_references(files).filter("kind = 'import'").select("repo", F.col("path").alias("importer_file"), "lang", "pos", F.col("name").alias("import_path"))


def fold_path(path: Column) -> Column:
    """path without . segments and with each .. taken off its parent folder; a .. above the top stays."""
    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("..")) != "..")
        return F.when(part == ".", done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def path_aliases(configs: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, root, prefix, target) from configs (repo, dir, json): those of the nearest folder at or above a root whose JSON can be read.

    baseUrl and paths of compilerOptions; the first replacement of a pattern counts. Paths are relative to
    the repository, "" is its top. A nearer broken config is passed over, a readable one without paths is not.
    """
    shape = "struct<compilerOptions:struct<baseUrl:string,paths:map<string,array<string>>>>"
    read = configs.select("repo", "dir", F.from_json("json", shape, {"columnNameOfCorruptRecord": "_none"}).alias("c"), F.get_json_object("json", "$").isNotNull().alias("ok")).filter("ok")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    above = (F.col("dir") == "") | (F.col("root") == F.col("dir")) | F.col("root").startswith(F.concat(F.col("dir"), F.lit("/")))
    near = roots.select("repo", "root").join(read, "repo").filter(above).groupBy("repo", "root").agg(F.max_by(F.struct("dir", "c"), depth).alias("n"))
    base = F.concat_ws("/", F.when(F.col("n.dir") != "", F.col("n.dir")), F.coalesce("n.c.compilerOptions.baseUrl", F.lit(".")))
    bare = lambda c: F.rtrim(c, F.lit("/*"))
    rows = near.select("repo", "root", base.alias("base"), F.explode("n.c.compilerOptions.paths").alias("pattern", "to")).filter(F.size("to") > 0)
    return rows.select("repo", "root", bare(F.col("pattern")).alias("prefix"), fold_path(F.concat_ws("/", "base", bare(F.get("to", F.lit(0))))).alias("target"))


SUFFIXES = ("", ".ts", ".tsx")


IMPORT = ["repo", "importer_file", "pos", "import_path"]


def import_tries(imports: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(repo, importer_file, pos, import_path, by, rank, path): the paths that each import of a TypeScript file may name, by preference."""
    keys = IMPORT
    named = F.concat(F.regexp_replace("importer_file", r"[^/]+$", ""), "import_path")
    tried = imports.filter(F.col("import_path").startswith(".")).select(*keys, F.lit(0).alias("by"), fold_path(named).alias("stem"))
    if aliases is not None:
        others = imports.filter(~F.col("import_path").startswith(".")).select(*keys)
        # the roots at or above an importer are beginnings of its path; of those that have aliases the longest counts
        folders = F.split("importer_file", "/")
        above = F.transform(F.sequence(F.lit(0), F.size(folders) - 1), lambda n: F.array_join(F.slice(folders, F.lit(1), n), "/"))
        importers = others.select("repo", "importer_file").distinct().select("repo", "importer_file", F.explode(above).alias("root"))
        roots = importers.join(aliases.select("repo", "root").distinct(), ["repo", "root"])
        near = roots.groupBy("repo", "importer_file").agg(F.max_by("root", F.length("root")).alias("root"))
        # an alias is joined by each beginning of the import that ends before a slash
        parts = F.split("import_path", "/")
        heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        begun = others.join(near, ["repo", "importer_file"]).select(*keys, "root", F.explode(heads).alias("prefix"))
        rest = F.ltrim(F.expr("substring(import_path, length(prefix) + 1)"), F.lit("/"))
        stem = fold_path(F.concat_ws("/", F.when(F.col("target") != "", F.col("target")), F.when(rest != "", rest)))
        by_alias = begun.join(aliases.select("repo", "root", "prefix", "target"), ["repo", "root", "prefix"]).select(*keys, (-F.length("prefix")).alias("by"), stem.alias("stem"))
        tried = tried.unionByName(by_alias)
    tries = F.array(*[F.struct(F.col("by"), F.lit(k).alias("rank"), F.concat("stem", F.lit(s)).alias("path")) for k, s in enumerate(SUFFIXES)])
    return tried.select(*keys, F.explode(tries).alias("t")).select(*keys, "t.*")


def resolve_tries(imports: DataFrame, tries: DataFrame, files: DataFrame) -> DataFrame:
    """imports with imported_file: the most preferred of their tries that files (repo, path) has, else null."""
    hit = tries.join(files.select("repo", "path").distinct(), ["repo", "path"]).groupBy(*IMPORT).agg(F.min_by("path", F.struct("by", "rank")).alias("imported_file"))
    return imports.join(hit, IMPORT, "left")


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Import rows of TypeScript files with the file they name, null where none does.

    A relative path starts at the importer's folder; any other goes by the aliases (repo, root, prefix, target)
    of the nearest root that the importer is under, longest prefix first. The path as given, with .ts, with .tsx: the first that exists counts.
    """
    return resolve_tries(imports, import_tries(imports, aliases), files)


#: Endings of imports that are no source files.
ASSETS = ("css", "json", "svg", "png", "jpg")


def unresolved_imports(resolved: DataFrame) -> DataFrame:
    """(repo, imports, unresolved, passed): assets are left out; passed when every import names a file."""
    kept = resolved.filter(~F.col("import_path").rlike(r"\.(?:" + "|".join(ASSETS) + ")$"))
    return kept.groupBy("repo").agg(F.count(F.lit(1)).alias("imports"), F.count_if(F.col("imported_file").isNull()).alias("unresolved")).withColumn("passed", F.col("unresolved") == 0)


def unique_symbols(symbols: DataFrame) -> DataFrame:
    """One row for each name: the last definition in scan order (.ts, .tsx, .py, .go, .rs; path; position)."""
    ending = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("ts", "tsx", "py", "go", "rs"))), ending), F.lit(0))
    return symbols.groupBy("repo", "name").agg(F.max_by(F.struct("file", "kind"), F.struct(rank, F.col("file"), F.col("pos"))).alias("s")).select("repo", "name", "s.file", "s.kind")


def derivations(calls: DataFrame, winners: DataFrame) -> DataFrame:
    """(repo, caller_file, called_name, callee_file), distinct: where each call leads. The exact name first, only without one every type's method so named; winners: unique_symbols."""
    exact = winners.select("repo", F.col("name").alias("called_name"), F.col("file").alias("exact_file"))
    last = F.element_at(F.split("name", r"\."), -1)
    methods = winners.filter("kind in ('method', 'interface_method')").select("repo", last.alias("called_name"), F.col("file").alias("method_file")).distinct()
    named = calls.select("repo", "caller_file", "called_name").distinct().join(exact, ["repo", "called_name"], "left")
    by_exact = named.filter("exact_file is not null").withColumnRenamed("exact_file", "callee_file")
    by_method = named.filter("exact_file is null").join(methods, ["repo", "called_name"]).withColumnRenamed("method_file", "callee_file")
    columns = ["repo", "caller_file", "called_name", "callee_file"]
    return by_exact.select(*columns).unionByName(by_method.select(*columns)).filter("caller_file <> callee_file")


def call_file_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, caller_file, callee_file): the files that a file's calls lead to. Of each name its winning record counts."""
    return derivations(calls, unique_symbols(symbols)).select("repo", "caller_file", "callee_file").distinct()


#: Seeds whose bits share a number.
WORD = 64


class Closure:
    """What is reached from each seed along edges (repo, src, dst), as bits: of WORD seeds in one number for each node and round.

    names: (repo, name, node), the number of each node. seeds: (repo, seed, id). bits: (node, word, bits, depth): bit i is the seed of
    id word * WORD + i, which reaches the node in depth steps and not in fewer. Neighbours in path order share a word, so the
    files of a folder, which reach much the same, cost one number a node. A round sends, along each edge, the bits that are new,
    and writes those that no earlier round has.
    """

    def __init__(self, edges: DataFrame, seeds: DataFrame | None = None, max_depth: int | None = None):
        spark = edges.sparkSession
        base = f"{shared_dir(spark)}/closure-{uuid.uuid4().hex}"
        edges = settled(edges.select("repo", "src", "dst").filter("src <> dst").distinct(), "edges")
        ends = edges.select("repo", F.col("src").alias("name")).unionByName(edges.select("repo", F.col("dst").alias("name")))
        starts = ends if seeds is None else seeds.select("repo", F.col("file").alias("name"))
        ordered = lambda df: df.distinct().repartitionByRange("repo", "name").sortWithinPartitions("repo", "name")
        own = settled(ordered(starts).withColumn("id", F.monotonically_increasing_id()), "seeds")
        self.seeds = own.withColumnRenamed("name", "seed")
        self.names = own.withColumnRenamed("id", "node") if seeds is None else settled(ordered(ends.unionByName(starts)).withColumn("node", F.monotonically_increasing_id()), "names")
        number = lambda c: self.names.select("repo", F.col("name").alias(c), F.col("node").alias(f"{c}_node"))
        edges = settled(edges.join(number("src"), ["repo", "src"]).join(number("dst"), ["repo", "dst"]).select(F.col("src_node").alias("node"), "dst_node"), "numbered")
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("id", F.lit(WORD)).cast("int"))
        fresh = own.join(self.names, ["repo", "name"]).select("node", F.floor(F.col("id") / WORD).alias("word"), one.alias("bits")).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
        shape, depth, none = "node long, word long, bits long", 0, F.lit(0).cast("long")
        while True:
            fresh.write.parquet(f"{base}/depth={depth}")
            found = spark.read.schema(shape).parquet(f"{base}/depth={depth}")
            self.bits = spark.read.schema(f"{shape}, depth int").parquet(base)
            if depth == max_depth or found.isEmpty():
                break
            depth += 1
            sent = found.join(edges, "node").select(F.col("dst_node").alias("node"), "word", none.alias("known"), F.col("bits").alias("sent"))
            known = self.bits.select("node", "word", F.col("bits").alias("known"), none.alias("sent"))
            both = known.unionByName(sent).groupBy("node", "word").agg(F.bit_or("known").alias("known"), F.bit_or("sent").alias("sent"))
            fresh = both.select("node", "word", F.col("sent").bitwiseAND(F.bitwise_not("known")).alias("bits")).filter("bits <> 0")

    def rows(self, bits: DataFrame) -> DataFrame:
        """bits with a row for each bit, and the id of its seed."""
        each = bits.select("*", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("i")).filter(F.getbit("bits", F.col("i")) == 1)
        return each.withColumn("id", F.col("word") * WORD + F.col("i"))

    def pairs(self) -> DataFrame:
        """(repo, seed, node, depth)"""
        named = self.bits.join(self.names.select("node", "name"), "node")
        return self.rows(named).select("id", "name", "depth").join(self.seeds, "id").select("repo", "seed", F.col("name").alias("node"), "depth")

    def sums(self, sizes: DataFrame) -> DataFrame:
        """(id, n, total) of each seed: how many nodes of sizes (repo, name, size) it reaches, and the sum of their sizes.

        The bits of a word meet in one task, and a row for each seed and node arises and is summed only there.
        """
        sized = self.bits.join(self.names.join(sizes, ["repo", "name"]).select("node", "size"), "node").select("word", "bits", "size")
        return self.rows(sized.repartition("word")).groupBy("word", "i").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).drop("word", "i")


def closure(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(repo, seed, node, depth): everything reachable from each seed, itself too, and in how many steps. Cycles are fine.

    seeds (repo, file): where to start; without it every node of the edges. max_depth: steps to go at most.
    """
    return Closure(edges, seeds, max_depth).pairs()


def dependency_edges(calls: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, src, dst) from call edges (repo, caller_file, callee_file) and resolved imports; an import counts if its file defines a symbol."""
    called = calls.select("repo", F.col("caller_file").alias("src"), F.col("callee_file").alias("dst"))
    known = symbols.select("repo", F.col("file").alias("dst")).distinct()
    imported = imports.filter("imported_file is not null").select("repo", F.col("importer_file").alias("src"), F.col("imported_file").alias("dst"))
    return called.unionByName(imported.join(known, ["repo", "dst"], "left_semi").select("repo", "src", "dst")).distinct()


def cone_sizes(files: DataFrame, edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(repo, origin, cone_files, cone_tokens, origin_tokens, total_tokens) for each file of the edges, or each seed.

    The bits of a closure are joined with the files' sizes and sent by word, 64 seeds in one row: no pair of files is moved.
    """
    sizes = settled(files.select("repo", F.col("path").alias("name"), count_tokens(F.col("content")).alias("size")), "tokens")
    total = sizes.groupBy("repo").agg(F.sum("size").alias("total_tokens"))
    reached = Closure(edges, seeds)
    cones = reached.sums(sizes).withColumnsRenamed({"n": "cone_files", "total": "cone_tokens"})
    origins = reached.seeds.join(sizes.withColumnsRenamed({"name": "seed", "size": "origin_tokens"}), ["repo", "seed"], "left")
    out = origins.join(cones, "id").join(total, "repo")
    return out.select("repo", F.col("seed").alias("origin"), "cone_files", "cone_tokens", F.coalesce("origin_tokens", F.lit(0)).alias("origin_tokens"), "total_tokens")


def ratio(cone: Column, total: Column) -> Column:
    """Percent of the repository to one place, halves up; whole numbers are divided last."""
    return F.when(total > 0, F.floor((cone * 2000 + total) / (total * 2)) / 10)


def measure_cones(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, name, kind, origin, cone_files, cone_tokens, origin_tokens, cone_ratio) for each symbol, by its winning record.

    A cone depends on the symbol's file alone, so it is measured once a file. cone_ratio is in percent of the repository.
    """
    winners = unique_symbols(symbols).withColumnRenamed("file", "origin")
    sizes = cone_sizes(files, edges, winners.select("repo", F.col("origin").alias("file")))
    share = ratio(F.col("cone_tokens"), F.col("total_tokens"))
    return winners.join(sizes, ["repo", "origin"]).select("repo", "name", "kind", "origin", "cone_files", "cone_tokens", "origin_tokens", share.alias("cone_ratio"))
