"""What cones save, graph statistics, symbol searches and the checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depscope.operators.graph import closure, count_tokens, unique_symbols
from depscope.operators.matching import containing

#: Fixed value: dollars for a million prompt tokens saved.
SAVED_RATE = 3


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, cut to three places; null where there is no whole."""
    a, b = (c.cast("decimal(38,0)") for c in (part, whole))
    large = F.abs(part) > 90000000000  # part * 100000 is no whole double any more, or beyond a long
    return F.when(whole > 0, F.when(large, F.call_function("div", a * 100000, b)).otherwise(F.floor(part * 100000 / whole)) / 1000)


def all_cones(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(repo, seed_file, file, depth) for every file of the edges, or for the seeds: what is reached in depth steps, max_depth at most. A file outside the edges is its own cone."""
    return closure(edges, seeds, max_depth).select("repo", F.col("seed").alias("seed_file"), F.col("node").alias("file"), "depth")


def symbol_cones(names: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, name, file): the files that each asked name needs; unknown names have none."""
    origin = names.select("repo", "name").distinct().join(unique_symbols(symbols), ["repo", "name"]).select("repo", "name", F.col("file").alias("seed_file"))
    cones = all_cones(edges, origin.select("repo", F.col("seed_file").alias("file")))
    return origin.join(cones, ["repo", "seed_file"]).select("repo", "name", "file")


def file_context(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, file, cone_file): the union of the cones of a file's symbols, each by its name's winning record."""
    winners = unique_symbols(symbols).select("repo", "name", F.col("file").alias("seed_file"))
    origin = symbols.select("repo", "file", "name").join(winners, ["repo", "name"]).select("repo", "file", "seed_file").distinct()
    cones = all_cones(edges, origin.select("repo", F.col("seed_file").alias("file"))).withColumnRenamed("file", "cone_file")
    return origin.join(cones, ["repo", "seed_file"]).select("repo", "file", "cone_file").distinct()


def cone_context(cones: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, seed_file, ord, piece): the bundle of a cone, a row a file in path order; nothing is collected, so hubs of any size work."""
    order = F.row_number().over(Window.partitionBy("repo", "seed_file").orderBy("file")).cast("long")
    ordered = cones.select("repo", "seed_file", "file", order.alias("ord"))
    text = files.select("repo", F.col("path").alias("file"), "content")
    piece = F.concat(F.lit("// ── FILE: "), "file", F.lit(" ──\n"), F.coalesce("content", F.lit("")))
    return ordered.join(text, ["repo", "file"]).select("repo", "seed_file", "ord", piece.alias("piece"))


def connected_symbols(symbols: DataFrame, edges: DataFrame, n: int = 20) -> DataFrame:
    """The first n names whose file calls into or imports another."""
    return unique_symbols(symbols).join(edges.select("repo", F.col("src").alias("file")).distinct(), ["repo", "file"], "left_semi").orderBy("name").limit(n).select("name", "file")


def cone_summary(measured: DataFrame) -> DataFrame:
    """(repo, cones, avg_ratio, avg_files, avg_reduction) over the measured symbols; sums of tenths, divided once."""
    tenths = F.sum(F.round(F.col("cone_ratio") * 10).cast("long"))
    out = measured.groupBy("repo").agg(F.count(F.lit(1)).alias("cones"), tenths.alias("t"), F.sum("cone_files").alias("f"))
    ratio = F.col("t") / F.col("cones") / 10
    return out.select("repo", "cones", ratio.alias("avg_ratio"), (F.col("f") / F.col("cones")).alias("avg_files"), (100 - ratio).alias("avg_reduction"))


def cone_reduction(measured: DataFrame) -> DataFrame:
    """Percent of the repository that each symbol's cone spares."""
    return measured.select("repo", "name", (100 - F.col("cone_ratio")).alias("reduction_pct"))


def repo_tokens(files: DataFrame) -> DataFrame:
    return files.groupBy("repo").agg(F.sum(count_tokens(F.col("content"))).alias("total_tokens"))


def session_stats(measured: DataFrame, total: DataFrame) -> DataFrame:
    """One query a symbol: what all their cones took and spared, in tokens and dollars."""
    return (
        measured.groupBy("repo")
        .agg(F.count(F.lit(1)).alias("queries"), F.sum("cone_tokens").alias("cone_tokens"))
        .join(total.withColumnRenamed("total_tokens", "t"), "repo")
        .withColumn("total_tokens", F.col("t") * F.col("queries"))
        .drop("t")
        .withColumn("tokens_saved", F.col("total_tokens") - F.col("cone_tokens"))
        .withColumn("reduction_pct", percent(F.col("tokens_saved"), F.col("total_tokens")))
        .withColumn("cost_saved", F.col("tokens_saved") * SAVED_RATE / F.lit(1000000.0))
    )


def handoff_savings(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(repo, src, dst, savings_pct): two agents that hold the cones of an edge's ends (sizes: graph.cone_sizes), against two full contexts."""
    a = sizes.select("repo", F.col("origin").alias("src"), F.col("cone_tokens").alias("a"), "total_tokens")
    b = sizes.select("repo", F.col("origin").alias("dst"), F.col("cone_tokens").alias("b"))
    full = 2 * F.col("total_tokens")
    return edges.join(a, ["repo", "src"]).join(b, ["repo", "dst"]).select("repo", "src", "dst", percent(full - F.col("a") - F.col("b"), full).alias("savings_pct"))


def token_savings_check(measured: DataFrame, target: float = 80.0) -> DataFrame:
    """Cones of up to two files are leaves; passed when the best leaf spares the target."""
    saved = 100 - F.col("cone_ratio")
    leaf = F.col("cone_files") <= 2
    tenths = F.sum(F.round(F.col("cone_ratio") * 10).cast("long"))
    return measured.groupBy("repo").agg(
        F.count_if(leaf).alias("leaves"),
        F.max(F.when(leaf, saved)).alias("best_leaf_savings"),
        F.min(saved).alias("hub_savings"),
        (100 - tenths / F.count(F.lit(1)) / 10).alias("avg_savings"),
        F.coalesce(F.max(F.when(leaf, saved)) >= target, F.lit(False)).alias("passed"),
    )


def graph_summary(files: DataFrame, symbols: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, metric, value): files, symbols, files with calls, edges: the call edges between files."""
    def one(df: DataFrame, name: str, column: Column) -> DataFrame:
        return df.groupBy("repo").agg(column.alias("value")).select("repo", F.lit(name).alias("metric"), "value")

    return (
        one(files, "files", F.countDistinct("path"))
        .unionByName(one(symbols, "symbols", F.countDistinct("name")))
        .unionByName(one(calls, "files_with_calls", F.countDistinct("caller_file")))
        .unionByName(one(edges, "edges", F.count(F.lit(1))))
    )


def compare_corpora(stats: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, value_a, value_b, ratio) of two repositories in stats (repo, metric, value)."""
    of = lambda r: F.max(F.when(F.col("repo") == r, F.col("value")))
    both = stats.groupBy("metric").agg(of(a).alias("value_a"), of(b).alias("value_b"))
    return both.withColumn("ratio", F.when(F.col("value_a") > 0, F.floor(F.col("value_b") * 1000 / F.col("value_a")) / 1000))


def build_time_check(timings: DataFrame) -> DataFrame:
    """Five seconds for 500 files are allowed, one at least."""
    target = F.greatest(F.col("file_count") / 500.0 * 5, F.lit(1.0))
    return timings.select("*", target.alias("target_s"), (F.col("elapsed_s") < target).alias("passed"))


def parse_success(files: DataFrame, target: float = 99.0) -> DataFrame:
    """(repo, total, failed, success_rate, passed) of scanned files, by their parse_ok; a repository without files is not there."""
    out = files.groupBy("repo").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("parse_ok")).alias("failed"))
    rate = F.coalesce(percent(F.col("total") - F.col("failed"), F.col("total")), F.lit(0.0))
    return out.select("repo", "total", "failed", rate.alias("success_rate"), (rate >= target).alias("passed"))


def list_symbols(symbols: DataFrame, file: str | None = None, kind: str | None = None, query: str | None = None, limit: int = 100) -> DataFrame:
    """The first names that pass the filters; query is looked for in any case."""
    out = unique_symbols(symbols)
    for wanted, test in ((file, F.col("file") == file), (kind, F.col("kind") == kind), (query, F.contains(F.lower("name"), F.lit((query or "").lower())))):
        out = out if wanted is None else out.filter(test)
    return out.select("name", "kind", "file").orderBy("name").limit(limit)


def suggest_symbols(symbols: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Names that contain an unknown one; none for a known one."""
    known = symbols.filter(F.col("name") == name).limit(1).select(F.lit(1).alias("known"))
    return list_symbols(symbols, query=name, limit=limit).select("name").join(F.broadcast(known), F.lit(True), "left_anti")


def changed_source_files(changes: DataFrame, prefix: str, suffixes: tuple[str, ...] = (".ts", ".tsx")) -> DataFrame:
    """(commit, file) of changed sources under prefix, relative to it."""
    source = F.lit(False)
    for s in suffixes:
        source = source | F.col("path").endswith(s)
    return changes.filter(F.col("path").startswith(prefix) & source).select("commit", F.expr(f"substring(path, {len(prefix) + 1})").alias("file"))


def strip_code_fences(text: Column) -> Column:
    """text without the lines that start with three backticks."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.startswith("```")), "\n")


def assemble_replies(lines: DataFrame) -> DataFrame:
    """(conv_id, reply, prompt_tokens, completion_tokens): the text pieces of a streamed response in order, and what it took.

    Lines without data:, [DONE], blanks and broken JSON are skipped. The last usage a line reports counts;
    without one prompt_tokens is null and completion_tokens are those of the reply. A response without any piece has an empty reply.
    """
    chunk = F.trim(F.substring("line", 6, 1 << 30))
    kept = lines.filter(F.col("line").startswith("data:")).select("conv_id", "line_no", chunk.alias("chunk"))
    kept = kept.filter(~F.col("chunk").isin("", "[DONE]") & F.get_json_object("chunk", "$").isNotNull())
    piece = F.coalesce(F.get_json_object("chunk", "$.choices[0].delta.content"), F.lit(""))
    count = lambda name: F.get_json_object("chunk", f"$.usage.{name}").cast("long").alias(name)
    told = F.get_json_object("chunk", "$.usage").isNotNull()
    usage = F.when(told, F.struct(count("prompt_tokens"), count("completion_tokens")))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "piece")))  # the lines of one response
    out = kept.select("conv_id", "line_no", piece.alias("piece"), usage.alias("used")).groupBy("conv_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("reply"), F.max_by("used", F.when(F.col("used").isNotNull(), F.col("line_no"))).alias("used")
    )
    return out.select("conv_id", "reply", F.col("used.prompt_tokens").alias("prompt_tokens"), F.coalesce("used.completion_tokens", count_tokens(F.col("reply"))).alias("completion_tokens"))


def find_callers(changed: DataFrame, calls: DataFrame) -> DataFrame:
    """(repo, change_id, file, hits): files that call a changed symbol (repo, change_id, symbol), and which, sorted."""
    hit = calls.select("repo", F.col("caller_file").alias("file"), F.col("called_name").alias("symbol")).join(changed.select("repo", "change_id", "symbol").distinct(), ["repo", "symbol"])
    return hit.groupBy("repo", "change_id", "file").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("hits"), F.countDistinct("symbol").alias("n_hits"))


def top_caller(callers: DataFrame) -> DataFrame:
    """(repo, change_id, file, n_hits) of the caller with most changed symbols; ties go to the smaller path."""
    best = F.min(F.struct((-F.col("n_hits")).alias("h"), F.col("file"))).alias("b")
    return callers.groupBy("repo", "change_id").agg(best).select("repo", "change_id", "b.file", (-F.col("b.h")).alias("n_hits"))


def import_callers(changed: DataFrame, callers: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, change_id, file): for changes (repo, change_id, file) that no call leads to, the importers of the changed file.

    An import counts if its target contains the changed path without .ts, anywhere.
    """
    stem = F.replace("file", F.lit(".ts"), F.lit(""))
    alone = changed.join(callers.select("repo", "change_id").distinct(), ["repo", "change_id"], "left_anti")
    bare = alone.select("repo", "change_id", stem.alias("pattern")).distinct()
    t = imports.filter("imported_file is not null").select("repo", F.col("importer_file").alias("file"), F.col("imported_file").alias("text")).distinct()
    met = containing(t, "text", bare, "pattern", ("repo",))
    return met.join(bare, ["repo", "pattern"]).join(t, ["repo", "text"]).select("repo", "change_id", "file").distinct()
