"""Symbol diffs, delta routing, the token ledger and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depscope.sources.shared import settled

#: US cents for a million tokens (input, output), by model.
RATES = {"claude-haiku-4.5": (25, 125), "claude-sonnet-4": (300, 1500), "claude-sonnet-4.6": (300, 1500)}
DEFAULT_RATE = (300, 1500)
#: Fixed pattern of a compiler's error line.
DIAGNOSTIC = r"^(.+?)\(([0-9]+),([0-9]+)\): +error +(TS[0-9]+): +(.+)$"


def _last_of_name(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Of a name defined more than once the last one; without a start column any order of bodies."""
    order = F.struct(*[c for c in ("start", "body") if c in symbols.columns])
    return symbols.groupBy(*keys).agg(F.max_by("body", order).alias("body"))


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, file, name, change): added, removed, or changed where the body differs; a file new or gone has all its names added or removed."""
    keys = ["repo", "file", "name"]
    both = _last_of_name(old, keys).withColumnRenamed("body", "was").join(_last_of_name(new, keys).withColumnRenamed("body", "now"), keys, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select(*keys, change.alias("change")).filter("change is not null")


def symbol_fingerprint(symbols: DataFrame) -> DataFrame:
    """(repo, file, n_symbols, fingerprint): md5 of the sorted distinct names."""
    names = F.array_sort(F.collect_set("name"))
    return symbols.groupBy("repo", "file").agg(F.countDistinct("name").alias("n_symbols"), F.md5(F.array_join(names, ",").cast("binary")).alias("fingerprint"))


def same_fingerprints(*runs: DataFrame) -> DataFrame:
    """(repo, file, runs, unique_results, passed) over the fingerprints of several runs."""
    every = None
    for k, r in enumerate(runs):
        r = r.select("repo", "file", "fingerprint", F.lit(k).alias("run"))
        every = r if every is None else every.unionByName(r)
    found = every.groupBy("repo", "file").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("fingerprint").alias("unique_results"))
    return found.withColumn("passed", (F.col("unique_results") == 1) & (F.col("runs") == len(runs)))


def replace_files(old: DataFrame, new: DataFrame, touched: DataFrame, file_col: str = "file") -> DataFrame:
    """old with the rows of touched files (repo, file) replaced by those of new; a file that new lacks is gone."""
    t = touched.select("repo", F.col("file").alias(file_col)).distinct()
    return old.join(t, ["repo", file_col], "left_anti").unionByName(new.join(t, ["repo", file_col], "left_semi").select(*old.columns))


def commit_deltas(diff: DataFrame, notified: DataFrame) -> DataFrame:
    """(repo, file, added, changed, removed, all_changed, notifications) for each file with a change; notified (repo, file, agent_id, ...) has a row a notification."""
    counts = diff.groupBy("repo", "file").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "changed", "removed")], F.count(F.lit(1)).alias("all_changed"))
    sent = notified.groupBy("repo", "file").agg(F.count(F.lit(1)).alias("notifications"))
    return counts.join(sent, ["repo", "file"], "left").withColumn("notifications", F.coalesce("notifications", F.lit(0)))


def bucket(ts: Column, window_s: int) -> Column:
    """Number of the stretch of window_s seconds that ts lies in; without a window each microsecond is one."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(max(window_s * 1000000, 1)))


#: Of the symbols of a delta, those an agent read in a stretch, and its flushes in one, a row lists so many at most; what has more takes a shuffle of its hits.
LISTED = 64


def _listed(rows: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """(*keys, name, many): the rows of each key as a list, or an empty list and many where there are more than LISTED."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    few = F.when(F.col("_n") <= LISTED, F.struct(*fields))
    return rows.withColumn("_n", n).groupBy(*keys).agg(F.array_sort(F.collect_list(few)).alias(name), (F.max("_n") > LISTED).alias("many"))


def _with_lists(rows: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """rows (*keys, *fields), each with the list of its key; null where that is longer than LISTED."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    counted = rows.select(*keys, *fields).withColumn("_n", n)
    few = counted.filter(F.col("_n") <= LISTED).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    listed = few.select(*keys, name, F.inline(name))
    return listed.unionByName(counted.filter(F.col("_n") > LISTED).drop("_n").withColumn(name, F.lit(None)))


def read_spans(reads: DataFrame, window_s: int) -> DataFrame:
    """(repo, agent_id, b, symbol, since, until, spans): what an agent's reads of a symbol mean for the deltas of stretch b.

    A delta of b meets a read of b if it is not before since, the first of them, and one of the stretch before if it is not after
    until, when the last of those runs out. So a symbol has one row, however often it was read. spans: the agent's rows of b.
    """
    ends = F.expr(f"INTERVAL {window_s} SECOND")
    seen = reads.select("repo", "agent_id", "symbol", F.col("ts").alias("at"), bucket(F.col("ts"), window_s).alias("own"), F.explode(F.array(F.lit(0), F.lit(1))).alias("later"))
    seen = seen.withColumn("b", F.col("own") + F.col("later"))
    one = seen.groupBy("repo", "agent_id", "b", "symbol").agg(F.min(F.when(F.col("later") == 0, F.col("at"))).alias("since"), F.max(F.when(F.col("later") == 1, F.col("at") + ends)).alias("until"))
    return _with_lists(one, ["repo", "agent_id", "b"], ["symbol", "since", "until"], "spans")


def changed_names(deltas: DataFrame, window_s: int, *more: str) -> DataFrame:
    """(repo, delta_id, ts, *more, symbol, emitting_agent, changed, b): a row for each symbol of a delta; changed: all of them."""
    names = deltas.select("repo", "delta_id", "ts", *more, "symbol", "emitting_agent").distinct()
    listed = _with_lists(names, ["repo", "delta_id", "ts", *more], ["symbol", "emitting_agent"], "changed")
    return listed.withColumn("b", bucket(F.col("ts"), window_s))


def meets(since: Column, until: Column) -> Column:
    """Whether a delta at ts meets a read of read_spans."""
    return F.coalesce(since <= F.col("ts"), F.lit(False)) | F.coalesce(until >= F.col("ts"), F.lit(False))


def notifications(changed: DataFrame, spans: DataFrame, *more: str) -> DataFrame:
    """(repo, delta_id, agent_id, ts, changed_symbols, *more): deltas (changed_names) and the other agents whose reads (read_spans) they meet.

    more: columns that both share and are joined by, or of spans. Each delta and agent is told in the row of the first symbol by which
    they meet, which has the lists of both, so pairs are neither sorted nor sent: they leave the join as they arise. Only those
    with a list of more than LISTED are grouped.
    """
    keys = ["repo", "symbol", "b", *[c for c in more if c in changed.columns]]
    out = ["repo", "delta_id", "agent_id", "ts"]
    hit = meets(F.col("since"), F.col("until")) & (F.col("agent_id") != F.col("emitting_agent"))
    # an agent that read one symbol is told of that one: most pairs are such, and need no lists
    one, several = spans.filter("size(spans) = 1"), spans.filter("size(spans) > 1")
    listed = changed.filter("changed is not null")
    alone = F.size(F.array_distinct(F.transform("changed", lambda c: c["emitting_agent"]))) == 1
    plain = listed.filter(alone).drop("changed").join(one.drop("spans"), keys).filter(hit).select(*out, F.col("symbol").alias("changed_symbols"), *more)
    met = listed.join(several, keys).unionByName(listed.filter(~alone).join(one, keys)).filter(hit)
    read = lambda c: F.exists("spans", lambda x: (x["symbol"] == c["symbol"]) & meets(x["since"], x["until"]))
    hits = F.filter("changed", lambda c: (c["emitting_agent"] != F.col("agent_id")) & read(c))
    here = F.struct("symbol", "emitting_agent")
    names = lambda h: F.when(F.get(h, F.lit(0)) == here, F.array_join(F.array_distinct(F.transform(h, lambda c: c["symbol"])), ","))
    told = F.array_compact(F.transform(F.array(hits), names))  # of one or none
    few = plain.unionByName(met.select(*out, F.explode(told).alias("changed_symbols"), *more))
    large = changed.filter("changed is null").join(spans, keys).unionByName(changed.filter("changed is not null").join(spans.filter("spans is null"), keys)).filter(hit)
    many = large.groupBy(*out, *more).agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("changed_symbols"))
    return few.unionByName(many)


def route_deltas(deltas: DataFrame, reads: DataFrame, window_s: int = 300) -> DataFrame:
    """(repo, delta_id, agent_id, ts, changed_symbols): one notification for each delta and each other agent that read a changed symbol in the window (its ends count)."""
    return notifications(settled(changed_names(deltas, window_s), "changed"), settled(read_spans(reads, window_s), "spans"))


def _flushed(spans: DataFrame, flushes: DataFrame, window_s: int) -> DataFrame:
    """spans with flushes, the agent's in the stretch (none listed and crowded if there are more than LISTED), and next_flush, its first one in a later stretch."""
    keys = ["repo", "agent_id", "b"]
    f = flushes.select("repo", "agent_id", F.col("ts").alias("at"), "flush_id", bucket(F.col("ts"), window_s).alias("b"))
    lists = _listed(f, keys, ["at", "flush_id"], "flushes").withColumnRenamed("many", "crowded")
    firsts = f.groupBy(*keys).agg(F.min(F.struct("at", "flush_id"))["flush_id"].alias("first"))
    known = spans.select(*keys).distinct().join(lists.join(firsts, keys), keys, "full_outer")
    later = Window.partitionBy("repo", "agent_id").orderBy("b").rowsBetween(1, Window.unboundedFollowing)  # the stretches of an agent
    return spans.join(known.withColumn("next_flush", F.first("first", ignorenulls=True).over(later)).drop("first"), keys).withColumn("crowded", F.coalesce("crowded", F.lit(False)))


def deliver(deltas: DataFrame, reads: DataFrame, flushes: DataFrame, window_s: int = 300, pending: bool = False) -> DataFrame:
    """(repo, delta_id, agent_id, ts, changed_symbols, delivered_by): pending_after_flush of route_deltas; with pending only what is still queued.

    An agent's flushes come with its reads, so notifications are not sent to them: only those of an agent with more than LISTED flushes in a stretch are.
    """
    changed = settled(changed_names(deltas, window_s), "changed")
    spans = _flushed(read_spans(reads, window_s), flushes, window_s)
    spans = settled(spans.filter("next_flush is null") if pending else spans, "spans")
    own = F.get(F.filter("flushes", lambda f: f["at"] >= F.col("ts")), F.lit(0))["flush_id"]
    by = F.coalesce(F.when(F.size("flushes") > 0, own), F.col("next_flush"))
    columns = ["repo", "delta_id", "agent_id", "ts", "changed_symbols", "delivered_by"]
    plain = notifications(changed, spans.filter("not crowded"), "flushes", "next_flush").withColumn("delivered_by", by)
    rest = notifications(changed, spans.filter("crowded"))
    rest = rest.join(pending_after_flush(rest, flushes), ["repo", "delta_id", "agent_id"])
    out = plain.select(*columns).unionByName(rest.select(*columns))
    return out.filter("delivered_by is null") if pending else out


def pending_after_flush(notifications: DataFrame, flushes: DataFrame) -> DataFrame:
    """Each notification with the first flush of its agent at or after it; null: still queued.

    A scan of two levels: rows are dealt out by ranges of (agent, time), so that an agent may lie in many parts; in a part the
    flushes are carried backward over the rows before them, and rows behind an agent's last flush in a part get the first
    one of the agent's later parts, of which there is one row a part.
    """
    n = notifications.select("repo", "agent_id", "ts", F.lit(0).alias("turn"), F.col("delta_id").alias("id"), F.lit(None).cast("long").alias("flush_id"))
    f = flushes.select("repo", "agent_id", "ts", F.lit(1).alias("turn"), F.col("flush_id").alias("id"), "flush_id")
    order, agent = ["ts", "turn", "id"], ["repo", "agent_id"]
    parts = int(n.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settled(n.unionByName(f).repartitionByRange(parts, *agent, *order).withColumn("part", F.spark_partition_id()), "queue")
    first = rows.groupBy(*agent, "part").agg(F.min_by("flush_id", F.when(F.col("turn") == 1, F.struct(*order))).alias("first"))
    later = Window.partitionBy(*agent).orderBy("part").rowsBetween(1, Window.unboundedFollowing)  # the parts of an agent
    carried = first.select(*agent, "part", F.first("first", ignorenulls=True).over(later).alias("carried"))
    ahead = Window.partitionBy(*agent, "part").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    own = rows.withColumn("own", F.first("flush_id", ignorenulls=True).over(ahead)).filter("turn = 0")
    return own.join(carried, [*agent, "part"]).select("repo", F.col("id").alias("delta_id"), "agent_id", F.coalesce("own", "carried").alias("delivered_by"))


def cost_units(model: Column, prompt: Column, completion: Column) -> Column:
    """Cost in whole hundred-millionths of a dollar: the exact model name (a vendor prefix aside), else a haiku, else a sonnet, else the default."""
    name = F.element_at(F.split(model, "/"), -1)

    def rate(k: int) -> Column:
        exact = F.lit(None)
        for m, r in RATES.items():
            exact = F.when(name == m, F.lit(r[k])).otherwise(exact)
        low = F.lower(model)
        family = F.when(low.contains("haiku"), RATES["claude-haiku-4.5"][k]).when(low.contains("sonnet"), RATES["claude-sonnet-4.6"][k])
        return F.coalesce(exact, family, F.lit(DEFAULT_RATE[k])).cast("long")

    return prompt * rate(0) + completion * rate(1)


def dollars(units: Column) -> Column:
    return units.cast("double") / F.lit(100000000.0)


def estimate_cost(model: Column, prompt: Column, completion: Column) -> Column:
    return dollars(cost_units(model, prompt, completion))


def _cost() -> Column:
    """Dollars of all rows of a group: whole units are summed, so the order of the rows does not matter."""
    return dollars(F.sum(cost_units(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"))))


def ledger_summary(records: DataFrame) -> DataFrame:
    """Totals of each run, and by agent, task and model; level tells them apart."""
    cols = ["run_id", "agent_id", "task_id", "model"]
    units = cost_units(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"))
    sets = records.withColumn("u", units).groupingSets([["run_id"], ["run_id", "agent_id"], ["run_id", "task_id"], ["run_id", "model"]], *cols)
    out = sets.agg(
        F.grouping_id().alias("g"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("u").alias("u"), F.count(F.lit(1)).alias("calls")
    )
    level = F.when(F.col("g") == 7, "run").when(F.col("g") == 3, "agent").when(F.col("g") == 5, "task").otherwise("model")
    key, cost = F.coalesce("agent_id", "task_id", "model", F.lit("")), dollars(F.col("u"))
    return out.select("run_id", level.alias("level"), key.alias("key"), "prompt_tokens", "completion_tokens", cost.alias("cost_usd"), "calls")


def list_runs(records: DataFrame, top: int = 20) -> DataFrame:
    """The runs that began last, with their totals."""
    return (
        records.groupBy("run_id")
        .agg(
            F.min("ts").cast("string").alias("first_ts"),
            F.max("ts").cast("string").alias("last_ts"),
            F.count(F.lit(1)).alias("calls"),
            F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("completion_tokens").alias("completion_tokens"),
            F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
            _cost().alias("cost_usd"),
            F.count_if("passed").alias("passed"),
            F.count_if(~F.col("passed")).alias("failed"),
        )
        .orderBy(F.desc("first_ts"), "run_id")
        .limit(top)
    )


def parse_diagnostics(lines: DataFrame) -> DataFrame:
    """Lines that are compiler errors, in columns."""
    part = lambda k: F.regexp_extract("line_text", DIAGNOSTIC, k)
    return lines.filter(F.col("line_text").rlike(DIAGNOSTIC)).select(
        "run_id", "attempt", part(1).alias("file"), part(2).cast("long").alias("line"), part(3).cast("long").alias("col"), part(4).alias("code"), F.trim(part(5)).alias("message")
    )


def new_diagnostics(diagnostics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Diagnostics whose (file, code, message) the run's baseline lacks; duplicates stay."""
    return diagnostics.join(baseline.select("run_id", "file", "code", "message").distinct(), ["run_id", "file", "code", "message"], "left_anti").select(*diagnostics.columns)


def dedup_diagnostics(diagnostics: DataFrame, changed: DataFrame | None = None, top: int = 3) -> DataFrame:
    """For each run and attempt, the first of each (file, code); the first three of those: errors of changed files (run_id, file) first, then by line."""
    keys = ["run_id", "attempt"]
    if changed is not None:
        diagnostics = diagnostics.join(changed.select("run_id", "file", F.lit(0).alias("other")).distinct(), ["run_id", "file"], "left").withColumn("other", F.coalesce("other", F.lit(1)))
    else:
        diagnostics = diagnostics.withColumn("other", F.lit(1))
    first = diagnostics.groupBy(*keys, "file", "code").agg(F.min(F.struct("other", "line", "col", "message")).alias("d")).select(*keys, "file", "code", "d.*")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("other", "line", "file", "code"))
    return first.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).drop("other")
