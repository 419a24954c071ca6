"""Rule registry, the unified findings table, and evidence."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrylake.operators.routes import Routes
from sentrylake.schema import severity_rank, struct_type
from sentrylake.session import FREED, held, shared_folder, staged

FINDING_COLUMNS = {
    "finding_id": "string", "kit": "string", "rule_id": "string", "title": "string", "severity": "string",
    "severity_rank": "int", "confidence": "string", "score": "int", "category": "string",
    "first_us": "bigint", "last_us": "bigint", "src_ip": "string", "dst_ip": "string", "user": "string",
    "entity": "string", "mitre": "array<string>", "metrics": "map<string,string>", "case_key": "string",
}
#: What stands behind a finding, a row each: every value of the lists it counts (kind names the list), and with
#: kind 'event' every event that made it up. Lists are read in the order of value, events by ts_us, event_id.
ITEM_COLUMNS = {"finding_id": "string", "rule_id": "string", "kind": "string", "value": "string", "event_id": "bigint", "ts_us": "bigint"}


@dataclass(frozen=True)
class Listed:
    """All values of one kind behind findings: rows hold the keys (columns of the findings) and the value, and
    first_us where it is known. Repeats are allowed."""
    kind: str
    rows: DataFrame
    keys: tuple
    value: str


@dataclass(frozen=True)
class Found:
    """What a rule returns: a row per finding, its lists, and the events behind it (rows with event_id, ts_us and the keys)."""
    rows: DataFrame
    lists: tuple = ()
    events: DataFrame | None = None
    event_keys: tuple = ()


def listed(kind: str, rows: DataFrame, keys: list[str], value: str) -> Listed:
    return Listed(kind, rows, tuple(keys), value)


def found(rows: DataFrame, *lists: Listed, events: DataFrame | None = None, keys=()) -> Found:
    return Found(rows, lists, events, tuple(keys))


@dataclass(frozen=True)
class Rule:
    """reads names the route whose rows the rule looks at (see operators.routes); None: all events."""
    kit: str
    name: str
    rule_id: str
    title: str
    category: str
    mitre: tuple
    build: Callable
    reads: str | None = None

    def run(self, events, config) -> Found:
        out = self.build(events, config)
        return out if isinstance(out, Found) else Found(out)


REGISTRY: dict[str, list[Rule]] = {"net": [], "win": [], "pkt": [], "mail": []}


def rule(kit: str, rule_id: str, title: str, category: str, mitre=(), reads: str | None = None):
    """Register a function (events, config) -> Found, or a table of one row per finding. Called by its name, the function
    gives the rows alone."""
    def wrap(fn):
        REGISTRY[kit].append(Rule(kit, fn.__name__, rule_id, title, category, tuple(mitre), fn, reads))

        @wraps(fn)
        def rows(*args, **more):
            out = fn(*args, **more)
            return out.rows if isinstance(out, Found) else out
        rows.found = fn
        return rows
    return wrap


def with_lists(out: Found, *kinds: str, order: str | None = None) -> DataFrame:
    """The findings of a rule with the named lists as columns, whole: every distinct value of a finding, in the order of
    value or, if given, of another column first. Values are made distinct before the shuffle; a finding's list is one
    row, the items (as_items) have a row per value. Null keys meet null keys."""
    rows = out.rows
    for x in [x for kind in kinds for x in out.lists if x.kind == kind]:
        value = F.col(x.value)
        keys = [F.col(k).alias(f"_{k}") for k in x.keys]
        own = x.rows.where(value.isNotNull() & (value.cast("string") != ""))
        if order is None:
            lists = own.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(x.kind))
        else:
            own = own.groupBy(*keys, value.alias("_v")).agg(F.min(order).alias("_o"))
            lists = own.groupBy(*[f"_{k}" for k in x.keys]).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda p: p["_v"]).alias(x.kind))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in x.keys]
        rows = rows.join(lists, same, "left").drop(*[f"_{k}" for k in x.keys])
    return rows


def list_rules(spark: SparkSession, kit: str | None = None) -> DataFrame:
    from sentrylake.operators import mail_rules, net_access, net_channels, pkt_rules, win_rules  # noqa: F401
    rows = [(r.kit, r.name, r.rule_id, r.title, r.category, list(r.mitre))
            for k, rules in REGISTRY.items() for r in rules if kit in (None, k)]
    return spark.createDataFrame(
        rows, "kit string, name string, rule_id string, title string, category string, mitre array<string>")


def _metrics(df: DataFrame):
    """A rule's own columns as a map of texts."""
    types = dict(df.dtypes)

    def text(c):
        return F.to_json(F.col(c)) if types[c].startswith(("array", "map", "struct")) else F.col(c).cast("string")
    extra = [c for c in df.columns if c not in FINDING_COLUMNS]
    if not extra:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*[x for c in extra for x in (F.lit(c), text(c))]), lambda k, v: v.isNotNull())


def identified(df: DataFrame, r: Rule) -> DataFrame:
    """df with finding_id: a digest of the rule, the subject and all it says."""
    def part(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    subject = [part(c) for c in ("case_key", "src_ip", "dst_ip", "user", "entity", "first_us")]
    entries = F.to_json(F.array_sort(F.map_entries(_metrics(df))))
    own = F.col("rule_id") if "rule_id" in df.columns else F.lit(r.rule_id)
    return df.withColumn("finding_id", F.sha2(F.concat_ws("\u0001", own, *subject, entries), 256))


def as_findings(df: DataFrame | Found, r: Rule) -> DataFrame:
    """Fold a rule's own columns into the unified table; extra columns become metrics."""
    df = df.rows if isinstance(df, Found) else df
    df = df if "finding_id" in df.columns else identified(df, r)
    have = set(df.columns)

    def pick(name, default=None):
        return F.col(name) if name in have else F.lit(default)
    sev = pick("severity", "info")
    cols = {
        "kit": F.lit(r.kit), "rule_id": pick("rule_id", r.rule_id), "title": pick("title", r.title),
        "severity": sev, "severity_rank": severity_rank(sev), "confidence": pick("confidence", "medium"),
        "score": pick("score"), "category": pick("category", r.category),
        "mitre": pick("mitre") if "mitre" in have else F.array(*[F.lit(m) for m in r.mitre]).cast("array<string>"),
        "metrics": _metrics(df),
    }
    return df.select(*[
        cols.get(c, pick(c)).cast(t).alias(c) for c, t in FINDING_COLUMNS.items()])


def as_items(out: Found, rows: DataFrame, r: Rule) -> DataFrame | None:
    """The items of a rule's findings; rows are its findings with finding_id. Values are made distinct for a key
    before they meet its findings, and no list is ever one row, so a finding may have any number of them."""
    def ids(keys):
        return rows.select(*keys, "finding_id").distinct()
    parts = []
    for x in out.lists:
        keys, value = list(x.keys), F.col(x.value).cast("string")
        first = F.min("first_us") if "first_us" in x.rows.columns else F.lit(None)
        one = x.rows.where(F.col(x.value).isNotNull() & (value != "")).groupBy(*keys, value.alias("value")).agg(first.cast("bigint").alias("ts_us"))
        parts.append(one.join(ids(keys), keys).select("finding_id", F.lit(x.kind).alias("kind"), "value", F.lit(None).cast("bigint").alias("event_id"), "ts_us"))
    if out.events is not None:
        keys = list(out.event_keys)
        own = out.events.select(*keys, "event_id", "ts_us")
        parts.append(own.join(ids(keys), keys).select("finding_id", F.lit("event").alias("kind"), F.lit(None).cast("string").alias("value"), "event_id", "ts_us"))
    elif "event_id" in rows.columns:
        at = F.coalesce(*[F.col(c).cast("bigint") for c in ("first_us", "last_us") if c in rows.columns], F.lit(None).cast("bigint"))
        parts.append(rows.select("finding_id", F.lit("event").alias("kind"), F.lit(None).cast("string").alias("value"), "event_id", at.alias("ts_us")))
    if not parts:
        return None
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.select("finding_id", F.lit(r.rule_id).alias("rule_id"), "kind", "value", F.col("event_id").cast("bigint").alias("event_id"), "ts_us")


@dataclass
class Results:
    """findings, items, and the names of the rules that failed, with what they raised. Items may be given as a function that
    makes them: that runs once, when they are first asked for, so findings alone cost no items."""
    findings: DataFrame
    given: DataFrame | Callable
    failed: list = field(default_factory=list)
    raised: list = field(default_factory=list)

    @cached_property
    def items(self) -> DataFrame:
        return self.given if isinstance(self.given, DataFrame) else self.given()

    def whole(self) -> Results:
        """The same results, if every rule ended; for what is made of all rules and has no place for the failed ones. The
        items of whole results are whole as well, or asking for them fails."""
        def items() -> DataFrame:
            made = self.items
            self._need_all()
            return made
        self._need_all()
        return Results(self.findings, items, self.failed, self.raised)

    def _need_all(self) -> None:
        if self.failed:
            raise RuntimeError(f"rules failed, so findings or items are missing: {', '.join(self.failed)}") from (self.raised or [None])[0]


#: MB a core of a route from which on a rule fills the cluster by itself.
LARGE_MB = 4


def chosen(kit: str, only=None) -> list[Rule]:
    return [r for r in REGISTRY[kit] if not only or r.name in only or r.rule_id in only]


def run_all(kit: str, events, config, only=None, path: str | None = None, at_once: int = 4, items: bool = True) -> Results:
    """Run the rules of a kit, or the named ones, and write each rule's findings and items apart, under path or in
    the shared folder. A rule that fails, when it is built or when it runs, becomes one informational row and costs no
    other rule its result; what needs the results of all rules takes them by Results.whole(), which raises then. Rules run a few at a time, so that small jobs fill the cluster;
    those of a route with much to read run one after the other, and what a step shuffled leaves the disk when the step ends.

    Without a path, items are written when they are first asked for; a rule that fails only then keeps its findings, has no
    items and is named among the failed. Without items, a route is deleted when its last rule has ended.

    events: one table, or a table for each route (see operators.routes.dealt). For mail: whatever its rules take."""
    spark = (next(iter(events.values())) if isinstance(events, dict) else events).sparkSession
    base = path or f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}"

    pending, raised = {}, []

    def write_items(r: Rule) -> None:
        items = as_items(*pending[r.name], r)
        if items is not None:
            items.write.mode("overwrite").parquet(f"{base}/items/kit={kit}/rule={r.name}")

    def one(r: Rule) -> str | None:
        own = events[r.reads] if isinstance(events, dict) else events
        target = f"{base}/findings/kit={kit}/rule={r.name}"
        failed = None
        try:
            out = r.run(own, config)
            rows = identified(out.rows, r)
            if items:
                rows = staged(rows)
                pending[r.name] = out, rows
            as_findings(rows, r).drop("kit").write.mode("overwrite").option("compression", "zstd").parquet(target)
            if path and items:
                write_items(r)
        except Exception as exc:  # noqa: BLE001 - isolation is the feature
            failed = r.name
            raised.append(exc)
            error_row(spark, r, exc).drop("kit").write.mode("overwrite").parquet(target)
        return failed

    def late(r: Rule) -> None:
        try:
            write_items(r)
        except Exception as exc:  # noqa: BLE001 - as above
            failed.append(r.name)
            raised.append(exc)

    rules = chosen(kit, only)
    spark.createDataFrame([], struct_type({k: v for k, v in FINDING_COLUMNS.items() if k != "kit"})).write.mode("overwrite").parquet(f"{base}/findings/kit={kit}/rule=_none")
    spark.createDataFrame([], struct_type(ITEM_COLUMNS)).write.mode("overwrite").parquet(f"{base}/items/kit={kit}/rule=_none")
    # What a rule shuffles is in proportion to its route; several large ones at a time would only add up on disk. The
    # largest routes come last, when others may be gone.
    mb = events.mb if isinstance(events, Routes) else {}
    large = sorted([r for r in rules if mb.get(r.reads, 0) > LARGE_MB * spark.sparkContext.defaultParallelism], key=lambda r: (mb[r.reads], r.reads))
    small = [r for r in rules if r not in large]
    done = {}

    def spend(ended: list[Rule], left: list[Rule]) -> None:
        if isinstance(events, Routes) and not items:
            for route in {r.reads for r in ended} - {r.reads for r in left}:
                events.spend(route)
    with held(spark, FREED):
        with ThreadPoolExecutor(max(1, at_once)) as pool:
            done.update(zip([r.name for r in small], pool.map(one, small)))
        spend(small, large)
        for i, r in enumerate(large):
            done[r.name] = one(r)
            spend([r], large[i + 1:])
    failed = [r.name for r in rules if done[r.name]]
    part = {"kit": "string", "rule": "string"}
    findings = spark.read.schema(struct_type({**{k: v for k, v in FINDING_COLUMNS.items() if k != "kit"}, **part})).parquet(f"{base}/findings")

    def made() -> DataFrame:
        if not items:
            raise ValueError("these results were made without items")
        if not path:
            with held(spark, FREED), ThreadPoolExecutor(max(1, at_once)) as pool:
                list(pool.map(late, [r for r in rules if r.name not in failed]))
        table = spark.read.schema(struct_type({**ITEM_COLUMNS, **part})).parquet(f"{base}/items")
        # A rule that failed after its findings were written may have left items of an earlier run under the same path.
        return (table.where(~F.col("rule").isin(failed)) if failed else table).select(*ITEM_COLUMNS)
    return Results(findings.select(*FINDING_COLUMNS), made, failed, raised)


def run_rules(kit: str, events, config, only=None) -> DataFrame:
    """The findings of run_all."""
    return run_all(kit, events, config, only).findings


# Rule ids of a failed rule.
ERROR_IDS = {"net": "NSM-ERR-001", "win": "EVTX-ERR-001", "pkt": "TRAF-ERR-001", "mail": "PH-ERR-001"}


def error_row(spark: SparkSession, r: Rule, exc: Exception) -> DataFrame:
    row = spark.range(1).select(
        F.lit("info").alias("severity"), F.lit("low").alias("confidence"), F.lit(r.name).alias("entity"),
        F.lit(ERROR_IDS[r.kit]).alias("rule_id"), F.lit(f"{type(exc).__name__}: {exc}"[:500]).alias("error"))
    return as_findings(row, r).withColumn("title", F.lit("Rule failed")).withColumn("category", F.lit(None).cast("string"))


def severity_floor(findings: DataFrame, floor: str) -> DataFrame:
    return findings.where(F.col("severity_rank") >= severity_rank(F.lit(floor)))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("severity_rank"), "rule_id", "finding_id")


def previewed(findings: DataFrame, items: DataFrame, kind: str, n: int, out: str) -> DataFrame:
    """findings and the first n values of a list, for a report; the items have all of them. The row_number
    limit is applied before the shuffle, so a finding with millions of values ships n per task."""
    order = Window.partitionBy("finding_id").orderBy("value")
    top = items.where(F.col("kind") == kind).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n)
    return findings.join(top.groupBy("finding_id").agg(F.array_sort(F.collect_list("value")).alias(out)), "finding_id", "left")


def evidence(items: DataFrame, events: DataFrame, n: int = 10) -> DataFrame:
    """finding_id and the first n non-empty lines (raw) of its events in the order of time. The number is a
    report's; the items have every event. Lines stay in the events' table until they are asked for. Rows with one event_id
    are one event."""
    lines = events.select("event_id", F.trim("raw").alias("line")).where(F.col("line") != "").groupBy("event_id").agg(F.min("line").alias("line"))
    own = items.where(F.col("kind") == "event").select("finding_id", "event_id", "ts_us").distinct().join(lines, "event_id")
    order = Window.partitionBy("finding_id").orderBy(F.asc_nulls_last("ts_us"), "event_id")
    top = own.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n)
    packed = F.array_sort(F.collect_list(F.struct("_rn", "line")))
    return top.groupBy("finding_id").agg(F.transform(packed, lambda x: x["line"]).alias("evidence"))


def bounds():
    return [F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")]


def band(score, *steps, default):
    """Severity band: band(score, (7, 'critical'), (5, 'high'), default='medium')."""
    out = F.lit(default)
    for limit, name in reversed(steps):
        out = F.when(score >= limit, name).otherwise(out)
    return out


def points(*pairs):
    """Sum of n for every condition that holds."""
    total = F.lit(0)
    for cond, n in pairs:
        total = total + F.when(cond, n).otherwise(0)
    return total
