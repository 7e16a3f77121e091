"""Splits that keep related records together (problem 3).

Records are edges between the keys they carry. A persisted component table maps
each key to the root of its component; new records are contracted to edges
between roots, roots hook to their smallest neighbour, and pointer jumping
flattens the hooks, round by round, until no edge is left. The root of a
component is its smallest key, so a component keeps its name unless an even
smaller key joins it.

Splits are assigned per component and kept with it (``SplitStore``): a component that already has a split keeps
it, one that merges components of different splits is quarantined, and new ones
fill the deficits of the target shares.

Sizes: an edge is shipped once per distinct key pair, whatever the number of its
records. Hooking aggregates with partial minima, so a key that holds a third of
all rows is one row per task after the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.storage import Scratch, Versions

# --- Fixed values: keys that connect nothing ---------------------------------------
PLACEHOLDERS = ["", "-", "none", "nan", "unknown"]
UNMATCHED_PREFIX = "_um_"
#: Names of splits; ``QUARANTINE`` is where components of conflicting splits go.
QUARANTINE = "quarantine"
#: A component with more than this share of all records is placed one by one, largest first; at most its inverse exist.
LARGE_SHARE = 1e-3
#: Hash ranges of the distributed running sum over the small components.
RANGES = 1024


def clean_key(key: Column) -> Column:
    """Trimmed, lower-cased key; null where it is null, blank, a placeholder or unmatched."""
    k = F.lower(F.regexp_replace(key.cast("string"), r"^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$", ""))
    return F.when(~k.isin(PLACEHOLDERS) & ~k.startswith(UNMATCHED_PREFIX), k)


def keyed(records: DataFrame, record: str, fields: Sequence[str]) -> DataFrame:
    """``record`` and ``keys``: the cleaned keys of the fields, each marked with its field's rank.

    Keys of different fields never meet. The mark sorts the first field's keys
    before the second's, so the smallest key of a component is the smallest of
    the first field where it has one.
    """
    marked = [F.concat(F.lit(f"{i}:"), clean_key(F.col(f))) for i, f in enumerate(fields)]
    return records.select(F.col(record), F.array_compact(F.array(*marked)).alias("keys"))


def key_edges(keys: DataFrame) -> DataFrame:
    """Distinct pairs (``a``, ``b``) of keys that stand in one record; a lone key is paired with itself."""
    first = F.element_at("keys", 1)
    rest = F.explode(F.when(F.size("keys") > 1, F.slice("keys", 2, F.size("keys") - 1)).otherwise(F.col("keys")))
    return keys.filter(F.size("keys") > 0).select(first.alias("a"), rest.alias("b")).distinct()


def _roots_of(edges: DataFrame, table: DataFrame) -> DataFrame:
    """Edges with each end replaced by its root, where ``table`` (key, root) knows it."""
    for end in ("a", "b"):
        known = table.select(F.col("key").alias(end), F.col("root").alias(f"root_{end}"))
        edges = edges.join(known, end, "left").withColumn(end, F.coalesce(f"root_{end}", end)).drop(f"root_{end}")
    return edges


def update_components(spark: SparkSession, edges: DataFrame, table: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The component table (``key``, ``root``) after new edges (``a``, ``b``).

    ``table`` is the persisted table of earlier runs; only its rows whose root
    merges are changed. Without edges the table comes back as it is; with neither
    it is empty. Repeated edges and self-edges change nothing.
    """
    scratch = scratch or Scratch(spark, "components")
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    if table is not None:
        edges = _roots_of(edges, table)
    live = scratch.save(edges.distinct(), "edges")
    nodes = scratch.save(live.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "nodes")
    live = live.filter("a <> b")
    hooks: DataFrame | None = None  # key -> root so far, of every key that was hooked
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("up")).filter("up < key")
        parent = scratch.save(hooked.select("key", F.col("up").alias("root")), "hook")
        parent = _jump(parent, scratch)
        if hooks is not None:
            grown = hooks.join(parent.select(F.col("key").alias("root"), F.col("root").alias("above")), "root", "left").select("key", F.coalesce("above", "root").alias("root"))
            hooks = scratch.save(grown.unionByName(parent), "hooks")
        else:
            hooks = parent
        live = scratch.save(_roots_of(live, parent).filter("a <> b").distinct(), "contracted")
    if hooks is None:
        hooks = spark.createDataFrame([], "key string, root string")
    fresh = nodes.join(hooks, "key", "left").select("key", F.coalesce("root", "key").alias("root"))
    if table is None:
        return scratch.save(fresh, "table")
    moved = fresh.select(F.col("key").alias("root"), F.col("root").alias("above"))
    kept = table.join(moved, "root", "left").select("key", F.coalesce("above", "root").alias("root"))
    added = fresh.join(table.select("key"), "key", "left_anti")
    return scratch.save(kept.unionByName(added), "table")


def _jump(parent: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointer jumping: each key points at its pointer's pointer until all point at roots."""
    while True:
        up = parent.select(F.col("key").alias("root"), F.col("root").alias("above"))
        step = parent.join(up, "root", "left").select("key", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        step = scratch.save(step, "jump")
        parent = step.select("key", "root")
        if step.filter("moved").isEmpty():
            return parent


class ComponentStore:
    """The component table kept below a folder, one subfolder per version.

    An update reads the last version and writes the next one; a version exists
    once its write has been committed, so a failed update leaves the last one.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """Number of the last committed version; 0 where there is none."""
        n = 0
        while table_exists(self.spark, f"{self.path}/v{n + 1:06d}/_SUCCESS"):
            n += 1
        return n

    def table(self) -> DataFrame | None:
        n = self.version()
        return self.spark.read.schema("key string, root string").parquet(f"{self.path}/v{n:06d}") if n else None

    def update(self, edges: DataFrame) -> DataFrame:
        """Take in new edges (``a``, ``b``); the new table."""
        at = f"{self.path}/v{self.version() + 1:06d}"
        scratch = Scratch(self.spark, "components")
        update_components(self.spark, edges, self.table(), scratch).write.mode("overwrite").parquet(at)
        scratch.finish()
        return self.spark.read.schema("key string, root string").parquet(at)


def table_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def record_groups(keys: DataFrame, record: str, table: DataFrame) -> DataFrame:
    """``record``, ``root`` of each record; a record without keys has a null root and is alone."""
    first = keys.select(record, F.element_at(F.when(F.size("keys") > 0, F.col("keys")), 1).alias("key"))
    known = table.select("key", "root")
    lone = first.filter("key IS NULL").select(record, F.lit(None).cast("string").alias("root"))
    return first.filter("key IS NOT NULL").join(known, "key").select(record, "root").unionByName(lone)


def grouped_records(records: DataFrame, record: str, fields: Sequence[str]) -> DataFrame:
    """``record`` and ``group_key`` of every record in a group of two or more.

    ``group_key`` is the smallest cleaned key of the first field in the group or,
    without any, of the next one. Repeated records count as records.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "groups")
    keys = scratch.save(keyed(records, record, fields), "keys")
    table = update_components(spark, key_edges(keys), scratch=scratch)
    groups = record_groups(keys, record, table).filter("root IS NOT NULL")
    many = groups.groupBy("root").count().filter("count > 1").select("root")
    scratch.finish(keys, table)
    return groups.join(many, "root").select(record, F.substring("root", 3, 1 << 30).alias("group_key"))


def component_sizes(groups: DataFrame, record: str) -> DataFrame:
    """``unit`` and ``n``: records of each component; a record without keys is a unit of its own."""
    return groups.select(F.coalesce("root", F.concat(F.lit("r:"), F.col(record).cast("string"))).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))


def assign_splits(sizes: DataFrame, targets: DataFrame, previous: DataFrame | None = None, seed: str = "split") -> DataFrame:
    """``unit``, ``n``, ``split``, ``kept`` for each component.

    ``previous`` (``unit``, ``split``) has the splits that the units' parts
    already had, several rows where a unit was merged from several. One split:
    kept. Several: quarantined. None: the unit fills a deficit, where the deficit of
    a split is its target share of all records outside quarantine less what it
    holds. Units above ``LARGE_SHARE`` of all records are placed largest first
    into the largest deficit (at most its inverse of them exist, so they fit the
    driver); the rest lie in hash order on a line that the remaining deficits cut.
    Shares are met up to the size of one unit, unless kept units exceed them.
    """
    spark = sizes.sparkSession
    shares = [(r["split"], float(r["target_share"])) for r in targets.collect()]  # a table of few fixed rows
    total_share = sum(s for _, s in shares) or 1.0
    if previous is None:
        previous = spark.createDataFrame([], "unit string, split string")
    held = previous.filter("split IS NOT NULL").groupBy("unit").agg(F.min("split").alias("low"), F.max("split").alias("high"))
    known = sizes.join(held, "unit", "left").select("unit", "n", F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("low").isNotNull(), F.lit(QUARANTINE)).alias("split"))
    known = Scratch(spark, "splits").save(known, "known")
    filled = {r["split"]: r["n"] for r in known.groupBy("split").agg(F.sum("n").alias("n")).collect()}  # one row per split
    total = sum(n for s, n in filled.items() if s != QUARANTINE)
    deficits = {s: max(0.0, share / total_share * total - filled.get(s, 0)) for s, share in shares}
    free = known.filter("split IS NULL")
    limit = max(1.0, LARGE_SHARE * total)
    large = free.filter(F.col("n") > limit).orderBy(F.desc("n"), "unit").collect()  # at most 1 / LARGE_SHARE rows
    placed = []
    for row in large:
        into = max(deficits, key=lambda s: (deficits[s], s))
        deficits[into] -= row["n"]
        placed.append((row["unit"], row["n"], into, False))
    deficits = {s: max(0.0, x) for s, x in deficits.items()}
    small = free.filter(F.col("n") <= limit)
    point = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.col("unit"))), 1, 8), 16, 10).cast("bigint")
    small = small.withColumn("point", point).withColumn("range", (F.col("point") * RANGES / F.lit(1 << 32)).cast("int"))
    before = {}
    run = 0
    for r in small.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():  # at most RANGES rows
        before[r["range"]] = run
        run += r["n"]
    scale = sum(deficits.values())
    cuts, at = [], 0.0
    for s, _ in shares:
        at += deficits[s] / scale * run if scale else 0.0
        cuts.append((s, at))
    last = max(deficits, key=lambda s: (deficits[s], s)) if deficits else QUARANTINE
    starts = spark.createDataFrame([(k, v) for k, v in before.items()] or [(0, 0)], "range int, start long")
    inside = Window.partitionBy("range").orderBy("point", "unit").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("start") + F.sum("n").over(inside) - F.col("n") / 2
    split = F.lit(last)
    for s, cut in reversed(cuts):
        if deficits[s] > 0:
            split = F.when(F.col("middle") <= cut, F.lit(s)).otherwise(split)
    spread_out = small.join(F.broadcast(starts), "range").withColumn("middle", middle).select("unit", "n", split.alias("split"), F.lit(False).alias("kept"))
    big = spark.createDataFrame(placed, "unit string, n long, split string, kept boolean")
    old = known.filter("split IS NOT NULL").select("unit", "n", "split", F.lit(True).alias("kept"))
    return old.unionByName(big).unionByName(spread_out)


class SplitStore:
    """Components and their splits kept below a folder, so that a later call, in any session, goes on from the last one.

    Two versioned tables: ``components`` (key, root) and ``units`` (unit, n, split, kept), a row per component or
    lone record. An update reads the new records, the edges between their keys and these tables; records of
    earlier calls are never read again. Both tables of one update carry one number, and the units are
    committed last, so a failed update leaves the last whole one. A record is to be given once.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.components, self.units = Versions(spark, f"{path.rstrip('/')}/components", 3), Versions(spark, f"{path.rstrip('/')}/units", 3)

    def number(self) -> int:
        return (self.units.numbers() or [0])[-1]

    def update(self, keys: DataFrame, record: str, targets: DataFrame) -> None:
        """Take in new records (``record``, ``keys``) and give their components splits."""
        scratch = Scratch(self.spark, "split-store")
        last = self.number()
        table = self.components.write(update_components(self.spark, key_edges(keys), self.components.read(last), scratch), last + 1)
        fresh = units_of(record_groups(keys, record, table), record).groupBy("unit").agg(F.count("*").alias("n"))
        sizes, before = fresh, None
        if last:
            # the root of a component is one of its keys, so its row tells the root that it has now
            moved = table.select(F.col("key").alias("unit"), F.col("root").alias("now"))
            old = scratch.save(self.units.read(last).join(moved, "unit", "left").select(F.coalesce("now", "unit").alias("unit"), "n", "split"), "old")
            sizes = old.select("unit", "n").unionByName(fresh).groupBy("unit").agg(F.sum("n").alias("n"))
            before = old.select("unit", "split")
        self.units.write(assign_splits(sizes, targets, before).select("unit", "n", "split", "kept"), last + 1)
        scratch.finish()

    def splits(self, keys: DataFrame, record: str) -> DataFrame:
        """``record``, ``unit``, ``split``, ``kept`` of records (``record``, ``keys``) that updates have taken in."""
        last = self.number()
        return units_of(record_groups(keys, record, self.components.read(last)), record).join(self.units.read(last).select("unit", "split", "kept"), "unit").select(record, "unit", "split", "kept")


def units_of(groups: DataFrame, record: str) -> DataFrame:
    """``record`` and its ``unit``: the root of its component, or itself where it has no keys."""
    return groups.select(record, F.coalesce("root", F.concat(F.lit("r:"), F.col(record).cast("string"))).alias("unit"))


def assign_records(records: DataFrame, record: str, fields: Sequence[str], targets: DataFrame, batches: Sequence[Column], path: str | None = None) -> DataFrame:
    """``record``, ``group_key``, ``split``, ``batch``, ``kept`` of all records, taken in batches.

    Rows without a record id are left out. Each batch (a predicate; the last takes
    what the others leave) updates the ``SplitStore`` at ``path`` (a fresh one of this run unless given).
    Rows of one batch whose component was split before follow it; components
    merged from different splits go to quarantine with all their records.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "assign")
    records = records.filter(F.col(record).isNotNull())
    number = F.lit(len(batches) - 1)
    for i, predicate in reversed(list(enumerate(batches[:-1]))):
        number = F.when(predicate, F.lit(i)).otherwise(number)
    marked = [F.concat(F.lit(f"{i}:"), clean_key(F.col(f))) for i, f in enumerate(fields)]
    keys = scratch.save(records.select(record, F.array_compact(F.array(*marked)).alias("keys"), number.alias("batch")), "keys")
    store = SplitStore(spark, path or f"{scratch.root}/store")
    for i in range(len(batches)):
        store.update(keys.filter(F.col("batch") == i).select(record, "keys"), record, targets)
    assigned = store.splits(keys, record).join(keys.select(record, "batch"), record)
    group = F.when(~F.col("unit").startswith("r:"), F.substring("unit", 3, 1 << 30))
    out = scratch.save(assigned.select(record, group.alias("group_key"), "split", "batch", "kept"), "assigned")
    scratch.finish(out)
    return out
