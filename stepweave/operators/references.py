"""References to records that do not exist at the time of the reference.

A target key lives in half-open lifetimes [start, end). A reference carries a
key and a time; it is an orphan if no lifetime of its key holds its time.

Method: a skew-aware split. References are pre-aggregated per key and month to
(count, earliest, latest time). A lifetime that spans a whole group clears it,
a group that no lifetime touches is orphaned as a whole, and only the rest
needs a look at single rows. Groups of heavy keys are checked against a
broadcast of those keys' lifetimes, all others by a shuffled join; both
verdicts are united and bring back the orphaned rows. A key is heavy as soon
as it would fill more than a task's share, so no shuffled key does, whatever
the number of rows. Where the verdicts or lifetimes of heavy keys are too many
to broadcast, both sides are salted instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.paths import normal_path
from stepweave.runtime import BROADCAST_ROWS, broadcast_if_small, cut

#: A task's share of the references: this part of them, but never more rows than TASK_ROWS.
SHARE, TASK_ROWS = 1024, 500_000
#: Copies of each heavy row's partners where they have to be shuffled.
SALTS = 64


def references(df: DataFrame, table: str, ref_id: str, time: str, fields: dict[str, tuple[str, Column]]) -> DataFrame:
    """Long form of one referring table. fields: name -> (kind of target, key as written, or an array of keys); null keys are no references."""
    who = [F.lit(table).alias("ref_table"), F.col(ref_id).cast("long").alias("ref_id"), F.col(time).cast("timestamp_ntz").alias("t")]
    lists = {n for n, (_, c) in fields.items() if df.select(c.alias("c")).schema["c"].dataType.typeName() == "array"}
    parts = [df.select(*who, F.lit(fields[n][0]).alias("kind"), F.lit(n).alias("ref_field"), F.posexplode(fields[n][1]).alias("ref_pos", "raw")) for n in fields if n in lists]
    single = [F.struct(F.lit(k).alias("kind"), F.lit(n).alias("ref_field"), F.lit(0).alias("ref_pos"), c.alias("raw")) for n, (k, c) in fields.items() if n not in lists]
    if single:
        parts.append(df.select(*who, F.explode(F.array(*single)).alias("r")).select("ref_table", "ref_id", "t", "r.*"))
    flat = parts[0]
    for p in parts[1:]:
        flat = flat.unionByName(p)
    month = F.year("t") * 12 + F.month("t") - 1  # months since year 0: cheap to compute and to group by
    return flat.filter(F.col("raw").isNotNull()).select("ref_table", "ref_field", "ref_id", "ref_pos", "kind", "raw", "t", month.alias("month"))


def lifetimes(df: DataFrame, kind: str, key: Column, start: str = "registered_at", end: str = "deleted_at") -> DataFrame:
    """Long form of a target table; a null start never begins, a null end never comes."""
    return df.select(F.lit(kind).alias("kind"), key.alias("key"), F.col(start).cast("timestamp_ntz").alias("start"), F.col(end).cast("timestamp_ntz").alias("end")).filter(F.col("key").isNotNull() & F.col("start").isNotNull())


def _heavy(groups: DataFrame, heavy_rows: int) -> DataFrame | None:
    """Keys, in normal form, whose references in all their spellings exceed a task's share: at most max(SHARE, references / TASK_ROWS) keys."""
    sums = groups.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    top = sums.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    least = max(heavy_rows, min(TASK_ROWS, (top.total or 0) // SHARE))
    return sums.filter(F.col("n") > least).select("kind", "key") if (top.most or 0) > least else None


def _verdicts(groups: DataFrame, lives: DataFrame) -> DataFrame:
    """The groups whose references are not all fine, with state ``orphan`` or ``mixed``."""
    g, l = groups.alias("g"), lives.alias("l")
    joined = g.join(l, ["kind", "key"], "left")
    open_end = F.col("l.end").isNull()
    spans = (F.col("l.start") <= F.col("g.first_t")) & (open_end | (F.col("g.last_t") < F.col("l.end")))
    meets = (F.col("l.start") <= F.col("g.last_t")) & (open_end | (F.col("g.first_t") < F.col("l.end")))
    by = joined.groupBy("kind", "key", "raw", "month").agg(F.max(F.coalesce(spans, F.lit(False))).alias("spans"), F.max(F.coalesce(meets, F.lit(False))).alias("meets"))
    return by.filter(~F.col("spans")).select("kind", "key", "raw", "month", F.when(F.col("meets"), "mixed").otherwise("orphan").alias("state"))


def _hits(refs: DataFrame, bad: DataFrame, salts: int = 1) -> DataFrame:
    """The references in bad groups, with the group's key and state."""
    r, m = _salted(refs, salts).alias("r"), _copies(bad, salts).alias("m")
    on = (F.col("r.kind") == F.col("m.kind")) & (F.col("r.raw") == F.col("m.raw")) & F.col("r.month").eqNullSafe(F.col("m.month")) & _same_salt("r", "m", salts)
    return r.join(m, on).select(*[F.col(f"r.{c}").alias(c) for c in refs.columns], "m.key", "m.state")


def _unheld(hits: DataFrame, lives: DataFrame, salts: int = 1) -> DataFrame:
    """Hits without those of mixed groups whose own time a lifetime holds."""
    h, l = _salted(hits, salts).alias("h"), _copies(lives, salts).alias("l")
    holds = (F.col("h.kind") == F.col("l.kind")) & (F.col("h.key") == F.col("l.key")) & (F.col("h.state") == "mixed") & (F.col("l.start") <= F.col("h.t")) & (F.col("l.end").isNull() | (F.col("h.t") < F.col("l.end")))
    return h.join(l, holds & _same_salt("h", "l", salts), "left_anti").select(*hits.columns)


def _salted(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64("ref_id", "ref_pos"), F.lit(salts)).cast("int")) if salts > 1 else df


def _copies(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))) if salts > 1 else df


def _same_salt(a: str, b: str, salts: int) -> Column:
    return F.col(f"{a}.salt") == F.col(f"{b}.salt") if salts > 1 else F.lit(True)


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def orphan_references(refs: DataFrame, lives: DataFrame, normal: dict[str, Callable[[Column], Column]] | None = None, *, heavy_rows: int = 0) -> DataFrame:
    """The references without a living target: ref_table, ref_field, ref_id, ref_pos, key, t, month; each once.

    ``normal`` brings keys of a kind into normal form, once per group rather
    than per row; a null normal form is no reference. A null time lies in no
    lifetime, so such a reference is an orphan with a null month. Repeated rows
    count once per (ref_table, ref_field, ref_id, ref_pos). Repeated lifetimes
    do no harm; empty inputs give an empty result or, without any target, all
    references. A key is heavy with more references than a task's share, and
    more than ``heavy_rows``.
    """
    lives = lives.distinct()
    key = F.col("raw")
    for kind, f in (normal or {}).items():
        key = F.when(F.col("kind") == kind, f(F.col("raw"))).otherwise(key)
    seen = refs.groupBy("kind", "raw", "month").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    groups = cut(seen.withColumn("key", key).filter(F.col("key").isNotNull()))
    heavy = _heavy(groups, heavy_rows)
    if heavy is None:
        bad = cut(_verdicts(groups, lives))
        found = _unheld(_hits(refs, broadcast_if_small(bad)), lives)
    else:
        h = broadcast_if_small(cut(heavy))
        hot, cold = groups.join(h, ["kind", "key"], "left_semi"), groups.join(h, ["kind", "key"], "left_anti")
        hot_lives = cut(lives.join(h, ["kind", "key"], "left_semi"))
        few = _small(hot_lives)
        hot_lives, salts = (F.broadcast(hot_lives), 1) if few else (hot_lives, SALTS)
        bad = cut(_verdicts(hot, hot_lives).withColumn("state", F.concat(F.lit("hot "), "state")).unionByName(_verdicts(cold, lives)))
        is_hot = F.startswith(F.col("state"), F.lit("hot "))
        if _small(bad):  # one pass over the references
            hits = cut(_hits(refs, F.broadcast(bad)))
        else:
            hits = cut(_hits(refs, bad.filter(is_hot), SALTS).unionByName(_hits(refs, bad.filter(~is_hot))))
        hot_hits = hits.filter(is_hot).withColumn("state", F.substring("state", 5, 6))
        found = _unheld(hot_hits, hot_lives, salts).unionByName(_unheld(hits.filter(~is_hot), lives))
    return found.dropDuplicates(["ref_table", "ref_field", "ref_id", "ref_pos"]).select("ref_table", "ref_field", "ref_id", "ref_pos", "key", "t", "month")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per referring table, field and month (``2025-03``)."""
    text = F.when(F.col("month").isNotNull(), F.format_string("%04d-%02d", F.floor(F.col("month") / 12).cast("int"), F.col("month") % 12 + 1))
    return orphans.groupBy("ref_table", "ref_field", text.alias("month")).agg(F.count(F.lit(1)).alias("orphans"), F.count_distinct("key").alias("missing_keys"))


def _episode_key(run: Column, episode: Column) -> Column:
    """Run and episode as one text; a null run names no target, but the reference stays one."""
    return F.concat(F.coalesce(F.concat(F.lit("r:"), run), F.lit("null")), F.lit("\n"), episode.cast("string"))


#: Paths are compared in normal form.
NORMAL = {"shard": normal_path, "run": normal_path}


def experiment_references(activation_index: DataFrame, merge_configs: DataFrame) -> DataFrame:
    """All references of the two referring tables. episode_num null or -1 is none."""
    ep = F.when(F.col("episode_num") != -1, _episode_key(F.col("run_id"), F.col("episode_num")))
    a = references(activation_index, "activation_index", "index_id", "logged_at", {"shard_path": ("shard", F.col("shard_path")), "episode_num": ("episode", ep)})
    m = references(merge_configs, "merge_configs", "merge_id", "created_at", {"input_dirs": ("run", F.col("input_dirs"))})
    return a.unionByName(m)


def experiment_lifetimes(shard_registry: DataFrame, prompt_records: DataFrame, run_registry: DataFrame) -> DataFrame:
    s = lifetimes(shard_registry, "shard", normal_path(F.col("shard_path")))
    e = lifetimes(prompt_records.filter(F.col("run_id").isNotNull() & F.col("episode_num").isNotNull()), "episode", _episode_key(F.col("run_id"), F.col("episode_num")))
    r = lifetimes(run_registry, "run", normal_path(F.col("run_dir")))
    return s.unionByName(e).unionByName(r)


def experiment_orphans(activation_index: DataFrame, merge_configs: DataFrame, shard_registry: DataFrame, prompt_records: DataFrame, run_registry: DataFrame, **kw) -> DataFrame:
    return orphan_references(experiment_references(activation_index, merge_configs), experiment_lifetimes(shard_registry, prompt_records, run_registry), NORMAL, **kw)
