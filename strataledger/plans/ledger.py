"""Queries of ledger state, layout and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataledger.functions import scalars
from strataledger.operators import access, state
from strataledger.plans.registry import ACCESS, RECURSIVE, register
from strataledger.schema import KEY, SIZE_CLASSES
from strataledger.sources.txo import txo

HEIGHT, LOW, HIGH, BATCH = 400_000, 300_000, 400_000, 100_000


def _outputs(spark, sf_dir):
    return txo(spark, sf_dir).select("tx_id", "vout", "creation_block", "value", "op_return")


def _inputs(spark, sf_dir):
    return txo(spark, sf_dir).where("event").select("tx_id", "vout", F.col("spent_block").alias("height"))


@register("resolve_spends", ", i AS (SELECT tx_id, vout, spent_block AS height FROM txo WHERE event) SELECT o.tx_id, o.vout, o.creation_block, o.value, o.op_return, i.height AS spent_height FROM txo o LEFT JOIN i ON o.tx_id = i.tx_id AND o.vout = i.vout")
def resolve_spends(spark, sf_dir):
    return state.resolve_spends(_outputs(spark, sf_dir), _inputs(spark, sf_dir))


@register("unspent_antijoin", "SELECT tx_id, vout, creation_block, value, op_return FROM txo WHERE NOT event")
def unspent_antijoin(spark, sf_dir):
    return state.unspent(_outputs(spark, sf_dir), _inputs(spark, sf_dir))


def _batch_rows(spark, sf_dir):
    rows = txo(spark, sf_dir)
    op = lambda name, height: rows.where(F.col(height).isNotNull()).select(F.floor(F.col(height) / BATCH).cast("int").alias("batch"), F.lit(name).alias("op"), *KEY)
    return op("insert", "creation_block").unionAll(op("delete", "spent_block"))


@register("in_batch_netting", f"SELECT batch, count(*) FILTER (WHERE i AND NOT d) AS n_inserts, count(*) FILTER (WHERE d AND NOT i) AS n_deletes, count(*) FILTER (WHERE i AND d) AS n_in_batch FROM (SELECT batch, tx_id, vout, bool_or(ins) AS i, bool_or(NOT ins) AS d FROM (SELECT CAST(creation_block // {BATCH} AS INT) AS batch, true AS ins, tx_id, vout FROM txo UNION ALL SELECT CAST(spent_block // {BATCH} AS INT), false, tx_id, vout FROM txo WHERE event) GROUP BY ALL) GROUP BY batch")
def in_batch_netting(spark, sf_dir):
    return state.netting_counts(_batch_rows(spark, sf_dir))


@register("apply_batch_sequence", "SELECT tx_id, vout, creation_block, value FROM txo WHERE NOT event")
def apply_batch_sequence(spark, sf_dir):
    """Every batch of the history applied in order to an empty ledger, all in one aggregation by key."""
    return state.fold_batches(txo(spark, sf_dir), BATCH)


_WRITES = ", w AS (SELECT tx_id, CAST(vout % 2 AS INT) AS vout, CAST(creation_block // 50000 + vout AS INT) AS batch, value FROM txo), d AS (SELECT DISTINCT tx_id, CAST(vout % 2 AS INT) AS vout, CAST(spent_block // 50000 AS INT) AS batch FROM txo WHERE event)"


@register(
    "folded_conflicts",
    f"{_WRITES}, i AS (SELECT tx_id, vout, batch, min(value) AS value FROM w GROUP BY ALL), ops AS (SELECT tx_id, vout, batch, true AS ins, value FROM i ANTI JOIN d USING (tx_id, vout, batch) UNION ALL SELECT tx_id, vout, batch, false, NULL FROM d ANTI JOIN i USING (tx_id, vout, batch)), "
    "seen AS (SELECT *, lag(ins) OVER (PARTITION BY tx_id, vout ORDER BY batch) AS before FROM ops), g AS (SELECT tx_id, vout, max(batch) FILTER (WHERE NOT ins) AS gone, CAST(count(*) FILTER (WHERE NOT ins AND NOT coalesce(before, false)) AS INT) AS n_failed FROM seen GROUP BY ALL) "
    "SELECT g.tx_id, g.vout, arg_min(o.value, o.batch) FILTER (WHERE o.ins AND (gone IS NULL OR o.batch > gone)) AS value, min(o.batch) FILTER (WHERE o.ins AND (gone IS NULL OR o.batch > gone)) AS batch, any_value(n_failed) AS n_failed FROM g JOIN ops o USING (tx_id, vout) GROUP BY ALL",
)
def folded_conflicts(spark, sf_dir):
    """Keys that are written and deleted several times: netting, first writes that stay, and deletes that find nothing."""
    rows = txo(spark, sf_dir).select("tx_id", (F.col("vout") % 2).cast("int").alias("key"), "vout", "creation_block", "spent_block", "value")
    key = F.col("key").alias("vout")
    made = rows.select((F.floor(F.col("creation_block") / 50_000) + F.col("vout")).cast("int").alias("batch"), F.lit("insert").alias("op"), "tx_id", key, "value")
    gone = rows.where("spent_block IS NOT NULL").select(F.floor(F.col("spent_block") / 50_000).cast("int").alias("batch"), F.lit("delete").alias("op"), "tx_id", key, F.lit(None).cast("long").alias("value"))
    ends = state.folded(made.unionAll(gone), ["value"])
    # keys of which nothing is left once every batch is netted have no row
    return ends.where("held IS NOT NULL OR n_operations > 0").select(*KEY, "held.value", "held.batch", "n_failed")


@register("state_at_height", f"SELECT tx_id, vout, creation_block, value FROM txo WHERE creation_block <= {HEIGHT} AND (spent_block IS NULL OR spent_block > {HEIGHT})")
def state_at_height(spark, sf_dir):
    return state.state_at(txo(spark, sf_dir), HEIGHT).select(*KEY, "creation_block", "value")


_WANTED = f", w AS (SELECT tx_id, CAST(vout + CASE WHEN op_return THEN 1000 ELSE 0 END AS INT) AS vout FROM txo WHERE spent_block >= {LOW} AND spent_block < {HIGH})"


def _wanted(spark, sf_dir):
    """The outpoints that a range of blocks spends; those of OP_RETURN outputs with an index that does not exist."""
    rows = txo(spark, sf_dir).where(f"spent_block >= {LOW} AND spent_block < {HIGH}")
    return rows.select("tx_id", (F.col("vout") + F.when(F.col("op_return"), 1000).otherwise(0)).cast("int").alias("vout"))


@register("bulk_lookup", f"{_WANTED} SELECT w.tx_id, w.vout, t.creation_block, t.value, t.tx_id IS NOT NULL AS found FROM w LEFT JOIN txo t ON w.tx_id = t.tx_id AND w.vout = t.vout")
def bulk_lookup(spark, sf_dir):
    return state.lookup(txo(spark, sf_dir).select(*KEY, "creation_block", "value"), _wanted(spark, sf_dir))


@register("bulk_lookup_failed", f"{_WANTED} SELECT w.tx_id, w.vout FROM w ANTI JOIN txo t ON w.tx_id = t.tx_id AND w.vout = t.vout")
def bulk_lookup_failed(spark, sf_dir):
    return state.missing_keys(txo(spark, sf_dir), _wanted(spark, sf_dir))


@register("point_lookup", "SELECT tx_id, vout, creation_block, value FROM txo WHERE tx_id = (SELECT min(o_orderkey) FROM orders) AND vout = 0")
def point_lookup(spark, sf_dir):
    first = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.min("o_orderkey")).first()[0]
    return txo(spark, sf_dir).where((F.col("tx_id") == first) & (F.col("vout") == 0)).select(*KEY, "creation_block", "value")


@register("bulk_delete", f"{_WANTED} SELECT t.tx_id, t.vout, t.value FROM txo t ANTI JOIN w ON w.tx_id = t.tx_id AND w.vout = t.vout")
def bulk_delete(spark, sf_dir):
    rows = txo(spark, sf_dir).select(*KEY, "value")
    return state.apply_batch(rows, rows.limit(0), _wanted(spark, sf_dir))[0]


@register("failed_deletes", f"{_WANTED} SELECT w.tx_id, w.vout FROM w ANTI JOIN txo t ON w.tx_id = t.tx_id AND w.vout = t.vout")
def failed_deletes(spark, sf_dir):
    rows = txo(spark, sf_dir).select(*KEY, "value")
    return state.apply_batch(rows, rows.limit(0), _wanted(spark, sf_dir))[1]


def _repeated(spark, sf_dir):
    """The same outpoint written several times: lines of an order, by supplier."""
    return txo(spark, sf_dir).select("tx_id", (F.col("vout") % 2).cast("int").alias("vout"), F.col("vout").alias("write"), "value")


_REPEATED = ", r AS (SELECT tx_id, CAST(vout % 2 AS INT) AS vout, vout AS write, value FROM txo)"


@register("dedup_first", f"{_REPEATED} SELECT tx_id, vout, min(write) AS write, arg_min(value, write) AS value FROM r GROUP BY tx_id, vout")
def dedup_first(spark, sf_dir):
    return state.deduplicate(_repeated(spark, sf_dir), ["write"], keep="first")


@register("dedup_last", f"{_REPEATED} SELECT tx_id, vout, max(write) AS write, arg_max(value, write) AS value FROM r GROUP BY tx_id, vout")
def dedup_last(spark, sf_dir):
    return state.deduplicate(_repeated(spark, sf_dir), ["write"], keep="last")


@register("lookup_workload", f", h AS (SELECT tx_id, vout FROM txo WHERE spent_block >= {LOW} AND spent_block < {HIGH} AND creation_block < {LOW}) SELECT tx_id, vout, true AS should_exist FROM h UNION ALL SELECT -tx_id - 1, vout, false FROM h")
def lookup_workload(spark, sf_dir):
    return state.lookup_workload(txo(spark, sf_dir), LOW, HIGH, misses=1)


_CLASS = "CAST(CASE WHEN locking_script_size <= 44 THEN 0 WHEN locking_script_size <= 128 THEN 1 WHEN locking_script_size <= 512 THEN 2 ELSE 3 END AS INT)"
_LAID = f", laid AS (SELECT *, {_CLASS} AS container, CAST(creation_block // 50000 AS INT) AS version FROM txo)"


def _laid(spark, sf_dir):
    return state.with_layout(txo(spark, sf_dir), scalars.size_class(F.col("locking_script_size")), F.floor(F.col("creation_block") / 50_000).cast("int"))


@register("size_class_counts", f"{_LAID} SELECT container, count(*) AS n, count(*) FILTER (WHERE event) AS n_deleted, min(locking_script_size) AS min_size, max(locking_script_size) AS max_size FROM laid GROUP BY 1")
def size_class_counts(spark, sf_dir):
    return _laid(spark, sf_dir).groupBy("container").agg(F.count("*").alias("n"), F.count_if("event").alias("n_deleted"), F.min("locking_script_size").alias("min_size"), F.max("locking_script_size").alias("max_size"))


@register("version_counts", f"{_LAID} SELECT container, version, format('cont_{{}}_v{{:05d}}.dat', container, version) AS file, count(*) AS n FROM laid GROUP BY 1, 2")
def version_counts(spark, sf_dir):
    return _laid(spark, sf_dir).groupBy("container", "version").agg(F.count("*").alias("n")).withColumn("file", scalars.version_file(F.col("container"), F.col("version")))


_ZONES = "SELECT container, version, min(tx_id) AS min_key, max(tx_id) AS max_key, min(creation_block) AS min_height, max(creation_block) AS max_height, count(*) AS n FROM laid GROUP BY 1, 2"


@register("zone_map", f"{_LAID} {_ZONES}")
def zone_map(spark, sf_dir):
    return state.zone_map(_laid(spark, sf_dir))


@register("zone_pruned_lookup", f"{_LAID}, z AS ({_ZONES}), w AS (SELECT DISTINCT tx_id FROM txo) SELECT tx_id, count(min_key) AS n_zones FROM w LEFT JOIN z ON tx_id BETWEEN min_key AND max_key GROUP BY 1")
def zone_pruned_lookup(spark, sf_dir):
    wanted = txo(spark, sf_dir).select("tx_id").distinct()
    return state.zone_candidates(wanted, state.zone_map(_laid(spark, sf_dir)))


@register("layout_report", f"{_LAID} SELECT container, count(DISTINCT version) AS n_versions, count(*) AS n, CAST(sum(locking_script_size) AS BIGINT) AS bytes, count(*) / CAST(count(DISTINCT version) * 1000 AS DOUBLE) AS fill, count(DISTINCT version) * 1000 - count(*) AS wasted FROM laid GROUP BY 1")
def layout_report(spark, sf_dir):
    return state.layout_report(_laid(spark, sf_dir), 1000)


@register("op_return_set", f"SELECT tx_id, vout, creation_block FROM txo WHERE op_return AND (spent_block IS NULL OR spent_block > {HEIGHT}) AND creation_block <= {HEIGHT}")
def op_return_set(spark, sf_dir):
    return state.state_at(txo(spark, sf_dir).where("op_return"), HEIGHT).select(*KEY, "creation_block")


@register("compaction_invariant", f"{_LAID}, r AS (SELECT container, row_number() OVER (PARTITION BY container ORDER BY version, tx_id, vout) - 1 AS k, value FROM laid) SELECT container, CAST(k // 2000 AS INT) AS version, count(*) AS n, CAST(sum(value) AS BIGINT) AS sum_value FROM r GROUP BY 1, 2")
def compaction_invariant(spark, sf_dir):
    return state.compact(_laid(spark, sf_dir), 2000).groupBy("container", "version").agg(F.count("*").alias("n"), F.sum("value").alias("sum_value"))


_TOTALS = f", c AS (SELECT CAST(creation_block // {BATCH} AS INT) AS batch, count(DISTINCT tx_id) AS n_tx, count(*) AS n_outputs FROM txo GROUP BY 1), s AS (SELECT CAST(spent_block // {BATCH} AS INT) AS batch, count(*) AS n_inputs FROM txo WHERE event GROUP BY 1), totals AS (SELECT coalesce(c.batch, s.batch) AS batch, coalesce(n_tx, 0) AS n_tx, coalesce(n_outputs, 0) AS n_outputs, coalesce(n_inputs, 0) AS n_inputs FROM c FULL JOIN s ON c.batch = s.batch)"


@register("batch_totals", f"{_TOTALS} SELECT * FROM totals")
def batch_totals(spark, sf_dir):
    return access.batch_totals(txo(spark, sf_dir), BATCH)


@register("cumulative_rates", f"{_TOTALS} SELECT *, CAST(sum(n_tx) OVER w AS BIGINT) AS total_n_tx, CAST(sum(n_outputs) OVER w AS BIGINT) AS total_n_outputs, CAST(sum(n_inputs) OVER w AS BIGINT) AS total_n_inputs FROM totals WINDOW w AS (ORDER BY batch)")
def cumulative_rates(spark, sf_dir):
    return access.cumulative(access.batch_totals(txo(spark, sf_dir), BATCH), ["n_tx", "n_outputs", "n_inputs"])


@register("ema_factor", f"{_TOTALS}, k AS (SELECT row_number() OVER (ORDER BY batch) AS i, batch, CASE WHEN n_tx > 0 THEN n_outputs / CAST(n_tx AS DOUBLE) END AS x FROM totals), e AS (SELECT i, batch, coalesce(x, CAST(6 AS DOUBLE)) AS x FROM k) SELECT a.batch, round(power(CAST(0.9 AS DOUBLE), a.i) * 6 + (SELECT coalesce(sum(CAST(0.1 AS DOUBLE) * b.x * power(CAST(0.9 AS DOUBLE), a.i - b.i)), 0) FROM e b WHERE b.i <= a.i), 6) AS factor FROM e a WHERE a.i <= (SELECT max(i) FROM k WHERE x IS NOT NULL)")
def ema_factor(spark, sf_dir):
    totals = access.batch_totals(txo(spark, sf_dir), BATCH).where("n_tx > 0")
    return access.smoothed(totals, F.col("n_outputs") / F.col("n_tx"), 6.0).withColumn("factor", F.round("factor", 6))


def access_log(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = F.col("user_id")
    return events.select(
        F.col("event_id").cast("int").alias("access_height"), (F.col("event_id") - user * 3 + 100).cast("int").alias("insertion_height"), (user % 5).cast("int").alias("depth"),
        ((user % 5 > 0) & (user % 2 == 0)).alias("is_cache_hit"), (F.col("event_type") != "error").alias("found"), F.when(F.col("event_type") == "view", "find").otherwise("erase").alias("op"),
    )


@register("access_summary", "SELECT count(*) AS n_ops, count(*) FILTER (WHERE found) AS n_found, count(*) FILTER (WHERE found AND depth = 0) AS n_current, count(*) FILTER (WHERE found AND is_cache_hit) AS n_cached, avg(depth) AS mean_depth, avg(CASE WHEN found THEN greatest(access_height - insertion_height, 0) END) AS mean_age, count(*) FILTER (WHERE found) / CAST(count(*) AS DOUBLE) AS hit_rate FROM access", ACCESS)
def access_summary(spark, sf_dir):
    return access.access_summary(access_log(spark, sf_dir))


@register("access_by_height_range", ", a AS (SELECT *, CASE WHEN found AND access_height > insertion_height THEN access_height - insertion_height END AS age FROM access WHERE access_height BETWEEN 100 AND 5000) SELECT count(*) FILTER (WHERE op = 'find') AS n_find, count(*) FILTER (WHERE op = 'erase') AS n_erase, count(*) FILTER (WHERE found) AS n_found, max(depth) AS max_depth, min(age) AS min_age, max(age) AS max_age FROM a", ACCESS)
def access_by_height_range(spark, sf_dir):
    return access.access_range(access_log(spark, sf_dir), 100, 5000)


@register("not_found_depth", "SELECT depth, count(*) AS n FROM access WHERE NOT found GROUP BY 1", ACCESS)
def not_found_depth(spark, sf_dir):
    return access.not_found_by_depth(access_log(spark, sf_dir))


@register("filtered_scan", "SELECT count(*) AS processed, count(*) FILTER (WHERE value > 100000 AND creation_block BETWEEN 100000 AND 300000) AS matched FROM txo")
def filtered_scan(spark, sf_dir):
    matched = (F.col("value") > 100_000) & F.col("creation_block").between(100_000, 300_000)
    return txo(spark, sf_dir).agg(F.count("*").alias("processed"), F.count_if(matched).alias("matched"))


_PACKED = "(CAST(container AS BIGINT) << 62) | (CAST(version AS BIGINT) << 46) | tx_id"


@register("pointer_pack", f", laid AS (SELECT *, CAST(CASE WHEN locking_script_size <= 44 THEN 0 ELSE 1 END AS INT) AS container, CAST(creation_block // 50000 AS INT) AS version FROM txo) SELECT DISTINCT CAST({_PACKED} AS BIGINT) AS pointer, container, version, tx_id AS position FROM laid")
def pointer_pack(spark, sf_dir):
    rows = _laid(spark, sf_dir).select(F.least("container", F.lit(1)).alias("c"), F.col("version").alias("v"), "tx_id").distinct()
    packed = rows.select(scalars.pack_pointer(F.col("c"), F.col("v"), F.col("tx_id")).alias("pointer"))
    container, version, position = scalars.unpack_pointer(F.col("pointer"))
    return packed.select("pointer", container.alias("container"), version.alias("version"), position.alias("position"))


@register("bucket_counts", ", n AS (SELECT CAST(creation_block // 50000 AS INT) AS version, count(*) AS n FROM txo GROUP BY 1) SELECT version, n, CAST(CASE WHEN n = 0 THEN 0 WHEN n < 15 THEN 29 ELSE power(2, ceil(log2(greatest(floor((ceil(n / CAST(0.836 AS DOUBLE)) + 1) / 15), 1)))) * 15 - 1 END AS BIGINT) AS buckets FROM n")
def bucket_counts(spark, sf_dir):
    n = txo(spark, sf_dir).groupBy(F.floor(F.col("creation_block") / 50_000).cast("int").alias("version")).agg(F.count("*").alias("n"))
    return n.withColumn("buckets", scalars.bucket_count(F.col("n")))


@register(
    "transaction_batches",
    ", b AS MATERIALIZED (SELECT creation_block AS height, count(DISTINCT tx_id) AS n_tx, row_number() OVER (ORDER BY creation_block) AS k FROM txo GROUP BY 1), "
    "r(k, height, n_tx, batch, held) AS (SELECT k, height, n_tx, CAST(0 AS BIGINT), CAST(n_tx AS BIGINT) FROM b WHERE k = 1 UNION ALL SELECT b.k, b.height, b.n_tx, r.batch + CASE WHEN r.held >= 1000 THEN 1 ELSE 0 END, CASE WHEN r.held >= 1000 THEN 0 ELSE r.held END + b.n_tx FROM r JOIN b ON b.k = r.k + 1) SELECT height, n_tx, CAST(batch AS INT) AS batch FROM r",
    RECURSIVE,
)
def transaction_batches(spark, sf_dir):
    """Blocks cut greedily into batches of at least 1000 transactions."""
    from strataledger.sources.files import batches_of

    blocks = txo(spark, sf_dir).groupBy(F.col("creation_block").alias("height")).agg(F.countDistinct("tx_id").alias("n_tx"))
    return batches_of(blocks, 1000)


def _rates(spark, sf_dir, factor):
    return access.batch_totals(txo(spark, sf_dir), BATCH).select("batch", ((F.col("n_tx") + F.col("n_inputs")) / F.lit(float(factor)) + F.col("batch")).alias("tps"))


@register("benchmark_compare", f"{_TOTALS}, r AS (SELECT batch, (n_tx + n_inputs) / CAST(10 AS DOUBLE) + batch AS a, (n_tx + n_inputs) / CAST(25 AS DOUBLE) + batch AS b FROM totals), quot AS (SELECT a, b, CASE WHEN b <> 0 THEN a / b END AS q FROM r) SELECT max(a) AS max_tps_one, min(a) AS min_tps_one, avg(a) AS mean_tps_one, median(a) AS median_tps_one, max(b) AS max_tps_other, min(b) AS min_tps_other, avg(b) AS mean_tps_other, median(b) AS median_tps_other, max(q) AS max_speedup, min(q) AS min_speedup, avg(q) AS mean_speedup, median(q) AS median_speedup FROM quot")
def benchmark_compare(spark, sf_dir):
    return access.compare_benchmarks(_rates(spark, sf_dir, 10), _rates(spark, sf_dir, 25))[1]


@register("outpoint_text", "SELECT tx_id, vout, lpad(printf('%x', tx_id % 256), 2, '0') || lpad(printf('%x', tx_id // 256 % 256), 2, '0') || lpad(printf('%x', tx_id // 65536 % 256), 2, '0') || lpad(printf('%x', tx_id // 16777216 % 256), 2, '0') || ':' || vout AS shown FROM txo")
def outpoint_text(spark, sf_dir):
    raw = F.unhex(F.lpad(F.hex(F.col("tx_id")), 8, "0"))
    return txo(spark, sf_dir).select("tx_id", "vout", scalars.outpoint_text(raw, F.col("vout")).alias("shown"))


@register("container_statistics", f"{_LAID} SELECT container, count(*) AS n_inserts, count(*) FILTER (WHERE event) AS n_deletes, count(*) FILTER (WHERE NOT event) AS n_current, CAST(sum(locking_script_size) AS BIGINT) AS bytes, avg(locking_script_size) AS mean_size FROM laid GROUP BY 1")
def container_statistics(spark, sf_dir):
    return _laid(spark, sf_dir).groupBy("container").agg(
        F.count("*").alias("n_inserts"), F.count_if("event").alias("n_deletes"), F.count_if(~F.col("event")).alias("n_current"), F.sum(F.col("locking_script_size").cast("long")).alias("bytes"), F.avg("locking_script_size").alias("mean_size")
    )


@register("value_size_histogram", f"{_LAID} SELECT container, locking_script_size AS size, count(*) AS n FROM laid GROUP BY 1, 2")
def value_size_histogram(spark, sf_dir):
    return _laid(spark, sf_dir).groupBy("container", F.col("locking_script_size").alias("size")).agg(F.count("*").alias("n"))


@register("lifetime_histogram", "SELECT duration AS age, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY duration) AS BIGINT) AS n_up_to FROM txo WHERE event GROUP BY 1")
def lifetime_histogram(spark, sf_dir):
    """Erased entries by age, and how many were no older; a row a different age, so the ordered sum is over few rows."""
    ages = txo(spark, sf_dir).where("event").groupBy(F.col("duration").alias("age")).agg(F.count("*").alias("n"))
    return access.cumulative(ages, ["n"], "age").withColumnRenamed("total_n", "n_up_to")


@register("deferred_queue", ", q AS (SELECT tx_id, CAST(vout % 2 AS INT) AS vout, creation_block + vout AS height FROM txo WHERE event) SELECT tx_id, vout, min(height) AS height FROM q GROUP BY 1, 2")
def deferred_queue(spark, sf_dir):
    """Deferred keys, each once, with the first height at which it was asked for."""
    asked = txo(spark, sf_dir).where("event").select("tx_id", (F.col("vout") % 2).cast("int").alias("vout"), (F.col("creation_block") + F.col("vout")).alias("height"))
    return state.deduplicate(asked, ["height"], keep="first")


@register("dangling_pointers", "SELECT count(*) AS n FROM txo ANTI JOIN (SELECT o_orderkey AS tx_id FROM orders) t USING (tx_id)")
def dangling_pointers(spark, sf_dir):
    """Entries whose transaction is not there: none in a sound ledger."""
    transactions = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("tx_id"))
    return state.missing_keys(transactions, txo(spark, sf_dir), ["tx_id"]).agg(F.count("*").alias("n"))


@register("hot_files", f"{_LAID}, touched AS (SELECT container, version, count(*) AS n_access FROM laid WHERE event GROUP BY 1, 2) SELECT container, version, n_access, CAST(row_number() OVER (ORDER BY n_access DESC, container, version) AS INT) AS place FROM touched ORDER BY n_access DESC, container, version LIMIT 20")
def hot_files(spark, sf_dir):
    """The 20 file groups that spends touch most."""
    from pyspark.sql.window import Window

    touched = _laid(spark, sf_dir).where("event").groupBy("container", "version").agg(F.count("*").alias("n_access"))
    top = touched.orderBy(F.desc("n_access"), "container", "version").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_access"), "container", "version")))


@register("state_totals", f", h AS (SELECT CAST(range * {BATCH} AS INT) AS height FROM range(1, 8)) SELECT height, count(*) FILTER (WHERE creation_block <= height) AS n_created, count(*) FILTER (WHERE spent_block <= height) AS n_spent, count(*) FILTER (WHERE creation_block <= height AND (spent_block IS NULL OR spent_block > height)) AS n_live FROM h, txo GROUP BY 1")
def state_totals(spark, sf_dir):
    """Inserted less deleted is live, at several heights; outputs are first counted by the pair of heights at which they came and went."""
    step = lambda c: F.ceil(F.col(c) / BATCH).cast("int")
    moves = txo(spark, sf_dir).groupBy(step("creation_block").alias("came"), step("spent_block").alias("went")).agg(F.count("*").alias("n"))
    heights = spark.range(1, 8).select(F.col("id").cast("int").alias("k"))
    created, spent = F.col("came") <= F.col("k"), F.coalesce(F.col("went") <= F.col("k"), F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return F.broadcast(heights).crossJoin(moves).groupBy("k").agg(total(created).alias("n_created"), total(spent).alias("n_spent"), total(created & ~spent).alias("n_live")).select((F.col("k") * BATCH).cast("int").alias("height"), "n_created", "n_spent", "n_live")


@register("capacity", "SELECT CAST(rate AS BIGINT) AS rate, CAST(rate * 86400 AS BIGINT) AS per_day, CAST(rate * 86400 * 365 AS BIGINT) AS per_year, CAST(rate * 600 AS BIGINT) AS per_block FROM (SELECT unnest([1000::BIGINT, 114000, 202000]) AS rate)", "")
def capacity(spark, sf_dir):
    """Transactions a day, a year and a block of ten minutes at given rates a second."""
    rate = F.col("rate").cast("long")
    return spark.createDataFrame([(1000,), (114_000,), (202_000,)], "rate long").select("rate", (rate * 86_400).alias("per_day"), (rate * 86_400 * 365).alias("per_year"), (rate * 600).alias("per_block"))


@register("activity_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2", "")
def activity_windows(spark, sf_dir):
    """The windowed aggregate of the event stream, here over the whole table at once."""
    from strataledger.streaming.matching import windowed_activity

    return windowed_activity(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("total", F.round("total", 6))


_OPS = f"{_LAID}, e AS (SELECT tx_id, CAST(vout + CASE WHEN op_return THEN 1000 ELSE 0 END AS INT) AS vout, container, spent_block // {BATCH} AS batch, spent_block // 50000 AS newest FROM laid WHERE event), x AS (SELECT e.*, CASE WHEN l.tx_id IS NOT NULL THEN greatest(newest - version, 0) END AS depth FROM e LEFT JOIN laid l ON e.tx_id = l.tx_id AND e.vout = l.vout)"


def _erased(spark, sf_dir):
    """The deletes of a history with their depth; those of OP_RETURN outputs ask for an index that does not exist."""
    laid = _laid(spark, sf_dir)
    asked = laid.where("event").select(
        "tx_id", (F.col("vout") + F.when(F.col("op_return"), 1000).otherwise(0)).cast("int").alias("vout"), "container", F.floor(F.col("spent_block") / BATCH).alias("batch"), F.floor(F.col("spent_block") / 50_000).cast("int").alias("version")
    )
    return state.deferred(laid.select(*KEY, "version"), asked)


@register("container_operations", f"{_OPS} SELECT container, count(*) AS n_asked, count(*) FILTER (WHERE depth = 0) AS n_deleted, count(*) FILTER (WHERE depth > 0) AS n_deferred, count(*) FILTER (WHERE depth IS NULL) AS n_failed, CAST(NULL AS INT) AS n_rehash FROM x GROUP BY 1")
def container_operations(spark, sf_dir):
    return state.container_operations(_erased(spark, sf_dir))


@register(
    "deferred_summary",
    f"{_OPS}, runs AS (SELECT batch, count(*) FILTER (WHERE depth > 0) AS waiting, count(*) FILTER (WHERE depth IS NULL) AS failed, sum(depth) FILTER (WHERE depth > 0) AS depths, max(depth) FILTER (WHERE depth > 0) AS deepest FROM x GROUP BY 1) "
    "SELECT CAST(sum(waiting) AS BIGINT) AS n_deferred, CAST(sum(failed) AS BIGINT) AS n_failed, count(*) FILTER (WHERE waiting > 0) AS n_runs, max(waiting) AS longest_queue, CAST(sum(depths) AS DOUBLE) / CAST(sum(waiting) AS DOUBLE) AS mean_depth, CAST(max(deepest) AS INT) AS max_depth FROM runs",
)
def deferred_summary(spark, sf_dir):
    return state.deferred_summary(_erased(spark, sf_dir))


@register("deletions_by_depth", f"{_OPS} SELECT CAST(depth AS INT) AS depth, count(*) AS n FROM x GROUP BY 1")
def deletions_by_depth(spark, sf_dir):
    return _erased(spark, sf_dir).groupBy("depth").agg(F.count("*").alias("n"))


_BUCKETS = "CASE WHEN n < 15 THEN 29 ELSE CAST(power(2, ceil(log2(greatest(floor((ceil(n / CAST(0.836 AS DOUBLE)) + 1) / 15), 1)))) * 15 - 1 AS BIGINT) END"


@register(
    "memory_estimate",
    f"{_LAID}, f AS (SELECT container, version, count(*) AS n, CAST(sum(locking_script_size + 44) AS BIGINT) AS used FROM laid GROUP BY 1, 2), s AS (SELECT container, used, {_BUCKETS} * (CASE container WHEN 0 THEN 44 WHEN 1 THEN 128 WHEN 2 THEN 512 ELSE 10240 END + 44) AS estimate FROM f), "
    "t AS (SELECT container, count(*) AS n_versions, CAST(sum(estimate) AS BIGINT) AS estimate, CAST(sum(used) AS BIGINT) AS used FROM s GROUP BY 1) SELECT *, used / CAST(estimate AS DOUBLE) AS fill, estimate - used AS wasted FROM t",
)
def memory_estimate(spark, sf_dir):
    return state.memory_estimate(_laid(spark, sf_dir), SIZE_CLASSES)


@register("cached_files", f"{_LAID}, f AS (SELECT DISTINCT container, version FROM laid) SELECT container, version, CAST(row_number() OVER (ORDER BY container, version DESC) AS INT) AS place FROM f")
def cached_files(spark, sf_dir):
    return state.cached_order(_laid(spark, sf_dir).select("container", "version").distinct())


@register("op_return_versions", ", r AS (SELECT *, CAST((row_number() OVER (ORDER BY creation_block, tx_id, vout) - 1) // 500 AS INT) AS version FROM txo WHERE op_return) SELECT version, count(*) AS n_inserts, count(*) FILTER (WHERE event) AS n_erased, count(*) FILTER (WHERE NOT event) AS n_current, min(creation_block) AS min_height, max(creation_block) AS max_height FROM r GROUP BY 1")
def op_return_versions(spark, sf_dir):
    """The set of OP_RETURN outputs, a new version after every 500: what each version was given, has lost and still holds."""
    placed = state.rotated(txo(spark, sf_dir).where("op_return"), 500)
    return placed.groupBy("version").agg(F.count("*").alias("n_inserts"), F.count_if("event").alias("n_erased"), F.count_if(~F.col("event")).alias("n_current"), F.min("creation_block").alias("min_height"), F.max("creation_block").alias("max_height"))


def _batch_sizes(spark, sf_dir):
    """Per batch its transactions, and what is inserted (OP_RETURN apart) and deleted once it is netted."""
    rows = txo(spark, sf_dir).withColumns({"came": F.floor(F.col("creation_block") / BATCH).cast("int"), "went": F.floor(F.col("spent_block") / BATCH).cast("int")})
    here = F.coalesce(F.col("came") == F.col("went"), F.lit(False))
    made = rows.groupBy(F.col("came").alias("batch")).agg(F.countDistinct("tx_id").alias("n_tx"), F.count_if(~here & ~F.col("op_return")).alias("n_inserts"), F.count_if(~here & F.col("op_return")).alias("n_op_returns"))
    gone = rows.where(F.col("went").isNotNull() & ~here).groupBy(F.col("went").alias("batch")).agg(F.count("*").alias("n_deletes"))
    return made.join(gone, "batch", "left").withColumn("n_deletes", F.coalesce("n_deletes", F.lit(0)))


@register(
    "sizing_factors",
    f", r AS (SELECT *, CAST(creation_block // {BATCH} AS INT) AS came, CAST(spent_block // {BATCH} AS INT) AS went FROM txo), m AS (SELECT came AS batch, count(DISTINCT tx_id) AS n_tx, count(*) FILTER (WHERE came IS DISTINCT FROM went AND NOT op_return) AS n_ins, count(*) FILTER (WHERE came IS DISTINCT FROM went AND op_return) AS n_op FROM r GROUP BY 1), "
    "g AS (SELECT went AS batch, count(*) AS n_del FROM r WHERE went IS NOT NULL AND came <> went GROUP BY 1), k AS MATERIALIZED (SELECT m.*, coalesce(n_del, 0) AS n_del, row_number() OVER (ORDER BY m.batch) AS k FROM m LEFT JOIN g ON m.batch = g.batch), "
    "e(k, batch, i, d, o) AS (SELECT CAST(0 AS BIGINT), -1, CAST(6 AS DOUBLE), CAST(3 AS DOUBLE), CAST(0.2 AS DOUBLE) UNION ALL SELECT k.k, k.batch, CAST(0.1 AS DOUBLE) * n_ins / n_tx + CAST(0.9 AS DOUBLE) * i, CASE WHEN n_del = 0 THEN d ELSE CAST(0.1 AS DOUBLE) * n_del / n_tx + CAST(0.9 AS DOUBLE) * d END, CAST(0.1 AS DOUBLE) * n_op / n_tx + CAST(0.9 AS DOUBLE) * o FROM e JOIN k ON k.k = e.k + 1) "
    "SELECT batch, round(i, 6) AS insert_factor, round(d, 6) AS delete_factor, round(o, 6) AS op_return_factor FROM e WHERE k > 0",
    RECURSIVE,
)
def sizing_factors(spark, sf_dir):
    found = access.sizing_factors(_batch_sizes(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in found.columns[1:]})


@register("operation_rates", "SELECT op, count(*) AS n, count(*) FILTER (WHERE found) AS n_found, count(*) FILTER (WHERE NOT found) AS n_failed, count(*) FILTER (WHERE found) / CAST(count(*) AS DOUBLE) AS hit_rate, count(*) / CAST(max(access_height) - min(access_height) + 1 AS DOUBLE) AS per_height FROM access GROUP BY 1", ACCESS)
def operation_rates(spark, sf_dir):
    return access.operation_rates(access_log(spark, sf_dir))
