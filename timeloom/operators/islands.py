"""Gaps and islands: streaks of a state, ventilation episodes and extubations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timeloom.functions.columns import minute_boundaries
from timeloom.operators.joins import asof_join, flag_followed


def changed(x: Column, w: Window) -> Column:
    """1 where the value is distinct from the one before; nulls are values."""
    return F.when(~x.eqNullSafe(F.lag(x).over(w)), 1).otherwise(0)


def first_of(flag: Column, w: Window) -> Column:
    """1 at the first row whose flag is 1."""
    return F.when((flag == 1) & (F.sum(flag).over(w) == 1), 1).otherwise(0)


def streaks(df: DataFrame, key: str, ts: str, state: Column) -> DataFrame:
    """key, streak, state, start, last, end, minutes: runs of one state; a run ends where the next begins."""
    rows = df.select(key, F.col(ts).alias("__t"), state.alias("state"))
    w2 = Window.partitionBy(key).orderBy("__t")
    rows = rows.withColumn("__chg", changed(F.col("state"), w2)).withColumn("streak", F.sum("__chg").over(w2))
    runs = rows.groupBy(key, "streak").agg(F.max("state").alias("state"), F.min("__t").alias("start"), F.max("__t").alias("last"), F.count(F.lit(1)).alias("n_rows"))
    w3 = Window.partitionBy(key).orderBy("streak")
    return runs.withColumn("end", F.coalesce(F.lead("start").over(w3), "last")).withColumn("minutes", minute_boundaries(F.col("start"), F.col("end")))


def ventilation_streaks(resp: DataFrame, key: str = "hospitalization_id", ts: str = "recorded_dttm") -> DataFrame:
    """Streaks on and off invasive ventilation, cut at the first tracheostomy."""
    w = Window.partitionBy(key).orderBy(ts)
    on = F.when(F.col("device_category") == "imv", 1).otherwise(0)
    rows = resp.withColumn("_on_imv", on).withColumn("_before", F.lag("_on_imv").over(w)).withColumn("_trach_before", F.lag("tracheostomy").over(w))
    rows = rows.withColumns({
        "_chg": F.when(((F.col("_on_imv") == 0) & (F.col("_before") == 1)) | ((F.col("_on_imv") == 1) & ~F.col("_before").eqNullSafe(F.lit(1))), 1).otherwise(0),
        "_flip": F.when((F.col("tracheostomy") == 1) & ~F.col("tracheostomy").eqNullSafe(F.col("_trach_before")), 1).otherwise(0),
    }).withColumns({"_streak_id": F.sum("_chg").over(w), "_trach_1st": first_of(F.col("_flip"), w)})
    runs = rows.groupBy(key, "_streak_id").agg(
        F.min(ts).alias("_start_dttm"), F.max(ts).alias("_last_observed_dttm"),
        F.min(F.when(F.col("_trach_1st") == 1, F.col(ts))).alias("_trach_dttm"), F.max("_on_imv").alias("_on_imv"),
    )
    after = Window.partitionBy(key).orderBy("_streak_id")
    runs = runs.withColumn("_next_start_dttm", F.lead("_start_dttm").over(after))
    runs = runs.withColumn("_end_dttm", F.coalesce("_trach_dttm", "_next_start_dttm", "_last_observed_dttm"))
    runs = runs.withColumn("_duration_hrs", minute_boundaries(F.col("_start_dttm"), F.col("_end_dttm")) / F.lit(60.0))
    return runs.withColumn("_at_least_24h", F.when(F.col("_duration_hrs") >= 24, 1).otherwise(0))


def extubations(resp: DataFrame, code_status: DataFrame, discharges: DataFrame, last_vitals: DataFrame, key: str = "hospitalization_id", ts: str = "recorded_dttm") -> DataFrame:
    """Each respiratory row with its breathing-trial block, first extubation, failure, withdrawal and success."""
    w = Window.partitionBy(key).orderBy(ts)
    trial = (F.col("mode_category").isin("pressure support/cpap") & (F.col("peep_set") <= 8) & (F.col("pressure_support_set") <= 8)) | F.col("device_name").rlike(r"t1[\s_-]?piece")
    before, trach = F.lag("device_category").over(w), F.lag("tracheostomy").over(w)
    imv = F.col("device_category").eqNullSafe(F.lit("imv"))
    rows = resp.withColumns({
        "_sbt_state": F.when(trial, 1).otherwise(0), "_intub": F.when(~before.eqNullSafe(F.lit("imv")) & imv, 1).otherwise(0),
        "_extub": F.when((before == "imv") & ~imv, 1).otherwise(0), "_flip": F.when((trach == 0) & (F.col("tracheostomy") == 1), 1).otherwise(0),
    })
    rows = rows.withColumns({"_extub_1st": first_of(F.col("_extub"), w), "_trach_1st": first_of(F.col("_flip"), w), "_chg": changed(F.col("_sbt_state"), w)})
    rows = rows.withColumn("_block_id", F.sum("_chg").over(w))
    rows = flag_followed(rows, rows.where("_intub = 1"), key, ts, 6 * 3600, "_again", open_start=True)
    rows = flag_followed(rows, last_vitals, key, ts, 24 * 3600, "_vitals", open_start=False)
    first = F.col("_extub_1st") == 1
    rows = rows.withColumns({"_fail_extub": F.when(first & (F.col("_again") == 1), 1).otherwise(0), "_last_vitals_within_24h_of_extub": F.when(first & (F.col("_vitals") == 1), 1).otherwise(0)})
    blocks = rows.groupBy(key, "_block_id").agg(F.min(ts).alias("_start"), F.max(ts).alias("_last"))
    after = Window.partitionBy(key).orderBy("_block_id")
    blocks = blocks.select(key, "_block_id", minute_boundaries(F.col("_start"), F.coalesce(F.lead("_start").over(after), F.col("_last"))).alias("_block_duration_mins"))
    rows = rows.join(blocks, [key, "_block_id"], "left")
    rows = asof_join(rows, code_status, key, ts, "start_dttm", ["code_status_category"], backward=True).withColumnRenamed("start_dttm", "cs_start_dttm")
    rows = asof_join(rows, discharges, key, ts, "discharge_dttm", ["discharge_category"], backward=False)
    gone = F.trim(F.lower("discharge_category")).isin("hospice", "expired")
    rows = rows.withColumns({
        "_block_duration_mins": F.coalesce("_block_duration_mins", F.lit(0)),
        "_withdrawl_lst": F.when(first & (F.trim(F.lower("code_status_category")) != "full") & gone, 1).otherwise(0),
    })
    rows = rows.withColumns({
        "sbt_done": F.when((F.col("_block_duration_mins") >= 30) & (F.col("_sbt_state") == 1), 1).otherwise(0),
        "_success_extub": F.when(first & (F.col("_withdrawl_lst") == 0) & (F.col("_fail_extub") == 0), 1).otherwise(0),
        "_death_after_extub_wo_reintub": F.when(first & (F.col("_last_vitals_within_24h_of_extub") == 1) & (F.col("_fail_extub") == 0) & gone, 1).otherwise(0),
    })
    return rows.where("tracheostomy = 0 or _trach_1st = 1").drop("_chg", "_flip", "_again", "_vitals", "_extub")


def successful_extubation_events(rows: DataFrame, key: str = "hospitalization_id", ts: str = "recorded_dttm") -> DataFrame:
    """Time of the event: 6 hours after a successful first extubation."""
    return rows.where("_success_extub = 1").select(key, (F.col(ts) + F.expr("INTERVAL '6' HOUR")).alias("event_dttm"))
