"""Stage outputs of the stand-in pipeline, built once per session and table folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from catalog import roles as R
from voltloom.operators import anomaly, blocks, days, forest, models, weather
from voltloom.plans import experiment
from voltloom.plans.building_table import build_table, clean_meters
from voltloom.session import stage

_MADE: dict[tuple, DataFrame] = {}


class Workspace:
    """Readings, blocks, cleaned meters, occupancy, weather and the building table.

    What several queries read is written once as a stage table, as a project would keep
    its stage outputs between steps.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.rules = spark, sf_dir, R.RULES

    def _once(self, name: str, make, **kw) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _MADE:
            _MADE[key] = stage(make(), name, **kw)
        return _MADE[key].alias(name)

    def table(self, name: str) -> DataFrame:
        return R.table(self.spark, self.sf_dir, name)

    @property
    def readings(self) -> DataFrame:
        return R.readings(self.spark, self.sf_dir)

    @property
    def registry(self) -> DataFrame:
        return R.registry(self.spark)

    @property
    def calendar(self) -> DataFrame:
        return R.calendar(self.spark, self.sf_dir)

    @property
    def occupancy_raw(self) -> DataFrame:
        return R.occupancy(self.spark, self.sf_dir)

    @property
    def block_sums(self) -> DataFrame:
        return self._once("block_sums", lambda: blocks.aggregate_blocks(
            blocks.invalidate(self.readings, self.rules)))

    @property
    def blocks(self) -> DataFrame:
        return self._once("meter_blocks", lambda: blocks.complete_grid(self.block_sums))

    @property
    def cleaned(self) -> DataFrame:
        return self._once("cleaned", lambda: clean_meters(self.blocks, self.rules))

    @property
    def occupancy(self) -> DataFrame:
        return self._once("occupancy", lambda: blocks.occupancy_blocks(self.occupancy_raw))

    @property
    def weather(self) -> DataFrame:
        return self._once("weather", lambda: weather.weather_grid(
            weather.parse_station(R.weather_rows(self.spark, self.sf_dir)), self.rules))

    @property
    def buildings(self) -> DataFrame:
        return self._once("buildings", lambda: build_table(
            self.cleaned, self.registry, self.occupancy, self.weather, self.calendar, self.rules),
            partition_by=["building"])

    # ------------------------------------------------------------------ models
    @property
    def split(self) -> DataFrame:
        """Model rows with their chronological split."""
        return self._once("split", lambda: models.with_split(
            models.usable_frame(self.buildings), ["building"], rules=self.rules), partition_by=["building"])

    @property
    def expected(self) -> DataFrame:
        """Bias-corrected predictions of models B and C on the validation and test rows."""
        return self._once("expected", lambda: experiment.expected_power(self.split, ["building"]))

    @property
    def forest(self) -> DataFrame:
        """Model D's trees of every building, with the answers of every published depth."""
        return self._once("forest", lambda: forest.grow(self.split, ["building"], depths=forest.DEPTHS))

    # --------------------------------------------- a detector SQL can follow
    @property
    def hourly_means(self) -> DataFrame:
        """Test rows with two simple expectations: the mean by hour (T) and the mean by
        hour and low occupancy (O), both from the training rows."""
        s = self.split.withColumn("low", F.col("occupancy") <= 1)
        train = s.filter("split = 'train'")
        t = train.groupBy("building", "hour").agg(F.avg("power_w").alias("pt"))
        o = train.groupBy("building", "hour", "low").agg(F.avg("power_w").alias("po"))
        test = s.filter("split = 'test'").drop("pos", "n_rows")
        test = models.row_positions(test, ["building"], "ts", self.rules.segment_days, "pos", "n_rows")
        d = test.join(t, ["building", "hour"]).join(o, ["building", "hour", "low"], "left")
        # rounded, so that both engines see the same values and hence the same ties
        return d.withColumns({"power_w": F.round("power_w", 6), "pt": F.round("pt", 6),
                              "po": F.round(F.coalesce("po", "pt"), 6)})

    @property
    def labelled(self) -> DataFrame:
        """The test rows with events at fixed places, once per detector."""
        return self._once("labelled", self._labelled)

    def fixed_events(self, test: DataFrame) -> DataFrame:
        p = F.col("pos")
        kinds = F.explode(F.array_compact(F.array(
            F.when(p % 97 == 13, F.struct(F.lit("spike").alias("type"), (1 + p % 3).cast("int").alias("length"),
                                          (0.5 + (p % 50) / 100.0).alias("magnitude"))),
            F.when((p % 53 == 5) & F.col("low"), F.struct(
                F.lit("waste").alias("type"), (12 + p % 24).cast("int").alias("length"),
                (0.15 + (p % 15) / 100.0).alias("magnitude"))))))
        e = test.select("building", "n_rows", p.alias("start_pos"), kinds.alias("e")).select(
            "building", "n_rows", "start_pos", "e.*")
        e = e.filter(F.col("start_pos") + F.col("length") <= F.col("n_rows")).drop("n_rows")
        # spikes take precedence, then the earlier start
        return e.withColumn("event_id", F.when(F.col("type") == "spike", F.col("start_pos"))
                            .otherwise(F.col("start_pos") + 1_000_000_000))

    def _labelled(self) -> DataFrame:
        test = self.hourly_means
        events = anomaly.drop_overlaps(self.fixed_events(test), ["building"])
        d = anomaly.contaminate(test, events, ["building"])
        both = F.explode(F.array(F.struct(F.lit("T").alias("detector"), F.col("pt").alias("p")),
                                 F.struct(F.lit("O").alias("detector"), F.col("po").alias("p"))))
        return d.withColumn("_b", both).withColumns(
            {"detector": F.col("_b.detector"), "predicted_w": F.col("_b.p")}).drop("_b", "pt", "po")

    @property
    def scored(self) -> DataFrame:
        return self._once("scored", lambda: anomaly.score_detector(
            self.labelled, ["building", "detector"], rules=self.rules))

    @property
    def hourly_days(self) -> DataFrame:
        """Days whose 144 blocks are all present, of the mains load with missing power filled in."""
        return self._once("hourly_days", lambda: days.with_labels(days.hourly(days.day_rows(
            self.dense, value="power_w"))))

    @property
    def day_scores(self) -> DataFrame:
        def make():
            z = days.standardise(self.hourly_days)
            return days.day_scores(z, days.principal_components(z))
        return self._once("day_scores", make)

    @property
    def dense(self) -> DataFrame:
        """A gap-free series per building: missing power counts as the building's mean of
        that hour (the stand-in meters are too sparse to have complete days)."""
        b = self.blocks.join(self.registry.filter("role = 'mains'"), "meter")
        mean = b.groupBy("building", F.hour("ts").alias("h")).agg(F.avg("power_w").alias("m"))
        return (b.withColumn("h", F.hour("ts")).join(mean, ["building", "h"])
                .select("building", "ts", F.coalesce("power_w", "m").alias("power_w")))
