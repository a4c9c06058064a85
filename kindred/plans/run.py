"""A linkage run: a configuration, named frames, and tasks of steps over them.

Every step's output is written to the run's warehouse and read back, so later steps start from files: nothing is
computed twice, and a lost executor costs one step at most.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.similarity import register_functions
from kindred.operators import blocking, decide, households, ml, pairs, prepare, reports, selections
from kindred.sources.io import Registry, check_text_columns, read_csv, read_datasource, write_csv

log = logging.getLogger(__name__)


def default_warehouse(spark: SparkSession) -> str:
    """A folder for one run's tables: in spark.checkpoint.dir, or in Spark's warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/link-run-{uuid.uuid4().hex}"


class LinkRun:
    """Programmatic entry: LinkRun(spark, config).task("matching").run_all_steps()."""

    def __init__(self, spark: SparkSession, config: dict[str, Any], use_preexisting_tables: bool = True, warehouse: str | None = None, print_sql: bool = False):
        self.spark, self.config = spark, config
        register_functions(spark)
        self.use_preexisting_tables, self.print_sql = use_preexisting_tables, print_sql
        self.tables = Registry(spark, warehouse or default_warehouse(spark))
        self.models: dict[str, ml.LinkModel] = {}
        self.tasks = {t.name: t for t in (make(self) for make in TASKS)}

    def task(self, name: str) -> Task:
        if name not in self.tasks:
            raise KeyError(f"no task is named {name}; there are {', '.join(self.tasks)}")
        return self.tasks[name]

    get_task = task

    def table(self, name: str) -> DataFrame:
        return self.tables.get(name)

    get_table = table

    def _model_path(self, section: str) -> str:
        return f"{self.tables.warehouse.rstrip('/')}/models/{section}"

    def keep_model(self, section: str, model: ml.LinkModel) -> None:
        self.models[section] = model
        model.save(self._model_path(section))

    def model(self, section: str) -> ml.LinkModel:
        """The model of this run, or the one that an earlier run left in the same warehouse."""
        if section not in self.models:
            try:
                self.models[section] = ml.LinkModel.load(self.spark, self._model_path(section))
            except AnalysisException:
                raise RuntimeError(f"no model is there; run the task {section} first") from None
        return self.models[section]

    def put(self, name: str, make: Callable[[], DataFrame], persist: bool = True, bucket_by: str | None = None) -> DataFrame:
        """The named frame: an existing one if that is allowed, else a new one. bucket_by: a column that later steps join on."""
        if self.use_preexisting_tables and self.tables.exists(name):
            return self.tables.get(name)
        df = self.tables.put(name, make(), persist, bucket_by)
        if self.print_sql:
            df.explain()
        return df


class Task:
    name = ""

    def __init__(self, run: LinkRun):
        self.run = run

    @property
    def config(self) -> dict[str, Any]:
        return self.run.config

    def steps(self) -> list[tuple[str, tuple[str, ...], Callable[[], None]]]:
        """(name, input tables, function) in order."""
        raise NotImplementedError

    def run_all_steps(self) -> None:
        for k in range(len(self.steps())):
            self.run_step(k)

    def run_step(self, k: int) -> float:
        """Seconds that the step took; RuntimeError if an input table is missing."""
        name, needs, f = self.steps()[k]
        missing = [t for t in needs if not self.run.tables.exists(t)]
        if missing:
            raise RuntimeError(f"{self.name}, step {k} ({name}): tables are missing: {', '.join(missing)}")
        began = time.time()
        f()
        took = time.time() - began
        log.info("%s, step %d (%s): %.1f s", self.name, k, name, took)
        return took


class Preprocessing(Task):
    name = "preprocessing"

    def steps(self):
        return [("register raw dataframes", (), self.register), ("prepare dataframes", ("raw_df_a", "raw_df_b"), self.prepare)]

    def register(self):
        for side in ("a", "b"):
            self.run.put(f"raw_df_{side}", lambda side=side: check_text_columns(self._filtered(read_datasource(self.run.spark, self.config[f"datasource_{side}"]), side)))

    def _filtered(self, df: DataFrame, side: str) -> DataFrame:
        for f in self.config.get("filter", []):
            if f.get("datasource") not in (None, side):
                continue
            serial = f.get(f"serial_{side}", "serialp")
            if f.get("training_data_subset"):
                training = read_csv(self.run.spark, self.config["training"]["dataset"])
                df = prepare.filter_training_subset(df, training, self.config["id_column"], f"{self.config['id_column']}_{side}", serial)
            elif f.get("household"):
                df = prepare.filter_households(df, f["expression"], serial)
            else:
                df = prepare.filter_rows(df, f["expression"])
        return df

    def prepare(self):
        c = self.config
        for side in ("a", "b"):

            def make(side=side):
                df = prepare.map_columns(self.run.table(f"raw_df_{side}"), c["column_mappings"], c["id_column"], side == "a")
                df = prepare.substitute(self.run.spark, df, c.get("substitution_columns", []))
                return selections.select_features(self.run.spark, df, c.get("feature_selections", []), c["id_column"], side == "a")

            self.run.put(f"prepped_df_{side}", make, bucket_by=c["id_column"])


class Matching(Task):
    name, prefix, section = "matching", "", "training"

    def steps(self):
        return [
            ("explode", ("prepped_df_a", "prepped_df_b"), self.explode),
            ("match", ("match_universe_df_a", "match_universe_df_b"), self.match),
            ("score", ("potential_matches",), self.score),
        ]

    def explode(self):
        conditions = [u["expression"] for u in self.config.get("potential_matches_universe", [])]
        for side in ("a", "b"):
            self.run.put(f"match_universe_df_{side}", lambda side=side: blocking.universe(self.run.table(f"prepped_df_{side}"), conditions), bucket_by=self.config["id_column"])

    def match(self):
        c = self.config

        def make():
            a, b = self.run.table("match_universe_df_a"), self.run.table("match_universe_df_b")
            ids = blocking.candidate_ids(a, b, c["blocking"], c["id_column"], hot_pairs=int(c.get("hot_key_pairs", blocking.HOT_PAIRS)), max_candidates=c.get("max_potential_matches"))
            specs = pairs.needed_features(c.get("comparisons"), c.get("comparison_features", []))
            return pairs.compare(self.run.spark, ids, a, b, c["id_column"], specs, c.get("comparisons"), keep_records=not c.get("streamline_potential_match_generation", False))

        self.run.put("potential_matches", make)

    def score(self):
        self._score("potential_matches", "scored_potential_matches", "predicted_matches")

    def _score(self, source: str, scored: str, predicted: str):
        c, conf = self.config, self.config.get(self.section, {})
        if not conf.get("score_with_model"):
            log.warning("%s: score_with_model is off; pairs are not scored", self.section)
            return
        model, id_column = self.run.model(self.section), c["id_column"]
        potential = self.run.table(source)

        def make():
            missing = [n for n in model.inputs if n not in potential.columns]
            df = potential
            if missing:
                a, b = self.run.table("prepped_df_a"), self.run.table("prepped_df_b")
                more = pairs.compare(self.run.spark, potential, a, b, id_column, c.get("comparison_features", []), wanted=model.inputs)
                df = more
            chosen = conf["chosen_model"]
            out = decide.decide(model.score(df), conf.get("decision"), float(chosen.get("threshold", decide.DEFAULT_ALPHA)), decide.threshold_ratio(conf, chosen), id_column)
            if c.get("drop_data_from_scored_matches"):
                out = out.select(f"{id_column}_a", f"{id_column}_b", "probability", "prediction")
            return out

        df = self.run.put(scored, make)
        self.run.put(predicted, lambda: decide.one_to_one(df, id_column))


class HouseholdMatching(Matching):
    name, prefix, section = "hh_matching", "hh_", "hh_training"

    def steps(self):
        return [
            ("block on households", ("prepped_df_a", "prepped_df_b", "predicted_matches"), self.block),
            ("filter", ("hh_blocked_matches",), self.match),
            ("score", ("hh_potential_matches",), self.score),
        ]

    def block(self):
        c = self.config
        records = c.get("hh_matching", {}).get("records_to_match", "unmatched_only")
        serial = c.get("hh_training", {}).get("hh_col", "serialp")
        self.run.put("hh_blocked_matches", lambda: households.block_on_households(self.run.table("predicted_matches"), self.run.table("prepped_df_a"), self.run.table("prepped_df_b"), c["id_column"], serial, records))

    def match(self):
        c = self.config

        def make():
            a, b = self.run.table("prepped_df_a"), self.run.table("prepped_df_b")
            specs = pairs.needed_features(c.get("hh_comparisons"), c.get("comparison_features", []))
            return pairs.compare(self.run.spark, self.run.table("hh_blocked_matches"), a, b, c["id_column"], specs, c.get("hh_comparisons")).distinct()

        self.run.put("hh_potential_matches", make)

    def score(self):
        self._score("hh_potential_matches", "scored_hh_potential_matches", "predicted_hh_matches")


class Training(Task):
    name, prefix = "training", ""

    def steps(self):
        p = self.prefix
        return [
            ("ingest", (), self.ingest),
            ("create comparison features", (f"{p}training_data", "prepped_df_a", "prepped_df_b"), self.features),
            ("train and save the model", (f"{p}training_features",), self.fit),
            ("save model metadata", (f"{p}training_features",), self.metadata),
        ]

    @property
    def section(self) -> str:
        return f"{self.prefix}training"

    def ingest(self):
        self.run.put(f"{self.prefix}training_data", lambda: read_csv(self.run.spark, self.config[self.section]["dataset"]))

    def features(self):
        c, conf = self.config, self.config[self.section]

        def make():
            data = self.run.table(f"{self.prefix}training_data")
            if conf.get("use_training_data_features"):
                return data
            a, b, id_column = self.run.table("prepped_df_a"), self.run.table("prepped_df_b"), c["id_column"]
            base = data.select(f"{id_column}_a", f"{id_column}_b", conf["dependent_var"])
            if self.prefix:
                base = households.training_households(base, a, b, id_column, conf.get("hh_col", "serialp"))
            made = {p["output_column"]: p for p in c.get("pipeline_features", [])}
            wanted = list(dict.fromkeys(r for n in conf["independent_vars"] for r in ml._roots(n, made)))
            needs = [n for n, x in (("exact", "exact_mult"), ("exact_all", "exact_all_mult"), ("exact_all", "exact_all_mult2")) if x in wanted]
            return pairs.compare(self.run.spark, base, a, b, id_column, c.get("comparison_features", []), wanted=list(dict.fromkeys([*wanted, *needs])))

        self.run.put(f"{self.prefix}training_features", make)

    def fit(self):
        if not self.config[self.section].get("score_with_model"):
            log.warning("%s: score_with_model is off; no model is fitted", self.section)
            return
        self.run.keep_model(self.section, ml.train(self.run.table(f"{self.prefix}training_features"), self.config, self.section))

    def metadata(self):
        if self.config[self.section].get("feature_importances") and self.section in self.run.models:
            self.run.put(f"{self.prefix}training_feature_importances", lambda: self.run.models[self.section].importances(self.run.spark))


class HouseholdTraining(Training):
    name, prefix = "hh_training", "hh_"


class Exploration(Training):
    name = "model_exploration"

    def steps(self):
        p = self.prefix
        return [
            ("ingest", (), self.ingest),
            ("create comparison features", (f"{p}training_data", "prepped_df_a", "prepped_df_b"), self.features),
            ("train and test models", (f"{p}training_features",), self.explore),
        ]

    def explore(self):
        self.run.put(f"{self.prefix}training_results", lambda: ml.summarize(ml.explore(self.run.table(f"{self.prefix}training_features"), self.config, self.section)))


class HouseholdExploration(Exploration):
    name, prefix = "hh_model_exploration", "hh_"


class Reporting(Task):
    name = "reporting"

    def steps(self):
        needs = ("prepped_df_a", "prepped_df_b", "predicted_matches", "predicted_hh_matches")
        return [("percent linked in round 2", needs, self.percent), ("representivity", ("raw_df_a", "raw_df_b", *needs), self.representivity), ("crosswalk", ("raw_df_a", "raw_df_b", "predicted_matches"), self.crosswalk)]

    def percent(self):
        t = self.run.table
        self.run.put("report_percent_linked", lambda: reports.percent_linked(t("prepped_df_a"), t("predicted_matches"), t("predicted_hh_matches"), self.config["id_column"]))

    def representivity(self):
        """The report as a table and as one CSV file; the configuration's features, or else the default ones that have their columns."""
        t, id_column = self.run.table, self.config["id_column"]
        sides = []
        for side in ("a", "b"):
            raw, prepped = t(f"raw_df_{side}"), t(f"prepped_df_{side}")
            more = [c for c in raw.columns if c not in prepped.columns]
            both = prepped.join(raw.select(F.col(id_column).alias("__id"), *more), F.col(id_column) == F.col("__id"), "left").drop("__id") if more else prepped
            sides.append(both)
        spec = self.config.get("representivity") or reports.default_features([c for c in sides[0].columns if c in sides[1].columns])
        if spec:
            df = self.run.put("report_representivity", lambda: reports.representivity(*sides, t("predicted_matches"), t("predicted_hh_matches"), reports.report_features(spec), id_column))
            write_csv(df.orderBy("feature", "value"), f"{self.run.tables.warehouse.rstrip('/')}/reports/representivity.csv")

    def crosswalk(self):
        t, c = self.run.table, self.config.get("crosswalk", {})
        rounds = [t(n) for n in ("predicted_matches", "predicted_hh_matches") if self.run.tables.exists(n)]
        self.run.put("crosswalk", lambda: reports.crosswalk(rounds, t("raw_df_a"), t("raw_df_b"), self.config["id_column"], c.get("variables_a", []), c.get("variables_b", []), c.get("include_round", False)))


TASKS = (Preprocessing, Training, Matching, HouseholdTraining, HouseholdMatching, Exploration, HouseholdExploration, Reporting)


class SparkFactory:
    """A local session, set up step by step: SparkFactory().set_num_cores(8).create()."""

    def __init__(self):
        self.conf: dict[str, str] = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"}
        self.cores, self.memory, self.master, self.name = 4, "10G", None, "linking"

    def set_num_cores(self, n: int):
        self.cores = n
        return self

    def set_executor_memory(self, memory: str):
        self.memory = memory
        return self

    def set_master(self, master: str):
        self.master = master
        return self

    def set_app_name(self, name: str):
        self.name = name
        return self

    def set_conf(self, key: str, value: str):
        self.conf[key] = value
        return self

    def set_warehouse_dir(self, path: str):
        return self.set_conf("spark.sql.warehouse.dir", path)

    def set_checkpoint_dir(self, path: str):
        return self.set_conf("spark.checkpoint.dir", path)

    def set_local_dir(self, path: str):
        return self.set_conf("spark.local.dir", path)

    def create(self) -> SparkSession:
        b = SparkSession.builder.appName(self.name).master(self.master or f"local[{self.cores}]").config("spark.driver.memory", self.memory).config("spark.executor.memory", self.memory)
        return b.config(map=self.conf).getOrCreate()

