"""Command line: interactive shell, batch tasks, batch commands.

python -m kindred.cli --conf FILE [--cores N] [--executor_memory 10G] [--task NAME] [--execute_tasks A B] [--execute_command CMD...]
"""

from __future__ import annotations

import argparse
import cmd
import shlex
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import households, reports
from kindred.plans import config as configs
from kindred.plans.run import LinkRun, SparkFactory
from kindred.sources import io


class Shell(cmd.Cmd):
    """One method for each command; words are split as in a shell."""

    prompt = "kindred $ "

    def __init__(self, run: LinkRun, task: str = "preprocessing", stdout=None):
        super().__init__(stdout=stdout)
        self.run_, self.current = run, run.task(task)

    def say(self, *words, sep: str = " ") -> None:
        print(*words, sep=sep, file=self.stdout)

    def frame(self, name: str) -> DataFrame:
        return self.run_.table(name)

    def onecmd(self, line: str):
        try:
            return super().onecmd(line)
        except Exception as e:  # noqa: BLE001  the shell goes on
            self.say(f"{type(e).__name__}: {e}")
            return False

    def emptyline(self):
        return False

    def do_q(self, arg):
        """q: leave"""
        return True

    def do_EOF(self, arg):
        return True

    def do_reload(self, arg):
        """reload: read the configuration again"""
        self.run_.config = configs.load(self.run_.config["conf_path"])

    def do_set_link_task(self, arg):
        """set_link_task NAME"""
        self.current = self.run_.task(arg.strip())

    def do_get_tasks(self, arg):
        """get_tasks: names of all tasks"""
        self.say(*self.run_.tasks, sep="\n")

    def do_get_steps(self, arg):
        """get_steps: steps of the current task"""
        for k, (name, _, _) in enumerate(self.current.steps()):
            self.say(k, name)

    def do_run_step(self, arg):
        """run_step N"""
        self.say(f"{self.current.run_step(int(arg)):.1f} s")

    def do_run_all_steps(self, arg):
        """run_all_steps"""
        self.current.run_all_steps()

    def do_set_preexisting_tables(self, arg):
        """set_preexisting_tables true|false"""
        self.run_.use_preexisting_tables = arg.strip().lower() != "false"

    def do_set_print_sql(self, arg):
        """set_print_sql true|false: show plans"""
        self.run_.print_sql = arg.strip().lower() != "false"

    def do_get_settings(self, arg):
        """get_settings"""
        self.say(f"task: {self.current.name}, preexisting tables: {self.run_.use_preexisting_tables}, print sql: {self.run_.print_sql}")

    def do_ipython(self, arg):
        """ipython: Python shell with `run`"""
        import code

        code.interact(local={"run": self.run_, "spark": self.run_.spark})

    def do_analyze(self, arg):
        """analyze: validate the configuration"""
        c = self.run_.config
        configs.validate(c, io.read_datasource(self.run_.spark, c["datasource_a"]), io.read_datasource(self.run_.spark, c["datasource_b"]))
        self.say("no mistakes found")

    def do_count(self, arg):
        """count TABLE"""
        self.say(self.frame(arg.strip()).count())

    def do_desc(self, arg):
        """desc TABLE"""
        for n, t in self.frame(arg.strip()).dtypes:
            self.say(n, t)

    def do_list(self, arg):
        """list [all]"""
        for n in self.run_.tables.names(arg.strip() == "all"):
            self.say(n, io.KNOWN_TABLES[n].description if n in io.KNOWN_TABLES else "")

    def do_show(self, arg):
        """show TABLE [LIMIT]"""
        self._show(arg, True)

    def do_showf(self, arg):
        """showf TABLE [LIMIT]: without cutting"""
        self._show(arg, False)

    def _show(self, arg: str, cut: bool) -> None:
        name, *n = shlex.split(arg)
        self._print(self.frame(name).limit(int(n[0]) if n else 10), cut)

    def _print(self, df: DataFrame, cut: bool = True) -> None:
        self.say("\t".join(df.columns))
        for r in df.collect():
            self.say("\t".join(str(v)[:20] if cut else str(v) for v in r))

    def do_drop(self, arg):
        """drop TABLE..."""
        for n in shlex.split(arg):
            self.run_.tables.drop(n)

    def do_drop_all(self, arg):
        """drop_all"""
        for n in list(self.run_.tables.frames):
            self.run_.tables.drop(n)

    def do_drop_all_temp(self, arg):
        """drop_all_temp: views that the registry doesn't know"""
        known = set(self.run_.tables.frames)
        for t in self.run_.spark.catalog.listTables():
            if t.isTemporary and t.name not in known:
                self.run_.spark.catalog.dropTempView(t.name)

    def do_drop_all_prc(self, arg):
        """drop_all_prc: everything but the raw tables"""
        for n in list(self.run_.tables.frames):
            if not n.startswith("raw_df"):
                self.run_.tables.drop(n)

    def do_x_summary(self, arg):
        """x_summary TABLE [COLUMN...]"""
        name, *cols = shlex.split(arg)
        df = self.frame(name)
        self._print((df.select(*cols) if cols else df).summary())

    def do_x_tab(self, arg):
        """x_tab TABLE COLUMN..."""
        name, *cols = shlex.split(arg)
        self._print(reports.tabulate(self.frame(name), cols).orderBy(F.desc("n"), *cols), False)

    def do_x_persist(self, arg):
        """x_persist TABLE: write it to the warehouse"""
        self.run_.tables.put(arg.strip(), self.frame(arg.strip()), True)

    def do_x_union(self, arg):
        """x_union TABLE1 TABLE2 OUT MARK"""
        one, two, out, mark = shlex.split(arg)
        self.run_.tables.put(out, io.marked_union(self.frame(one), self.frame(two), mark))

    def do_x_sql(self, arg):
        """x_sql STATEMENT"""
        self._print(self.run_.spark.sql(arg).limit(100))

    def do_x_sqlf(self, arg):
        """x_sqlf STATEMENT: without cutting"""
        self._print(self.run_.spark.sql(arg).limit(100), False)

    def do_csv(self, arg):
        """csv TABLE PATH [PARTITIONS]"""
        name, path, *n = shlex.split(arg)
        io.write_csv(self.frame(name), path, int(n[0]) if n else 1)

    def do_x_load(self, arg):
        """x_load PATH TABLE"""
        path, name = shlex.split(arg)
        self.run_.tables.put(name, self.run_.spark.read.parquet(path))

    def do_x_parquet_from_csv(self, arg):
        """x_parquet_from_csv CSV PARQUET"""
        io.csv_to_parquet(self.run_.spark, *shlex.split(arg))

    def do_borrow_tables(self, arg):
        """borrow_tables FOLDER"""
        self.say(*self.run_.tables.borrow(arg.strip()))

    def do_x_crosswalk(self, arg):
        """x_crosswalk PATH fixed|csv VARIABLE...: variables of both sides"""
        path, kind, *names = shlex.split(arg)
        rounds = [self.frame(n) for n in ("predicted_matches", "predicted_hh_matches") if self.run_.tables.exists(n)]
        df = reports.crosswalk(rounds, self.frame("raw_df_a"), self.frame("raw_df_b"), self.run_.config["id_column"], names, names, True)
        if kind == "fixed":
            io.fixed_width(df).coalesce(1).write.mode("overwrite").text(path)
        else:
            io.write_csv(df, path)

    def _families(self, arg: str, table: str) -> None:
        id_a, id_b = shlex.split(arg)[:2]
        c = self.run_.config["id_column"]
        for side, value in (("a", id_a), ("b", id_b)):
            df = self.frame(f"{table}_{side}")
            ids = self.run_.spark.createDataFrame([(value,)], f"{c} string").select(F.col(c).cast(dict(df.dtypes)[c]).alias(c))
            self._print(households.families_of(df, ids, c))

    def do_x_tfam(self, arg):
        """x_tfam ID_A ID_B: both families, prepared"""
        self._families(arg, "prepped_df")

    def do_x_tfam_raw(self, arg):
        """x_tfam_raw ID_A ID_B: both families, raw"""
        self._families(arg, "raw_df")

    def _household_sample(self, table: str, where: str, n: str) -> None:
        c = self.run_.config["id_column"]
        for r in self.frame(table).where(where).limit(int(n or 1)).collect():
            self._families(f"{r[f'{c}_a']} {r[f'{c}_b']}", "prepped_df")

    def do_x_hh_tfam(self, arg):
        """x_hh_tfam [N]: families of pairs that the household model predicts"""
        self._household_sample("scored_hh_potential_matches", "prediction = 1", arg)

    def do_x_hh_tfam_2a(self, arg):
        """x_hh_tfam_2a [N]: families of predicted household matches"""
        self._household_sample("predicted_hh_matches", "true", arg)

    def do_x_hh_tfam_2b(self, arg):
        """x_hh_tfam_2b [N]: families of pairs that the household model rejects"""
        self._household_sample("scored_hh_potential_matches", "prediction = 0", arg)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kindred")
    p.add_argument("--conf", "--run", dest="conf", required=True)
    p.add_argument("--cores", type=int, default=4)
    p.add_argument("--executor_memory", default="10G")
    p.add_argument("--task", default="preprocessing")
    p.add_argument("--execute_tasks", nargs="*")
    p.add_argument("--execute_command", nargs="*")
    p.add_argument("--warehouse")
    p.add_argument("--clean", action="store_true", help="don't reuse tables")
    p.add_argument("--user", default="")
    args = p.parse_args(argv)
    spark = SparkFactory().set_num_cores(args.cores).set_executor_memory(args.executor_memory).create()
    run = LinkRun(spark, configs.load(args.conf), not args.clean, args.warehouse)
    c = run.config
    configs.validate(c, io.read_datasource(spark, c["datasource_a"]), io.read_datasource(spark, c["datasource_b"]))
    shell = Shell(run, args.task)
    if args.execute_tasks:
        for t in args.execute_tasks:
            run.task(t).run_all_steps()
    elif args.execute_command:
        shell.onecmd(shlex.join(args.execute_command))
    else:
        shell.cmdloop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
