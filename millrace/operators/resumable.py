"""Evaluation runs that can be stopped at any point and taken up again, by any number of workers.

Tasks are planned as a table in chunks. A worker takes a chunk by a lease, which only one worker can create and which
runs out, answers the chunk's open tasks in one Spark job and enters the answers in the chunk's log. An entry can be
created only once, so when two workers have done the same chunk (one was given up too early), the first one counts
and no task is counted twice. Rows of a provider that refuses calls have the status ``provider_error``: they are part
of no score, the provider is left alone for the rest of the session, and the next session asks for exactly
these tasks again. Driver and workers exchange a few facts for each chunk, never rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.versions import Files

REFUSED = "provider_error"
CHUNK = "_chunk"


def plan_tasks(questions: DataFrame, generators: list[tuple[str, str]], reps: int, again: str = "true") -> DataFrame:
    """Every question for every (generator, provider), once, and up to ``reps`` times where the condition ``again``
    holds (a null condition does not). Adds generator, provider and rep, from 1."""
    gens = F.array(*(F.struct(F.lit(g).alias("generator"), F.lit(p).alias("provider")) for g, p in generators))
    times = F.when(F.coalesce(F.expr(again), F.lit(False)), F.lit(reps)).otherwise(F.lit(1))
    return questions.withColumn("rep", F.explode(F.sequence(F.lit(1), times))).withColumn("_g", F.explode(gens)).select("*", "_g.*").drop("_g")


@dataclass(frozen=True)
class Done:
    """What a chunk's log says of one pass over its open tasks; ``left`` are those that have no answer yet."""

    data: str
    rows: int
    refused: int
    left: int
    cost: float
    worker: str


@dataclass
class Session:
    """What one worker did: chunks it entered, tasks it wrote, providers that refused, and why it stopped."""

    chunks: int = 0
    rows: int = 0
    late: int = 0
    held: int = 0
    down: tuple[str, ...] = ()
    stopped: str = "done"


class Run:
    """A run below ``root``, in a folder that all workers share. ``key`` names the columns that tell tasks apart.

    ``ask`` takes a chunk's tasks and returns its rows: the key columns, ``provider``, ``status`` and ``cost``,
    and whatever else the answer has. Tasks whose key holds a null are tasks like others; tasks with an equal
    key are one task. Rows of a chunk for which ``ask`` returns nothing stay open.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], lease: float = 900.0, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.key, self.lease, self.clock = spark, root.rstrip("/"), key, lease, clock
        self.files, self.worker = Files(spark, root), uuid.uuid4().hex

    # -- the plan

    def _numbers(self, folder: str) -> list[str]:
        return [n for n in self.files.list(folder) if n.endswith(".json")]

    def _facts(self, name: str) -> dict:
        try:
            return json.loads(self.files.get(name) or "")
        except ValueError:  # its writer died; what it stood for never happened
            return {}

    def _plans(self) -> list[dict]:
        return [p for n in self._numbers("plan") if (p := self._facts(f"plan/{n}"))]

    def tasks(self) -> DataFrame | None:
        """All planned tasks, or None before the first plan."""
        paths = [f"{self.root}/tasks/{p['data']}" for p in self._plans()]
        return self.spark.read.option("basePath", f"{self.root}/tasks").parquet(*paths).drop("_plan") if paths else None

    def extend(self, tasks: DataFrame, parts: int, first: str | None = None, tries: int = 20) -> int:
        """Plan the tasks that are not planned yet, in ``parts`` chunks for each value of ``first`` (a column of
        few values: chunks of the smallest one come first). Returns the number of new chunks."""
        stage = F.coalesce(F.format_string("%09d", F.col(first).cast("long")), F.lit("")) if first else F.lit("")
        part = F.pmod(F.xxhash64(*self.key), F.lit(parts))
        for _ in range(tries):
            names = self._numbers("plan")
            number = int(names[-1][:-5]) + 1 if names else 1
            held = self.tasks()
            new = tasks.dropDuplicates(self.key)
            if held is not None:
                same = [F.col(f"n.{k}").eqNullSafe(F.col(f"h.{k}")) for k in self.key]
                new = new.alias("n").join(held.select(*self.key).alias("h"), same, "left_anti")
            data = f"_plan=p{uuid.uuid4().hex}"
            new = new.withColumn(CHUNK, F.concat(F.lit(f"p{number:04d}s"), stage, F.format_string("c%05d", part)))
            new.write.partitionBy(CHUNK).parquet(f"{self.root}/tasks/{data}")
            chunks = [n.split("=", 1)[1] for n in self.files.list(f"tasks/{data}") if n.startswith(f"{CHUNK}=")]
            if not chunks:
                return 0
            if self.files.put(f"plan/{number:06d}.json", json.dumps({"data": data, "chunks": chunks}), overwrite=False):
                return len(chunks)
            self.files.delete(f"tasks/{data}")  # somebody else planned; look at the tasks that came with it
        raise RuntimeError(f"other planners came first {tries} times")

    # -- leases and logs

    def _log(self, chunk: str) -> list[Done]:
        return [Done(**facts) for n in self._numbers(f"log/{chunk}") if (facts := self._facts(f"log/{chunk}/{n}"))]

    def _take(self, chunk: str) -> int | None:
        """The number of the pass that this worker may do now, or None while another one holds the chunk. An
        entry that cannot be read is still being written, for as long as the lease of its pass lasts."""
        done, names = len(self._numbers(f"log/{chunk}")), self._numbers(f"lease/{chunk}")
        if names:
            last = self._facts(f"lease/{chunk}/{names[-1]}")
            open_pass = last.get("pass", 0) > done or len(self._log(chunk)) < done
            if open_pass and last.get("until", 0) > self.clock():
                return None
        number = int(names[-1][:-5]) + 1 if names else 1
        facts = {"worker": self.worker, "until": self.clock() + self.lease, "pass": done + 1}
        return done + 1 if self.files.put(f"lease/{chunk}/{number:06d}.json", json.dumps(facts), overwrite=False) else None

    def _chunks(self) -> Iterator[tuple[str, str]]:
        for plan in self._plans():
            for chunk in sorted(plan["chunks"]):
                yield chunk, f"tasks/{plan['data']}/{CHUNK}={chunk}"

    def _answers(self, data: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/answers/{d}" for d in data))

    def spent(self) -> float:
        """Cost of everything that is in the logs."""
        return sum(d.cost for chunk, _ in self._chunks() for d in self._log(chunk))

    # -- work

    def work(self, ask: Callable[[DataFrame], DataFrame], budget: float = float("inf"), most: int | None = None) -> Session:
        """Do every chunk with open tasks that nobody holds, each at most once in this session, until the cost of
        the run reaches ``budget`` or ``most`` chunks are done."""
        told, down, spent = Session(), set(), self.spent()
        for chunk, path in self._chunks():
            log = self._log(chunk)
            if log and not log[-1].left:
                continue
            if spent >= budget or (most is not None and told.chunks >= most):
                told.stopped = "budget" if spent >= budget else "most"
                break
            number = self._take(chunk)
            if number is None:
                told.held += 1
                continue
            log = self._log(chunk)
            data = self._pass(path, log, ask, down)
            facts, refusing = self._told(data, path, log)
            down |= refusing  # a provider is down from its first refusal on
            entered = self._log(chunk) == log and self.files.put(f"log/{chunk}/{number:06d}.json", json.dumps(asdict(facts)), overwrite=False)
            if entered:
                told.chunks, told.rows, spent = told.chunks + 1, told.rows + facts.rows, spent + facts.cost
            else:  # the lease had run out and another worker was faster
                self.files.delete(f"answers/{data}")
                told.late += 1
        told.down = tuple(sorted(down))
        return told

    def _pass(self, path: str, log: list[Done], ask: Callable[[DataFrame], DataFrame], down: set[str]) -> str:
        """Ask for the open tasks of a chunk, but not providers that are down; the name of what was written."""
        tasks = self.spark.read.parquet(f"{self.root}/{path}")
        if log:
            same = [F.col(f"t.{k}").eqNullSafe(F.col(f"a.{k}")) for k in self.key]
            answered = self._answers([d.data for d in log]).filter(F.col("status") != REFUSED)
            tasks = tasks.alias("t").join(answered.select(*self.key).alias("a"), same, "left_anti")
        shut = F.coalesce(F.col("provider").isin(sorted(down)), F.lit(False)) if down else F.lit(False)
        rows = ask(tasks.filter(~shut))
        if down:
            refused = tasks.filter(shut).withColumns({"status": F.lit(REFUSED), "cost": F.lit(0.0)})
            rows = rows.unionByName(refused.select(*(c for c in rows.columns if c in refused.columns)), allowMissingColumns=True)
        data = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/answers/{data}")
        return data

    def _told(self, data: str, path: str, log: list[Done]) -> tuple[Done, set[str]]:
        """The facts of a pass, and the providers that refused in it."""
        bad = F.col("status") == REFUSED
        n = self._answers([data]).agg(F.count("*").alias("rows"), F.count_if(bad).alias("refused"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.collect_set(F.when(bad, F.col("provider"))).alias("down")).first()
        tasks = self.spark.read.parquet(f"{self.root}/{path}").count()
        left = tasks - sum(d.rows - d.refused for d in log) - (n["rows"] - n["refused"])
        return Done(data, n["rows"], n["refused"], left, float(n["cost"]), self.worker), set(n["down"])

    # -- results

    def results(self, refused: bool = False) -> DataFrame | None:
        """A row for each answered task; with ``refused`` also the tasks that wait for their provider. None before
        the first entry. A refused task is asked again in its chunk's next pass, so its last pass tells."""
        logs = [log for chunk, _ in self._chunks() if (log := self._log(chunk))]
        if not logs:
            return None
        answered = self._answers([d.data for log in logs for d in log]).filter(F.col("status") != REFUSED)
        if not refused:
            return answered
        return answered.unionByName(self._answers([log[-1].data for log in logs]).filter(F.col("status") == REFUSED))

    def progress(self) -> tuple[int, int, int]:
        """(tasks, answered, waiting for a provider) by the logs and the plan."""
        tasks, logs = self.tasks(), [self._log(chunk) for chunk, _ in self._chunks()]
        answered = sum(d.rows - d.refused for log in logs for d in log)
        return tasks.count() if tasks is not None else 0, answered, sum(log[-1].refused for log in logs if log)


def judge_tasks(answers: DataFrame, judges: list[tuple[str, str]], status: tuple[str, ...] = ("ok", "not_covered")) -> DataFrame:
    """Every answer with one of these states for every (judge, provider): errors are not judged."""
    all_ = F.array(*(F.struct(F.lit(j).alias("judge"), F.lit(p).alias("provider")) for j, p in judges))
    rows = answers.filter(F.col("status").isin(*status)).withColumnRenamed("status", "answered").drop("provider", "cost", "judge")
    return rows.withColumn("_j", F.explode(all_)).select("*", "_j.*").drop("_j")


def evaluate(answers: Run, verdicts: Run, ask: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame], judges: list[tuple[str, str]], parts: int, budget: float = float("inf")) -> tuple[Session, Session | None]:
    """One session of both steps: ask for the planned answers, plan the judgements of those that are new, judge. The
    budget is that of both runs together; a judge whose provider refuses leaves only its own judgements open."""
    first = answers.work(ask, budget - verdicts.spent())
    if (rows := answers.results()) is None:
        return first, None
    verdicts.extend(judge_tasks(rows, judges), parts)
    return first, verdicts.work(judge, budget - answers.spent())
