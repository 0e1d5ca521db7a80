"""Runs a job document: checks it, makes its tables, validates them, writes all below one folder.

``<root>/<hash>/`` gets observations, the experiment's tables, metrics.json,
validation_report.json, run_metadata.json and, last, manifest.json.  A job whose
manifest is there is not run again.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import book, features, grid, labels, portfolio, validate
from quern.operators.events import select_events
from quern.plans.job import Condition, JobSpec, parse_span
from quern.shards import SHARD_ROWS, ShardPlan
from quern.sources.sinks import write_json, write_rows
from quern.workdir import exists

#: Features that read levels of the book.
OF_LEVELS = ("structural_imbalance", "liquidity_wall", "resistance", "liquidity_depletion", "replenishment_rate", "bids", "asks")
#: How a job's checks are taken.
MODES = ("off", "warn", "fail")


def _hypothesis(rows: DataFrame, job: JobSpec) -> dict[str, DataFrame]:
    c = job.experiment_config
    counts = [int(x) for x in c.get("horizons", "1,5,20").split(",")]
    return {"hypothesis": labels.hypothesis(rows, Condition.parse(c["condition"]).column(rows.columns), c.get("price", "mid_price"), counts, c.get("direction", "up"))}


def _labels(rows: DataFrame, job: JobSpec) -> dict[str, DataFrame]:
    price = job.experiment_config.get("price", "mid_price")
    return {f"labels_{h // 1_000_000}s": labels.label_after(rows, price, h) for h in job.horizons}


def _position(rows: DataFrame, job: JobSpec) -> dict[str, DataFrame]:
    return {"position": portfolio.position_experiment(rows, job.experiment_config, job.experiment_config.get("price", "mid_price"))}


#: Experiments by name: tables from feature rows; more may be added.
EXPERIMENTS: dict[str, Callable[[DataFrame, JobSpec], dict[str, DataFrame]]] = {"dry-run": lambda rows, job: {}, "hypothesis": _hypothesis, "labels": _labels, "position": _position}


def preflight(job: JobSpec) -> list[str]:
    """What keeps a job from running, before anything is read."""
    out = job.problems(list(features.REGISTRY), list(features.RAW))
    columns = {*job.features, *job.raw_fields, "symbol", "bucket", "data_quality", "data_age_ms"}
    near = lambda n, known: f"; did you mean {m[0]!r}?" if (m := difflib.get_close_matches(n, sorted(known), 1)) else ""
    if job.experiment not in EXPERIMENTS:
        out.append(f"unknown experiment {job.experiment!r}" + near(job.experiment, EXPERIMENTS))
    for key in ("condition", "entry", "exit"):
        if text := job.experiment_config.get(key):
            try:
                name = Condition.parse(text).name
            except ValueError as e:
                out.append(str(e))
                continue
            if name not in {c.lower() for c in columns}:
                out.append(f"{key} names {name!r}, which is no column of the job" + near(name, columns))
    if job.experiment == "hypothesis" and "condition" not in job.experiment_config:
        out.append("a hypothesis has a condition")
    if job.experiment == "labels" and not job.horizons:
        out.append("labels have horizons")
    if (price := job.experiment_config.get("price", "mid_price")) not in columns and job.experiment != "dry-run":
        out.append(f"the experiment's price {price!r} is no column of the job" + near(price, columns))
    for n, most in (("max_observations", job.max_observations), ("max_events", job.max_events)):
        if most is not None and most <= 0:
            out.append(f"{n} must be above 0")
    for f, given in job.features.items():
        for p in given:
            if f in features.REGISTRY and p not in dict(features.REGISTRY[f].defaults):
                out.append(f"feature {f!r} has no parameter {p!r}" + near(p, dict(features.REGISTRY[f].defaults)))
    if job.event_types and any(f in OF_LEVELS for f in job.features) and not {"book", "quote"} & set(job.event_types):
        out.append("features of the book's levels need events of the kind book or quote")
    if "validation" in job.experiment_config and job.experiment_config["validation"] not in MODES:
        out.append(f"validation is one of {', '.join(MODES)}")
    if any(parse_span(f"{h // 1_000_000}s") != h for h in job.horizons):
        out.append("horizons are whole seconds")
    return out


def run_job(spark: SparkSession, job: JobSpec | str, events: DataFrame, root: str, form: str = "parquet", shard_rows: int = SHARD_ROWS) -> dict:
    """path, created (False: it was there), tables; raises ValueError with all that is wrong with the job.

    ``events``: unified events.  The observations are written first and read back for all
    that follows, so events are replayed once.
    """
    job = JobSpec.from_json(job) if isinstance(job, str) else job
    wrong = preflight(job)
    if wrong:
        raise ValueError("the job can't run: " + "; ".join(wrong))
    at = f"{root}/{job.hash()[:16]}"
    if exists(spark, f"{at}/manifest.json"):
        return {"path": at, "created": False, "tables": []}
    chosen = select_events(events, job)
    seen = grid.observations(chosen, job, shard_rows=shard_rows)
    if job.step and any(f in OF_LEVELS for f in features.resolve(job.features)):
        seen = book.with_book(seen, chosen.where(F.col("kind").isin("book", "quote")), job.step, job.origin, shard_rows=shard_rows)
    points = ((job.end - job.origin) // job.step + 1) if job.step else 0
    plan = ShardPlan(job.step * shard_rows, max(1, -(-points // shard_rows))) if job.step else None
    rows = features.feature_rows(seen, job.features, job.raw_fields, keep=("last_us",), plan=plan)
    write_rows(rows.repartition("symbol", F.floor(F.col("bucket") / (job.step or 1_000_000) / shard_rows)), f"{at}/observations", form)
    rows = spark.read.schema(", ".join(f"`{n}` {'double' if t.startswith('decimal') else t}" for n, t in rows.dtypes)).format(form).options(**({"header": "true"} if form == "csv" else {})).load(f"{at}/observations")
    tables = EXPERIMENTS[job.experiment](rows, job)
    for name, df in tables.items():
        write_rows(df, f"{at}/{name}", form)
    found = validate.check_numeric(rows, [c for c, t in rows.dtypes if t == "double" and c != "data_age_ms"])
    if job.step:
        found = found.unionByName(validate.check_grid(rows, job.step))
    report = [r.asDict() for r in validate.enforce(found, job.experiment_config.get("validation", "warn")).collect()]
    count = lambda q: F.count_if(F.col("data_quality") == q)
    per = rows.groupBy("symbol").agg(F.count("*").alias("observations"), count(2).alias("fresh"), count(1).alias("filled"), count(0).alias("missing"))
    total = per.agg(F.count("*").alias("symbols"), *[F.sum(c).alias(c) for c in ("observations", "fresh", "filled", "missing")]).first().asDict()
    write_json(spark, f"{at}/metrics.json", total)
    write_json(spark, f"{at}/validation_report.json", {"findings": report})
    write_json(spark, f"{at}/run_metadata.json", {"job_id": job.job_id, "hash": job.hash(), "experiment": job.experiment, "features": job.features, "raw_fields": job.raw_fields, "start": job.start, "end": job.end, "step": job.step, "spark": pyspark.__version__})
    write_json(spark, f"{at}/manifest.json", {"job_id": job.job_id, "hash": job.hash(), "tables": ["observations", *sorted(tables)], "format": form})
    return {"path": at, "created": True, "tables": ["observations", *sorted(tables)]}
