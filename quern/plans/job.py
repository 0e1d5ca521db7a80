"""The declarative job: what to read, the grid, the features, the experiment."""

from __future__ import annotations

import difflib
import hashlib
import json
import re
from dataclasses import dataclass, field, fields
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the units that horizons and intervals may end with.  Fixed values.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def parse_span(text: str) -> int:
    """Microseconds of ``60s``, ``5m``, ``0.5h``, ``2d``, ``300`` (seconds) or ``00:05:00``."""
    s = str(text).strip().lower()
    clock = re.fullmatch(r"(?:(\d+)\.)?(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,6}))?", s)
    if clock:
        d, h, m, sec, frac = clock.groups()
        us = (((int(d or 0) * 24 + int(h)) * 60 + int(m)) * 60 + int(sec)) * 1_000_000 + int((frac or "0").ljust(6, "0"))
    else:
        m = re.fullmatch(r"(\d+(?:\.\d+)?)([smhd]?)", s)
        if not m:
            raise ValueError(f"not a span of time: {text!r}")
        us = round(float(m[1]) * UNIT_SECONDS[m[2] or "s"] * 1_000_000)
    if us <= 0:
        raise ValueError(f"a span of time must be above 0: {text!r}")
    return us


@dataclass(frozen=True)
class Condition:
    """``name op number``; false where the column is missing or null."""

    name: str
    op: str
    value: float

    @classmethod
    def parse(cls, text: str) -> Condition:
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*(<=|>=|==|!=|<|>)\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*", text)
        if not m:
            raise ValueError(f"not a condition: {text!r}")
        return cls(m[1].lower(), m[2], float(m[3]))

    def column(self, columns: list[str]) -> Column:
        known = {c.lower(): c for c in columns}
        if self.name not in known:
            return F.lit(False)
        x = F.col(known[self.name]).cast("double")
        test = {"<": x < self.value, "<=": x <= self.value, ">": x > self.value, ">=": x >= self.value, "==": x == self.value, "!=": x != self.value}[self.op]
        return F.coalesce(test, F.lit(False))


def micros(t: datetime | str) -> int:
    """Epoch microseconds; a time without a zone is UTC."""
    if isinstance(t, str):
        t = datetime.fromisoformat(t.replace("Z", "+00:00"))
    if t.tzinfo is None:
        t = t.replace(tzinfo=timezone.utc)
    d = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


@dataclass(frozen=True)
class JobSpec:
    """A job, as read from its JSON document.  Spans and times are epoch microseconds.

    ``step`` None: one observation for each event.  ``features`` maps a feature's name
    to its parameters.
    """

    job_id: str = "job"
    symbols: tuple[str, ...] = ()
    venues: tuple[str, ...] = ()
    start: int = 0
    end: int = 0
    event_types: tuple[str, ...] = ()
    step: int | None = None
    anchor: int | None = None
    fill_forward: bool = True
    max_observations: int | None = None
    max_events: int | None = None
    features: dict[str, dict[str, str]] = field(default_factory=dict)
    raw_fields: tuple[str, ...] = ()
    experiment: str = "dry-run"
    experiment_config: dict[str, str] = field(default_factory=dict)
    horizons: tuple[int, ...] = ()

    @classmethod
    def from_json(cls, text: str) -> JobSpec:
        raw = {re.sub(r"[_-]", "", k).lower(): v for k, v in json.loads(text).items()}
        config = {str(k): str(v) for k, v in (raw.get("experimentconfig") or {}).items()}
        features: dict[str, dict[str, str]] = {str(f).lower(): {} for f in raw.get("features") or []}
        for k, v in config.items():
            parts = k.split(".")
            if len(parts) == 3 and parts[0] == "feature" and parts[1].lower() in features:
                features[parts[1].lower()][parts[2].lower()] = v
        get = raw.get
        return cls(
            job_id=get("jobid") or "job",
            symbols=tuple(get("symbols") or ()),
            venues=tuple([get("venue")] if isinstance(get("venue"), str) else get("venue") or ()),
            start=micros(get("starttime")),
            end=micros(get("endtime")),
            event_types=tuple(str(x).lower() for x in get("eventtypes") or ()),
            step=parse_span(get("observationinterval")) if get("observationinterval") else None,
            anchor=micros(get("gridanchor")) if get("gridanchor") else None,
            fill_forward=get("fillforward", True) is not False,
            max_observations=get("maxobservations"),
            max_events=get("maxevents"),
            features=features,
            raw_fields=tuple(str(x).lower() for x in get("rawfields") or ()),
            experiment=get("experimentname") or "dry-run",
            experiment_config=config,
            horizons=tuple(parse_span(h) for h in get("horizons") or ()),
        )

    @property
    def origin(self) -> int:
        return self.start if self.anchor is None else self.anchor

    def hash(self) -> str:
        """Identifies the result: equal jobs have equal hashes, whatever they are called."""
        own = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "job_id"}
        return hashlib.sha256(json.dumps(own, sort_keys=True, default=str).encode()).hexdigest()

    def problems(self, known_features: list[str], known_fields: list[str]) -> list[str]:
        """What keeps the job from running, with suggestions for names that don't exist."""
        out = []
        if not self.symbols:
            out.append("no symbols")
        if self.end <= self.start:
            out.append("the window ends before it begins")
        for what, names, known in (("feature", self.features, known_features), ("raw field", self.raw_fields, known_fields)):
            for n in names:
                if n not in known:
                    near = difflib.get_close_matches(n, known, 1)
                    out.append(f"unknown {what} {n!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        if self.step and (self.end - self.start) // self.step > 10_000_000:
            out.append("the grid has more than 10 million rows a symbol")
        if len(set(self.horizons)) < len(self.horizons):
            out.append("a horizon is named twice")
        return out
