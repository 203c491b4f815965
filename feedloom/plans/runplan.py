"""Configuration and the frozen plan of a run; checked on the driver."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import uuid
from dataclasses import dataclass, field
from pathlib import Path
from zoneinfo import ZoneInfo


class PlanError(ValueError):
    """A configuration or plan that cannot run."""


@dataclass(frozen=True)
class Product:
    slug: str
    display_name: str = ""
    app_store_id: str | None = None
    play_store_id: str | None = None
    pulse_doc_id: str = ""
    email_recipients: tuple[str, ...] = ()

    @property
    def sources(self) -> list[str]:
        return [s for s, i in (("app_store", self.app_store_id), ("play_store", self.play_store_id)) if i]


@dataclass(frozen=True)
class Config:
    window_weeks: int = 8
    n_min_reviews: int = 20
    total_token_cap: int = 200_000
    max_reviews_per_source: int = 500
    env: str = "dev"
    products: dict[str, Product] = field(default_factory=dict)

    def __post_init__(self):
        if not 1 <= self.window_weeks <= 52 or self.n_min_reviews < 1 or self.total_token_cap < 1000 or self.max_reviews_per_source < 1 or self.env not in ("dev", "staging", "prod"):
            raise PlanError("a setting is out of range")


def load_config(path: str) -> Config:
    """Configuration from JSON, or YAML where a parser is installed; ``${VAR}`` is replaced in document ids only."""
    text = Path(path).read_text()
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    unknown = set(data) - {"window_weeks", "n_min_reviews", "total_token_cap", "max_reviews_per_source", "env", "products"}
    if unknown:
        raise PlanError(f"unknown settings: {sorted(unknown)}")

    def expand(value: str) -> str:
        def one(m: re.Match) -> str:
            if m[1] not in os.environ:
                raise PlanError(f"{m[1]} is not set")
            return os.environ[m[1]]

        return re.sub(r"\$\{(\w+)\}", one, value)

    products = {p["slug"]: Product(**{**p, "pulse_doc_id": expand(p.get("pulse_doc_id", "")), "email_recipients": tuple(p.get("email_recipients", ()))}) for p in data.get("products", [])}
    return Config(**{**{k: v for k, v in data.items() if k != "products"}, "products": products, "env": os.environ.get("FEEDLOOM_ENV", data.get("env", "dev"))})


def parse_week(week: str) -> tuple[int, int]:
    m = re.fullmatch(r"(\d{4})-W(\d{2})", week)
    if not m:
        raise PlanError(f"{week!r} is no ISO week")
    try:
        dt.date.fromisocalendar(int(m[1]), int(m[2]), 1)
    except ValueError as e:
        raise PlanError(f"{week} does not exist") from e
    return int(m[1]), int(m[2])


def window(week: str, weeks: int) -> tuple[dt.datetime, dt.datetime]:
    year, number = parse_week(week)
    end = dt.datetime.combine(dt.date.fromisocalendar(year, number, 7), dt.time.max, dt.UTC)
    start = (end - dt.timedelta(weeks=weeks)).replace(hour=0, minute=0, second=0, microsecond=0)
    return start, end


def last_completed(now: dt.datetime | None = None) -> tuple[int, int]:
    day = (now or dt.datetime.now(dt.UTC)).astimezone(ZoneInfo("Asia/Kolkata")) - dt.timedelta(days=7)
    return day.isocalendar()[:2]


def week_range(first: str, last: str) -> list[str]:
    a, b = parse_week(first), parse_week(last)
    if a > b:
        raise PlanError("the weeks descend")
    day, out = dt.date.fromisocalendar(*a, 1), []
    while day.isocalendar()[:2] <= b:
        out.append("{}-W{:02d}".format(*day.isocalendar()[:2]))
        day += dt.timedelta(days=7)
    return out


@dataclass(frozen=True)
class RunPlan:
    run_id: str
    product: Product
    iso_week: str
    window_start: dt.datetime
    window_end: dt.datetime
    sources: tuple[str, ...]
    dry_run: bool
    draft_only: bool
    force_resend: bool
    llm_model: str = "extractive"


def build_plan(config: Config, slug: str, week: str | None = None, dry_run: bool = False, draft_only: bool | None = None, force_resend: bool = False, now: dt.datetime | None = None) -> RunPlan:
    if slug not in config.products:
        raise PlanError(f"unknown product {slug}")
    if force_resend and not week:
        raise PlanError("a forced run needs a week")
    done = last_completed(now)
    chosen = parse_week(week) if week else done
    if chosen > done:
        raise PlanError("the week is not complete")
    product = config.products[slug]
    if not product.sources:
        raise PlanError("the product has no source")
    name = "{}-W{:02d}".format(*chosen)
    start, end = window(name, config.window_weeks)
    return RunPlan(str(uuid.uuid4()), product, name, start, end, tuple(product.sources), dry_run, config.env != "prod" if draft_only is None else draft_only, force_resend)
