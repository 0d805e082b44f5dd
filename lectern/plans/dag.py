"""Stage plans: an ordered list of stages with ranked tools, compiled to a chain of DataFrame steps.

A stage reads what its builder makes of the results so far, else the stage it names, else the one before it. Tools are callables
DataFrame -> DataFrame from a registry; the first enabled one by rank whose gate is open runs. Nothing runs until the last DataFrame is
used: the plan is wiring, and Catalyst sees one query. A stage without a tool is an error as data, in `Run.errors`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

Tool = Callable[[DataFrame], DataFrame]

_TOOLS: dict[str, Tool] = {}


def register(name: str) -> Callable[[Tool], Tool]:
    """Puts a tool under a name; the last of equal names wins."""

    def put(tool: Tool) -> Tool:
        _TOOLS[name] = tool
        return tool

    return put


def find_tool(name: str, stage: str = "", pipeline: str = "") -> Tool | None:
    """By pipeline.stage.name, else stage.name, else name."""
    return next((_TOOLS[n] for n in (f"{pipeline}.{stage}.{name}", f"{stage}.{name}", name) if n in _TOOLS), None)


def tool_names() -> list[str]:
    return sorted(_TOOLS)


@dataclass(frozen=True)
class Choice:
    name: str
    rank: int = 999
    enabled: bool = True


@dataclass(frozen=True)
class Stage:
    name: str
    tools: tuple[Choice, ...]
    input_from: str | None = None
    input_builder: str | None = None
    parallel: bool = False


@dataclass
class Run:
    results: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    used: dict[str, str] = field(default_factory=dict)
    last: DataFrame | None = None


_SKILLS: dict[str, tuple[str, Callable[..., DataFrame]]] = {}


def register_skill(name: str, description: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Puts a composed workflow under a name; the last of equal names wins."""

    def put(workflow: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _SKILLS[name] = (description, workflow)
        return workflow

    return put


def find_skill(name: str) -> Callable[..., DataFrame] | None:
    return _SKILLS[name][1] if name in _SKILLS else None


def skills() -> dict[str, str]:
    """Names and descriptions."""
    return {name: said for name, (said, _) in sorted(_SKILLS.items())}


def usable(stage: Stage, pipeline: str = "", gates: dict[str, bool] | None = None) -> list[Choice]:
    """Enabled tools that are registered and whose gate is not closed, by rank, then as listed."""
    open_ = [c for c in stage.tools if c.enabled and (gates or {}).get(c.name, True) and find_tool(c.name, stage.name, pipeline)]
    return sorted(open_, key=lambda c: c.rank)


def groups(stages: list[Stage]) -> list[list[Stage]]:
    """Consecutive parallel stages together, every other one alone."""
    out: list[list[Stage]] = []
    for s in stages:
        if s.parallel and out and out[-1][0].parallel:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def compile_plan(stages: list[Stage], start: DataFrame, builders: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None, gates: dict[str, bool] | None = None, pipeline: str = "") -> Run:
    """A failed sequential stage ends the plan; a failed parallel one is left out, and the stages after it see none of it."""
    run = Run(last=start)
    for group in groups(stages):
        chain = run.last
        for stage in group:
            source: Any = chain
            if stage.input_builder:
                make = (builders or {}).get(stage.input_builder)
                source = make(run.results) if make else None
                problem = f"no builder {stage.input_builder}"
            elif stage.input_from:
                source = run.results.get(stage.input_from)
                problem = f"no result of {stage.input_from}"
            chosen = usable(stage, pipeline, gates)
            if source is None or not chosen:
                run.errors[stage.name] = problem if source is None else "no usable tool"
                if not stage.parallel:
                    run.last = None
                    return run
                continue
            tool = find_tool(chosen[0].name, stage.name, pipeline)
            run.results[stage.name] = tool(source)
            run.used[stage.name] = chosen[0].name
            run.last = run.results[stage.name]
    return run


def flatten_config(config: dict, prefix: str = "", opaque: tuple[str, ...] = ("pipeline",)) -> dict:
    """Nested keys joined by underscores; a key that is given flat wins; opaque ones stay nested."""
    out: dict = {}
    for k, v in config.items():
        name = f"{prefix}_{k}" if prefix else k
        if isinstance(v, dict) and name not in opaque:
            out = flatten_config(v, name, opaque) | out
        else:
            out[name] = v
    return out | {k: v for k, v in config.items() if not prefix and not isinstance(v, dict)}


def deep_merge(base: dict, override: dict) -> dict:
    """override over base, by key; lists are replaced, None changes nothing."""
    out = dict(base)
    for k, v in override.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = deep_merge(out[k], v)
        elif v is not None:
            out[k] = v
    return out
