"""Staged runs: enabled stages in order, each with the output of an earlier one as its input."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping

from tessitura.sources.writers import publish_json


def resolve(stages: list[Mapping], output_dir: str, initial: str) -> list[dict]:
    """Inputs and outputs of the enabled stages. ``input_from``: absent for the stage before,
    ``initial``, or the name of an earlier stage."""
    done: dict[str, str] = {}
    out, last = [], initial
    for stage in stages:
        if not stage.get("enabled", True):
            continue
        name = str(stage.get("name") or stage.get("method") or "")
        if not re.fullmatch(r"[A-Za-z0-9][\w.-]*", name) or name in done or name == "initial":
            raise ValueError(f"bad or repeated stage name {name!r}")
        source = stage.get("input_from")
        if source is not None and source != "initial" and source not in done:
            raise ValueError(f"stage {name!r} takes its input from {source!r}, which is no earlier stage")
        given = last if source is None else initial if source == "initial" else done[source]
        done[name] = last = os.path.join(output_dir, name)
        out.append({"name": name, "input": given, "output": last, "config": dict(stage.get("config") or {})})
    return out


def run(stages: list[Mapping], output_dir: str, initial: str, runner: Callable[[dict], None] | None, dry_run: bool = False) -> dict[str, str]:
    """Runs the stages and keeps ``pipeline_state.json`` up to date; returns the outputs by name.
    What a stage was given, its input and output resolved, stands in its folder as ``resolved.json``."""
    plan = resolve(stages, output_dir, initial)
    finished: dict[str, str] = {}
    for stage in plan:
        publish_json(stage, os.path.join(stage["output"], "resolved.json"))
        if not dry_run:
            runner(stage)
            finished[stage["name"]] = stage["output"]
            publish_json({"completed": finished}, os.path.join(output_dir, "pipeline_state.json"))
    return {s["name"]: s["output"] for s in plan}
