"""Run configuration: defaults, a file, overrides; and lazily loaded model checkpoints."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

# The defaults of a training run.
DEFAULTS = {
    "model": {"embed_dim": 512, "image_resolution": 224, "vision_layers": [3, 4, 6, 3], "vision_width": 64, "vision_patch_size": 32, "context_length": 256, "transformer_width": 512, "transformer_heads": 8, "transformer_layers": 12, "learning_rate": 5e-4, "weight_decay": 0.1, "warmup_steps": 2000},
    "data": {"parquet_path": None, "batch_size": 64, "num_workers": 4, "image_resolution": 224, "val_fraction": 0.1},
    "trainer": {"max_epochs": 32, "accumulate_grad_batches": 16, "log_every_n_steps": 10},
    "seed_everything": 0,
}

# Names that YAML would read as something else.
YAML_WORDS = ("y", "n", "yes", "no", "on", "off", "true", "false", "null")


def merge(base: dict, over: dict) -> dict:
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load_config(path: str | None = None, overrides: dict[str, object] | None = None) -> dict:
    """Defaults, then a JSON or YAML file, then overrides by dotted name."""
    config = DEFAULTS
    if path:
        text = Path(path).read_text()
        if path.endswith(".json"):
            config = merge(config, json.loads(text))
        else:
            try:
                import yaml
            except ImportError as e:
                raise ImportError("YAML files need the yaml package; JSON files don't") from e
            config = merge(config, yaml.safe_load(text) or {})
    for name, value in (overrides or {}).items():
        *parents, last = name.split(".")
        nested: dict = {last: value}
        for p in reversed(parents):
            nested = {p: nested}
        config = merge(config, nested)
    return config


def yaml_text(config: dict, indent: str = "") -> str:
    """Nested settings as YAML: a line for each, names and scalars as in JSON, which YAML reads."""
    lines = []
    for name, value in config.items():
        key = name if re.fullmatch(r"[A-Za-z_]\w*", name) and name.lower() not in YAML_WORDS else json.dumps(name)
        lines.append(f"{indent}{key}:\n{yaml_text(value, indent + '  ')}" if isinstance(value, dict) and value else f"{indent}{key}: {json.dumps(value)}\n")
    return "".join(lines)


def save_latest(config: dict, path: str) -> str:
    """Write the effective configuration beside ``path`` as <stem>-latest, replacing an earlier one: as JSON beside a JSON
    file, else as YAML."""
    p = Path(path)
    kind = ".json" if p.suffix == ".json" else ".yaml"
    out = p.with_name(f"{p.stem.removesuffix('-latest')}-latest{kind}")
    out.write_text(json.dumps(config, indent=2) if kind == ".json" else yaml_text(config))
    return str(out)


class LazyModel:
    """A model built from checkpoint bytes at first use in each Python process: with its hyper-parameters where the
    checkpoint has them, else from its weights alone. ``strict`` says whether unknown weights are an error."""

    _built: dict = {}

    def __init__(self, path: str, read: Callable[[str], dict], build: Callable[[dict | None, dict, bool], object], strict: bool = True):
        self.path, self.read, self.build, self.strict = path, read, build, strict

    def __call__(self):
        if self.path not in LazyModel._built:
            found = self.read(self.path)
            LazyModel._built[self.path] = self.build(found.get("hyper_parameters"), found["state_dict"], self.strict)
        return LazyModel._built[self.path]
