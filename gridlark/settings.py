"""Configuration files with exactly the keys that are expected."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path

from gridlark.operators.quality import ConstraintError


@dataclass(frozen=True)
class Number:
    """A range; ``above`` leaves its lower end out."""

    low: float
    high: float = math.inf
    whole: bool = False
    above: bool = False

    def check(self, name: str, value: object) -> None:
        kinds = (int,) if self.whole else (int, float)
        if isinstance(value, bool) or not isinstance(value, kinds):
            raise ConstraintError(f"{name} is not {'an integer' if self.whole else 'a number'}: {value!r}")
        if not self.low <= value <= self.high or not math.isfinite(value) or (self.above and value == self.low):
            raise ConstraintError(f"{name} is out of its range: {value!r}")


def load(path: str) -> dict:
    """A JSON file, or a YAML one where a YAML parser is installed."""
    text = Path(path).read_text(encoding="utf-8-sig")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            raise ConstraintError("No YAML parser is installed; give the configuration as JSON") from None
        value = yaml.safe_load(text)
    else:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ConstraintError(f"{path} holds no mapping")
    return value


def exactly(config: Mapping, keys: Iterable[str], what: str = "configuration") -> None:
    """Refuse a mapping that lacks a key or has another one."""
    wanted = set(keys)
    lacking, unknown = sorted(wanted - set(config)), sorted(map(str, set(config) - wanted))
    if lacking or unknown:
        raise ConstraintError(f"{what}: lacking {lacking}, unknown {unknown}")


def checked(config: Mapping, rules: Mapping[str, Number | Mapping | tuple], what: str = "configuration") -> None:
    """Exact keys, and for each its range, its allowed values or its own rules."""
    exactly(config, rules, what)
    for name, rule in rules.items():
        at = f"{what}.{name}"
        if isinstance(rule, Number):
            rule.check(at, config[name])
        elif isinstance(rule, Mapping):
            if not isinstance(config[name], Mapping):
                raise ConstraintError(f"{at} is no mapping")
            checked(config[name], rule, at)
        elif not any(config[name] == x and isinstance(config[name], bool) == isinstance(x, bool) for x in rule):
            raise ConstraintError(f"{at} is none of {list(rule)}: {config[name]!r}")
