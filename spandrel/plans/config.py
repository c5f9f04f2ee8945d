"""Configuration: file, then environment, then command line, then validation. Nine keys in three sections."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.codecs import FrameError

#: Environment variables of this prefix name a section and a key, with underscores.
PREFIX = "SPANDREL_"

# Keys with their defaults, and the allowed values of some.
DEFAULTS: dict[str, object] = {
    "compression.default_plugin": "auto",
    "compression.level": "balanced",
    "compression.timeout_seconds": 0,
    "output.progress_bars": True,
    "output.color": "auto",
    "output.quiet": False,
    "logging.format": "human",
    "logging.level": "info",
    "logging.file": "",
}
ALLOWED = {
    "compression.level": ("compression level", ("fast", "balanced", "best")),
    "output.color": ("color setting", ("auto", "always", "never")),
    "logging.format": ("log format", ("human", "json")),
    "logging.level": ("log level", ("error", "warn", "info", "debug", "trace")),
}

Config = dict[str, object]


def _fail(message: str) -> FrameError:
    return FrameError("Config", f"Configuration error: {message}")


def _known(key: str) -> str:
    if key.count(".") != 1:
        raise _fail(f"Invalid config key: '{key}' (must be section.key format)")
    name = key.replace("-", "_") if key.split(".")[0] in ("compression", "output") else key
    if name not in DEFAULTS:
        raise _fail(f"Invalid config key: '{key}' (unknown key)")
    return name


def parse(key: str, text: str) -> object:
    """A key's value from text; booleans are exactly true or false."""
    kind = type(DEFAULTS[key])
    if kind is bool:
        if text not in ("true", "false"):
            raise _fail(f"Invalid boolean value: '{text}' (must be true or false)")
        return text == "true"
    if kind is int:
        if not text.removeprefix("+").isascii() or not text.removeprefix("+").isdigit() or int(text) >= 1 << 64:
            raise _fail(f"Invalid timeout value: '{text}' (must be a number)")
        return int(text)
    return text


def show(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def validate(config: Config) -> Config:
    for key, (what, values) in ALLOWED.items():
        if config[key] not in values:
            raise _fail(f"Invalid {what}: '{config[key]}' (must be {', '.join(values[:-1])}{',' if len(values) > 2 else ''} or {values[-1]})")
    return config


def get(config: Config, key: str) -> str:
    return show(config[_known(key)])


def put(config: Config, key: str, text: str) -> Config:
    name = _known(key)
    return validate(config | {name: parse(name, text)})


def load(path: str) -> Config:
    """Defaults, overlaid by a TOML file if there is one; unknown keys are ignored."""
    if not os.path.exists(path):
        return dict(DEFAULTS)
    try:
        with open(path, "rb") as f:
            found = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise _fail(f"Invalid config file format: {e}") from e
    out = dict(DEFAULTS)
    for key, default in DEFAULTS.items():
        section, name = key.split(".")
        value = found.get(section, {}).get(name, default)
        if type(value) is not type(default) or (type(value) is int and value < 0):
            raise _fail(f"Invalid config file format: {key} is {value!r}")
        out[key] = value
    return out


def dump(config: Config) -> str:
    """The TOML text of a configuration."""
    lines: list[str] = []
    for section in dict.fromkeys(k.split(".")[0] for k in DEFAULTS):
        lines += ["", f"[{section}]"] if lines else [f"[{section}]"]
        for key in (k for k in DEFAULTS if k.startswith(section + ".")):
            value = config[key]
            text = show(value) if not isinstance(value, str) else '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
            lines.append(f"{key.split('.')[1]} = {text}")
    return "\n".join(lines) + "\n"


def save(config: Config, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(dump(config))


def env_key(name: str, prefix: str = PREFIX) -> str | None:
    """The key that an environment variable sets: underscores inside a key may be left out; unknown ones set none."""
    if not name.startswith(prefix):
        return None
    dotted = name[len(prefix) :].lower().replace("_", ".")
    names = {k.replace("_", "."): k for k in DEFAULTS} | {k.replace("_", ""): k for k in DEFAULTS}
    return names.get(dotted)


def with_env(config: Config, env: Mapping[str, str], prefix: str = PREFIX) -> Config:
    return config | {key: parse(key, text) for name, text in env.items() if (key := env_key(name, prefix))}


def with_cli(config: Config, verbose: int = 0, quiet: bool = False, log_format: str = "human", log_file: str | None = None) -> Config:
    """The command line wins; its log format always counts, since it has a default."""
    out = config | {"logging.format": log_format}
    out |= {"logging.level": "debug" if verbose == 1 else "trace"} if verbose else {}
    out |= {"output.quiet": True} if quiet else {}
    return out | ({"logging.file": log_file} if log_file else {})


def layered(settings: DataFrame) -> DataFrame:
    """key, value from rows (key, value, layer) with layers default, file, env and cli: the last layer that has a value."""
    rank = F.expr("CASE layer WHEN 'default' THEN 0 WHEN 'file' THEN 1 WHEN 'env' THEN 2 WHEN 'cli' THEN 3 END")
    return settings.filter(F.col("value").isNotNull() & rank.isNotNull()).groupBy("key").agg(F.max_by("value", rank).alias("value"))
