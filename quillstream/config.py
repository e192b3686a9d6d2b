"""Settings from a YAML mapping, checked; what is absent has its default."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re

import yaml

from quillstream.functions.redact import CLASSES

SCHEMA_VERSION = "1"
SCOPES = ("personal", "team")
CONNECTOR = re.compile(r"\A[a-z][a-z0-9-]*:[A-Za-z0-9][A-Za-z0-9._-]*\Z")


class ConfigError(ValueError):
    """A setting that is not understood."""


@dataclasses.dataclass(frozen=True)
class Connector:
    """name is <type>:<agent>; scope, if given, must be the repository's kind."""

    name: str
    path: str
    scope: str = "personal"
    max_files: int = 64
    max_facts: int = 512

    def __post_init__(self) -> None:
        if not CONNECTOR.match(self.name):
            raise ConfigError(f"bad connector name {self.name!r}")
        if not self.path or "\0" in self.path:
            raise ConfigError(f"bad path of {self.name}")
        if self.scope not in SCOPES:
            raise ConfigError(f"bad scope {self.scope!r}")

    @property
    def agent(self) -> str:
        return self.name.partition(":")[2]


@dataclasses.dataclass(frozen=True)
class Settings:
    kind: str = "personal"
    scope_lock: str | None = None
    related: int = 8
    max_candidates: int = 32
    max_attempts: int = 3
    threshold: int = 12
    idle_minutes: int = 60
    cron: str | None = None
    budget_tokens: int = 2000
    max_orphans: int | None = None
    redact: bool = True
    redact_classes: tuple[str, ...] = tuple(CLASSES)
    connectors: tuple[Connector, ...] = ()

    def admits(self, connector: Connector) -> bool:
        """Whether a connector may run here: its scope is the lock's and the repository's; an unknown kind counts as team."""
        kind = self.kind if self.kind in SCOPES else "team"
        return connector.scope == kind and self.scope_lock in (None, kind)


def load(text: str | None) -> Settings:
    """Settings of a YAML text; null or blank gives the defaults. Unknown keys, wrong types and unknown redaction classes are errors."""
    said = yaml.safe_load(text) if text and text.strip() else {}
    if not isinstance(said, dict):
        raise ConfigError("settings are no mapping")
    known = {f.name: f for f in dataclasses.fields(Settings)}
    if extra := set(said) - set(known):
        raise ConfigError(f"unknown settings {sorted(extra)}")
    values = dict(said)
    for name in ("related", "max_candidates", "max_attempts", "threshold", "idle_minutes", "budget_tokens"):
        if name in values and not (isinstance(values[name], int) and values[name] > 0 and not isinstance(values[name], bool)):
            raise ConfigError(f"{name} is a positive number")
    if "redact_classes" in values:
        if bad := set(values["redact_classes"]) - set(CLASSES):
            raise ConfigError(f"unknown redaction classes {sorted(bad)}")
        values["redact_classes"] = tuple(values["redact_classes"])
    if "connectors" in values:
        try:
            values["connectors"] = tuple(Connector(**c) for c in values["connectors"])
        except TypeError as e:
            raise ConfigError(str(e)) from e
    return Settings(**values)


def spec_hash(spec: dict) -> str:
    """SHA-256 of a mapping's canonical JSON."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def check_schema(version: str | None) -> None:
    """Raise unless data were written under this schema; none is taken for new."""
    if version is not None and version != SCHEMA_VERSION:
        raise ConfigError(f"schema version {version}, this is {SCHEMA_VERSION}")
