"""Policy files: policies, analyzer profiles and detector definitions, read and checked on the driver before planning."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

from veilmark.functions.labels import collapse_name

MODES = ("mask", "passthrough", "block")
KINDS = ("regex", "secret_regex", "phone", "ip", "token_classifier", "entropy", "natasha_ner")
OWN_KINDS: set[str] = set()  # types that were registered beside them


@dataclass(frozen=True)
class Pattern:
    name: str
    label: str
    regex: str
    score: float
    ignore_case: bool = False


@dataclass(frozen=True)
class Detector:
    id: str
    kind: str
    params: dict
    enabled: bool = True

    def patterns(self) -> list[Pattern]:
        """Patterns with their collapsed labels; those without label or expression are left out. Of one label's
        patterns the first decides about case, as all of them are one recognizer."""
        out, flags = [], {}
        for p in self.params.get("patterns", []):
            if not p.get("label") or not p.get("pattern"):
                continue
            label = collapse_name(p["label"])
            fold = flags.setdefault(label, "IGNORECASE" in [str(f).upper() for f in p.get("flags") or []])
            score = p.get("score", self.params.get("score", 0.8))
            out.append(Pattern(p.get("name") or label, label, p["pattern"], float(score), fold))
        return out


@dataclass(frozen=True)
class Policy:
    name: str
    mode: str = "mask"
    analyzer_profile: str = "external"
    min_score: float = 0.5
    storage_ttl_seconds: int = 3600
    placeholder_prefix: str = "GR"


@dataclass(frozen=True)
class PolicyFile:
    default_policy: str
    policies: dict[str, Policy]
    profiles: dict[str, list[str]]
    detectors: dict[str, Detector] = field(default_factory=dict)

    def resolve(self, name: str | None = None) -> Policy:
        """The named policy, or the default one; ``KeyError`` if unknown."""
        return self.policies[name or self.default_policy]

    def names(self) -> list[str]:
        return sorted(self.policies)

    def detectors_of(self, profile: str) -> list[Detector]:
        """The profile's enabled detectors in its order; unknown ids are skipped."""
        found = [self.detectors.get(i) for i in self.profiles[profile]]
        return [d for d in found if d is not None and d.enabled]


def parse_policy(raw: dict | None) -> PolicyFile:
    raw = raw or {}
    policies = {}
    for name, p in (raw.get("policies") or {}).items():
        policies[name] = Policy(name, **{k: v for k, v in p.items() if k in Policy.__dataclass_fields__ and k != "name"})
        if policies[name].mode not in MODES:
            raise ValueError(f"policy {name}: unknown mode {policies[name].mode!r}")
    detectors = {}
    for name, d in (raw.get("recognizer_definitions") or {}).items():
        if d.get("type") not in KINDS and d.get("type") not in OWN_KINDS:
            raise ValueError(f"detector {name}: unknown type {d.get('type')!r}")
        detectors[name] = Detector(name, d["type"], d.get("params") or {}, d.get("enabled", True))
    profiles = {n: list((p.get("analysis") or {}).get("recognizers") or []) for n, p in (raw.get("analyzer_profiles") or {}).items()}
    default = raw.get("default_policy")
    if default not in policies:
        raise ValueError(f"default policy {default!r} is not defined")
    for p in policies.values():
        if p.analyzer_profile not in profiles:
            raise ValueError(f"policy {p.name}: unknown profile {p.analyzer_profile!r}")
    for name, ids in profiles.items():
        if missing := [i for i in ids if i not in detectors]:
            raise ValueError(f"profile {name}: unknown detectors {missing}")
    return PolicyFile(default, policies, profiles, detectors)


def load_policy(path: str | Path | None = None) -> PolicyFile:
    """A policy file; without a path the one that comes with the package."""
    if path is None:
        return parse_policy(yaml.safe_load(_default_text()))
    return parse_policy(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def _default_text() -> str:
    from importlib.resources import files

    return files("veilmark.sources").joinpath("default_policy.yaml").read_text(encoding="utf-8")
