"""Public contracts: declared before any value is read, immutable, named by the digest of their canonical JSON."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from ..operators.privacy import check_policy
from ..sources.readers import sha256_json

DENOMINATOR = 1_000_000


@dataclass(frozen=True)
class Resampling:
    """A holdout (test share in millionths) or folds."""

    method: str = "none"
    test_numerator: int = 0
    folds: int = 0

    def __post_init__(self) -> None:
        good = {"none": True, "holdout": 0 < self.test_numerator < DENOMINATOR, "folds": 2 <= self.folds <= 10}
        if not good.get(self.method, False):
            raise ValueError("not a resampling")


@dataclass(frozen=True)
class Contract:
    """Columns, bounds, levels, unit and privacy of a run."""

    target: str
    features: tuple[str, ...]
    task: str = "binary"
    subject: str | None = None
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    levels: tuple = ()
    target_bounds: tuple[float, float] | None = None
    resampling: Resampling = Resampling()
    epsilon: float = 1.0
    delta: float = 1e-6
    clip: float = 1.0
    #: Further binary targets of a multilabel task.
    more_targets: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        check_policy(self.epsilon, self.delta, self.clip)
        names = [*self.targets, *self.features]
        if bool(self.more_targets) != (self.task == "multilabel"):
            raise ValueError("a multilabel task has several targets, any other has one")
        if not all(names) or len(set(names)) != len(names) or not self.features:
            raise ValueError("target and features must be named, once each")
        if any(not (math.isfinite(a) and math.isfinite(b) and -1e6 <= a < b <= 1e6) for a, b in [*self.bounds.values(), *([self.target_bounds] if self.target_bounds else [])]):
            raise ValueError("bounds must be finite, in order and within 1e6")
        if self.levels and not (2 <= len(self.levels) <= 1024 and len(set(self.levels)) == len(self.levels)):
            raise ValueError("2 to 1024 distinct levels")
        if self.task in ("regression", "count") and self.target_bounds is None:
            raise ValueError("a numeric task needs target bounds")

    @property
    def targets(self) -> tuple[str, ...]:
        return (self.target, *self.more_targets)

    @property
    def model_features(self) -> tuple[str, ...]:
        """Features without the subject's column."""
        return tuple(f for f in self.features if f != self.subject)

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.targets, *self.features, *([self.subject] if self.subject else [])]))

    def sha256(self) -> str:
        return sha256_json(asdict(self))


#: Depth, items and bytes of the parameters of a user's function, and names they may not use.
PARAM_DEPTH, PARAM_ITEMS, PARAM_BYTES = 8, 2048, 64 << 10
RESERVED = ("epsilon", "delta", "seed", "secret", "sigma", "noise", "clip")


def check_params(value: object, depth: int = 0) -> int:
    """The number of items of JSON-like parameters; ValueError if they are too deep, too many, too long, not finite or use a reserved
    name."""
    if depth > PARAM_DEPTH:
        raise ValueError("parameters are nested too deeply")
    if isinstance(value, dict):
        if any(not isinstance(k, str) or k.lower() in RESERVED for k in value):
            raise ValueError("a parameter's name is reserved")
        n = len(value) + sum(check_params(v, depth + 1) for v in value.values())
    elif isinstance(value, (list, tuple)):
        n = len(value) + sum(check_params(v, depth + 1) for v in value)
    elif value is None or isinstance(value, (bool, int, str)) or isinstance(value, float) and math.isfinite(value):
        n = 0
    else:
        raise ValueError("a parameter is not JSON")
    if n > PARAM_ITEMS or depth == 0 and len(repr(value).encode()) > PARAM_BYTES:
        raise ValueError("there are too many parameters")
    return n
