"""Configuration of a namespace: which comparator, normalizer, cache and index, and their limits."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from .errors import ConfigError

#: Signatures per record, and the number of terms beyond which a hybrid index takes signatures.
SIGNATURES = 270
EPSILON = 1e-12

COMPARATORS = ("l2", "jaccard", "ruzicka")
NORMALIZERS = ("identity", "lp", "reciprocal")
CACHES = ("generic", "sparse")
INDEXES = ("generic", "dense", "inverted", "signature", "sparse")
GENERATORS = {"l2": (), "jaccard": ("minhash",), "ruzicka": ("icws", "i2cws", "pcws", "scws")}
STRATEGIES = ("auto", "in_filtering", "pre_filtering", "post_filtering")


def _name(value: str | None) -> str:
    return (value or "").strip().lower()


@dataclass(frozen=True)
class NamespaceConfig:
    """All settings, validated together on creation. Type names are trimmed and lower-cased; unknown parameters are ignored."""

    comparator: str = "l2"
    normalizer: str = "reciprocal"
    cache: str = "generic"
    index: str = "generic"
    max_cache_size: int = 100_000
    max_num_similarities: int = 1000
    max_num_searchable_structures: int = 3
    min_num_terms: int = 0
    max_num_terms: int = 2**31 - 1
    params: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("comparator", "normalizer", "cache", "index"):
            object.__setattr__(self, name, _name(getattr(self, name)))
        object.__setattr__(self, "params", dict(self.params or {}))
        self.validate()

    def validate(self) -> None:
        wrong = []
        for name, known in (("comparator", COMPARATORS), ("normalizer", NORMALIZERS), ("cache", CACHES), ("index", INDEXES)):
            value = getattr(self, name)
            if not value:
                wrong.append(f"{name} is blank")
            elif value not in known:
                wrong.append(f"{name} {value!r} is not one of {', '.join(known)}")
        if self.max_num_searchable_structures <= 2:
            wrong.append("max_num_searchable_structures must be over 2")
        for name in ("max_cache_size", "max_num_similarities"):
            if getattr(self, name) <= 0:
                wrong.append(f"{name} must be positive")
        if self.min_num_terms > self.max_num_terms:
            wrong.append("min_num_terms is over max_num_terms")
        if self.index == "dense" and self.comparator != "l2":
            wrong.append("a dense index takes the comparator l2 only")
        if self.generator and self.generator not in GENERATORS.get(self.comparator, ()):
            wrong.append(f"{self.comparator} has no signature generator {self.generator!r}")
        if self.index in ("signature", "sparse") and not self.generator and self.comparator in COMPARATORS:
            wrong.append(f"index {self.index} needs a signature_generator_type")
        for name, low, high, open_low in (
            ("max_fraction_ids_per_sparse_key", 0.0, 1.0, True),
            ("max_fraction_ids_per_sparse_key_confidence", 0.5, 1.0, False),
            ("full_reevaluation_cache_size_decrease_fraction", 0.0, 1.0, False),
            ("max_pre_filtering_rows_ratio", 0.0, 1.0, False),
        ):
            value = self._number(name, 1.0)
            if value is None or not (low < value if open_low else low <= value) or value > high:
                wrong.append(f"{name} is out of its range")
        if self.strategy not in STRATEGIES:
            wrong.append(f"metadata_filtering_strategy {self.strategy!r} is unknown")
        if wrong:
            raise ConfigError("; ".join(wrong))

    def _number(self, name: str, default: float) -> float | None:
        try:
            return float(self.params.get(name, default))
        except (TypeError, ValueError):
            return None

    @property
    def generator(self) -> str:
        return _name(self.params.get("signature_generator_type"))

    @property
    def max_fraction(self) -> float:
        return self._number("max_fraction_ids_per_sparse_key", 1.0)

    @property
    def confidence(self) -> float:
        return self._number("max_fraction_ids_per_sparse_key_confidence", 0.95)

    @property
    def pre_filtering_ratio(self) -> float:
        return self._number("max_pre_filtering_rows_ratio", 0.1)

    @property
    def strategy(self) -> str:
        return _name(self.params.get("metadata_filtering_strategy", "auto"))
