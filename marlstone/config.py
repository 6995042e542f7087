"""Collection configuration, search requests, and their validation."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from marlstone.errors import ValidationError

# fixed limits of the data model
MAX_NAME, MAX_TAGS, MAX_TAG, MAX_ID = 100, 50, 100, 100
MAX_CONTENT, MAX_QUERY, MAX_INDEXED_STRING = 1_000_000, 10_000, 1024
MAX_TOP_K, MAX_DIMS = 10_000, 8192
LEXICAL = ("whitespace", "trigrams", "full_text", "wmtr")
DENSE = ("dense_custom", "dense_model")
SPARSE = (*LEXICAL, "sparse_custom", "sparse_model")
KINDS = (*SPARSE, *DENSE, "noop")
ALIASES = {"keyword": "wmtr"}
FIELDS = ("name", "description", "content")
META_TYPES = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "datetime": "timestamp"}
EXCLUDABLE = ("name", "description", "content", "tags", "metadata")


@dataclass
class VectorConfig:
    """One way to represent texts; applied to each of ``index_fields``."""

    name: str
    kind: str
    index_fields: list[str] = field(default_factory=lambda: ["content"])
    top_k: int = 128
    word_ratio: int = 80
    trigram_weight: float = 1.0
    language: str = "en"
    detect_language: bool = False
    confidence: float = 0.9
    use_stopwords: bool = True
    dims: int | None = None
    distance: str = "cosine"
    normalize: bool = True

    def __post_init__(self):
        self.kind = ALIASES.get(self.kind, self.kind)
        if self.kind not in KINDS:
            raise ValidationError(f"unknown vector kind {self.kind!r}; known: {', '.join(KINDS)}")
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,100}", self.name):
            raise ValidationError(f"bad vector name {self.name!r}")
        if not self.index_fields or any(f not in FIELDS for f in self.index_fields):
            raise ValidationError(f"index_fields must be among {', '.join(FIELDS)}")
        if not 1 <= self.top_k <= MAX_TOP_K:
            raise ValidationError(f"top_k must be from 1 to {MAX_TOP_K}")
        if not 0 <= self.word_ratio <= 100:
            raise ValidationError("word_ratio is a percentage")
        if self.distance not in ("cosine", "dot", "euclid"):
            raise ValidationError(f"unknown distance {self.distance!r}")
        if self.kind == "dense_custom" and (self.dims is None or not 1 <= self.dims <= MAX_DIMS):
            raise ValidationError(f"dense_custom needs dims from 1 to {MAX_DIMS}")

    @property
    def lexical(self) -> bool:
        return self.kind in LEXICAL

    @property
    def dense(self) -> bool:
        return self.kind in DENSE


@dataclass
class CollectionConfig:
    vectors: list[VectorConfig] = field(default_factory=list)
    metadata_indexes: dict[str, str] = field(default_factory=dict)
    store_content: bool = True

    def __post_init__(self):
        if not self.vectors:
            self.vectors = [VectorConfig("noop", "noop")]
        names = [v.name for v in self.vectors]
        if len(set(names)) < len(names):
            raise ValidationError("vector names must differ")
        for key, kind in self.metadata_indexes.items():
            if kind not in META_TYPES:
                raise ValidationError(f"metadata index {key!r}: type {kind!r} cannot be indexed")

    def vector(self, name: str) -> VectorConfig:
        for v in self.vectors:
            if v.name == name:
                return v
        raise ValidationError(f"unknown vector {name!r}; known: {', '.join(v.name for v in self.vectors)}")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> CollectionConfig:
        d = json.loads(text)
        return CollectionConfig([VectorConfig(**v) for v in d["vectors"]], d["metadata_indexes"], d["store_content"])


@dataclass
class Arm:
    """A vector of a field, with its weight in the fusion."""

    vector: str
    field: str
    weight: float = 1.0


@dataclass
class FacetOptions:
    max_values: int = 10
    prefetch_multiplier: int = 2

    def __post_init__(self):
        if not 1 <= self.max_values <= 100 or not 1 <= self.prefetch_multiplier <= 10:
            raise ValidationError("facets: max_values is 1 to 100, prefetch_multiplier 1 to 10")


@dataclass
class SearchRequest:
    query: str = ""
    arms: list[Arm] | None = None
    limit: int = 10
    fusion: str = "rrf"
    tags: list[str] = field(default_factory=list)
    tags_match_all: bool = False
    where: object = None
    score_threshold: float | None = None
    raw_scores: bool = False
    exclude: list[str] = field(default_factory=list)
    group_field: str | None = None
    group_max: int = 3
    group_max_fetches: int = 2
    facets: FacetOptions | None = None
    join: str | list[str] | None = None
    dense_query: list[float] | None = None
    sparse_query: dict[str, float] | None = None

    def __post_init__(self):
        if not 1 <= self.limit <= 100:
            raise ValidationError("limit must be from 1 to 100")
        if self.fusion not in ("rrf", "linear"):
            raise ValidationError(f"unknown fusion {self.fusion!r}")
        if len(self.query) > MAX_QUERY:
            raise ValidationError(f"queries have at most {MAX_QUERY} characters")
        bad = [x for x in self.exclude if x not in EXCLUDABLE]
        if bad:
            raise ValidationError(f"cannot exclude {', '.join(bad)}; only {', '.join(EXCLUDABLE)}")
        self.exclude = list(dict.fromkeys(self.exclude))
        self.tags = list(dict.fromkeys(self.tags))

    def chosen_arms(self, config: CollectionConfig) -> list[Arm]:
        """The arms that take part: all with equal weights by default; weight 0 leaves one out."""
        if self.arms is None:
            every = [Arm(v.name, f) for v in config.vectors for f in v.index_fields]
            return [Arm(a.vector, a.field, 1 / len(every)) for a in every]
        for a in self.arms:
            v = config.vector(a.vector)
            if a.field not in v.index_fields:
                raise ValidationError(f"vector {a.vector!r} has no field {a.field!r}; it has {', '.join(v.index_fields)}")
        kept = [a for a in self.arms if a.weight != 0]
        if not kept:
            raise ValidationError("no arm has a weight")
        return kept

    def prefetch(self) -> int:
        """Candidates of each arm."""
        p = max(5, int(1.5 * self.limit))
        return p if self.facets is None else max(p, 50, self.facets.prefetch_multiplier * self.limit)


def check_collection_name(name: str) -> str:
    if not re.fullmatch(r"[a-zA-Z0-9_-]{1,100}", name):
        raise ValidationError(f"bad collection name {name!r}")
    return name
