"""Search parameters with the defaults of the service this engine stands in for."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class SearchConfig:
    """k: neighbours per query keypoint and chunk; threshold: least inner product, inclusive."""

    k: int = 5
    threshold: float = 0.7
    top_k: int = 50
    page0_factor: float = 0.5
    max_keypoints: int = 2000
    scope: str = "chunk"
    min_matches: int = 8
    ransac_pixels: float = 8.0
    localise_top: int = 1000
    retrieval_k: int = 20_000
    rerank_k: int = 1000
    checkpoint_every: int = 5
    stored_top: int = 20

    #: Allowed ranges.
    RANGES = {"k": (1, 20), "threshold": (0.0, 1.0), "top_k": (1, 500), "page0_factor": (0.0, 1.0), "max_keypoints": (1, 100_000)}

    def __post_init__(self):
        for name, (low, high) in self.RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if self.scope not in ("chunk", "global"):
            raise ValueError("scope must be chunk or global")

    def with_(self, **changes) -> SearchConfig:
        return replace(self, **changes)


def page_args(page: int, size: int) -> tuple[int, int]:
    """Offset and limit of a page counted from 1."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1; size is from 1 to 100")
    return (page - 1) * size, size


def parse_list(text: str | None) -> list[str] | None:
    """A comma-separated filter; None or nothing in it means no filter."""
    got = [x.strip() for x in (text or "").split(",") if x.strip()]
    return got or None
