"""Parameters of chunking and preparation. One immutable object is handed to every operator; there are no globals."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "structure"
    target_chars: int = 1500
    hard_chars: int = 1800
    split_target: int = 1200
    overlap: int = 100
    appendix_threshold: int = 1500
    max_images: int = 10
    table_rows: int = 20
    table_chars: int = 5000
    fixed_size: int = 800
    fixed_overlap: int = 100
    semantic_threshold: float = 0.78
    parent_size: int = 1500
    child_size: int = 400
    segment_batch: int = 30
    segment_chars: int = 5000
    embed_batch: int = 20
    metadata_batch: int = 50

    def updated(self, **values) -> "ChunkConfig":
        """A validated copy: unknown names are refused, sizes are held above their least values."""
        known = {f.name for f in fields(self)}
        if unknown := sorted(set(values) - known):
            raise KeyError(f"unknown parameters: {', '.join(unknown)}")
        out = replace(self, **values)
        return replace(out, fixed_size=max(50, out.fixed_size), fixed_overlap=max(0, out.fixed_overlap), parent_size=max(300, out.parent_size), child_size=max(100, out.child_size))


#: key, default
STRATEGIES = [("structure", True), ("recursive", False), ("fixed", False), ("sentence", False), ("semantic", False), ("parent_child", False), ("late_chunking", False), ("llm", False)]


def resolve_strategy(explicit: str | None, profile: str | None = None, default: str | None = None) -> str:
    """explicit, else the profile's, else the configured default, else structure; an unknown name is structure."""
    name = next((x for x in (explicit, profile, default) if x and x.strip()), "structure")
    key = name.strip().lower().replace("-", "_")
    return key if key in {k for k, _ in STRATEGIES} else "structure"
