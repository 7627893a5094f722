"""Parameters of retrieval, graph building and beam search, with the defaults of the data model."""

from __future__ import annotations

from dataclasses import dataclass, replace

TEXT, AUDIO, IMAGE = 0, 1, 2
MODALITIES = {TEXT: "text", AUDIO: "audio", IMAGE: "image"}


@dataclass(frozen=True)
class RetrievalConfig:
    """modality_filter restricts seeds; with modality_filter_scope="results" it restricts results too."""

    top_k: int = 10
    max_hops: int = 2
    time_decay: float = 1e-8
    hop_decay: float = 0.5
    own_weight: float = 0.8
    modality_filter: int | None = None
    modality_filter_scope: str = "seeds"
    use_importance: bool = False
    normalize_query: bool = True


@dataclass(frozen=True)
class GraphConfig:
    """k ring neighbours, rewiring probability p, seed of the hashed draws, and a switch for each phase."""

    k: int = 6
    p: float = 0.15
    seed: int = 7
    ring: bool = True
    skips: bool = True
    hubs: bool = True
    rewire: bool = True
    bridges: bool = True


@dataclass(frozen=True)
class BeamConfig:
    top_k: int = 10
    beam: int = 128
    iterations: int = 64
    parents: int = 1
    seeds: int = 8
    time_decay: float = 1e-8
    modality_filter: int | None = None
    half: bool = False


_G, _R = GraphConfig(), RetrievalConfig()
#: Name to (graph, hops); a flat graph has no edges.
ABLATIONS = {
    "full": (_G, 2),
    "no_bridges": (replace(_G, bridges=False), 2),
    "no_hubs": (replace(_G, hubs=False), 2),
    "no_rewire": (replace(_G, rewire=False), 2),
    "ring_only": (replace(_G, skips=False, hubs=False, rewire=False, bridges=False), 2),
    "flat": (replace(_G, ring=False, skips=False, hubs=False, rewire=False, bridges=False), 0),
    "h0": (_G, 0),
    "h1": (_G, 1),
    "h3": (_G, 3),
}
