"""Tunables: the discovery parameters (fixed values) and the physical ones."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Discovery:
    """They define the results."""

    vector_k: int = 5
    metadata_top_n: int = 5
    graph_top_n: int = 5
    freeze_k: int = 5
    checkpoint_every: int = 50
    hybrid_top_n: int = 5
    hybrid_k_vec: int = 5
    w_entity: float = 1.0
    w_old: float = 3.0
    restart: float = 0.2
    block_k: int = 10
    block_floor: float = 0.30
    tau_high: float = 0.86
    tau_low: float = 0.55
    damping: float = 0.85
    max_iter: int = 100
    tol: float = 1e-9
    snippet_chars: int = 300


@dataclass(frozen=True)
class Physical:
    """Execution knobs: they change cost, never results."""

    # rows per packed vector block, and the most pivots a KNN join may use
    block_rows: int = 512
    max_pivots: int = 256
    # largest corpus, in bytes of vectors, that a KNN join broadcasts
    corpus_bytes: int = 32 << 20
    # most cells (group, pivot, length of life, slice of time) whose sizes a KNN join broadcasts
    most_cells: int = 1 << 18
    # width (in clock ticks) of one bucket of a two-level running fold
    fold_span: int = 65_536
    # postings longer than this are answered by leader lists, not by pair joins
    rare_posting: int = 64
    # most hot facets of one profile that are expanded into subsets
    head_facets: int = 6
    # keys with more intervals than this use the dyadic interval index
    stab_small: int = 64
    # readers that share one expanded part of the graph in a PageRank task
    walk_block: int = 64


DISCOVERY = Discovery()
PHYSICAL = Physical()
