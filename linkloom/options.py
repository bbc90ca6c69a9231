"""The parameters of a run, with the choices that each allows, and their command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field, fields

CHOICES = {
    "clustering_domain": ("within_doc", "cross_doc"),
    "available_entities": ("candidates_only", "knn_candidates", "open_domain"),
    "mention_negatives": ("context_overlap", "random", "knn"),
    "training_edges": ("all", "m-e", "m-m"),
    "pair_method": ("all_pairs", "mst"),
    "example_kind": ("triplet", "softmax", "threshold"),
}


@dataclass
class Options:
    """Defaults are those of the published configurations where there is one."""

    root: str = ""
    split: str = "val"
    domains: list[str] = field(default_factory=list)
    embeddings: str = ""
    results: str = ""
    context: int = 128
    clustering_domain: str = "within_doc"
    available_entities: str = "candidates_only"
    mention_negatives: str = "context_overlap"
    training_edges: str = "all"
    pair_method: str = "all_pairs"
    example_kind: str = "triplet"
    k: int = 32
    quota: int = 32
    margin: float = 0.5
    clusters_per_batch: int = 16
    row_negatives: int = 7
    threshold: float | None = None
    thresholds: int = 1000
    cells: int = 200
    probes: int = 75
    seed: str = "0"

    def __post_init__(self):
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name}: one of {', '.join(allowed)}")
        if min(self.k, self.quota, self.context, self.clusters_per_batch, self.row_negatives, self.thresholds, self.cells, self.probes) < 1:
            raise ValueError("counts start at 1")


def parsed(arguments: list[str] | None = None) -> tuple[str, Options]:
    """The command (evaluate or examples) and its options."""
    parser = argparse.ArgumentParser(prog="linkloom", description=__doc__)
    parser.add_argument("command", choices=("evaluate", "examples"))
    for f in fields(Options):
        kind = {"int": int, "float": float, "float | None": float}.get(str(f.type), str)
        more = {"nargs": "*", "default": []} if f.name == "domains" else {"type": kind, "default": f.default, "choices": CHOICES.get(f.name)}
        parser.add_argument(f"--{f.name.replace('_', '-')}", **more)
    found = vars(parser.parse_args(arguments))
    return found.pop("command"), Options(**found)
