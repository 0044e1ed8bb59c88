"""Row schemas and vocabularies of the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

NODES = (
    "id string, label string, source_file string, source_location string, node_type string, community int, "
    "source_kind string, source_priority float, source_flags array<string>, extra map<string,string>, node_seq long"
)
EDGES = (
    "source string, target string, relation string, confidence string, confidence_score double, source_file string, "
    "source_location string, weight double, extra map<string,string>, edge_seq long"
)
HYPEREDGES = "nodes array<string>, relation string, label string"

# Node kinds, confidence levels with their default scores, file kinds.
NODE_TYPES = (
    "class", "function", "module", "concept", "paper", "image", "file", "method",
    "interface", "enum", "struct", "trait", "constant", "variable", "package", "namespace",
)
CONFIDENCE = {"EXTRACTED": 1.0, "INFERRED": 0.7, "AMBIGUOUS": 0.4}
FILE_TYPES = ("code", "document", "paper", "image")


def confidence_score(confidence: str = "confidence"):
    """The default score of a confidence level; null for other values."""
    known = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return known[F.col(confidence)]
