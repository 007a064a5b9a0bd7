"""All registered queries."""

from quillspark.plans import answers, charts, foundation, governance, graphs, ingest, metrics, quality, questions, rails, reports, retrieval, storage, texts  # noqa: F401
from quillspark.plans.registry import ORACLES, QUERIES  # noqa: F401
