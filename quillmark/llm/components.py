"""Connected components for the corpus operators, whose scratch tables are noted for the stage that runs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import components
from .common import stash


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """See operators.components; edges are written once, so that they are computed once."""
    return components.connected_components(edges, max_rounds, stash)
