"""Connected components, shared with the graph operators."""

from claimweave.operators.components import components  # noqa: F401
