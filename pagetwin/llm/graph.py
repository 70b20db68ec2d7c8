"""Connected components, as the operators make them."""

from pagetwin.operators.graph import components  # noqa: F401
