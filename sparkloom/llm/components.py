"""Connected components of distributed edge lists."""

from sparkloom.operators.graph import components  # noqa: F401
