"""Query plans over the driver tables; importing the package registers them."""

from sparkloom.plans import further, inventory, linking, project, published, rollups, rule_queries, styles, texts, tokens, typed  # noqa: F401
