"""Query plans: the view stack (``Mart``), registered queries and oracles."""
