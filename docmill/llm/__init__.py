"""Training-data operators: one module each, registered by :mod:`docmill.llm.registry`."""
