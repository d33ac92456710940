"""Training-data operators: one module per operator, queries in :mod:`quillmesh.llm.queries`."""
