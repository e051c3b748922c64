"""railyard: retrieval, guardrail and conversation analytics as Spark jobs.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, joins, windows and Structured Streaming state.  Sub-packages:

* ``functions``  – Column-level helpers (text, regex, vectors)
* ``sources``    – table loaders, document scans, chunk-table maintenance
* ``operators``  – guards, search, chunking, embedding, conversation logic
* ``plans``      – compositions of operators (ingest, retrieval, turn routing)
                   and the named query catalogue used by ``__spark_entry__``
* ``streaming``  – Structured Streaming forms of the stateful rules
"""

from railyard.policy import Policy, DEFAULT_POLICY

__all__ = ["Policy", "DEFAULT_POLICY"]
