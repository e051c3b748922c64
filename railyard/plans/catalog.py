"""Imports every query module so that each registers its queries."""

from railyard.plans import q_search  # noqa: F401
from railyard.plans import q_text  # noqa: F401
from railyard.plans import q_retrieval  # noqa: F401
from railyard.plans import q_tables  # noqa: F401
from railyard.plans import q_chunking  # noqa: F401
from railyard.plans import q_output  # noqa: F401
from railyard.plans import q_conversation  # noqa: F401
from railyard.plans import q_reports  # noqa: F401
from railyard.plans import q_streaming  # noqa: F401
