"""All registered queries."""

from creditloom.queries import checks, decisions, evaluation, modelled, preparation, reports, retrieval  # noqa: F401
from creditloom.queries.registry import ORACLES, QUERIES  # noqa: F401
