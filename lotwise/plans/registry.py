"""All registered queries of the library, by name."""

from lotwise.plans import details, evaluation, texts  # noqa: F401  (all register with evaluation.query)

QUERIES: dict = evaluation.QUERIES
SQL: dict[str, str] = evaluation.SQL
