"""All registered queries, and the SQL of each."""

from longbox.plans import jobs as _jobs  # registers its queries
from longbox.plans import line_jobs as _line_jobs  # registers its queries
from longbox.plans import page_jobs as _page_jobs  # registers its queries
from longbox.plans import source_jobs as _source_jobs  # registers its queries
from longbox.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
assert _jobs and _line_jobs and _page_jobs and _source_jobs
