"""All registered queries and their SQL twins, by name."""

from . import job_plans, page_plans, scan_plans, tracker_plans, verdict_plans

_PARTS = (tracker_plans, page_plans, verdict_plans, job_plans, scan_plans)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: text for part in _PARTS for name, text in part.ORACLES.items()}
