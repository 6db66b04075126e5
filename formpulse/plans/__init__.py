"""Whole runs: from exports to report tables, one write per table."""

from formpulse.plans.dashboard import dashboard_tables, refresh_dashboard  # noqa: F401
from formpulse.plans.monthly import monthly_tables, run_monthly  # noqa: F401
from formpulse.plans.nps import nps_tables  # noqa: F401
