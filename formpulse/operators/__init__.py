"""Reports: each takes frames and returns one lazy frame that covers all periods."""

from formpulse.operators import (  # noqa: F401
    attendants,
    calendar,
    comments,
    keys,
    manifestations,
    nps,
    periods,
    ratings,
    reshape,
    satisfaction,
)
