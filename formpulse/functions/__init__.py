"""Column functions: built-in Spark expressions only, no actions, no Python in the data path."""

from formpulse.functions.dates import (  # noqa: F401
    derive_period,
    month_name,
    month_ordinal,
    parse_survey_date,
    parse_survey_timestamp,
    period_from_parts,
    period_label,
)
from formpulse.functions.nps import (  # noqa: F401
    nps_class,
    nps_flag,
    nps_sign,
    nps_zone,
    satisfaction_band,
)
from formpulse.functions.numbers import (  # noqa: F401
    exact_mean,
    exact_sum,
    half_even,
    percent_label,
    row_mean,
)
from formpulse.functions.ratings import (  # noqa: F401
    block_means,
    likert_fifths,
    likert_ordinal,
    likert_score,
    mean_of_means,
    rating_label,
)
from formpulse.functions.text import (  # noqa: F401
    cast_id,
    has_comment,
    manifestation_text,
    manifestation_type,
    normalize_consent,
    normalize_email,
    normalize_name,
    normalize_phone,
    normalize_sector,
    prefix_id,
    trim_ws,
)
