from gleaner.functions.expressions import (
    date_of,
    day_of,
    hash_bucket,
    half_even,
    int_array,
    price_to_double,
    seconds_of,
    seeded_digest,
    year_of,
)
from gleaner.functions.grouping import dealt, global_positions, group_positions, top_k

__all__ = [
    "date_of", "day_of", "dealt", "global_positions", "group_positions", "half_even", "hash_bucket", "int_array",
    "price_to_double", "seconds_of", "seeded_digest", "top_k", "year_of",
]
