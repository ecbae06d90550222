from tessera.functions.dates import month_start, parse_dmy, parse_month_year, year_month  # noqa: F401
from tessera.functions.encode import (  # noqa: F401
    binary_encode, binary_level, dummies, dummy_columns, factor_codes, levels,
)
from tessera.functions.text import (  # noqa: F401
    blank_to_null, first_token, gsub, lower_key, part, paste, percent_to_double,
    replace_chars, split_fixed, word_to_number,
)
