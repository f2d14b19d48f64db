"""Column functions: text, numbers and timestamps."""

from prepkit.functions.text import (  # noqa: F401
    apply_rules,
    append_when,
    contains_text,
    default_text,
    display_text,
    fixed_decimals,
    number_text,
    prefix_key,
    slug,
    split_part_exact,
    split_struct_exact,
    strip_chars,
    title_case,
    underscore,
)
from prepkit.functions.values import (  # noqa: F401
    checked_timestamp,
    is_plain_number,
    modulo,
    number_of,
    plain_number,
    scale,
    unit_hash,
)
