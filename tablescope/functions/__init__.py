from .columns import (
    canonical_key,
    classifiable,
    clean,
    col,
    is_boolean,
    is_datetime,
    is_floating,
    is_integral,
    is_missing,
    is_number,
    present,
    redact_credentials,
    required,
    value_of,
)

__all__ = [
    "canonical_key",
    "classifiable",
    "clean",
    "col",
    "is_boolean",
    "is_datetime",
    "is_floating",
    "is_integral",
    "is_missing",
    "is_number",
    "present",
    "redact_credentials",
    "required",
    "value_of",
]
