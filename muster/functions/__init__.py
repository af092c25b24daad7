"""Column-expression helpers; every one returns a JVM-side ``Column``."""

from muster.functions.ids import key_uuid, line_id
from muster.functions.predicates import (
    EMAIL_PATTERN,
    ci_equal,
    id_equal,
    in_list,
    octet_len,
    rfc3339_pattern_ok,
)
from muster.functions.text import matches_all_terms, text_tokens
from muster.functions.tokens import token_hash

__all__ = [
    "EMAIL_PATTERN", "ci_equal", "id_equal", "in_list", "key_uuid", "line_id",
    "matches_all_terms", "octet_len", "rfc3339_pattern_ok", "text_tokens",
    "token_hash",
]
