"""Masking and tokenisation (SCA1-SCA5).  Null in, null out everywhere."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import ColumnLike, as_column

# Mask texts, token separator, the salt's variable and its demo default.
MASK = "***"
PHONE_MASK = "***-***-"
TOKEN_SEPARATOR = "::"
SALT_VARIABLE = "TOKENIZATION_SALT"
DEMO_SALT = "local-demo-tokenization-salt"


def default_salt() -> str:
    return os.environ.get(SALT_VARIABLE, DEMO_SALT)


def mask_name(value: ColumnLike) -> Column:
    """First character, then the mask (SCA1)."""
    return F.concat(F.substring(as_column(value), 1, 1), F.lit(MASK))


def mask_email(value: ColumnLike) -> Column:
    """First character of the local part and the domain; without ``@`` nothing is shown (SCA2)."""
    email = as_column(value)
    shown = F.concat(F.substring(email, 1, 1), F.lit(MASK + "@"), F.substring_index(email, "@", -1))
    return F.when(email.isNull(), F.lit(None).cast("string")).when(F.instr(email, "@") > 0, shown).otherwise(F.lit(MASK))


def mask_phone(value: ColumnLike) -> Column:
    """Only the last four characters stay (SCA3)."""
    return F.concat(F.lit(PHONE_MASK), F.right(as_column(value), F.lit(4)))


def mask_zip_code(value: ColumnLike) -> Column:
    """Only the first two characters stay (SCA4)."""
    return F.concat(F.substring(as_column(value), 1, 2), F.lit(MASK))


def token(value: ColumnLike, salt: str | None = None) -> Column:
    """Deterministic SHA-256 token of salt, separator and value (SCA5)."""
    prefix = (salt if salt is not None else default_salt()) + TOKEN_SEPARATOR
    return F.sha2(F.concat(F.lit(prefix), as_column(value).cast("string")), 256)


MASKS = {"name": mask_name, "email": mask_email, "phone": mask_phone, "zip_code": mask_zip_code}
