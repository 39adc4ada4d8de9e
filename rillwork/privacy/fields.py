"""Roles of columns in a table to be anonymised."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame


class Role(Enum):
    IDENTIFIER = "IDENTIFIER"
    QUASIIDENTIFIER = "QUASIIDENTIFIER"
    SENSITIVE = "SENSITIVE"
    NONSENSETIVE = "NONSENSETIVE"


@dataclass(frozen=True)
class FieldSpec:
    index: int
    name: str
    type: str = "STRING"
    role: Role = Role.NONSENSETIVE


def with_role(fields: list[FieldSpec], role: Role, df: DataFrame | None = None) -> list[str]:
    """Names of the fields with a role, in order; with `df`, only those it has."""
    return [f.name for f in sorted(fields, key=lambda f: f.index) if f.role is role and (df is None or f.name in df.columns)]


#: Names that identify a person together with others.
SAFE_HARBOR = ("Name", "ZIP", "Date", "Telephone", "Fax", "E-mail", "Social Security Number", "Medical Record Number", "Account", "Licence", "Vehicle Identifiers", "Device Identifiers", "Web URLs", "IP Address", "Biometric Identifiers", "Photos")
