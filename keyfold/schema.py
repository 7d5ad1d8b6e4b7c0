"""Canonical fields and the header spellings that lead to them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, types as T

from keyfold import fixed

_SPARK_TYPES = {
    "string": T.StringType(),
    "numeric": T.DoubleType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
}


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str
    required: bool = False
    level: str | None = None
    category: str | None = None
    aliases: tuple[str, ...] = field(default_factory=tuple)


class CanonicalSchema:
    """Field metadata. Build it from a configuration dict, or use the default fields."""

    def __init__(self, fields: list[FieldSpec], version: str = "v1", derived: list[str] | None = None):
        self.version = version
        self.fields = {f.name: f for f in fields}
        self.derived_fields = list(derived or [])
        # a spelling claimed twice belongs to the field defined last
        self.alias_lookup = {a.lower(): f.name for f in fields for a in f.aliases}
        self.all_aliases = list(dict.fromkeys(a.lower() for f in fields for a in f.aliases))

    @classmethod
    def default(cls) -> "CanonicalSchema":
        specs = [
            FieldSpec(name, kind, name in fixed.REQUIRED_FIELDS, level, category,
                      tuple(s for a in fixed.HEADER_SPELLINGS[name] for s in dict.fromkeys((a, a.replace(" ", "_")))))
            for name, (kind, level, category) in fixed.FIELDS.items()
        ]
        return cls(specs, derived=fixed.DERIVED_CONTRACT_FIELDS)

    @classmethod
    def from_dict(cls, data: dict) -> "CanonicalSchema":
        """From {'version', 'fields': {name: {type, required, level, category, aliases}}}."""
        specs = [
            FieldSpec(n, d.get("type", "string"), bool(d.get("required")), d.get("level"),
                      d.get("category"), tuple(d.get("aliases", ())))
            for n, d in data["fields"].items()
        ]
        return cls(specs, data.get("version", "v1"), data.get("derived_contract_fields"))

    @classmethod
    def from_json(cls, path: str) -> "CanonicalSchema":
        """From a configuration file of that form on the driver."""
        with open(path, encoding="utf-8") as file:
            return cls.from_dict(json.load(file))

    def names(self, **where) -> list[str]:
        """Names of the fields whose metadata equals every given value."""
        return [f.name for f in self.fields.values() if all(getattr(f, k) == v for k, v in where.items())]

    def type_of(self, name: str) -> str | None:
        spec = self.fields.get(name)
        return spec.type if spec else None

    def lookup(self, header: str) -> str | None:
        return self.alias_lookup.get(header.strip().lower())

    def struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, _SPARK_TYPES[f.type]) for f in self.fields.values()])

    def alias_frame(self, spark: SparkSession) -> DataFrame:
        """(alias, canonical, position): a configuration table of a few hundred rows."""
        rows = [(a, self.alias_lookup[a], i) for i, a in enumerate(self.all_aliases)]
        return spark.createDataFrame(rows, "alias string, canonical string, position int")
