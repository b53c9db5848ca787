"""The mapping: which fields of a record are sensitive, which are free text."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Field:
    path: str
    type: str
    prefix: str


@dataclass(frozen=True)
class Mapping:
    fields: tuple[Field, ...] = ()
    texts: tuple[str, ...] = ()
    lookup_given: str = ""
    lookup_surname: str = ""
    whitelist: tuple[str, ...] = ()
    blacklist: tuple[str, ...] = ()
    unwrap: str = ""
    options: dict[str, Any] = field(default_factory=dict)
    description: str = ""

    @classmethod
    def from_json(cls, source: str | dict) -> Mapping:
        """From the text of a JSON mapping or its parsed object."""
        d = json.loads(source) if isinstance(source, str) else source
        lookup = d.get("lookup_noms") or {}
        out = cls(
            tuple(Field(path, x["type"], x["jeton"]) for path, x in (d.get("champs_sensibles") or {}).items()),
            tuple(d.get("texte_libre") or ()),
            lookup.get("prenom") or "",
            lookup.get("nom") or "",
            tuple(d.get("whitelist") or ()),
            tuple(d.get("blacklist") or ()),
            ((d.get("structure") or {}).get("unwrap") or {}).get("field", "") if isinstance((d.get("structure") or {}).get("unwrap"), dict) else (d.get("structure") or {}).get("unwrap") or "",
            d.get("options") or {},
            d.get("description") or "",
        )
        bad = [f.path for f in out.fields if "[]" in f.path] + [t for t in out.texts if t.count("[]") > 1]
        if bad:
            raise ValueError(f"paths with lists too deep: {', '.join(bad)}")
        return out

    def to_json(self) -> str:
        d: dict[str, Any] = {
            "description": self.description,
            "champs_sensibles": {f.path: {"type": f.type, "jeton": f.prefix} for f in self.fields},
            "texte_libre": list(self.texts),
            "whitelist": list(self.whitelist),
            "blacklist": list(self.blacklist),
        }
        if self.lookup_given or self.lookup_surname:
            d["lookup_noms"] = {"prenom": self.lookup_given, "nom": self.lookup_surname}
        if self.unwrap:
            d["structure"] = {"unwrap": {"field": self.unwrap}}
        if self.options:
            d["options"] = self.options
        return json.dumps(d, ensure_ascii=False, indent=2)
