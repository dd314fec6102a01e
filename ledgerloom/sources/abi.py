"""Contract interfaces: from their JSON to decoders of logs and calls."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from dataclasses import dataclass, field

from ledgerloom.functions.columns import IMPLICIT, snake_case, storage_kind
from ledgerloom.functions.keccak import keccak256


@dataclass(frozen=True)
class Param:
    """A parameter: its column, declared type, whether it is indexed, and its storage kind."""

    name: str
    sol_type: str
    indexed: bool
    kind: str

    @property
    def column(self) -> str:
        return f"{self.name}_hash" if self.kind == "hash32" else self.name


@dataclass(frozen=True)
class Decoder:
    """One event or function of one contract or template."""

    alias: str
    name: str
    table: str
    selector: str  # topic0 of an event, four bytes of a function
    signature: str
    params: tuple[Param, ...]
    address: str | None = None  # exact emitter; None for a template's children
    kind: str = "event"

    @property
    def columns(self) -> list[str]:
        return [p.column for p in self.params]

    @property
    def is_transfer(self) -> bool:
        """Three parameters, the first two of them addresses, in a table of that name."""
        return self.table.endswith("__transfer") and len(self.params) == 3 and all(p.sol_type == "address" for p in self.params[:2])

    def all_columns(self, timestamps: bool = True) -> list[str]:
        return sorted({*self.columns, *(c for c in IMPLICIT if timestamps or c != "block_timestamp"), "table"})


def canonical_type(item: dict) -> str:
    """A parameter's type as signatures spell it, tuples written out."""
    kind = item["type"]
    if kind.startswith("tuple"):
        return "(" + ",".join(map(canonical_type, item.get("components", []))) + ")" + kind[len("tuple") :]
    for short in ("uint", "int"):
        if kind == short or kind.startswith(short + "["):
            return short + "256" + kind[len(short) :]
    return kind


def params_of(inputs: list[dict], calls: bool = False) -> tuple[Param, ...]:
    """Parameters with distinct columns; those without a name are ``arg{i}``."""
    out = []
    for i, item in enumerate(inputs):
        kind = canonical_type(item)
        indexed = bool(item.get("indexed")) and not calls
        out.append(Param(item.get("name") or f"arg{i}", kind, indexed, storage_kind(kind, indexed)))
    return tuple(out)


@dataclass
class Registry:
    """Decoders of all contracts and templates."""

    decoders: list[Decoder] = field(default_factory=list)
    anonymous: int = 0

    def add(self, alias: str, abi: list[dict] | str, address: str | None = None, events: list[str] | None = None, functions: list[str] | None = None) -> None:
        """Add a contract (with an address) or a template. ``events`` and ``functions`` allow some by name; a name that isn't there is an error."""
        items = json.loads(abi) if isinstance(abi, str) else abi
        for what, allowed in (("event", events), ("function", functions)):
            found = [x for x in items if x.get("type") == what]
            if what == "function" and allowed is None:
                continue
            if allowed is not None and (unknown := set(allowed) - {x["name"] for x in found}):
                raise ValueError(f"{alias}: no {what} {', '.join(sorted(unknown))}")
            if what == "event":
                self.anonymous += sum(bool(x.get("anonymous")) for x in found)
                found = [x for x in found if not x.get("anonymous")]
            found = [x for x in found if allowed is None or x["name"] in allowed]
            names = Counter(x["name"] for x in found)
            for x in found:
                signature = f"{x['name']}({','.join(map(canonical_type, x.get('inputs', [])))})"
                digest = keccak256(signature.encode()).hex()
                stem = f"{alias}__{'call_' if what == 'function' else ''}{snake_case(x['name'])}"
                table = stem + (f"_{digest[:4]}" if names[x["name"]] > 1 else "")
                selector = "0x" + (digest if what == "event" else digest[:8])
                self.decoders.append(Decoder(alias, x["name"], table, selector, signature, params_of(x.get("inputs", []), what == "function"), address and address.lower(), what))

    def tables(self) -> dict[str, Decoder]:
        return {d.table: d for d in self.decoders}

    def schema(self, timestamps: bool = True) -> dict:
        """The declared tables as JSON."""
        return {"tables": [{"table": d.table, "alias": d.alias, "event": d.name, "topic0": d.selector, "columns": [{"name": p.column, "sol_type": p.sol_type, "storage": p.kind, "indexed": p.indexed} for p in d.params]} for d in self.decoders]}

    def content_hash(self) -> str:
        """One hash of all that decides what is decoded and how it is stored, whatever the order of adding."""
        lines = sorted(json.dumps([d.kind, d.alias, d.address, d.selector, d.signature, [[p.column, p.sol_type, p.kind] for p in d.params]]) for d in self.decoders)
        return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def schema_tables(text: str) -> dict[str, dict[str, str]]:
    """table -> column -> storage kind, from a declared schema's JSON."""
    return {t["table"]: {c["name"]: c["storage"] for c in t.get("columns", [])} for t in json.loads(text).get("tables", [])}
