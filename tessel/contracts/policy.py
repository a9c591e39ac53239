"""Comparison of a producer's shape with a contract's shape under a compatibility policy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum

from .shape import Field, Map, Optional, Primitive, Sequence, Shape, Struct


class Policy(Enum):
    EXACT = "Exact"
    EXACT_UNORDERED_CI = "ExactUnorderedCI"
    EXACT_ORDERED = "ExactOrdered"
    EXACT_ORDERED_CI = "ExactOrderedCI"
    EXACT_BY_POSITION = "ExactByPosition"
    BACKWARD = "Backward"
    FORWARD = "Forward"
    FULL = "Full"

    @property
    def matching(self) -> str:
        """How fields meet: by ``name``, by ``index`` with equal names, or by ``position`` alone."""
        if self is Policy.EXACT_BY_POSITION:
            return "position"
        return "index" if self in (Policy.EXACT_ORDERED, Policy.EXACT_ORDERED_CI) else "name"

    @property
    def folds_case(self) -> bool:
        return self in (Policy.EXACT, Policy.EXACT_UNORDERED_CI, Policy.EXACT_ORDERED_CI)

    def rejects(self, diff: Diff) -> bool:
        if self is Policy.FULL:
            return False
        if self is Policy.BACKWARD:
            return diff.kind is DiffKind.MISMATCH or diff.kind is DiffKind.MISSING and not diff.tolerable
        if self is Policy.FORWARD:
            return diff.kind is not DiffKind.MISSING
        return True


class DiffKind(Enum):
    MISSING = "missing"
    EXTRA = "extra"
    MISMATCH = "mismatch"


@dataclass(frozen=True)
class Diff:
    """One difference at ``path``; ``note`` is ``optional`` or ``default`` for a missing field that may be."""

    kind: DiffKind
    path: tuple[str, ...]
    expected: str = ""
    found: str = ""
    note: str = ""

    @property
    def tolerable(self) -> bool:
        return bool(self.note)

    def __str__(self) -> str:
        text = f"{self.kind.value} `{'.'.join(self.path)}`"
        if self.note:
            text += f" ({self.note})"
        return text + (f" (expected `{self.expected}`, found `{self.found}`)" if self.expected or self.found else "")


class ContractMismatch(TypeError):
    """A producer does not conform to a contract; ``diffs`` are those that the policy rejects."""

    def __init__(self, policy: Policy, diffs: list[Diff], what: str = "schema"):
        self.policy, self.diffs = policy, diffs
        super().__init__(f"{what} does not conform under {policy.value}: " + "; ".join(map(str, diffs)))


def _folded(name: str, policy: Policy) -> str:
    """ASCII letters only are folded."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name) if policy.folds_case else name


def _repeated(fields: tuple[Field, ...], policy: Policy) -> str | None:
    names = [_folded(f.name, policy) for f in fields]
    return next((f.name for f, n in zip(fields, names) if names.count(n) > 1), None)


def _absent(field: Field, path: tuple[str, ...]) -> Diff:
    note = "optional" if isinstance(field.shape, Optional) else "default" if field.has_default else ""
    return Diff(DiffKind.MISSING, (*path, field.name), note=note)


def _by_name(producer: Struct, contract: Struct, path: tuple[str, ...], policy: Policy) -> Iterator[Diff]:
    for side in (producer, contract):
        if name := _repeated(side.fields, policy):
            yield Diff(DiffKind.MISMATCH, (*path, name), "unique field name", name)
            return
    offered = {_folded(f.name, policy): f for f in producer.fields}
    wanted = {_folded(f.name, policy) for f in contract.fields}
    for c in contract.fields:
        p = offered.get(_folded(c.name, policy))
        yield from [_absent(c, path)] if p is None else _shapes(p.shape, c.shape, (*path, c.name), policy)
    yield from (Diff(DiffKind.EXTRA, (*path, p.name)) for p in producer.fields if _folded(p.name, policy) not in wanted)


def _by_index(producer: Struct, contract: Struct, path: tuple[str, ...], policy: Policy) -> Iterator[Diff]:
    named = policy.matching == "index"
    for p, c in zip(producer.fields, contract.fields):
        own = (*path, c.name if named else p.name)
        if named and _folded(p.name, policy) != _folded(c.name, policy):
            yield Diff(DiffKind.MISMATCH, (*own, "(name)"), c.name, p.name)
        yield from _shapes(p.shape, c.shape, own, policy)
    shared = min(len(producer.fields), len(contract.fields))
    yield from (_absent(c, path) for c in contract.fields[shared:])
    yield from (Diff(DiffKind.EXTRA, (*path, p.name)) for p in producer.fields[shared:])


def _fields(producer: Struct, contract: Struct, path: tuple[str, ...], policy: Policy) -> Iterator[Diff]:
    return (_by_name if policy.matching == "name" else _by_index)(producer, contract, path, policy)


def _shapes(p: Shape, c: Shape, path: tuple[str, ...], policy: Policy) -> Iterator[Diff]:
    if type(p) is not type(c) or isinstance(p, Primitive) and p != c:
        yield Diff(DiffKind.MISMATCH, path, c.label, p.label)
    elif isinstance(p, Optional):
        yield from _shapes(p.inner, c.inner, path, policy)
    elif isinstance(p, Sequence):
        yield from _shapes(p.item, c.item, (*path, "[]"), policy)
    elif isinstance(p, Map):
        yield from _shapes(p.key, c.key, (*path, "<key>"), policy)
        yield from _shapes(p.value, c.value, (*path, "<value>"), policy)
    elif isinstance(p, Struct):
        yield from _fields(p, c, path, policy)


def compare(producer: Shape, contract: Shape, policy: Policy) -> list[Diff]:
    """Every difference, whether the policy rejects it or not; roots that are not both structs must be equal."""
    if isinstance(producer, Struct) and isinstance(contract, Struct):
        return list(_fields(producer, contract, (), policy))
    return [] if producer == contract else [Diff(DiffKind.MISMATCH, ("<root>",), contract.label, producer.label)]


def conforms(producer: Shape, contract: Shape, policy: Policy) -> bool:
    return not any(map(policy.rejects, compare(producer, contract, policy)))


def enforce(producer, contract, policy: Policy, what: str = "schema") -> None:
    """Raises ``ContractMismatch`` unless the producer (a shape or a contract class) conforms."""
    from .derive import shape_of

    rejected = [d for d in compare(shape_of(producer), shape_of(contract), policy) if policy.rejects(d)]
    if rejected:
        raise ContractMismatch(policy, rejected, what)
