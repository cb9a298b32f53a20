"""Declarative models: which column depends on which, and how it is distributed."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Role(str, Enum):
    """How a parent column selects matching rows."""

    CAT = "cat"  # equal values
    BAND = "band"  # within +- radius
    SOFT = "soft"  # equal values, nearest values may stand in
    HARD = "hard"  # restricts stand-ins only


class Kind(str, Enum):
    UNIFORM = "uniform"
    FREQ = "freq"
    UNIFORM_CONT = "uniform_cont"
    BERNOULLI = "bernoulli"
    CAT = "cat"
    NUM = "num"
    EMB_CAT = "emb_cat"
    EMB_NUM = "emb_num"


ROOTS = {Kind.UNIFORM, Kind.FREQ, Kind.UNIFORM_CONT, Kind.BERNOULLI}
EMBEDDED = {Kind.EMB_CAT, Kind.EMB_NUM}
NUMERIC = {Kind.NUM, Kind.EMB_NUM, Kind.UNIFORM_CONT}


@dataclass(frozen=True)
class Parent:
    attr: str
    role: Role = Role.CAT
    radius: float | None = None

    def __post_init__(self):
        if (self.role is Role.BAND) != (self.radius is not None):
            raise ValueError(f"parent {self.attr}: a radius goes with a band, and only there")
        if self.radius is not None and self.radius < 0:
            raise ValueError(f"parent {self.attr}: negative radius")


@dataclass(frozen=True)
class Node:
    attr: str
    kind: Kind
    parents: tuple[Parent, ...] = ()
    k: int | None = None
    strict: bool = True
    greater_zero: bool = False

    def __post_init__(self):
        if self.kind in ROOTS and self.parents:
            raise ValueError(f"{self.attr}: a root has no parents")
        if self.kind not in ROOTS and not self.parents:
            raise ValueError(f"{self.attr}: parents needed")
        if (self.kind in EMBEDDED) != (self.k is not None):
            raise ValueError(f"{self.attr}: k goes with an embedded node, and only there")
        if self.k is not None and self.k < 1:
            raise ValueError(f"{self.attr}: k must be at least 1")
        allowed = {Role.SOFT, Role.HARD, Role.BAND} if self.kind in EMBEDDED else {Role.CAT, Role.BAND}
        for p in self.parents:
            if p.role not in allowed:
                raise ValueError(f"{self.attr}: parent {p.attr} cannot be {p.role.value} here")
        if sum(p.role is Role.BAND and p.radius > 0 for p in self.parents) > 1:
            raise ValueError(f"{self.attr}: one band with a radius per node")
        if self.kind in EMBEDDED and not any(p.role is Role.SOFT for p in self.parents):
            raise ValueError(f"{self.attr}: an embedded node needs a soft parent")

    def by_role(self, *roles: Role) -> list[str]:
        """Attributes of the parents in a role; a band of radius 0 is an equality."""
        return [p.attr for p in self.parents if self._effective(p) in roles]

    @staticmethod
    def _effective(p: Parent) -> Role:
        return Role.CAT if p.role is Role.BAND and p.radius == 0 else p.role

    @property
    def band(self) -> Parent | None:
        return next((p for p in self.parents if p.role is Role.BAND and p.radius > 0), None)

    @property
    def numeric(self) -> bool:
        return self.kind in NUMERIC


@dataclass(frozen=True)
class ModelSpec:
    nodes: tuple[Node, ...]
    name: str = "model"
    attrs: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        names = [n.attr for n in self.nodes]
        if len(set(names)) != len(names):
            raise ValueError("an attribute has two nodes")
        for n in self.nodes:
            for p in n.parents:
                if p.attr not in names:
                    raise ValueError(f"{n.attr}: parent {p.attr} has no node")
        self.topological()
        object.__setattr__(self, "attrs", tuple(names))

    def node(self, attr: str) -> Node:
        return next(n for n in self.nodes if n.attr == attr)

    def topological(self) -> list[Node]:
        """Nodes with parents first; raises on a cycle."""
        done: list[str] = []
        todo = list(self.nodes)
        while todo:
            ready = [n for n in todo if all(p.attr in done for p in n.parents)]
            if not ready:
                raise ValueError("the model has a cycle")
            done += [n.attr for n in ready]
            todo = [n for n in todo if n.attr not in done]
        return [self.node(a) for a in done]

    def touching(self, attr: str) -> list[Node]:
        """Nodes whose probability depends on an attribute: its own and its children's."""
        return [n for n in self.nodes if n.attr == attr or any(p.attr == attr for p in n.parents)]

    @property
    def soft_attrs(self) -> list[str]:
        return sorted({a for n in self.nodes for a in n.by_role(Role.SOFT)})


# Short forms for writing models.


def uniform(attr: str) -> Node:
    return Node(attr, Kind.UNIFORM)


def freq(attr: str) -> Node:
    return Node(attr, Kind.FREQ)


def uniform_cont(attr: str) -> Node:
    return Node(attr, Kind.UNIFORM_CONT)


def bernoulli(attr: str) -> Node:
    return Node(attr, Kind.BERNOULLI)


def cat(attr: str, *parents: Parent | str, strict: bool = True) -> Node:
    return Node(attr, Kind.CAT, _parents(parents, Role.CAT), strict=strict)


def num(attr: str, *parents: Parent | str, strict: bool = True, greater_zero: bool = False) -> Node:
    return Node(attr, Kind.NUM, _parents(parents, Role.CAT), strict=strict, greater_zero=greater_zero)


def emb_cat(attr: str, *parents: Parent | str, k: int) -> Node:
    return Node(attr, Kind.EMB_CAT, _parents(parents, Role.SOFT), k=k)


def emb_num(attr: str, *parents: Parent | str, k: int) -> Node:
    return Node(attr, Kind.EMB_NUM, _parents(parents, Role.SOFT), k=k)


def band(attr: str, radius: float) -> Parent:
    return Parent(attr, Role.BAND, radius)


def hard(attr: str) -> Parent:
    return Parent(attr, Role.HARD)


def _parents(items, role: Role) -> tuple[Parent, ...]:
    return tuple(i if isinstance(i, Parent) else Parent(i, role) for i in items)
