"""Role-based access: a policy as rules over users and resources, asked for one request or for many at once."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from ..terms import C, L, V

ROLES = {0: "Reader", 1: "Writer", 2: "Admin"}
ACTIONS = {0: "View", 1: "Create", 2: "Edit", 3: "Delete"}
KINDS = {0: "Post", 1: "Comment"}

#: Who may do what to which kind of resource, and whose rights each role has besides.
GRANTS = (("Reader", "View", KINDS.values()), ("Reader", "Create", ["Comment"]), ("Writer", "Create", ["Post"]), ("Writer", "Edit", KINDS.values()), ("Writer", "Delete", KINDS.values()))
INHERITS = {"Writer": "Reader", "Admin": "Writer"}


class AccessPolicy:
    """users(id, role) and a relation of ids for each kind of resource; grants and inheritance are program clauses."""

    def __init__(self, spark: SparkSession, users: DataFrame, resources: Mapping[str, DataFrame] | None = None, columns: Sequence[str] = ("id", "role"), grants: Iterable[tuple[str, str, Iterable[str]]] = GRANTS, inherits: Mapping[str, str] = INHERITS, coded: bool = True) -> None:
        self.engine = engine = Engine(spark)
        engine.register("user", users, list(columns), encoders={columns[1]: ROLES} if coded else None)
        for kind, df in (resources or {}).items():
            engine.register(f"each{kind}", df, ["id"])
            engine.add(C(L("kind", V("Id"), kind), L(f"each{kind}", V("Id"))))
        for role, action, kinds in grants:
            for kind in kinds:
                engine.add(L("may", role, action, kind))
        for role, other in inherits.items():
            engine.add(C(L("may", role, V("Do"), V("Kind")), L("may", other, V("Do"), V("Kind"))))
        who, do, kind, role, what = (V(x) for x in ("Who", "Do", "Kind", "Role", "What"))
        engine.add(C(L("canKind", who, do, kind), L("user", who, role), L("may", role, do, kind)))
        engine.add(C(L("can", who, do, what), L("kind", what, kind), L("user", who, role), L("may", role, do, kind)))

    @classmethod
    def of_segments(cls, spark: SparkSession, users: DataFrame) -> AccessPolicy:
        """Market segments in the place of roles."""
        segment = {"Reader": "BUILDING", "Writer": "MACHINERY", "Admin": "HOUSEHOLD"}
        grants = [(segment[r], a, k) for r, a, k in GRANTS]
        return cls(spark, users, None, users.columns, grants, {segment[a]: segment[b] for a, b in INHERITS.items()}, coded=False)

    def check(self, user: object, action: str, resource: object) -> bool:
        """Whether a user may do that to a resource."""
        return self.engine.holds(L("can", user, action, resource))

    def check_kind(self, user: object, action: str, kind: str) -> bool:
        return self.engine.holds(L("canKind", user, action, kind))

    def check_many(self, requests: DataFrame) -> DataFrame:
        """Of requests (user, action, resource), as texts, those that are allowed: one join for all of them."""
        allowed = self.engine.ask(L("can", V("A"), V("B"), V("C"))).toDF("user", "action", "resource")
        return requests.join(allowed, ["user", "action", "resource"], "left_semi")

    def permissions(self) -> DataFrame:
        """Everything that each user may do, by kind of resource."""
        return self.engine.ask(L("canKind", V("A"), V("B"), V("C")))

    def why(self, user: object, action: str, resource: object) -> str:
        """A proof that the user may, or an empty text."""
        return self.engine.proof(L("can", user, action, resource))
