"""Who may do what: grants by strength, decision tables for changes of membership and accounts, and the scope that every search carries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import name_tokens

#: The grants from weak to strong, the texts of refusals, and the words that make a tool's name one of reading or writing.
LEVELS = ["viewer", "editor", "owner"]
NEEDS_OWNER = "Owner access to this department is required"
MAKES_OWNER = "Only a global admin can grant owner access to a department"
TOUCHES_OWNER = "Only a global admin can change or revoke another owner's access"
OWN_ACCOUNT = "You cannot deactivate your own account"
LAST_ADMIN = "This is the last active admin; promote or activate another admin first"
READ = ["get", "list", "search", "read", "fetch", "find", "view"]
WRITE = ["create", "update", "delete", "send", "remove", "archive", "associate", "advance", "propose", "apply", "register"]

Facts = dict[str, Column]
Table = list[tuple[Callable[[Facts], Column], str | None]]

#: Changes of membership by `caller` (a grant), `admin`, `wanted` (a grant, null to revoke), `held` (the grant that is there) and `own` (the caller's own
#: row): the first line that applies decides; None lets the change pass, as does no line at all.
MEMBERSHIP: Table = [
    (lambda f: f["admin"], None),
    (lambda f: ~reaches(f["caller"], "owner"), NEEDS_OWNER),
    (lambda f: f["own"], None),
    (lambda f: f["wanted"] == "owner", MAKES_OWNER),
    (lambda f: f["held"] == "owner", TOUCHES_OWNER),
]
#: Deactivations of an account: `own`, `admin` (the account is one) and `admins` (active ones).
DEACTIVATION: Table = [(lambda f: f["own"], OWN_ACCOUNT), (lambda f: f["admin"] & (f["admins"] <= 1), LAST_ADMIN)]


def strength(level: Column | str) -> Column:
    """1 to 3 for a grant, 0 for anything else."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), F.lit(level) if isinstance(level, str) else level), F.lit(0))


def reaches(level: Column, required: Column | str) -> Column:
    """Whether a grant is as strong as the required one; what is no grant reaches nothing, and nothing reaches it."""
    return (strength(required) > 0) & (strength(level) >= strength(required))


def standing(grant: Column, admin: Column) -> Column:
    """The grant in force: an administrator's is the strongest, an unknown one is none."""
    return F.when(admin, F.lit(LEVELS[-1])).when(strength(grant) > 0, grant)


def refusal(table: Table, **facts: Column) -> Column:
    """The text of the first line of a decision table that applies, or null; a test that is null doesn't apply."""
    out = F.lit(None).cast("string")
    for test, text in reversed(table):
        out = F.when(F.coalesce(test(facts), F.lit(False)), F.lit(text).cast("string")).otherwise(out)
    return out


def scoped(rows: DataFrame, grants: DataFrame, user: object, required: str = "viewer", *, department: str = "department_id", user_col: str = "user_id", level: str = "role") -> DataFrame:
    """Rows of the departments that a user's grants open at the required level: the API puts the predicate in, not the caller."""
    open_to = grants.where((F.col(user_col) == F.lit(user)) & reaches(F.col(level), required)).select(department).distinct()
    return rows.join(open_to, department, "left_semi")


def owned(rows: DataFrame, wanted: DataFrame, user: object, *, key: str, owner: str = "user_id") -> DataFrame:
    """Of the rows asked for (keys in `wanted`) those of a user; another's row is as absent as one that isn't there: `found` is false for both."""
    own = rows.where(F.col(owner) == F.lit(user))
    return wanted.join(own.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def tool_kind(name: Column) -> Column:
    """read, write or unknown by the words of a tool's name; a writing word wins."""
    words = name_tokens(name)
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, WRITE))), "write").when(F.arrays_overlap(words, F.array(*map(F.lit, READ))), "read").otherwise("unknown")
