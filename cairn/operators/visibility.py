"""Row visibility: what an actor may see of each table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The roles that each right needs.
EDITORS = ("editor", "moderator", "admin")
MODERATORS = ("moderator", "admin")


@dataclass(frozen=True)
class Actor:
    """Who asks; no id is an anonymous visitor."""

    id: int | None = None
    role: str = "user"

    @property
    def edits(self) -> bool:
        return self.role in EDITORS

    @property
    def moderates(self) -> bool:
        return self.role in MODERATORS


def by_status(df: DataFrame, actor: Actor) -> DataFrame:
    """Approved rows; all for editors."""
    return df if actor.edits else df.filter("status = 'approved'")


def by_owner(df: DataFrame, actor: Actor, owner: str = "owner_id", public: str | None = None) -> DataFrame:
    """One's own rows, and public ones if the table has them."""
    own = F.lit(False) if actor.id is None else F.col(owner) == actor.id
    return df.filter(own | F.col(public)) if public else df.filter(own)


def moderated(df: DataFrame, actor: Actor, owner: str = "owner_id") -> DataFrame:
    """Approved rows and one's own; all for moderators."""
    if actor.moderates:
        return df
    own = F.lit(False) if actor.id is None else F.col(owner) == actor.id
    return df.filter((F.col("status") == "approved") | own)


def with_visible_parent(df: DataFrame, key: str, parents: DataFrame, actor: Actor) -> DataFrame:
    """Rows whose parent the actor may see."""
    return df.join(by_status(parents, actor).select(F.col("id").alias(key)), key, "left_semi")


def staging(df: DataFrame, actor: Actor) -> DataFrame:
    """Staging rows, for editors alone."""
    return df if actor.edits else df.filter(F.lit(False))
