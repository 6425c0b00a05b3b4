"""Roles, key checks and the audit log."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.errors import DeniedError, KeyFormError

#: What each role may do.
ROLES = {
    "admin": ("read", "write", "delete", "create_namespace", "manage_keys", "backup"),
    "read-write": ("read", "write", "delete"),
    "read-only": ("read",),
}
AUDIT_SCHEMA = "timestamp double, actor string, operation string, doc_id string, namespace string, metadata string"


class Access:
    """The role of a key: no key is the local admin, an unknown one reads only."""

    def __init__(self, key: str | None = None, roles: dict[str, str] | None = None):
        self.key, self.roles = key, dict(roles or {})
        self.role = "admin" if key is None else self.roles.get(key, "read-only")
        if self.role not in ROLES:
            self.role = "read-only"

    def allows(self, permission: str) -> bool:
        return permission in ROLES[self.role]

    def require(self, permission: str) -> None:
        if not self.allows(permission):
            raise DeniedError(permission, self.role)

    def register(self, key: str, role: str) -> None:
        self.require("manage_keys")
        if role not in ROLES:
            raise ValueError(f"no role {role}")
        self.roles[key] = role

    @property
    def actor(self) -> str:
        if not self.key:
            return "local-admin"
        return self.key[:8] + "..." if len(self.key) > 8 else "***"


def checked_key(key: str | None) -> str | None:
    """An encryption key of eight characters or more, or none."""
    if key is not None and len(key) < 8:
        raise KeyFormError("an encryption key needs eight characters")
    return key


def role_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, ps in ROLES.items() for p in ps], "role string, permission string")


def key_roles(keys: DataFrame) -> DataFrame:
    """``(key_id, role)``: role names in any case, anything else reads only."""
    role = F.lower("role_name")
    return keys.select("key_id", F.when(role.isin(*ROLES), role).otherwise("read-only").alias("role"))


class AuditLog:
    """JSON lines in a folder, one file an event, written without a job; ``private`` leaves out the metadata."""

    def __init__(self, spark: SparkSession, path: str | None, private: bool = False):
        self.spark, self.path, self.private = spark, path, private

    @property
    def enabled(self) -> bool:
        return self.path is not None

    def log(self, actor: str, operation: str, doc_id: str | None = None, namespace: str | None = None, metadata: str | None = None) -> None:
        if self.enabled:
            row = {"timestamp": time.time(), "actor": actor, "operation": operation, "doc_id": doc_id, "namespace": namespace, "metadata": None if self.private else metadata}
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{time.time_ns()}-{uuid.uuid4().hex[:8]}.json")
            out = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(p, False)
            out.write(bytearray(json.dumps(row).encode() + b"\n"))
            out.close()

    def read(self, **filters) -> DataFrame:
        return audit_events(self.spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(self.path), **filters)


def audit_events(events: DataFrame, since: float | None = None, until: float | None = None, actor: str | None = None, operation: str | None = None) -> DataFrame:
    """Events within both bounds, of an actor and of an operation; an event without time is at 0."""
    t = F.coalesce("timestamp", F.lit(0.0))
    out = events.where(t >= since) if since is not None else events
    out = out.where(t <= until) if until is not None else out
    out = out.where(F.col("actor") == actor) if actor is not None else out
    return out.where(F.col("operation") == operation) if operation is not None else out
