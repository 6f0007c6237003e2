"""A session hands out tables with the policies of its workspace, tenant, role and actor applied."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.curation import visible


@dataclass
class Session:
    """The only way to a table: every read passes its filters. Without a workspace nothing is readable.

    ``tenants`` (workspace, tenant) restricts further where a tenant is set; it has one row a workspace.
    """

    tables: dict[str, DataFrame] = field(repr=False)
    workspace: str = ""
    actor: str = ""
    role: str = "agent"
    tenant: str = ""
    tenants: DataFrame | None = field(default=None, repr=False)
    #: (workspace, status), if workspaces may be unknown or disabled
    workspaces: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if self.workspaces is not None and self.workspace:
            found = self.workspaces.filter(F.col("workspace") == self.workspace).select("status").limit(1).collect()
            if not found:
                raise LookupError(f"workspace {self.workspace} not found")
            if found[0].status == "disabled":
                raise PermissionError(f"workspace {self.workspace} is disabled")

    def table(self, name: str) -> DataFrame:
        if not self.workspace:
            raise PermissionError("a session needs a workspace")
        df = self.tables[name]
        if "workspace" in df.columns:
            df = df.filter(F.col("workspace") == self.workspace)
            if self.tenant:
                if self.tenants is None:
                    raise PermissionError("a tenant needs the table of tenants")
                own = self.tenants.filter(F.col("tenant") == self.tenant).select("workspace")
                df = df.join(own, "workspace", "left_semi")
        if {"sharing", "agent"} <= set(df.columns):
            df = visible(df, self.actor, service=self.role == "service", llm=self.role == "llm")
        return df
