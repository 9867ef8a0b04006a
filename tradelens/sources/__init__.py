"""Role bindings, readers and writers."""

from tradelens.sources.roles import SCHEMAS, Roles, bind_test_tables, read_roles

__all__ = ["SCHEMAS", "Roles", "bind_test_tables", "read_roles"]
