"""Registered queries, one module per family. Importing this package fills the registry."""

from importlib import import_module

for _name in ("directory", "decisions", "fraud", "dashboards", "evaluation", "identity", "streams"):
    import_module(f"veriframe.plans.{_name}")
