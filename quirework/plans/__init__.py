"""Registered queries and the tables they read."""

import importlib

MODULES = ("page_queries", "text_queries", "web_queries", "log_queries", "geometry_queries", "stream_queries")


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"quirework.plans.{m}")
