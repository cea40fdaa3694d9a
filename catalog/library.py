"""Import every module that registers queries."""

import importlib

for _area in ("exchange", "labels", "metrics", "tables", "portfolio", "options", "selection", "streaming", "intraday", "models"):
    importlib.import_module(f"catalog.{_area}")
