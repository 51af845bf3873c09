"""All registered queries and their SQL equivalents."""
import importlib

QUERIES: dict = {}
ORACLES: dict = {}

MODULES = ("signals", "stored", "prepared", "tokenized", "prompted", "featured", "scored", "aligned")

for _name in MODULES:
    _module = importlib.import_module(f"sigspark.plans.{_name}")
    for _key, (_query, _sql) in _module.PLANS.items():
        if _key in QUERIES:
            raise ValueError(f"two queries named {_key}")
        QUERIES[_key] = _query
        if _sql is not None:
            ORACLES[_key] = _sql
