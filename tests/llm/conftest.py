import importlib

import pytest
from pyspark import cloudpickle


@pytest.fixture
def sized(monkeypatch):
    """Sets constants of the operators' modules, in the driver and in Python workers, which get the modules by value."""
    modules = [importlib.import_module(f"extentlake.llm.{m}") for m in ("_words", "_buckets", "substring_dedup", "jaccard_join", "decontaminate")]
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
    yield monkeypatch.setattr
    for m in modules:
        cloudpickle.unregister_pickle_by_value(m)
