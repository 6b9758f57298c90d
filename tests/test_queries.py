import pytest

from siltstone.plans import definitions, engine, judging, ledger, relational, retrieval, scalars  # noqa: F401
from siltstone.plans.registry import ORACLES, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, duck, same):
    same(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_entry_imports_without_the_llm_folders(monkeypatch):
    import builtins

    import __spark_entry__

    real = builtins.__import__

    def refuse(name, *a, **k):
        if name == "corpus_pipeline" or name.startswith("siltstone.llm"):
            raise ImportError(name, name=name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", refuse)
    assert not [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
