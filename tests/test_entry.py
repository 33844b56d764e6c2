import pathlib
import re

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_corpus_operators():
    for p in (ROOT / "lodestitch").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*llm|from.*llm", p.read_text()), p
