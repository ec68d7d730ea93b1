import pytest
from pyspark.sql import Row

#: Columns that clash with names the operators use inside or add.
CLASHING = {"kept": "x", "h": 1, "component_id": -1, "n_words": "y", "_text": "z", "bands": 0, "tokens": 3, "n_lines": 7, "copies": 5}


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, ties, repeats and clashing columns."""
    passage = " ".join(f"word{k}" for k in range(60))
    texts = [None, "", "   \n\t ", "one two three", "one two three", "One TWO three", passage, passage + " tail", "a b c d e f g", "a b c d e f g", "x " * 5000, "ünï cödé — ☃ " * 9, "line one is here and it is long enough\nline two is here and it is long enough too\n" * 3, "Released under the MIT License.\nbody", "\n\n\n", "z" * 30000]
    rows = [Row(doc_id=k, text=t, lang="en" if k % 2 else None, source=None if k % 5 == 0 else f"s{k % 3}", n_chars=len(t or ""), **CLASHING) for k, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, h long, component_id long, n_words string, _text string, bands long, tokens long, n_lines long, copies long")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture
def scratch(spark):
    from topicloom.llm.common import Scratch

    return Scratch(spark, "test")
