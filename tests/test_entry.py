"""The entry point with and without the training-data operators."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))"


def said(code: str) -> list[str]:
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, check=True)
    return out.stdout.split()


@pytest.mark.parametrize("gone", ["millrace.llm", "tiktoken", "corpus_pipeline"])
def test_what_cannot_be_imported_is_left_out(gone):
    whole = said(SAY)
    less = said(f"import sys; sys.modules[{gone!r}] = None; {SAY}")
    assert less[1] == "False" and less[3] == whole[3] == "True" and int(less[0]) > 100
    assert (less[2] == whole[2]) if gone == "corpus_pipeline" else less[2] == "False"


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from millrace import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):  # noqa: N802
            return Conf()

    fake = type("S", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, *_: ""})()})()
    with pytest.raises(ValueError, match="checkpoint"):
        session.scratch(fake, "x")
    assert session.scratch(spark, "x") != session.scratch(spark, "x")
