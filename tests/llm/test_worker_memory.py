"""Python workers give memory back between tasks, and packing starts none beside them."""

import subprocess
import sys

import pytest
from test_operators import BPE, check_packing

from corpusloom.llm import packing

HELD = """
import re, sys
from pathlib import Path
import numpy as np
from corpusloom.llm.common import slices

def held():
    return int(re.search(r"Anonymous:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

before = held()
blocks = [np.ones(64 << 10, dtype=np.uint8) for _ in range(1600)]
blocks = blocks[-1:]  # the last one keeps the heap from shrinking by itself
list(slices(iter(())))
print(held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_freed_memory_leaves_the_worker():
    said = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, timeout=60)
    assert float(said.stdout) < 20  # of 100 MB


def test_packing_needs_no_python_rows(spark, monkeypatch):
    plans = {}

    def watched(df, name, *since):
        plans.setdefault(name, df._jdf.queryExecution().toRdd().toDebugString())
        return own(df, name, *since)

    own = packing.written
    monkeypatch.setattr(packing, "written", watched)
    texts = {1: "one two three", 2: "four", 3: ""}
    df = spark.createDataFrame([(1, texts[1], "a"), (2, texts[2], None), (3, texts[3], "b")], "doc_id long, text string, source string")
    check_packing(packing.pack(own(df, "texts"), BPE, targets={"a": 2.0, None: 1.0}, with_ids=False).collect(), texts)
    assert "queues" in plans and not [name for name, plan in plans.items() if "PythonRDD" in plan]
