"""What training takes in the driver's process does not stay there for the later stages of the pipeline."""

import re
from pathlib import Path

from marketlens.llm import shared, toxicity
from marketlens.llm.shared import table


def own_mb():
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_free_memory_between_kept_blocks_is_given_back():
    blocks = [bytes([1]) * 20_000 for _ in range(10_000)]
    full, blocks = own_mb(), blocks[::100]
    shared.give_back()
    assert own_mb() < full - 100 and len(blocks) == 100


def test_training_gives_its_memory_back(spark, sf, monkeypatch):
    done = []
    monkeypatch.setattr(toxicity, "train", lambda *a, **b: done.append("trained"))
    monkeypatch.setattr(toxicity, "give_back", lambda: done.append("given back"))
    toxicity.trained(spark, sf, table(spark, sf, "documents"))
    assert done == ["trained", "given back"]
